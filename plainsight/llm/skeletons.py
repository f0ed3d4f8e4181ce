"""Template of a text: its skeleton, taken of the consistent form (one pass per text, for Arrow batches)."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

from plainsight.constants import CURRENCY, NUMBER, PERCENT, SLOT_TERMS

_CUR, _PCT, _NUM, _GAP = (re.compile(p) for p in (CURRENCY, PERCENT, NUMBER, r"\s+"))


@lru_cache(1)
def _slots() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in SLOT_TERMS:
        a.add_word(term.lower(), len(term))
    a.make_automaton()
    return a


def template(form: str) -> str:
    """Skeleton of a consistent form: currency, percentages, slot terms and numbers masked, spaces collapsed."""
    s = _PCT.sub("<pct>", _CUR.sub("<cur>", form.lower()))
    parts, at = [], 0
    for end, n in _slots().iter_long(s):
        parts += (s[at : end + 1 - n], "<slot>")
        at = end + 1
    if parts:
        s = "".join(parts) + s[at:]
    return _GAP.sub(" ", _NUM.sub("<num>", s)).strip()
