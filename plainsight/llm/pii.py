"""Personal information in free text (problem 10): proposals by pattern, checks by validators, scores by context.

Texts are searched in their consistent form, so look-alike letters and invisible characters hide nothing; spans are
mapped back and cut out of the text as it stands. Patterns propose spans, validators and the words around them
score them (``pii_rules``), and proposals that reach the threshold are taken, the surest, earliest and longest
first, without overlaps. One automaton finds the words that lead up to names, titles and given names.

Defined cases: null text has a null redaction and no findings, empty text an empty one; a piece that occurs
twice in a document is found once, but masked everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm import pii_rules as R
from plainsight.llm.forms import default_folder
from plainsight.session import spread

TYPES = ["email", "phone", "id_number", "street_address", "person_name"]
#: Masked too, but no type of the query over documents.
FURTHER = ["card_number", "account_number"]

Span = tuple[int, int, str]


#: What may stand before a cue, all read as a space.
_EDGES = "\n\r\t\"'“‘«([{<>;|*_/"


@lru_cache(1)
def _cues() -> ahocorasick.Automaton:
    """Leads of names with their weight, and given names (weight 0), each after a space; leads of letters before one."""
    a = ahocorasick.Automaton()
    for name in R.GIVEN:
        a.add_word(f" {name}", (len(name), 0, 0.0))
    for weight, words in R.LEADS.items():
        for w in words:
            edge = " " if w[-1].isalpha() else ""
            a.add_word((" " if w[0].isalpha() else "") + w + edge, (len(w), len(edge), weight))
    a.make_automaton()
    return a


def _person_at(text: str, at: int) -> int | None:
    for rx in R.PERSONS:
        if m := rx.match(text, at):
            return m.end() - 2 * m[0].endswith(("'s", "’s"))
    return None


def _names(text: str, low: str) -> Iterator[tuple[float, int, int]]:
    """``low`` is the text in lower case, character by character."""
    best: dict[tuple[int, int], float] = {}
    line = f" {low} "
    for c in _EDGES:
        line = line.replace(c, " ")
    for last, (n, edge, weight) in _cues().iter(line):
        end = last - edge
        start = end - n
        if weight:
            at = R.GAP.match(text, end).end()
            if t := R.TITLE.match(text, at):
                at = t.end()
        elif low[end : end + 1].isalnum():
            continue  # part of a longer word
        else:
            at = start
            # family, given: step back over the comma and the family name
            head = low[max(0, start - 2) : start].strip()
            if head == ",":
                comma = low.rindex(",", 0, start)
                back = comma
                while back and (low[back - 1].isalpha() or low[back - 1] in "-\'’"):
                    back -= 1
                if back < comma and _person_at(text, back) is not None:
                    at = back
        if (e := _person_at(text, at)) is not None and e > (end if not weight else 0):
            best[at, e] = max(weight, best.get((at, e), 0.0))
    for (s, e), lead in best.items():
        yield R.person_score(text, s, e, lead), s, e


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _proposals(text: str) -> Iterator[tuple[float, int, int, str]]:
    low = _lowered(text)
    if R.SIGN.search(low):
        for m in R.EMAIL.finditer(text):
            yield 0.9, m.start(), m.end(), "email"
    if " dot " in low:
        for m in R.EMAIL_WORDS.finditer(text):
            yield 0.8, m.start(), m.end(), "email"
    for m in R.PHONE.finditer(text):
        shape = next(k for k in R.PHONE_SCORE if m[k])
        length, fits = R.planned(m[0]) if shape == "code" else (len(m[0]), True)
        end = m.start() + length
        lead = text[max(0, m.start() - R.BEFORE) : m.start()]
        s = R.PHONE_SCORE[shape] + 0.3 * bool(R.PHONE_FOR.search(lead)) - 0.7 * bool(R.NOT_PERSONAL.search(lead)) - 0.6 * (not fits)
        if shape not in ("code", "area") and R.ID_FOR.search(R.SENTENCE.split(lead)[-1]):
            s -= 0.4
        if 7 <= sum(c.isdigit() for c in text[m.start() : end]) <= 15:
            yield s, m.start(), end, "phone"
    for m in R.NUMBER.finditer(low):
        shape = m.lastgroup if m.lastgroup in ("social", "letter") else "digits"
        score, kind = R.number_score(shape, m[0], low[max(0, m.start() - R.BEFORE) : m.start()])
        yield score, m.start(), m.end(), kind
    for m in R.LETTERED.finditer(low):
        if m["account"] is not None:
            if (at := R.account_at(low, m.start())) is not None:
                yield 0.9, m.start(), at[0], "account_number" if at[1] else "rejected"
            continue
        yield R.lettered_score(m.lastgroup, m[0], low[max(0, m.start() - R.BEFORE) : m.start()]), m.start(), m.end(), "id_number"
    cased = text != low
    for rx, base, cues in R.STREET:
        if not cues or any(c in low for c in cues):
            for m in rx.finditer(low):
                yield R.street_score(base, text, m.start(), m.end(), cased), m.start(), m.end(), "street_address"
    for score, start, end in _names(text, low):
        yield score, start, end, "person_name"


def find_spans(form: str) -> list[Span]:
    """Spans (start, end, type) in a consistent form, in order and without overlaps."""
    taken: list[Span] = []
    # an account number comes first: nothing inside it is another number
    best = sorted((x for x in _proposals(form) if x[0] >= R.THRESHOLD - 1e-9), key=lambda x: (x[3] not in ("account_number", "rejected"), -min(x[0], 0.8), x[1], -x[2]))
    for _, a, b, kind in best:
        if all(b <= s or a >= e for s, e, _ in taken):
            taken.append((a, b, kind))
    return sorted(x for x in taken if x[2] != "rejected")


def reduced(piece: str) -> str:
    return "".join(c for c in piece.lower() if c.isalnum())


def _spans_of(text: str) -> list[Span]:
    folder = default_folder()
    form = folder(text)
    spans = find_spans(form)
    if not spans or form == text:
        return spans
    _, back = folder.aligned(text)  # only where something was found in a text that changed
    return [(back[a], back[b], kind) for a, b, kind in spans]


def found(docs: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """``doc_id``, ``pii_type``, ``pii_text``, without repeats within a document."""
    wanted = frozenset(types)

    def run(batches):
        for b in batches:
            ids, kinds, pieces = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    for kind, piece in sorted({(k, reduced(text[s:e])) for s, e, k in _spans_of(text) if k in wanted}):
                        ids.append(doc)
                        kinds.append(kind)
                        pieces.append(piece)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(pieces, pa.string())], names=["doc_id", "pii_type", "pii_text"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, pii_type string, pii_text string")


def redacted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with a typed placeholder for every piece, cards and accounts included."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if text:
                    parts, at = [], 0
                    for s, e, kind in _spans_of(text):
                        parts += (text[at:s], f"[{kind.upper()}]")
                        at = e
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return spread(docs.select("doc_id", F.col("text"))).mapInArrow(run, "doc_id long, text string")
