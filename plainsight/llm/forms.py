"""Consistent form of text: look-alike classes, representatives, and the rewriting automaton.

Look-alike relations hold between strings (a letter and its accent against the composed letter) and
single code points (a full-width letter against the plain one). They are closed transitively with
union-find, every class gets one representative, and texts are rewritten greedily, longest match
first, by one multi-pattern automaton.

Defined cases: null stays null, the empty text stays empty; plain ASCII text is its own form (only
control characters other than tab and line breaks go); line breaks stay line breaks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ɑ": "a", "ɡ": "g",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

# Characters that show nothing although their category is not "format".
_BLANK_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
# Format characters that do show.
_VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
_BREAKS = {0x85, 0x2028, 0x2029}
_KEPT_CONTROLS = {*range(0x09, 0x0E), *range(0x1C, 0x20)}
_STYLES = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_TOP = 0x30000


def _invisible(cp: int, cat: str) -> bool:
    if cat == "Cc":
        return cp not in _KEPT_CONTROLS and cp not in _BREAKS
    return (cat == "Cf" and cp not in _VISIBLE_FORMAT) or cp in _BLANK_EXTRA


class _Union:
    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        found: dict[str, list[str]] = {}
        for x in list(self.parent):
            found.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in found.values() if len(c) > 1]


def _representative(members: list[str], freq: dict[str, int]) -> str:
    """Nothing for what shows nothing; else plain text, Latin letters, the most frequent member of the corpus
    (a string occurs at most as often as its rarest code point), ordinary before styled ones, composed before apart.
    """

    def rank(s: str):
        latin = unicodedata.name(s[:1] or " ", "").startswith("LATIN")
        often = min((freq.get(c, 0) for c in s), default=0) if not s.isascii() and not latin else 0
        styled = unicodedata.normalize("NFKC", s) != unicodedata.normalize("NFC", s)
        return (s != "", not s.isascii(), not latin, -often, styled, len(s) != 1, s)

    return min(members, key=rank)


def look_alike_classes(freq: dict[str, int] | None = None) -> dict[str, str]:
    """Every string or code point that is not its class's representative, with that representative.

    ``freq`` counts code points of the corpus; it decides among members of a class none of which is plain.
    """
    freq = freq or {}
    single = _Union()
    canonical: list[str] = []
    for cp in range(0x7F, _TOP):
        if 0xAC00 <= cp < 0xE000:  # Hangul syllables compose by rule, surrogates are no text
            continue
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Cn":
            continue
        if _invisible(cp, cat):
            single.join(c, "")
        elif cp in _BREAKS:
            single.join(c, "\n")
        elif cat == "Zs":
            single.join(c, " ")
        elif d := unicodedata.decomposition(c):
            if not d.startswith("<"):
                canonical.append(c)
            elif d.startswith(_STYLES) or cat[0] == "L" or cat == "Nd":
                single.join(c, unicodedata.normalize("NFKC", c))
    for cp in [x for x in range(0x20) if x not in _KEPT_CONTROLS] + [*range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]:
        single.join(chr(cp), "")
    for a, b in LOOK_ALIKE.items():
        single.join(a, b)
    chosen = {x: r for m in single.classes() for r in [_representative(m, freq)] for x in m}

    joint = _Union()
    for x, r in chosen.items():
        joint.join(x, r)
    for c in canonical:
        full = unicodedata.normalize("NFD", c)
        plain = "".join(chosen.get(x, x) for x in full)
        joint.join(c, full)
        joint.join(c, plain)
        if len(whole := unicodedata.normalize("NFC", plain)) == 1:
            joint.join(c, whole)
    return {x: r for m in joint.classes() for r in [_representative(m, freq)] for x in m if x != r}


class Folder:
    """Rewrites texts by a table of look-alikes.

    The automaton holds the patterns whose code points have occurred in the texts so far and is rebuilt when
    further ones occur: a root with thousands of branches would slow every step.
    """

    def __init__(self, rewrite: dict[str, str]):
        self.rewrite = rewrite
        self.involved = {c for s in rewrite for c in s if not c.isascii()}
        self.seen: set[str] = set()
        self.automaton = None
        self.control = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
        self.beyond = re.compile(r"[^\x00-\x7f]+")

    def _learn(self, new: set[str]) -> None:
        self.seen |= new
        self.automaton = ahocorasick.Automaton()
        for s, r in self.rewrite.items():
            if all(c in self.seen or c.isascii() for c in s):
                self.automaton.add_word(s, (len(s), r))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        if text.isascii():
            return self.control.sub("", text)
        if not (present := self.involved.intersection(text)):
            out = self.control.sub("", text)
            return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)
        if not present <= self.seen:
            self._learn(present)
        parts, at = [], 0
        for end, (n, r) in self.automaton.iter_long(text):
            parts += (text[at : end + 1 - n], r)
            at = end + 1
        out = "".join(parts) + text[at:] if parts else text
        # marks that stood apart from their letter (behind an invisible character, or a second one) compose last
        return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)

    def _attached(self, c: str) -> bool:
        """A mark, or nothing visible: belongs to the character before."""
        return bool(unicodedata.combining(c)) or not self(c)

    def aligned(self, text: str) -> tuple[str, list[int]]:
        """The form, and for each of its characters (and its end) the offset in ``text`` from which it comes.

        Folds cluster by cluster: a letter with its marks and the invisible characters before them. The joined
        clusters equal the form of the whole text.
        """
        if text.isascii() and not self.control.search(text):
            return text, list(range(len(text) + 1))
        out, back, at = [], [], 0
        n = len(text)

        def plain(start: int, end: int) -> None:
            """ASCII without marks: one character each, controls aside."""
            for c in self.control.finditer(text, start, end):
                out.append(text[start : c.start()])
                back.extend(range(start, c.start()))
                start = c.end()
            out.append(text[start:end])
            back.extend(range(start, end))

        for run in self.beyond.finditer(text):
            start, end = run.span()
            if start > at and self._attached(text[start]):
                start -= 1
            plain(at, start)
            while start < end:
                stop = start + 1
                while stop < end and self._attached(text[stop]):
                    stop += 1
                piece = self(text[start:stop])
                out.append(piece)
                back += [start] * len(piece)
                start = stop
            at = end
        plain(at, n)
        back.append(n)
        return "".join(out), back


@lru_cache(1)
def default_folder() -> Folder:
    """By the built-in relations alone. Whether two texts have one form never depends on frequencies."""
    return Folder(look_alike_classes())


_WORD = re.compile(r"[^\W_]+")
_DIVIDE = re.compile(r"[|;\n\r\x0b\x0c]")


def fold(text: str) -> str:
    return default_folder()(text)


def words(form: str) -> list[str]:
    """Runs of letters and digits of a consistent form, in lower case."""
    return _WORD.findall(form.lower())


def _fields(low: str) -> list[str] | None:
    pieces = [p for p in _DIVIDE.split(low) if p.strip()]
    if len(pieces) < 2:
        return None
    out = []
    for p in pieces:
        name, colon, value = p.partition(":")
        name, value = _WORD.findall(name), _WORD.findall(value)
        if not (colon and name and value):
            return None
        out.append(" ".join(name + value))
    return out


def copy_keys(form: str) -> tuple[str, str | None]:
    """The words in order; and, for labelled fields, their set in byte order.

    Copies agree in either, directly or over further texts: a line break that only formatting put in may make
    fields of a text whose other copies have none.
    """
    low = form.lower()
    fields = _fields(low) if ":" in low else None
    return " ".join(_WORD.findall(low)), fields and "\x1f".join(sorted(set(fields)))
