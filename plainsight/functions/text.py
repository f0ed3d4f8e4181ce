"""Text expressions, all inside the JVM. ``unicode=True`` makes \\s, \\d and \\w follow Unicode.

Patterns carry (?d), so that a dot stops at a line feed only. Null text gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainsight.constants import CURRENCY, NUMBER, PERCENT, SLOT_TERMS


def flags(unicode: bool = False) -> str:
    return "(?dU)" if unicode else "(?d)"


def _sub(t: Column, pattern: str, to: str, unicode: bool = False) -> Column:
    return F.regexp_replace(t, flags(unicode) + pattern, to)


def strip(t: Column, unicode: bool = False) -> Column:
    return _sub(t, r"^\s+|\s+$", "", unicode)


def normalise(t: Column) -> Column:
    """Key under which two texts are the same: lower-case ASCII letters and digits, single spaces."""
    return F.trim(_sub(_sub(F.lower(t), "[^a-z0-9 ]+", " "), " +", " "))


def trie_pattern(terms: list[str]) -> str:
    """One expression for many literal terms, shared prefixes factored out, longer terms before their prefixes."""
    import re

    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(c) + render(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{body}?" if "" in node else body

    return render(root)


SLOT_TRIE = trie_pattern(sorted({t.lower() for t in SLOT_TERMS}))


def skeleton(t: Column, unicode: bool = False) -> Column:
    """Template of a text: currency, percentages, slot terms and numbers masked. Order and case matter."""
    s = F.lower(t)
    for pattern, mask in ((CURRENCY, "<cur>"), (PERCENT, "<pct>"), (SLOT_TRIE, "<slot>"), (NUMBER, "<num>"), (r"\s+", " ")):
        s = _sub(s, pattern, mask, unicode)
    return F.lower(strip(s, unicode))


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))


def model_tokens(t: Column) -> Column:
    """Tokens of the sequence models: runs of letters, digits and currency or percent signs; ! and ? alone."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9₹$%]+|[!?])"), F.lit(1))


def word_tokens(t: Column) -> Column:
    """Lower-case tokens of two characters or more."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9_][a-z0-9_]+)"), F.lit(1))


def word_ngrams(t: Column, low: int = 1, high: int = 3) -> Column:
    """Word n-grams over tokens of two characters or more."""
    tokens = word_tokens(t)

    def grams(n: int) -> Column:
        last = F.size(tokens) - (n - 1)
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        )

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def words(t: Column) -> Column:
    """Lower-case words, parted by white space."""
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def char_wb_ngrams(t: Column, low: int = 2, high: int = 6) -> Column:
    """Character n-grams inside words, each word padded by one space on both sides."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(padded)))
        return F.flatten(
            F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, n)))
        )

    return F.flatten(F.transform(words(t), of_word))


# Contractions that the tokenizer parts.
CONTRACTIONS = {"cannot": "can not", "gonna": "gon na", "wanna": "wan na", "gotta": "got ta", "gimme": "gim me", "lemme": "lem me"}
# Words whose noun lemma the suffix rules would miss or spoil.
LEMMAS = {
    "men": "man", "women": "woman", "children": "child", "people": "people", "feet": "foot", "teeth": "tooth", "mice": "mouse",
    "this": "this", "its": "it", "us": "u", "was": "wa", "has": "ha", "as": "a", "is": "is", "yes": "yes", "always": "always",
    "news": "news", "plus": "plus", "less": "le", "unless": "unless", "does": "doe", "bus": "bus", "gas": "gas",
}


#: Endings that are replaced; the last that fits decides.
LEMMA_RULES = [("([^su])s$", "$1"), ("(ch|sh|x|z|ss)es$", "$1"), ("([a-z]{2})ies$", "$1y"), ("ves$", "ve")]


def clean_text(t: Column) -> Column:
    """Lower case, letters with ! and ? only, tokens, noun lemmas by rule (approximate: no dictionary is at hand)."""
    s = _sub(F.lower(t), r"[^a-z\s!?]", "")
    for word, parts in CONTRACTIONS.items():
        s = _sub(s, rf"\b{word}\b", parts)
    tokens = F.regexp_extract_all(s, F.lit("([a-z]+|[!?])"), F.lit(1))
    special = F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv])

    def lemma(w: Column) -> Column:
        ruled = reduce(
            lambda other, rule: F.when(w.rlike(rule[0]), F.regexp_replace(w, rule[0], rule[1])).otherwise(other),
            LEMMA_RULES,
            w,
        )
        return F.coalesce(F.try_element_at(special, w), ruled)

    return F.array_join(F.transform(tokens, lemma), " ")
