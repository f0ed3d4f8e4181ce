"""Near-duplicates (problem 5): pigeonring filtering of word-set pairs, then the full check.

In terms of Hamming distance H (words in one set only), similarity 3/4 of sets of a and b words is
H <= (a + b) / 7. Differences are counted over consecutive segments, each with its share of the budget:

1. The rarest words of a set are divided into boxes by frequency (``prefixes``). A box has its own budget of words
   to miss; by the pigeonhole principle some box of every similar pair keeps within it. Boxes are indexed by
   what must then be equal, so only pairs with such a first box are ever formed.
2. Each set carries a parity sketch of eight segments on a ring. Differing bits of a segment never outnumber
   differing words, so some segment starts a chain whose first l segments together stay within l/8 of the budget
   for every l up to 8. Chains are followed while a pair is joined, before anything is shuffled. A chain over the
   whole ring exists exactly where the ring as a whole keeps the budget, so after ``CHAIN`` segments the rest of
   the chain is tested at once, by the ring's sum.
3. The words themselves are compared.

Defined cases: null and blank texts take no part; copies (problem 4) are represented once and never pair
with each other; sets of one word pair only with the same word repeated otherwise, as in "no" and "no no".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.llm.copies import copy_runs
from plainsight.llm.prefixes import _BITS, DEN, NUM, SEGMENTS, signatures, verified, with_words
from plainsight.operators.components import components
from plainsight.session import Scratch

#: Segments of a chain that are compared one by one before the whole ring is.
CHAIN = 3


def _chain_exists(budget7: Column) -> Column:
    """Some start whose first l segments differ in at most l/8 of the budget (given times seven), l = 1..CHAIN."""
    per_word = 64 // _BITS
    mask = (1 << _BITS) - 1
    boxes = [
        F.bit_count(F.shiftrightunsigned(F.col("x0" if k < per_word else "x1"), _BITS * (k % per_word)).bitwiseAND(F.lit(mask)))
        for k in range(SEGMENTS)
    ]

    def chain(start: int) -> Column:
        tests, total = [], F.lit(0)
        for length in range(1, CHAIN + 1):
            total = total + boxes[(start + length - 1) % SEGMENTS]
            tests.append(total * (7 * SEGMENTS) <= budget7 * length)
        return reduce(lambda p, q: p & q, tests)

    return reduce(lambda p, q: p | q, [chain(k) for k in range(SEGMENTS)])


def similar_classes(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a < b) of representatives whose word sets are similar. ``classes`` has rep and key."""
    sigs = scratch.save(signatures(with_words(classes), sketches=True), "signatures")
    x, y = sigs.alias("x"), sigs.alias("y")
    budget = F.col("x.n") + F.col("y.n")
    candidates = (
        x.join(y, F.col("x.sig") == F.col("y.sig"))
        .where((F.col("x.rep") < F.col("y.rep")) & ~(F.col("x.guest") & F.col("y.guest")))
        .where((F.col("x.n") * DEN >= F.col("y.n") * NUM) & (F.col("y.n") * DEN >= F.col("x.n") * NUM))
        .select(
            F.col("x.rep").alias("a"),
            F.col("y.rep").alias("b"),
            budget.alias("budget7"),
            F.col("x.s0").bitwiseXOR(F.col("y.s0")).alias("x0"),
            F.col("x.s1").bitwiseXOR(F.col("y.s1")).alias("x1"),
        )
        .where(_chain_exists(F.col("budget7")))
        .where((F.bit_count("x0") + F.bit_count("x1")) * 7 <= F.col("budget7"))
        .select("a", "b")
        .distinct()
    )
    candidates = scratch.save(candidates, "candidates")
    scratch.drop("signatures")
    return verified(candidates, classes)


def _classes_and_pairs(features: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with their class (``row_id``, ``rep``), and the pairs of similar classes."""
    runs = scratch.save(copy_runs(features, scratch), "members")
    scratch.drop("runs", "links")
    pairs = scratch.save(similar_classes(runs.where("key is not null").select("rep", "key"), scratch), "pairs")
    scratch.drop("candidates")
    return runs.select("row_id", "rep"), pairs


def near_pairs(features: DataFrame) -> DataFrame:
    """``row_id_a`` < ``row_id_b``: all rows of similar classes."""
    members, pairs = _classes_and_pairs(features, Scratch(features.sparkSession, "near"))
    rows = pairs.join(members.select(F.col("rep").alias("a"), F.col("row_id").alias("ra")), "a").join(
        members.select(F.col("rep").alias("b"), F.col("row_id").alias("rb")), "b"
    )
    return rows.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))


def near_groups(features: DataFrame) -> DataFrame:
    """One row per record: ``row_id``, its class (least copy), the number of its links to other classes, and its
    group of near-copies, linked directly or over others (the least class of it).
    """
    members, pairs = _classes_and_pairs(features, Scratch(features.sparkSession, "neargroups"))
    links = (
        pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    )
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("rep"), "root")
    return members.join(links, "rep", "left").join(roots, "rep", "left").select(
        "row_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("group_id")
    )
