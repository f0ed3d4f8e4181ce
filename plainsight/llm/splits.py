"""Splits that keep related rows together (problem 1), and rows whose group an existing plan tears apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsight.llm.groups import digest, homed_rows, links, spanning_forest
from plainsight.session import Scratch

SHARES = {"train": 80, "validation": 10, "test": 10}
#: Groups above this share of all rows (at most its inverse many) are placed one by one, by what a split still lacks.
LARGE = 0.005
#: Groups of one size band that one task deals.
DEALT = 200_000


def _rooted(features: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    net = links(features, scratch)
    forest, comp = spanning_forest(net.edges, scratch)
    return scratch.save(homed_rows(net), "homed"), comp.select(F.col("v").alias("k"), "c"), forest


def torn_rows(features: DataFrame, plan: DataFrame) -> DataFrame:
    """``row_id`` of planned rows whose group has rows in more than one split of the plan."""
    scratch = Scratch(features.sparkSession, "torn")
    homed, comp, _ = _rooted(features, scratch)
    planned = plan.where("split_name is not null").select("row_id", "split_name").distinct()
    rows = scratch.save(homed.where("k is not null").join(planned, "row_id"), "planned")
    vertex = rows.groupBy("k").agg(F.min("split_name").alias("lo"), F.max("split_name").alias("hi"))
    vertex = scratch.save(
        vertex.join(comp, "k", "left").select("k", "lo", "hi", F.coalesce("c", "k").alias("root")), "vertices"
    )
    torn = vertex.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    bad = vertex.select("k", "root").join(torn.select("root"), "root", "left_semi").select("k")
    return rows.join(bad, "k", "left_semi").select("row_id").distinct()


def forest_edges(features: DataFrame) -> DataFrame:
    """The persisted spanning forest over page digests (hex): ``page_a``, ``page_b``."""
    scratch = Scratch(features.sparkSession, "forest")
    forest, _ = spanning_forest(links(features, scratch).edges, scratch)
    return forest.select(F.hex("u").alias("page_a"), F.hex("v").alias("page_b"))


def assigned_splits(features: DataFrame, shares: dict[str, int] = SHARES, seed: int = 42) -> DataFrame:
    """``row_id``, ``split``: every row in one split near the shares (in percent), no group torn apart.

    Roots are stratified by size band (powers of two); within a band they are put in a hash order and dealt
    systematically over the shares, with a hashed offset per task. The few large groups go, largest first, to
    the split that lacks most. A row that is linked to nothing is its own group.
    """
    scratch = Scratch(features.sparkSession, "assign")
    homed, comp, _ = _rooted(features, scratch)
    alone = digest("r", F.col("row_id"))
    rows = scratch.save(
        homed.withColumn("k", F.coalesce("k", alone))
        .join(comp, "k", "left")
        .select("row_id", F.coalesce("c", "k").alias("root")),
        "rooted",
    )
    groups = scratch.save(rows.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    total = groups.agg(F.sum("n")).first()[0] or 0
    names = list(shares)
    large = groups.where(F.col("n") > total * LARGE).collect()  # at most 1 / LARGE groups
    lacking = {s: total * shares[s] / 100 for s in names}
    placed = []
    for g in sorted(large, key=lambda r: (-r["n"], bytes(r["root"]))):
        s = max(names, key=lambda x: lacking[x])
        lacking[s] -= g["n"]
        placed.append((bytes(g["root"]), s))
    spark = features.sparkSession
    placed_df = spark.createDataFrame(placed, "root binary, split string")
    left = {s: max(v, 0.0) for s, v in lacking.items()}
    room = sum(left.values()) or 1.0

    small = groups.where(F.col("n") <= total * LARGE).withColumn("band", F.floor(F.log2("n")).cast("int"))
    counts = {r["band"]: r["count"] for r in small.groupBy("band").count().collect()}  # at most 63 bands
    tasks = F.create_map(*[F.lit(x) for b, c in counts.items() for x in (b, 1 + c // DEALT)]) if counts else F.create_map(F.lit(0), F.lit(1))
    order = F.xxhash64("root", F.lit(seed))
    deck = small.withColumn("order", order).withColumn("task", F.pmod("order", F.element_at(tasks, F.col("band")).cast("long")))
    w = Window.partitionBy("band", "task").orderBy("order", "root")
    golden = 0.6180339887498949
    offset = F.pmod(F.xxhash64("band", "task", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    at = F.pmod(F.row_number().over(w) * F.lit(golden) + offset, F.lit(1.0))
    split, edge = F.lit(names[-1]), 1.0
    for s in reversed(names[:-1]):
        edge = sum(left[x] for x in names[: names.index(s) + 1]) / room
        split = F.when(at < edge, s).otherwise(split)
    dealt = deck.select("root", split.alias("split")).unionByName(placed_df)
    return rows.join(dealt, "root").select("row_id", "split")
