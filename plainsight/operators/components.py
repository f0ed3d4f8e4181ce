"""Connected components of a graph with long ids, by alternating large-star and small-star steps.

Every step replaces edges by edges to a smaller neighbour, so memory per task stays bounded: no neighbourhood
is ever gathered, only its minimum, which combines before the shuffle. Chains shorten geometrically.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.session import Scratch


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return arcs.join(_least(arcs), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``root`` (the least id of its component) for every vertex that is not itself the root."""
    scratch = Scratch(edges.sparkSession, "components")
    marks = {"n": F.count("*"), "s": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    current, mark = scratch.save_counting(edges.where("u <> v").select("u", "v").distinct(), "edges0", **marks)
    step = 0
    while mark["n"]:  # without edges nothing is left to do
        before, step = mark, step + 1
        current, mark = scratch.save_counting(_small_star(_large_star(current)), f"edges{step}", **marks)
        scratch.drop(f"edges{step - 1}")
        if mark == before:
            break
    return current.select("u", F.col("v").alias("root"))


def linked_rows(df: DataFrame, row: str, keys: list[Column]) -> DataFrame:
    """``row`` and ``group`` (least row of its group): rows linked, also over others, by any equal non-blank key."""
    edges = []
    keyed = df.select(F.col(row).alias("r"), *[k.alias(f"k{n}") for n, k in enumerate(keys)])
    rows = Scratch(df.sparkSession, "linked").save(keyed, "keys")  # keys cost more than reading them again
    for n in range(len(keys)):
        known = rows.select("r", F.col(f"k{n}").alias("k")).where("k is not null and k rlike '\\\\S'")
        least = known.groupBy("k").agg(F.min("r").alias("v"), F.count("*").alias("c")).where("c > 1")
        edges.append(known.join(least, "k").where("r <> v").select(F.col("r").alias("u"), "v"))
    roots = components(reduce(DataFrame.unionByName, edges))
    return rows.select("r").join(roots.select(F.col("u").alias("r"), "root"), "r", "left").select(
        F.col("r").alias(row), F.coalesce("root", "r").alias("group")
    )
