"""Dense codes in sort order without a global window: range-partition, number inside partitions, add offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsight.session import Scratch


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with its zero-based position under ``order`` (which must be total).

    One shuffle: rows are numbered where they are sorted, and one offset per partition is added.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = Scratch(spark, "numbered").save(sorted_, "placed")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    total, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = spark.createDataFrame(offsets, "_part long, _off long")
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(name, inside + F.col("_off")).drop("_part", "_off", "_m")


#: Rows of one key that one task puts in order.
DEALT = 200_000
_TOP = 1 << 32


def placed_within(df: DataFrame, key: str, order: Column, tie: str, name: str = "place", size: str = "size") -> DataFrame:
    """``df`` with its one-based position within ``key`` under (``order``, ``tie``), and the rows of the key.

    ``order`` is a whole number from 0 to 2**32 - 1. A key of any size is cut into ranges of the order, as many as
    its rows need; the positions do not depend on the cut.
    """
    deck = df.withColumn("_o", order)
    sizes = deck.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(size)).withColumn("_cuts", 1 + F.floor(F.col(size) / DEALT))
    cut = deck.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_b", F.floor(F.col("_o") * F.col("_cuts") / _TOP))
    counts = cut.groupBy(F.col("_k").alias("_k2"), F.col("_b").alias("_b2")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k2").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_k2", "_b2", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_o", tie))
    return (
        cut.join(offsets, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2")))
        .withColumn(name, inside + F.col("_before"))
        .drop("_o", "_k", "_cuts", "_b", "_k2", "_b2", "_before")
    )


def factorised(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """``key`` of every distinct non-null value and its code in sort order."""
    return numbered(df.where(F.col(key).isNotNull()).select(key).distinct(), [F.col(key)], name)


def category_codes(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """``df`` with the code of ``key`` in sort order; null has -1."""
    codes = factorised(df, key, name)
    return df.join(codes, key, "left").withColumn(name, F.coalesce(name, F.lit(-1)))
