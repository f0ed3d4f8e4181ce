"""Seeded samples, class weights and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_rows(df: DataFrame, row: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by hash order: the same ones in every run and layout."""
    return df.orderBy(F.md5(F.concat(F.col(row).cast("string"), F.lit(f"-{seed}"))), row).limit(n)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * count): weights under which every class counts alike."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return by.crossJoin(total).select(label, "n", (F.col("total") / (F.col("k") * F.greatest("n", F.lit(1)))).alias("weight"))  # one row on the right


def dense_histogram(df: DataFrame, code: str, size: int) -> DataFrame:
    """Rows of every code from 0 to size - 1, zeros included."""
    codes = df.sparkSession.range(size).select(F.col("id").cast("int").alias(code))
    return codes.join(df.groupBy(code).agg(F.count("*").alias("n")), code, "left").na.fill(0, ["n"])
