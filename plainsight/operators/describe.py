"""Exploratory aggregates: counts, rates, description, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, ties by value; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def unpivoted(row: DataFrame, names: list[str], value: str) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias(value)) for n in names])).alias("x")).select("x.*")


def signal_rates(df: DataFrame, names: list[str]) -> DataFrame:
    """Share of rows in which a signal is present, all signals in one pass."""
    return unpivoted(df.agg(*[F.avg((F.col(n) > 0).cast("double")).alias(n) for n in names]), names, "rate")


def described(df: DataFrame, names: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles (interpolated) of each column.

    From the counts of distinct values, which combine before the shuffle; a quartile is found by their running sum.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])).alias("c")).select("c.*")
    values = cells.where("x is not null").groupBy("name", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("name").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("name")))

    def quartile(q: float):
        at = (F.col("total") - 1) * q
        below, above = (F.min(F.when(F.col("upto") > f(at), F.col("x"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        return below + (above - below) * part

    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("x")) / total
    stats = ranked.groupBy("name").agg(
        total.alias("count"), mean.alias("mean"), F.min("x").alias("min"), quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max("x").alias("max"),
    )
    apart = values.join(F.broadcast(stats.select("name", "mean", "count")), "name").groupBy("name").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)), F.max("count") - 1)).alias("std")
    )
    all_names = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    out = all_names.join(stats, "name", "left").join(apart, "name", "left")
    return out.select("name", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregate; null where a column is constant."""
    pairs = list(combinations(names, 2))
    row = df.agg(*[
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)
    ])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def null_counts(df: DataFrame) -> DataFrame:
    return unpivoted(df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]), df.columns, "n_null")
