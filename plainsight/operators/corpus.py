"""Building a corpus from labelled sources, and its signal table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.functions.labels import binary_label, map_label
from plainsight.functions.signals import signals
from plainsight.functions.text import clean_text, normalise, strip


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key under ``order``; combines before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(first).select(key, "_row.*")


def relabelled(raw: DataFrame, text: str = "text", category: str = "pattern_category") -> DataFrame:
    """Source categories mapped to the classes, with the binary label recomputed; rows without either are dropped."""
    return (
        raw.dropna(subset=[text, category])
        .withColumn(category, map_label(F.col(category), F.col(text)))
        .withColumn("label", binary_label(F.col(category)))
    )


def build_corpus(sources: list[DataFrame], seq: str = "seq") -> DataFrame:
    """Union in order of the sources, stripped texts of three characters or more, one row per normalised text.

    Of rows with one key the one of the earlier source wins, then the one of lower ``seq``. Null texts,
    categories and labels are dropped. Texts without ASCII letters or digits share the empty key.
    """
    ranked = [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)]
    rows = (
        reduce(DataFrame.unionByName, ranked)
        .dropna(subset=["text", "pattern_category", "label"])
        .withColumn("text", strip(F.col("text")))
        .where(F.length("text") >= 3)
        .withColumn("key", normalise(F.col("text")))
    )
    return keep_first(rows, "key", ["source_rank", seq])


def existing(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the columns that the table has, in the given order."""
    return [n for n in names if n in df.columns]


def feature_table(rows: DataFrame, head: list[str], text: str = "text") -> DataFrame:
    """The head's existing columns, the clean text and the twelve signals, all counted anew; rows without text are dropped."""
    rows = rows.dropna(subset=[text])
    return rows.select(*existing(rows, head), clean_text(F.col(text)).alias("clean_text"), *signals(F.col(text)))


def duplicate_count(df: DataFrame, key) -> DataFrame:
    """Rows beyond the first of each key (null counts as one key)."""
    return df.groupBy(key.alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))
