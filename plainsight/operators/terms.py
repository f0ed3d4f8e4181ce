"""Vocabularies and TF-IDF in long form: (row, term, weight), so width never sits in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsight.functions.text import model_tokens
from plainsight.operators.codes import numbered
from plainsight.session import Scratch

#: Terms of a vocabulary that is broadcast.
BROADCAST = 100_000


def by_row(df: DataFrame, row: str) -> DataFrame:
    """Rows placed by their id, so that what is exploded from a row stays where it is counted: the texts move, not their terms."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, row)


def term_counts(df: DataFrame, row: str, terms: Column, also: list[str] | None = None) -> DataFrame:
    """Terms of every row with their counts; ``also`` carries further columns of the row along. ``df`` is placed by row."""
    keys = [row, *(also or [])]
    return by_row(df, row).select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def vocabulary(counts: DataFrame, min_df: int = 2, size: int | None = None) -> DataFrame:
    """Terms of ``min_df`` documents or more; with ``size``, the most frequent ones (ties by term)."""
    v = document_frequencies(counts).where(F.col("df") >= min_df)
    return v.orderBy(F.desc("total"), "term").limit(size) if size else v


def tfidf(counts: DataFrame, row: str, n_rows: int, min_df: int = 2, size: int | None = None) -> DataFrame:
    """Sublinear tf, smoothed idf, rows scaled to length 1.

    The counts are written once and read for the vocabulary and for the weights. A vocabulary of bounded ``size`` is
    broadcast; a row's length comes from a window over its own terms.
    """
    counts = Scratch(counts.sparkSession, "tfidf").save(counts, "counts")
    idf = F.log((1.0 + n_rows) / (1.0 + F.col("df"))) + 1.0
    known = vocabulary(counts, min_df, size).select("term", idf.alias("idf"))
    weighed = counts.join(F.broadcast(known) if size and size <= BROADCAST else known, "term").select(row, "term", ((F.log("tf") + 1.0) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row)))
    return weighed.select(row, "term", (F.col("w") / norm).alias("weight"))


def token_vocabulary(df: DataFrame, row: str, text: Column, min_count: int = 2) -> DataFrame:
    """``token``, ``id``: ids from 2 in order of first appearance (row, then place); 0 pads, 1 is unknown."""
    t = df.select(row, F.posexplode(model_tokens(text)).alias("at", "token"))
    known = t.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct(row, "at")).alias("first")).where(F.col("c") >= min_count)
    return numbered(known.select("token", "first"), [F.col("first")], "id").select("token", (F.col("id") + 2).alias("id"))


def encode(df: DataFrame, row: str, text: Column, vocab: DataFrame, length: int = 40) -> DataFrame:
    """``row``, ``ids``: the first ``length`` tokens as ids, padded with 0 on the right (the models' input)."""
    t = df.select(row, F.posexplode(F.slice(model_tokens(text), 1, length)).alias("at", "token"))
    found = t.join(vocab, "token", "left").select(row, "at", F.coalesce("id", F.lit(1)).alias("id"))
    lists = found.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    padded = F.slice(F.concat(F.coalesce("ids", F.array().cast("array<bigint>")), F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length)
    return df.select(row).join(lists, row, "left").select(row, padded.alias("ids"))
