"""Texts in their consistent form, and rows that look the same in different characters (problem 3).

Frequencies of the corpus decide between equally plain members of a class, so code points are counted first:
a distributed count over all texts whose result is bounded by the size of Unicode, not by the data.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.llm.forms import Folder, look_alike_classes
from plainsight.session import Scratch, spread


def code_point_counts(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """Count of every code point beyond ASCII, over all texts (at most 0x110000 rows)."""
    rest = F.regexp_replace(F.col(text), r"[\x00-\x7f]+", "")
    rows = (
        texts.select(rest.alias("r"))
        .where(F.col("r") != "")
        .select(F.explode(F.split("r", "")).alias("c"))
        .where(F.col("c") != "")
        .groupBy("c")
        .count()
    )
    return {r["c"]: r["count"] for r in rows.collect()}


def consistent_texts(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key`` and ``form`` of every row. A null text has a null form, an empty text an empty one."""
    rewrite = look_alike_classes(code_point_counts(df, text))

    def rewrite_batches(batches):
        folder = Folder(rewrite)
        for b in batches:
            forms = [None if t is None else folder(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(forms, pa.string())], names=["id", "form"])

    out = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"))).mapInArrow(
        rewrite_batches, "id long, form string"
    )
    return out.withColumnRenamed("id", key)


def _digests(df: DataFrame, rewrite: dict[str, str]) -> DataFrame:
    """Digests (128 bits) of the form and of the text of every row that is not blank."""

    def digest(s: str) -> bytes:
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches):
        folder = Folder(rewrite)
        for b in batches:
            ids, forms, texts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = folder(t)
                if form.strip():
                    ids.append(i)
                    texts.append(d := digest(t))
                    forms.append(d if form == t else digest(form))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())],
                names=["id", "form", "text"],
            )

    return df.mapInArrow(run, "id long, form binary, text binary")


def same_looking_pairs(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id_a`` < ``id_b``: rows of one consistent form whose texts differ. Null and blank texts take no part.

    Forms that occur in one spelling only are dropped after a partially aggregated pass; pairs are formed
    within the rest. A repeated row counts once; rows without an id are ignored.
    """
    df = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rewrite = look_alike_classes(code_point_counts(df))
    scratch = Scratch(df.sparkSession, "forms")
    rows = scratch.save(_digests(spread(df), rewrite), "digests")
    several = (
        rows.groupBy("form")
        .agg(F.min("text").alias("least"), F.max("text").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("form")
    )
    kept = scratch.save(rows.join(several, "form", "left_semi").distinct(), "kept")
    a = kept.select("form", F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    b = kept.select("form", F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    pair: Column = (F.col("id_a") < F.col("id_b")) & (F.col("text_a") != F.col("text_b"))
    return a.join(b, "form").where(pair).select("id_a", "id_b")
