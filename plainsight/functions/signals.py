"""The twelve signals of a text, as one projection without shuffle or Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight import constants as C
from plainsight.functions.text import flags


def signals(text: Column, unicode: bool = False) -> list[Column]:
    """Counts are numbers of distinct patterns that match; flags say whether any does. Null counts as empty."""
    raw = F.coalesce(text, F.lit(""))
    low, f = F.lower(raw), flags(unicode)

    def count(patterns: list[str]) -> Column:
        return sum((low.rlike(f + p).cast("int") for p in patterns), F.lit(0))

    def flag(patterns: list[str]) -> Column:
        return low.rlike(f + "|".join(patterns)).cast("int")

    def literal(c: str) -> Column:
        return F.length(raw) - F.length(F.replace(raw, F.lit(c), F.lit("")))

    values = [
        count(C.URGENCY), count(C.SCARCITY), flag(C.SHAME), count(C.CANCEL), flag(C.SOCIAL), flag(C.DRIP),
        flag(C.DISCOUNT), flag(C.NEG_OPTION), literal("!"), literal("?"), raw.rlike(f + r"\d").cast("int"),
        flag([C.TIME_WORDS]),
    ]
    return [v.cast("int").alias(n) for v, n in zip(values, C.SIGNALS)]


def with_signals(df: DataFrame, text: str = "text", unicode: bool = False) -> DataFrame:
    return df.select("*", *signals(F.col(text), unicode))
