"""Splits and folds by stratum and group, what leaks across them, and gates that stop on a leak."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsight.operators.codes import placed_within
from plainsight.session import Scratch


class GateError(AssertionError):
    """A data gate did not hold."""


def stratified(df: DataFrame, row: str, stratum: str, share: Column | float = 0.2, order: Column | None = None) -> DataFrame:
    """``row``, ``stratum`` and ``side``: in every stratum the first ``share`` (rounded half up) under a hash order is test.

    ``order`` is a whole number from 0 to 2**32 - 1; a stratum of any size is spread over tasks.
    """
    order = F.pmod(F.xxhash64(row, F.lit(42)), F.lit(1 << 32)) if order is None else order
    deck = placed_within(df.select(row, stratum), stratum, order, row)
    side = F.when(F.col("place") <= F.floor(F.col("size") * share + 0.5), "test").otherwise("train")
    return deck.select(row, stratum, side.alias("side"))


def leak_count(df: DataFrame, group: str = "group", side: str = "side") -> DataFrame:
    """Groups on both sides, and test rows whose group is also in train; one aggregate per group."""
    by = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(F.col(side) == "train").alias("t"), F.count_if(F.col(side) == "test").alias("e")
    )
    torn = (F.col("t") > 0) & (F.col("e") > 0)
    return by.agg(
        F.count_if(torn).alias("shared_groups"),
        F.coalesce(F.sum(F.when(torn, F.col("e"))), F.lit(0)).alias("leaked_test_rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("test_rows"),
    )


#: Groups holding more than this share of any class (at most its inverse for each class) are placed one by one.
LARGE = 0.001
#: Groups of one class and size band that one task deals.
DEALT = 200_000


def _placed(large: list, whole: dict[str, int], k: int) -> tuple[list, np.ndarray]:
    """Groups (with their counts by class) put, largest first, where the spread of class shares stays least."""
    at = {y: c for c, y in enumerate(whole)}
    total = np.array([*whole.values()], float)
    have, out = np.zeros((k, len(whole))), []
    for r in sorted(large, key=lambda r: (-r["n"], r["o"], str(r["g"]))):
        mine = np.zeros(len(whole))
        for _, y, n in r["mix"]:
            mine[at[y]] = n
        spread = [((have + np.eye(k)[f][:, None] * mine) / total).std(axis=0).sum() for f in range(k)]
        best = min(range(k), key=lambda f: (spread[f], have[f].sum(), f))
        have[best] += mine
        out.append((r["g"], best))
    return out, have


def _lacking(whole: dict[str, int], have: np.ndarray, held: dict, k: int, rounds: int = 200) -> np.ndarray:
    """Share of each stratum's groups due to each fold, so that every class comes to 1 / k in all of them.

    ``held`` has the rows of a class in the groups of a stratum. The strata are set in turn, each by what its class
    lacks beside large groups and the present shares of the other strata.
    """
    names = [*whole]
    rows = np.array([[held.get((s, c), 0) for c in names] for s in names], float)
    due = np.full((len(names), k), 1 / k)
    for _ in range(rounds):
        for s, y in enumerate(names):
            others = rows[:, s] @ due - rows[s, s] * due[s]
            lacks = np.maximum(whole[y] / k - have[:, s] - others, 0.0)
            if lacks.sum() > 0:
                due[s] = lacks / lacks.sum()
    return due


def grouped_folds(df: DataFrame, row: str, group: str, label: str, k: int = 5) -> DataFrame:
    """``row`` and ``fold``: groups stay whole, every class is spread; all groups count, whatever their number.

    Class totals are over all rows. A group that holds much of any class (LARGE; a bounded number, and of a rare
    class every group) is placed where the spread of class shares stays least. The others are stratified by the
    class they hold most of, by share, and by that count's band (powers of two), put in order of their second
    class and size, and dealt systematically by what each fold still lacks of the class. The driver holds only
    strata and large groups.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "folds")
    rows = df.select(row, F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("y"))
    counts = scratch.save(rows.groupBy("g", "y").agg(F.count("*").alias("n")), "counts")
    whole = {r["y"]: r["n"] for r in counts.groupBy("y").agg(F.sum("n").alias("n")).orderBy("y").collect()}
    totals = spark.createDataFrame([*whole.items()], "y string, whole long")
    shares = counts.join(F.broadcast(totals), "y").select("g", F.struct((F.col("n") / F.col("whole")).alias("share"), "y", "n").alias("m"))
    groups = shares.groupBy("g").agg(F.sum("m.n").alias("n"), F.sort_array(F.collect_list("m"), asc=False).alias("mix"))
    groups = scratch.save(groups.withColumn("o", F.xxhash64("g", F.lit(42))), "groups")
    main = F.col("mix")[0]
    placed, have = _placed(groups.where(main["share"] > LARGE).collect(), whole, k)

    small = groups.where(main["share"] <= LARGE).select(
        "g", "n", "o", "mix", main["y"].alias("y"), F.floor(F.log2(main["n"])).cast("int").alias("band"),
        F.coalesce(F.try_element_at("mix", F.lit(2))["y"], F.lit("")).alias("second"),
    )
    held = small.select("y", F.explode("mix").alias("m")).groupBy("y", F.col("m.y").alias("c")).agg(F.sum("m.n").alias("n")).collect()
    edges = {y: [float(x) for x in e.cumsum()[:-1]] for y, e in zip(whole, _lacking(whole, have, {(r["y"], r["c"]): r["n"] for r in held}, k))}
    strata = small.groupBy("y", "band").count().collect()
    dealing = spark.createDataFrame([(r["y"], r["band"], 1 + r["count"] // DEALT, edges[r["y"]]) for r in strata], "y string, band int, tasks long, edges array<double>")
    deck = small.join(F.broadcast(dealing), ["y", "band"]).withColumn("task", F.pmod("o", "tasks"))
    w = Window.partitionBy("y", "band", "task").orderBy("second", F.desc("n"), "o", "g")
    offset = F.pmod(F.xxhash64("y", "band", "task", F.lit(42)), F.lit(1 << 20)) / float(1 << 20)
    at = F.pmod(F.row_number().over(w) * F.lit(0.6180339887498949) + offset, F.lit(1.0))
    dealt = deck.withColumn("at", at).select("g", F.size(F.filter("edges", lambda e: e <= F.col("at"))).alias("fold"))
    kind = df.schema[group].dataType.simpleString()
    dealt = dealt.unionByName(spark.createDataFrame(placed, f"g {kind}, fold int")).withColumnRenamed("g", "h")
    return rows.join(dealt, F.col("g").eqNullSafe(F.col("h"))).select(F.col(row), "fold")


def missing_classes(folds: DataFrame, group: str, label: str = "y", fold: str = "fold", k: int = 5) -> DataFrame:
    """``label``, ``folds`` and ``groups``: classes that fewer than ``k`` folds hold, and how many groups they have."""
    by = folds.where(F.col(label).isNotNull()).groupBy(label).agg(F.count_distinct(fold).alias("folds"), F.count_distinct(group).alias("groups"))
    return by.where(F.col("folds") < k)


def validate_folds(folds: DataFrame, group: str, label: str = "y", fold: str = "fold", k: int = 5) -> None:
    """Raise where a class is missing from a fold although it has ``k`` groups or more."""
    bad = missing_classes(folds, group, label, fold, k).where(F.col("groups") >= k).head(1)
    if bad:
        raise GateError(f"class {bad[0][label]} is in {bad[0]['folds']} of {k} folds, though in {bad[0]['groups']} groups")


def covered_fold(folds: DataFrame, label: str = "y", fold: str = "fold") -> int:
    """The fold with most classes; of equals the first."""
    return (
        folds.groupBy(fold).agg(F.count_distinct(label).alias("c")).agg(F.max_by(fold, F.struct("c", -F.col(fold)))).first()[0]
    )


def template_aware(df: DataFrame, row: str, group: str, label: str, k: int = 5) -> DataFrame:
    """``row`` and ``side``: test is the first fold of ``k`` group-safe ones that holds every class.

    Where no fold holds all of them, the one with most classes is test.
    """
    folds = grouped_folds(df, row, group, label, k).join(df.select(row, F.col(label).alias("y")), row)
    chosen = covered_fold(folds.where("y is not null"))
    return folds.select(row, F.when(F.col("fold") == chosen, "test").otherwise("train").alias("side"))


def content_hash(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """One row: a digest of the columns' values in order of ``row``, and the number of rows.

    Every row's digest includes its place (its id), and the digests add up, so the sum is the same in every
    layout but changes when two rows trade places. It combines before the shuffle and needs no sort.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    line = F.sha2(F.concat_ws("\x1f", F.col(row).cast("string"), *cells), 256)
    part = F.conv(F.substr(line, F.lit(1), F.lit(15)), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(part).cast("decimal(38,0)").cast("string"), F.lit("0"))
    return df.agg(F.sha2(total, 256).alias("content_sha256"), F.count("*").alias("n_rows"))


def validate_split(split: DataFrame, rows: DataFrame, row: str, group: str = "group", side: str = "side") -> None:
    """Raise unless the split covers the rows once each and tears no group apart."""
    if split.groupBy(row).agg(F.count_distinct(side).alias("c")).where("c > 1").head(1):
        raise GateError("a row is on both sides")
    if rows.select(row).exceptAll(split.select(row)).head(1) or split.select(row).exceptAll(rows.select(row)).head(1):
        raise GateError("the split does not cover the rows exactly")
    leak = leak_count(split.join(rows.select(row, group), row), group, side).first()
    if leak["shared_groups"]:
        raise GateError(f"{leak['shared_groups']} groups are on both sides")


def validate_saved(split: DataFrame, saved_hash: str, rows: DataFrame, row: str, columns: list[str], group: str = "group", side: str = "side") -> None:
    """A split that was saved beside the hash of its rows: raise where they have changed since, or the split is not valid."""
    now = content_hash(rows, row, columns).first()["content_sha256"]
    if now != saved_hash:
        raise GateError("the split is stale: its rows have changed")
    validate_split(split, rows, row, group, side)
