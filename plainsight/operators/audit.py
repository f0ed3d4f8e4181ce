"""The leak audit as one document, and its parts that stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.operators import splits
from plainsight.session import Scratch


def inflation(spark: SparkSession, scores: list[tuple[str, float, float]]) -> DataFrame:
    """Per model: macro F1 on the naive and on the group-safe split, the drop, and the drop in percent of the former."""
    df = spark.createDataFrame(scores, "model string, macro_f1_naive double, macro_f1_leakfree double")
    drop = F.col("macro_f1_naive") - F.col("macro_f1_leakfree")
    return df.select(
        "model", F.bround("macro_f1_naive", 4).alias("macro_f1_naive"), F.bround("macro_f1_leakfree", 4).alias("macro_f1_leakfree"),
        F.bround(drop, 4).alias("macro_f1_drop"), F.bround(F.try_divide(100 * drop, "macro_f1_naive"), 1).alias("relative_pct"),
    )


def largest_clusters(rows: DataFrame, skeleton: str = "skeleton", k: int = 5) -> DataFrame:
    """The ``k`` skeletons of most rows, ties in byte order, as one array (a top-k report)."""
    top = rows.groupBy(skeleton).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), skeleton).limit(k)
    cells = F.array_sort(F.collect_list(F.struct((-F.col("n_rows")).alias("o"), F.col(skeleton).alias("skeleton"), "n_rows")))
    return top.agg(F.transform(cells, lambda x: F.struct(x["skeleton"].alias("skeleton"), x["n_rows"].alias("n_rows"))).alias("largest_clusters"))


def report(rows: DataFrame, models: list[tuple[str, float, float]], probes: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """One row. ``rows``: row_id, pattern_category, text, skeleton, group and the group-safe ``side``.

    Raises where a group or a skeleton is on both sides of the group-safe split.
    """
    rows = rows.withColumn("skeleton", F.when(F.col("skeleton").rlike(r"\S"), F.col("skeleton")))  # blanks link nothing
    naive = splits.stratified(rows, "row_id", "pattern_category").select("row_id", F.col("side").alias("naive"))
    # read by every part of the report
    data = Scratch(rows.sparkSession, "report").save(rows.join(naive, "row_id").select("row_id", "pattern_category", "text", "skeleton", "group", "side", "naive"), "rows")

    def leak(side: str, group: str):
        return splits.leak_count(data, group, side).first()

    clean, skeletons = leak("side", "group"), leak("side", "skeleton")
    if clean["shared_groups"] or skeletons["shared_groups"]:
        raise splits.GateError(f"{clean['shared_groups']} groups and {skeletons['shared_groups']} skeletons are on both sides")
    n_skeleton, n_group = leak("naive", "skeleton"), leak("naive", "group")
    test = n_group["test_rows"]
    clusters = data.where("skeleton is not null").groupBy("skeleton").agg(F.count("*").alias("n"))
    sizes = clusters.agg(F.count("*").alias("total_clusters"), F.count_if(F.col("n") > 1).alias("multi_row_clusters"))
    t = F.col("text")
    whole = data.agg(
        F.count("*").alias("n_rows"), F.count_distinct("pattern_category").alias("n_classes"), F.count_distinct("group").alias("connected_source_groups"),
        F.count_if(F.col("side") == "train").alias("train_size"), F.count_if(t.contains("$")).alias("n_dollar_rows"), F.count_if(t.contains("₹")).alias("n_rupee_rows"),
    )
    line = whole.crossJoin(sizes).crossJoin(largest_clusters(data.where("skeleton is not null")))  # one row each
    scores = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(round(a, 4)).alias("macro_f1_naive"), F.lit(round(b, 4)).alias("macro_f1_leakfree"), F.lit(round(a - b, 4)).alias("macro_f1_drop"), F.lit(round(100 * (a - b) / a, 1) if a else None).cast("double").alias("relative_pct"))
        for m, a, b in models
    ])
    named = {n: F.lit(float(v)) for n, v in probes}
    return line.select(
        "n_rows", "n_classes",
        F.struct("total_clusters", "multi_row_clusters", "largest_clusters").alias("skeleton_clusters"),
        "connected_source_groups",
        F.struct(
            F.lit(test).alias("test_size"), F.lit(n_skeleton["shared_groups"]).alias("cross_split_clusters"), F.lit(n_skeleton["leaked_test_rows"]).alias("leaked_test_rows"),
            F.lit(round(100 * n_skeleton["leaked_test_rows"] / test, 1) if test else None).cast("double").alias("leaked_test_pct"),
            F.lit(n_group["shared_groups"]).alias("cross_split_source_groups"), F.lit(n_group["leaked_test_rows"]).alias("source_leaked_test_rows"),
        ).alias("naive_split"),
        F.struct("train_size", F.lit(clean["test_rows"]).alias("test_size"), F.lit(0).alias("cross_split_clusters"), F.lit(0).alias("leaked_test_rows"), F.lit(0).alias("cross_split_skeletons")).alias("leak_free_split"),
        scores.alias("models"),
        F.struct(
            F.struct(named["currency_symbol"].alias("macro_f1"), "n_dollar_rows", "n_rupee_rows").alias("currency_symbol"),
            *[F.struct(v.alias("macro_f1")).alias(n) for n, v in named.items() if n != "currency_symbol"],
        ).alias("trivial_probes"),
        F.lit(seed).alias("seed"),
    )
