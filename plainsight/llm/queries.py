"""Queries over the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.llm import consistent, copies, groups, near, overlap, passages, pii, splits, tokens
from plainsight.session import table


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Texts of features and of ood_real_test under one id."""
    a = table(spark, d, "features").select(F.col("row_id").alias("id"), "text")
    return a.unionByName(table(spark, d, "ood_real_test").select(F.col("ood_id").alias("id"), "text"))


def queries():
    t = table
    return {
        "p1_found": lambda s, d: splits.torn_rows(t(s, d, "features"), t(s, d, "split_plan")),
        "p1_splits": lambda s, d: splits.assigned_splits(t(s, d, "features")),
        "p1_forest": lambda s, d: splits.forest_edges(t(s, d, "features")),
        "p2_found": lambda s, d: overlap.overlap_pairs(t(s, d, "features"), t(s, d, "split_plan")),
        "p2_report": lambda s, d: overlap.overlap_report(t(s, d, "features"), t(s, d, "split_plan")),
        "p3_found": lambda s, d: consistent.same_looking_pairs(_both(s, d)),
        "p3_forms": lambda s, d: consistent.consistent_texts(_both(s, d)),
        "p4_found": lambda s, d: copies.copy_pairs(t(s, d, "features")),
        "p4_collapsed": lambda s, d: copies.collapsed(t(s, d, "features")),
        "p5_found": lambda s, d: near.near_pairs(t(s, d, "features")),
        "p5_groups": lambda s, d: near.near_groups(t(s, d, "features")),
        "p7_found": lambda s, d: groups.group_ids(t(s, d, "features")),
        "p8_ids": lambda s, d: tokens.encoded(t(s, d, "documents")),
        "p9_found": lambda s, d: passages.leak_pairs(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_spans": lambda s, d: passages.contained_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_items": lambda s, d: passages.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p10_found": lambda s, d: pii.found(t(s, d, "documents")),
        "p10_redacted": lambda s, d: pii.redacted(t(s, d, "documents")),
    }


def oracle_sql():
    """None of these is expressible in SQL over whole tables; tests compare them with brute force instead."""
    return {}
