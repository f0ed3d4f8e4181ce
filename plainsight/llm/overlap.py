"""Copies and near-copies across splits (problem 2): prefix-filter bipartite join on rare words.

Prefixes of evaluation classes form the index, prefixes of training classes probe it with length and
position filters; overlaps are verified on the words themselves and reported per row, split and source.

Defined cases: rows outside the plan take no part; a row planned twice counts once per split; null and blank
texts take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.copies import copy_runs
from plainsight.llm.prefixes import DEN, NUM, signatures, verified, with_words
from plainsight.session import Scratch


@dataclass
class Overlaps:
    """members: row_id, rep, train of every planned row. linked: classes a (evaluation) and b (train), equal or similar.
    held: rep and t, the rows it has in train.
    """

    members: DataFrame
    linked: DataFrame
    held: DataFrame


def linked_classes(features: DataFrame, plan: DataFrame) -> Overlaps:
    scratch = Scratch(features.sparkSession, "overlap")
    runs = scratch.save(copy_runs(features, scratch), "members")
    scratch.drop("runs", "links")
    sides = plan.where("split_name is not null").select("row_id", (F.col("split_name") == "train").alias("train")).distinct()
    members = scratch.save(runs.join(sides, "row_id").select("row_id", "rep", "train"), "sided")
    # tag of a class: 1 with rows in train, 2 with rows in evaluation, 3 with both
    held = members.groupBy("rep").agg(F.sum(F.when(F.col("train"), 1).otherwise(0)).alias("t"), F.count("*").alias("n"))
    tag = F.when(F.col("t") > 0, 1).otherwise(0) + F.when(F.col("t") < F.col("n"), 2).otherwise(0)
    classes = scratch.save(
        runs.where("key is not null").select("rep", "key").join(held, "rep").select("rep", "key", tag.alias("tag"), "t"), "classes"
    )
    sigs = scratch.save(signatures(with_words(classes)), "signatures")
    e = sigs.where("tag >= 2").alias("e")
    t = sigs.where("tag <> 2").alias("t")
    rest = F.least(F.col("e.n") - F.col("e.pos"), F.col("t.n") - F.col("t.pos"))
    total = F.col("e.n") + F.col("t.n")
    pairs = (
        e.join(t, F.col("e.sig") == F.col("t.sig"))
        .where((F.col("e.rep") != F.col("t.rep")) & ~(F.col("e.guest") & F.col("t.guest")))
        .where((F.col("e.n") * DEN >= F.col("t.n") * NUM) & (F.col("t.n") * DEN >= F.col("e.n") * NUM))  # length
        .where(rest * (NUM + DEN) >= total * NUM)  # position: words from here on must suffice for the overlap
        .select(F.col("e.rep").alias("a"), F.col("t.rep").alias("b"))
        .distinct()
    )
    near = verified(scratch.save(pairs, "candidates"), classes)
    scratch.drop("signatures")
    both = classes.where("tag = 3").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    return Overlaps(members, near.unionByName(both), classes.select("rep", "t"))


def overlap_pairs(features: DataFrame, plan: DataFrame) -> DataFrame:
    """``row_id_a`` < ``row_id_b``: rows of train and of another split that are copies or near-copies."""
    o = linked_classes(features, plan)
    rows = (
        o.linked.join(o.members.where("not train").select(F.col("rep").alias("a"), F.col("row_id").alias("eval_id")), "a")
        .join(o.members.where("train").select(F.col("rep").alias("b"), F.col("row_id").alias("train_id")), "b")
        .where("eval_id != train_id")
    )
    return rows.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b")).distinct()


def overlap_report(features: DataFrame, plan: DataFrame) -> DataFrame:
    """Evaluation rows with an overlap in train, and their training partners, per split and source.

    Partners are counted by class, so the work stays linear in the rows however many copies a class has.
    """
    o = linked_classes(features, plan)
    of_class = o.linked.join(o.held.select(F.col("rep").alias("b"), "t"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("t").alias("partners"))
    # a row that stands in train too is no partner of itself
    rows = o.members.groupBy("row_id", "rep").agg(F.max(F.col("train").cast("int")).alias("own"), F.min(F.col("train").cast("int")).alias("only"))
    hit = (
        rows.where("only = 0")
        .join(of_class, "rep")
        .groupBy("row_id")
        .agg(F.sum(F.col("partners") - F.col("own")).alias("partners"))
        .where("partners > 0")
    )
    planned = plan.where("split_name <> 'train'").select("row_id", "split_name").distinct()
    return (
        planned.join(features.select("row_id", "source"), "row_id")
        .join(hit, "row_id", "left")
        .groupBy("split_name", "source")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("partners").alias("n_leaked"),
            F.coalesce(F.sum("partners"), F.lit(0)).alias("n_pairs"),
        )
    )
