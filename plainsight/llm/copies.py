"""Duplicates hidden by formatting (problem 4): range-partitioned external sort and a scan of adjacent runs.

Canonical records are range-partitioned and sorted by (key, id), so a run of copies is contiguous, even
where it spans partitions: no key, however hot, has to fit one task. The scan compares full keys. Only the
run a partition begins with can continue an earlier one; two summary rows a partition settle those.

Records are first collapsed by their words in order; labelled fields then link classes of one set of fields in
different orders, and linked classes take the least representative of their component.

Defined cases: null and blank texts are no record and take no part; texts of punctuation alone have the
empty key and are copies of each other; a repeated row counts once; rows without an id are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.forms import copy_keys, fold
from plainsight.operators.components import components
from plainsight.session import Scratch, spread


def _keyed(df: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, keys, fields = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = fold(t)
                if form.strip():
                    ids.append(i)
                    key, field = copy_keys(form)
                    keys.append(key)
                    fields.append(field)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(fields, pa.string())], names=["row_id", "key", "fields"])

    return spread(df).mapInArrow(run, "row_id long, key string, fields string")


_RUNS = "row_id long, least long, lead int, key string, fields string, summary boolean"
_NAMES = ["row_id", "least", "lead", "key", "fields", "summary"]


def _scan_runs(batches):
    """Rows with the least id of their run so far; the key on first rows of runs; summaries of the edge runs."""
    part = TaskContext.get().partitionId()
    last_key = last_least = last_id = None
    first: tuple | None = None
    leading = True

    def rows(ids, least, lead, keys, fields, summary):
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(least, pa.int64()), pa.array(lead, pa.int32()), pa.array(keys, pa.string()), fields, pa.array(summary, pa.bool_())],
            names=_NAMES,
        )

    for b in batches:
        if not b.num_rows:
            continue
        ids, keys = b.column(0).to_pylist(), b.column(1)
        starts = [True] * len(ids)
        if len(ids) > 1:
            starts[1:] = pc.not_equal(keys[1:], keys[:-1]).to_pylist()
        starts[0] = keys[0].as_py() != last_key
        kept, least, lead, heads, at = [], [], [], [], []
        for k, (i, new) in enumerate(zip(ids, starts)):
            if not new and i == last_id:
                continue  # the row is repeated
            kept.append(i)
            at.append(k)
            last_id = i
            if new:
                if first is None:
                    first = (keys[k].as_py(), i)
                else:
                    leading = False
                last_least = i
                last_key = keys[k].as_py()
                heads.append(last_key)
            else:
                heads.append(None)
            least.append(last_least)
            lead.append(part if leading else None)
        yield rows(kept, least, lead, heads, b.column(2).take(pa.array(at, pa.int64())), [False] * len(kept))
    if first is not None:
        edges = [first] if leading else [first, (last_key, last_least)]
        n = len(edges)
        yield rows([None] * n, [e[1] for e in edges], [part, None][:n], [e[0] for e in edges], pa.nulls(n, pa.string()), [True] * n)


def copy_runs(features: DataFrame, scratch: Scratch) -> DataFrame:
    """``row_id``, ``rep`` (least id among its copies) and, on representatives only, ``key``."""
    keyed = scratch.save(
        _keyed(features.select("row_id", "text").where("row_id is not null and text is not null")), "keyed"
    )
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = scratch.save(
        keyed.repartitionByRange(parts, "key", "row_id").sortWithinPartitions("key", "row_id").mapInArrow(_scan_runs, _RUNS),
        "runs",
    )
    scratch.drop("keyed")
    edges = runs.where("summary").select("lead", "key", "least")
    settled = (
        edges.where("lead is not null")
        .select("lead", "key")
        .join(edges.groupBy("key").agg(F.min("least").alias("settled")), "key")
        .select("lead", "settled")
    )  # one row a partition
    rows = runs.where("not summary").join(F.broadcast(settled), "lead", "left")
    rows = rows.select("row_id", F.coalesce("settled", "least").alias("rep"), "key", "fields")
    rep = F.col("rep")
    orders = rows.where("fields is not null").select("fields", "rep").distinct()
    least = orders.groupBy("fields").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).where("v < most")
    links = scratch.save(orders.join(least, "fields").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct(), "links")
    if links.head(1):
        roots = components(links).select(F.col("u").alias("rep"), "root")
        rows = rows.join(roots, "rep", "left")
        rep = F.coalesce("root", "rep")
    return rows.select("row_id", rep.alias("rep"), F.when(F.col("row_id") == rep, F.col("key")).alias("key"))


def copy_pairs(features: DataFrame) -> DataFrame:
    """Each copy except the least (``row_id_b``) with that least one (``row_id_a``)."""
    runs = copy_runs(features, Scratch(features.sparkSession, "copies"))
    return runs.where(F.col("row_id") != F.col("rep")).select(
        F.col("rep").alias("row_id_a"), F.col("row_id").alias("row_id_b")
    )


def collapsed(features: DataFrame) -> DataFrame:
    """One row per distinct record: its representative and the exact number of copies, itself included."""
    runs = copy_runs(features, Scratch(features.sparkSession, "collapsed"))
    return runs.groupBy(F.col("rep").alias("row_id")).agg(F.count("*").alias("n_copies"))
