"""Linked rows: groups by page and template, by low-diameter decomposition or by a spanning forest.

Vertices are pages; a template links the pages it occurs on to the least of them, so a template with k pages
gives k - 1 edges. Ids are 128-bit digests: links are compared and shuffled as 16 bytes whatever the text.
Rows without a page hang on their template; they never connect pages by themselves beyond its own links.

Any labelling whose classes lie within components leaves the components of the contracted graph unchanged,
so both algorithms may stop a phase early: rounds decide speed, never the result.

Defined cases: null and blank pages and null and blank texts link nothing; a row with neither is alone; rows
without an id are ignored; a repeated row comes out as often as it comes in.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.llm.forms import fold
from plainsight.llm.skeletons import template
from plainsight.session import Scratch, spread

_BLANK = r"(?U)^\s*$"


def digest(kind: str, col: Column) -> Column:
    """Pages (p), templates (t) and lone rows (r) never meet, even where their texts are equal."""
    return F.unhex(F.md5(F.concat(F.lit(kind), col.cast("string"))))


def _with_templates(df: DataFrame) -> DataFrame:
    """(row_id, p, text) to (row_id, p, t)."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                t = template(form) if text is not None and (form := fold(text)).strip() else ""
                out.append(hashlib.md5(b"t" + t.encode("utf-8", "surrogatepass")).digest() if t else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["row_id", "p", "t"])

    return spread(df).mapInArrow(run, "row_id long, p binary, t binary")


@dataclass
class Links:
    """rows: row_id, p, t. first: template to the least page it is on. edges: u, v of pages, once each."""

    rows: DataFrame
    first: DataFrame
    edges: DataFrame


def links(features: DataFrame, scratch: Scratch) -> Links:
    features = features.where("row_id is not null")
    page = F.when(~F.col("page_id").rlike(_BLANK), digest("p", F.col("page_id"))).alias("p")
    rows = scratch.save(_with_templates(features.select("row_id", page, "text")), "rows")
    on = scratch.save(rows.where("p is not null and t is not null").select("p", "t").distinct(), "on")
    first = scratch.save(on.groupBy("t").agg(F.min("p").alias("m"), F.count("*").alias("n_pages")), "first")
    edges = (
        on.join(first.where("n_pages > 1"), "t")
        .where("p <> m")
        .select(F.col("m").alias("u"), F.col("p").alias("v"))
        .distinct()
    )
    return Links(rows, first, scratch.save(edges, "edges"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _contracted(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Edges between the labels (v, c) of their ends, without loops, once each."""
    x = (
        edges.join(label.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
        .join(label.select("v", F.col("c").alias("cv")), "v")
        .where("cu <> cv")
    )
    return x.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()


def _arcs(edges: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, int]:
    """Arcs u, v both ways at a cost of 1, every vertex to itself at none; and how many there are."""
    both = _both_ways(edges).withColumn("cost", F.lit(1.0))
    stay = both.select("v").distinct().select(F.col("v").alias("u"), "v", F.lit(0.0).alias("cost"))
    arcs, seen = scratch.save_counting(both.unionByName(stay), f"arcs{level}", n=F.count("*"))
    return arcs, seen["n"]


def low_diameter_components(edges: DataFrame, scratch: Scratch, beta: float = 0.1, hops: int = 4) -> DataFrame:
    """``v`` and its component ``c``, for every vertex with an edge.

    Every vertex draws a head start from an exponential distribution (rate ``beta``, by hash of vertex and
    level); clusters grow from the earliest starters hop by hop, each vertex joining the cluster that reaches
    it first. Clusters contract to super-vertices and the edges between clusters are decomposed again. The
    assignments of all levels are composed at the end, from the last level back.
    """
    levels: list[DataFrame] = []
    arcs, left = _arcs(edges, scratch, 0)
    while left:
        level = len(levels)
        unit = (F.pmod(F.xxhash64(F.col("u"), F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        reach = arcs.select("v", (-F.log(unit) / beta - F.col("cost")).alias("lead"), F.col("u").alias("c"))
        for hop in range(hops):
            if hop:
                at = state.select(F.col("v").alias("u"), "lead", "c")
                reach = arcs.join(at, "u").select("v", (F.col("lead") - F.col("cost")).alias("lead"), "c")
            state = reach.groupBy("v").agg(F.max(F.struct("lead", "c")).alias("best")).select("v", "best.lead", "best.c")
        label = scratch.save(state.select("v", "c"), f"level{level}")
        levels.append(label)
        arcs, left = _arcs(_contracted(arcs.where("u < v"), label), scratch, level + 1)
        scratch.drop(f"arcs{level}")
    return _composed(levels, edges)


def _composed(levels: list[DataFrame], edges: DataFrame) -> DataFrame:
    if not levels:
        return edges.select("v", F.col("u").alias("c")).limit(0)
    whole = levels[-1]
    for label in reversed(levels[:-1]):
        deeper = whole.select(F.col("v").alias("c"), F.col("c").alias("root"))
        whole = label.join(deeper, "c", "left").select("v", F.coalesce("root", "c").alias("c"))
    return whole


def spanning_forest(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Boruvka-style contraction: the forest's edges (u, v), persisted, and (v, c) with the root of every vertex.

    Each round every vertex takes its least incident edge (weights are hashes, ties fall to the edge itself);
    of two vertices that take the same edge the lesser is a root; roots are found by pointer doubling until
    nothing moves (counted while a pass is written), the chosen edges join the forest, and the graph contracts to the roots.
    """
    weight = F.xxhash64("u", "v").alias("w")
    current = edges.select("u", "v", weight, F.col("u").alias("eu"), F.col("v").alias("ev"))
    levels: list[DataFrame] = []
    chosen: list[DataFrame] = []
    level = 0
    left = len(current.head(1))
    while left:
        flipped = current.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "eu", "ev")
        best = (
            current.unionByName(flipped)
            .groupBy("u")
            .agg(F.min(F.struct("w", "eu", "ev", "v")).alias("b"))
            .select(F.col("u").alias("x"), F.col("b.v").alias("up"), "b.eu", "b.ev")
        )
        best = scratch.save(best, f"best{level}")
        chosen.append(best.select(F.col("eu").alias("u"), F.col("ev").alias("v")).distinct())
        back = best.select(F.col("x").alias("up"), F.col("up").alias("upup"))
        root = F.when((F.col("upup") == F.col("x")) & (F.col("x") < F.col("up")), F.col("x")).otherwise(F.col("up"))
        hooked = best.join(back, "up").select("x", root.alias("c"))
        step, moved = 0, 1
        while moved:  # each pass doubles twice, and counts what the second time still moved
            over = hooked.select(F.col("x").alias("c"), F.col("c").alias("cc"))
            once = hooked.join(over, "c").select("x", F.col("cc").alias("c"))
            over = once.select(F.col("x").alias("c"), F.col("c").alias("cc"))
            twice = once.join(over, "c").select("x", "c", "cc")
            jumped, seen = scratch.save_counting(twice, f"roots{level}_{step}", n=F.count_if(F.col("c") != F.col("cc")))
            hooked, moved = jumped.select("x", F.col("cc").alias("c")), seen["n"]
            if step:
                scratch.drop(f"roots{level}_{step - 1}")
            step += 1
        label = hooked.select(F.col("x").alias("v"), "c")
        levels.append(label)
        ends = (
            current.join(label.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
            .join(label.select("v", F.col("c").alias("cv")), "v")
            .where("cu <> cv")
        )
        lighter = (
            ends.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"), "w", "eu", "ev")
            .groupBy("u", "v")
            .agg(F.min(F.struct("w", "eu", "ev")).alias("b"))
            .select("u", "v", "b.*")
        )
        following, seen = scratch.save_counting(lighter, f"graph{level}", n=F.count("*"))
        left = seen["n"]
        if level:
            scratch.drop(f"graph{level - 1}")
        current, level = following, level + 1
    forest = chosen[0] if chosen else edges.select("u", "v").limit(0)
    for c in chosen[1:]:
        forest = forest.unionByName(c)
    return forest, _composed(levels, edges)


def homed_rows(net: Links) -> DataFrame:
    """``row_id`` and its vertex ``k``: its page, else its template's least page, else the template, else null."""
    lone = net.rows.where("p is null and t is not null").join(net.first.select("t", "m"), "t", "left")
    return (
        net.rows.where("p is not null").select("row_id", F.col("p").alias("k"))
        .unionByName(lone.select("row_id", F.coalesce("m", "t").alias("k")))
        .unionByName(net.rows.where("p is null and t is null").select("row_id", F.lit(None).cast("binary").alias("k")))
    )


def group_ids(features: DataFrame) -> DataFrame:
    """``row_id`` and ``group_id``, the least page of the group in byte order, for groups of two rows or more."""
    scratch = Scratch(features.sparkSession, "groups")
    net = links(features, scratch)
    comp = low_diameter_components(net.edges, scratch)
    lone = net.rows.where("p is null and t is not null").select("row_id", "t").join(net.first.select("t", F.col("m").alias("p")), "t")
    pages = (
        features.where("row_id is not null")
        .where(~F.col("page_id").rlike(_BLANK))
        .groupBy("page_id")
        .agg(F.count("*").alias("n"))
        .withColumn("p", digest("p", F.col("page_id")))
    )
    extra = lone.groupBy("p").agg(F.count("*").alias("more"))
    sized = scratch.save(
        pages.join(extra, "p", "left")
        .join(comp.select(F.col("v").alias("p"), "c"), "p", "left")
        .select("p", "page_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("c", "p").alias("c")),
        "sized",
    )
    named = (
        sized.groupBy("c").agg(F.min("page_id").alias("group_id"), F.sum("n").alias("n")).where("n >= 2")
    )
    of_page = sized.select("p", "c").join(named.select("c", "group_id"), "c").select("p", "group_id")
    rows = net.rows.where("p is not null").select("row_id", "p").unionByName(lone.select("row_id", "p"))
    return rows.join(of_page, "p").select("row_id", "group_id")
