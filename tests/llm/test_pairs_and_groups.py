import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainsight.llm import consistent, copies, groups, near, overlap, prefixes, splits
from plainsight.llm.forms import fold
from plainsight.session import Scratch
from tests.llm import fixtures as X

ROWS = X.features()
PLAN = X.plan(ROWS)


@pytest.fixture(scope="module")
def feats(spark):
    return spark.createDataFrame(ROWS, X.SCHEMA)


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame(PLAN, "row_id long, split_name string").withColumn("rep", F.lit("clash"))


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_copies(spark, feats, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # runs that span partitions, and empty partitions
    try:
        want = {(min(v), i) for v in X.copies(ROWS).values() for i in v if i != min(v)}
        assert pairs(copies.copy_pairs(feats)) == want
        assert {r[0]: r[1] for r in copies.collapsed(feats).collect()} == {min(v): len(v) for v in X.copies(ROWS).values()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_one_hot_key_over_all_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.lit("same Text").alias("text"))
    assert pairs(copies.copy_pairs(df)) == {(0, i) for i in range(1, 500)}


@pytest.mark.parametrize("group, held", [(64, 200_000), (2, 200_000), (2, 0)])
def test_near(feats, monkeypatch, group, held):
    monkeypatch.setattr(prefixes, "GROUP", group)
    monkeypatch.setattr(prefixes, "HELD", held)
    assert pairs(near.near_pairs(feats)) == X.near(ROWS)


def _candidates(sets, group):
    """Pairs that share a signature and pass the position filter, the rows of signatures, and the pairs joined."""
    flat, off = np.array([w for s in sets for w in s], np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    count = collections.Counter(flat.tolist())
    df = np.array([c if (c := count[w]) > group else 0 for w in flat.tolist()], np.int64)
    by, n = collections.defaultdict(list), np.diff(off)
    for parts in prefixes.batch_signatures(flat, off, df, len(sets), group):
        for sig, *x in zip(*(p.tolist() for p in parts)):
            by[sig].append(x)
    met = [(x, y) for v in by.values() for x, y in itertools.combinations(v, 2) if x[0] != y[0] and not (x[2] and y[2])]
    fit = {(min(a, b), max(a, b)) for (a, p, _), (b, q, _) in met if 7 * min(n[a] - p, n[b] - q) >= 3 * (n[a] + n[b])}
    return fit, sum(map(len, by.values())), len(met)


@pytest.mark.parametrize("words, low, high", [(6, 1, 6), (12, 3, 12), (200, 8, 40), (30, 28, 70), (12, 60, 150)])
@pytest.mark.parametrize("group", [1, 4, 1000])
def test_signatures_lose_no_pair(words, low, high, group):
    rng = random.Random(words * low)

    def drawn(n):
        s = set()
        while len(s) < n:
            s.add(int(max(words, 2 * n) * rng.random() ** 3) * 7919 + 13)
        return s

    sets = []
    for _ in range(50):
        sets.append(s := drawn(rng.randint(low, high)))
        for _ in range(2):
            t = set(s)
            for _ in range(rng.randint(0, max(1, len(s) // 4))):
                t = t - {rng.choice(sorted(t))} if rng.random() < 0.5 and len(t) > 1 else t | drawn(1)
            sets.append(t)
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    found, rows, _ = _candidates(sets, group)
    assert want <= found
    assert rows <= sum(40 + 8 * len(s) for s in sets)  # in proportion to the words, however frequent they are


def test_candidates_stay_in_proportion():
    """Sets of one language: ten times the sets, not more candidates a set."""
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 1001)
    each = []
    for n in (600, 6000):
        sets = [set(rng.choice(1000, rng.integers(8, 18), p=share / share.sum()).tolist()) for _ in range(n)]
        each.append(_candidates(sets, 16)[2] / n)
    assert each[1] < 3 * each[0]


def test_near_groups(feats):
    keys = {i: min(v) for v in X.copies(ROWS).values() for i in v}
    links = {frozenset((keys[a], keys[b])) for a, b in X.near(ROWS)}
    group = {k: k for k in keys.values()}
    for _ in group:
        for a, b in map(tuple, links):
            group[a] = group[b] = min(group[a], group[b])
    want = {(i, k, sum(k in x for x in links), group[k]) for i, k in keys.items()}
    assert {tuple(r) for r in near.near_groups(feats).collect()} == want


def overlaps():
    side = {(i, s == "train") for i, s in PLAN if i is not None and s}
    linked = X.near(ROWS) | {p for v in X.copies(ROWS).values() for p in itertools.combinations(sorted(v), 2)}
    return {(a, b) for a, b in linked if ((a, True) in side and (b, False) in side) or ((a, False) in side and (b, True) in side)}


def test_overlap(feats, plan):
    assert pairs(overlap.overlap_pairs(feats, plan)) == overlaps()


def test_overlap_report(feats, plan):
    total = sum(r["n_pairs"] for r in overlap.overlap_report(feats.dropDuplicates(["row_id"]), plan).collect())
    assert total == len(overlaps())


def test_same_looking(feats):
    d = {r[0]: r[2] for r in ROWS if r[0] in X.live(ROWS)}
    want = {(a, b) for a, b in itertools.combinations(sorted(d), 2) if d[a] != d[b] and fold(d[a]) == fold(d[b])}
    assert pairs(consistent.same_looking_pairs(feats, "row_id")) == want
    forms = {r[0]: r[1] for r in consistent.consistent_texts(feats, "row_id").collect()}
    assert all(forms[r[0]] == (None if r[2] is None else fold(r[2])) for r in ROWS)


def test_group_ids(feats):
    page = {r[0]: r[1] for r in ROWS if r[1] and r[1].strip()}
    want = {(i, min(page[j] for j in g if j in page)) for g in X.groups(ROWS) if len(g) > 1 and any(j in page for j in g) for i in g}
    assert {tuple(r) for r in groups.group_ids(feats).collect()} == want


def test_torn_rows(feats, plan):
    side = {}
    for i, s in PLAN:
        if i is not None and s:
            side.setdefault(i, set()).add(s)
    want = {i for g in X.groups(ROWS) if len(set().union(*(side.get(j, set()) for j in g))) > 1 for i in g if i in side}
    assert {r[0] for r in splits.torn_rows(feats, plan).collect()} == want


def test_assigned_splits(spark, feats):
    got = {}
    for r in splits.assigned_splits(feats).collect():
        got.setdefault(r["row_id"], set()).add(r["split"])
    assert set(got) == {r[0] for r in ROWS if r[0] is not None} and all(len(s) == 1 for s in got.values())
    assert all(len(set().union(*(got[i] for i in g))) == 1 for g in X.groups(ROWS))
    many = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), (F.col("id") / 3).cast("int").cast("string")).alias("page_id"), F.lit(None).cast("string").alias("text"))
    share = {r["split"]: r["count"] / 20_000 for r in splits.assigned_splits(many).groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02


@pytest.mark.parametrize("shape", ["chain", "star", "ring", "two", "none"])
def test_both_component_algorithms(spark, shape):
    n = 150
    edges = {
        "chain": [(k, k + 1) for k in range(n)], "star": [(0, k) for k in range(1, n)], "ring": [(k, (k + 1) % n) for k in range(n)],
        "two": [(k, k + 2) for k in range(n)], "none": [],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long").select(F.md5(F.col("a").cast("string")).cast("binary").alias("u"), F.md5(F.col("b").cast("string")).cast("binary").alias("v"))
    df = df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    parts = {"chain": 1, "star": 1, "ring": 1, "two": 2, "none": 0}[shape]
    low = groups.low_diameter_components(df, Scratch(spark, "t"))
    forest, roots = groups.spanning_forest(df, Scratch(spark, "t"))
    vertices = len({x for e in edges for x in e})
    for c in (low, roots):
        assert c.count() == vertices and c.select("c").distinct().count() == parts
    assert forest.distinct().count() == vertices - parts


def test_empty_tables(spark):
    f = spark.createDataFrame([], X.SCHEMA)
    p = spark.createDataFrame([], "row_id long, split_name string")
    for df in (
        copies.copy_pairs(f), copies.collapsed(f), near.near_pairs(f), near.near_groups(f), overlap.overlap_pairs(f, p), overlap.overlap_report(f, p),
        consistent.same_looking_pairs(f, "row_id"), consistent.consistent_texts(f, "row_id"), groups.group_ids(f), splits.torn_rows(f, p), splits.assigned_splits(f), splits.forest_edges(f),
    ):
        assert df.count() == 0
