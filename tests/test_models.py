"""Parts of the screening model that its speed rests on."""

import numpy as np
from pyspark.sql import functions as F

from plainsight.constants import SIGNALS
from plainsight.ml import linear, models
from tests.test_operators import _labelled, _rows

TEXTS = ["Buy buy now", "buy\tlater  ÉTÉ été", "now or later", "", "unseen zzz now ₹5", "buy now 👍 later"]


def _table(spark):
    rows = [(k, x, x.lower(), *[(k * c) % 3 - 1 for c in range(len(SIGNALS))]) for k, x in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "row_id long, text string, clean_text string, " + ", ".join(f"{c} int" for c in SIGNALS))
    return df.withColumns({"a": F.col("row_id") < 9, "b": F.col("row_id") % 2 == 0})


def test_one_pass_counts_as_the_terms_of_rows_do(spark, monkeypatch):
    monkeypatch.setattr(models, "_HELD", 3)
    df = _table(spark)
    for recipe in (models.CURRENT, models.LEGACY):
        by = models.counted(df, recipe, "row_id", ["a", "b"]).groupBy("term").agg(*[x for f in ("a", "b") for x in (F.count_if(f), F.coalesce(F.sum(F.when(F.col(f), F.col("tf"))), F.lit(0)))])
        want = {tuple(r) for r in by.collect() if any(r[1:])}
        assert {tuple(r) for r in models.tallied(df, recipe, ["a", "b"]).collect()} == want


def test_workers_vectors_are_those_of_expressions(spark):
    df = _table(spark)
    for recipe in (models.CURRENT, models.LEGACY):
        counts = models.counted(df, recipe, "row_id", ["a", "b"])
        fitted = models.features_of(df, models.tallied(df, recipe, ["a", "b"]), recipe, ["a", "b"])
        want = {(r["part"], r["row_id"]): (r["idx"], r["val"]) for r in models.vectors(df, counts, fitted).collect()}
        mine = df.select("row_id", recipe.pieces.alias("p"), F.array(*[F.col(x).cast("double") for x in SIGNALS]).alias("n")).collect()
        for k, f in enumerate(fitted):
            rows = models.local_vectors(f.plain)([r["p"] for r in mine], [r["n"] for r in mine])
            for i, r in enumerate(mine):
                at = slice(rows.at[i], rows.at[i + 1])
                idx, val = want[k, r["row_id"]]
                assert rows.idx[at].tolist() == idx and np.allclose(rows.val[at], val)


def test_costs_side_by_side_reach_each_optimum():
    rows, y = _rows(np.random.default_rng(4), 120, 40, 3)
    products = linear.gram(rows)
    mix, label = linear.oversampled_mix(products, y)
    many = linear.linear_svms(products, mix, label, 3, [0.5, 2.0], tol=1e-6)
    for c, beta in zip((0.5, 2.0), many):
        assert np.allclose(products @ beta, products @ linear.linear_svm(products, mix, label, 3, c, tol=1e-6), atol=1e-3)


def test_selection_and_refits_read_the_texts_once(spark, monkeypatch):
    seen, real = [], models.tallied
    monkeypatch.setattr(models, "tallied", lambda *a: seen.append(a) or real(*a))
    df = _labelled(spark).withColumn("fold", F.floor(F.col("row_id") / 3) % 2)
    fits = models.Fits(df, [*models.fold_parts("fold", 2), models.whole_part(F.col("row_id") < 60), models.whole_part()], ["a", "b", "c"], models.CURRENT)
    assert models.ranked(fits, [0, 1])[0][1] > 0.8
    made = fits.models({2: [0, 1], 3: [0, 1]}, 1.0)
    assert len(seen) == 1 and made[2].weights.tolist() != made[3].weights.tolist()
    assert fits.margins([0, 1], [1.0]).count() == 90  # a row for each that a fold holds out


def test_vocabulary_of_frequent_words_is_that_of_all_terms(spark):
    from dataclasses import replace

    df = _table(spark)
    for size in (1, 2, 4):
        recipe = replace(models.LEGACY, size=size)
        counts = models.counted(df, recipe, "row_id", ["a", "b"])
        want = models.fit_features(df, counts, recipe, ["a", "b"])
        got = models.features_of(df, models.tallied(df, recipe, ["a", "b"]), recipe, ["a", "b"])
        assert [f.vocabulary for f in got] == [f.vocabulary for f in want]
    assert models.tallied(df, replace(models.LEGACY, size=1), ["a", "b"]).count() < models.tallied(df, models.LEGACY, ["a", "b"]).count()


def test_probes_count_groups_of_equal_rows(spark):
    rows = [("a" if k % 3 else "b", "test" if k % 5 == 0 else "train", float(k % 3 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "pattern_category string, side string, sign double")
    jobs = []
    real, models.LogisticRegression = models.LogisticRegression, lambda **k: jobs.append(k) or real(**k)
    try:
        assert models.probe(df, "sign", ["sign"]) == ("sign", 1.0)
    finally:
        models.LogisticRegression = real
    assert len(jobs) == 1
    grouped = df.groupBy("pattern_category", "side", "sign").count()
    assert grouped.count() == 4


def test_trees_learn_from_weighted_rows(spark):
    df = _labelled(spark).withColumn("naive", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    df = df.withColumn("side", F.when(F.col("row_id") < 20, "test").otherwise("train")).drop("fold")
    twice = df.unionByName(df.withColumn("row_id", F.col("row_id") + 1000))
    from plainsight.session import Scratch

    flagged = twice.withColumn("_t", F.col("naive") == "train")
    (groups,) = models.grouped_vectors(flagged, ["_t"], models.LEGACY, Scratch(spark, "test"))
    assert groups.agg(F.sum("n"), F.min("n")).first()[:] == (180, 2)
    assert all(x > 0.7 for x in models.tree_baseline(twice, ["naive", "side"], trees=20, depth=5))
