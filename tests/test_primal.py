"""Models of more rows than products of every two of them can serve."""

import numpy as np
from pyspark.sql import functions as F

from plainsight.ml import linear, models, primal
from tests.test_operators import _labelled


def _rows(rng, n=400, width=60, k=3, numbers=2):
    y = np.sort(rng.integers(0, k, n) * rng.integers(0, 2, n))
    idx = [np.append(np.unique(rng.integers(0, width, 8)), [*range(width, width + numbers)]) for _ in y]
    val = [np.append(rng.random(len(i) - numbers), rng.integers(0, 3, numbers) * 0.7) for i in idx]
    rows = linear.Rows.of(idx, val)
    width += numbers
    return primal.Blocks([primal.packed(rows.take(np.arange(lo, min(lo + 90, n))), width) for lo in range(0, n, 90)], width), y


def test_nearest_rows_are_those_of_all_pairs(monkeypatch):
    rows, _ = _rows(np.random.default_rng(1))
    whole = rows.whole()
    products = linear.gram(whole).astype(float)
    d = np.round(np.diagonal(products)[:, None] + np.diagonal(products) - 2 * products, 4)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5]
    for small, tile, dense in ((0, 30, 10), (100, 2048, 1000), (45, 64, 5)):
        for name, value in (("SMALL", small), ("TILE", tile), ("DENSE", dense), ("ASK", 25)):
            monkeypatch.setattr(primal, name, value)
        near = primal.nearest(whole, 2)
        assert all(len({*x, i}) == 6 for i, x in enumerate(near.tolist()))
        assert np.allclose(np.take_along_axis(d, near, 1), want, atol=2e-4)
    assert primal.nearest(whole.take(np.arange(3)), 2).shape == (3, 2)


def test_steps_in_the_weights_reach_the_optimum(monkeypatch):
    rows, y = _rows(np.random.default_rng(2))
    whole = rows.whole()
    products = linear.gram(whole)
    mix, label = linear.oversampled_mix(products, y)
    mine, own = primal.oversampled_mix(rows, y, 2)
    assert own.tolist() == label.tolist() and mine.base.tolist() == mix.base.tolist() and np.mean(mine.other == mix.other) > 0.99
    monkeypatch.setattr(primal, "SEEN", 20)  # begins on fewer rows, and scales its steps by some
    for weight in (None, np.array([0.5, 1.0, 2.0])):
        want = linear.linear_svms(products, mine, label, 3, [0.5, 2.0], weight, tol=1e-5)
        got = primal.svm_weights(rows, mine, label, 3, [0.5, 2.0], weight, tol=1e-5)
        for beta, w in zip(want, got):
            assert np.allclose(products @ beta, linear.margins(whole, w), atol=1e-2)


def test_fits_learn_from_all_rows_and_score_all(spark, monkeypatch):
    df = _labelled(spark).withColumn("fold", F.floor(F.col("row_id") / 3) % 2)

    def margins():
        fits = models.Fits(df, models.fold_parts("fold", 2), ["a", "b", "c"], models.CURRENT)
        return {(r["part"], r["c"], r["row_id"]): r["margins"] for r in fits.margins([0, 1], [1.0, 2.0]).collect()}

    want = margins()
    monkeypatch.setattr(models, "FIT_ROWS", 10)  # a part has 45 rows to learn from
    got = margins()
    assert len(got) == 180 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=0.05) for k in want)


def test_selection_and_refits_learn_from_all_rows(spark, monkeypatch):
    df = _labelled(spark).withColumn("fold", F.floor(F.col("row_id") / 3) % 2)

    def selected():
        fits = models.Fits(df, [*models.fold_parts("fold", 2), models.whole_part(F.col("row_id") < 60), models.whole_part()], ["a", "b", "c"], models.CURRENT)
        return models.ranked(fits, [0, 1]), fits.models({2: [0, 1], 3: [0, 1]}, 1.0)

    ranks, want = selected()
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    again, got = selected()
    assert np.allclose(sorted(again), sorted(ranks), atol=0.05)
    for k, m in got.items():
        assert np.allclose(m.weights, want[k].weights, atol=0.05) and np.allclose(m.sigmoids, want[k].sigmoids, atol=0.2)
