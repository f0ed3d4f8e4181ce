import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainsight.constants import SIGNALS
from plainsight.functions import labels, scoring, text
from plainsight.functions.signals import signals
from plainsight.operators import codes, components, corpus, metrics, scaling, splits
from plainsight.sources import readers, records


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("save 12.5% now", "save <num>.<pct> now"),
        ("17 days free", "<num><slot> free"),
        ("18 days free", "<num> days free"),
        ("$20% off", "<cur>% off"),
        ("Travel wallets", "<slot> <slot>s"),
        ("₹1,499.00 or $ 99", "<cur> or <cur>"),
        ("Tata cliq 7 DAYS", "<slot> <slot>"),
        ("  a \t b\n", "a b"),
        ("", ""),
        (None, None),
    ],
)
def test_skeleton(spark, raw, expected):
    assert one(spark, raw, text.skeleton) == expected


def test_signal_contract(spark):
    assert len(SIGNALS) == 12 and SIGNALS[0] == "urgency_kw_count" and SIGNALS[-1] == "time_reference_flag"
    rows = [("Hurry! Only 3 left, sale ends today?",), ("only 3\rhours",), ("only 3\nhours",), (None,), ("only ३ left",)]
    got = spark.createDataFrame(rows, "t string").select(*signals(F.col("t"))).collect()
    assert (got[0]["urgency_kw_count"], got[0]["scarcity_kw_count"], got[0]["exclamation_count"], got[0]["question_count"]) == (2, 1, 1, 1)
    assert got[1]["urgency_kw_count"] == 1 and got[2]["urgency_kw_count"] == 0
    assert all(v == 0 for v in got[3])
    assert got[4]["scarcity_kw_count"] == 0
    wide = spark.createDataFrame(rows, "t string").select(*signals(F.col("t"), unicode=True)).collect()
    assert wide[4]["scarcity_kw_count"] == 1


def test_clean_text(spark):
    for raw, clean in {
        "Only 3 left": "only left",
        "Today's deals Sponsored": "today deal sponsored",
        "Convenience fees": "convenience fee",
        "This venue does not support it.": "this venue doe not support it",
        "you cannot pre-select!": "you can not preselect !",
    }.items():
        assert one(spark, raw, text.clean_text) == clean


def test_label_map(spark):
    cases = [
        ("Urgency", "x", "False Urgency"), ("Misdirection", "No thanks, never", "Confirm Shaming"), ("Misdirection", "Yes, do", "Trick Question"),
        ("Misdirection", "plain", "Interface Interference"), ("Obstruction", "hotline", "Subscription Trap"), ("Obstruction", "x", "Interface Interference"),
        ("Sneaking", "a fee", "Drip Pricing"), ("Sneaking", "x", "Basket Sneaking"), ("Forced Action", None, "Forced Action"), (None, "x", "Not a Dark Pattern"),
    ]
    df = spark.createDataFrame([(c, t) for c, t, _ in cases], "c string, t string")
    assert [r[0] for r in df.select(labels.map_label(F.col("c"), F.col("t"))).collect()] == [x for *_, x in cases]


def test_abstention(spark):
    rows = [("False Urgency", 0.49), ("Not a Dark Pattern", 0.49), ("False Urgency", 0.5), ("Not a Dark Pattern", 0.5)]
    df = spark.createDataFrame(rows, "l string, s double")
    assert [r[0] for r in df.select(scoring.status(F.col("l"), F.col("s"))).collect()] == ["inconclusive", "inconclusive", "signal", "no_signal"]


def test_softmax_and_first_maximum(spark):
    r = spark.sql("select array(1.0D, 3.0D, 3.0D) as z").select(scoring.softmax(F.col("z")).alias("p")).select("p", scoring.argmax(F.col("p"))).first()
    assert abs(sum(r[0]) - 1) < 1e-12 and r[1] == 1


def test_corpus_keeps_first_of_earlier_source(spark):
    a = spark.createDataFrame([(5, "Act  NOW!", 1, "x"), (2, "ab", 1, "x"), (3, None, 1, "x"), (9, "₹₹₹", 0, "x")], "seq long, text string, label int, pattern_category string")
    b = spark.createDataFrame([(1, "act now", 0, "y"), (4, "…!!!", 0, "y"), (7, "new one", 0, "y")], a.schema)
    got = {(r["key"], r["seq"], r["source_rank"]) for r in corpus.build_corpus([a, b]).collect()}
    assert got == {("act now", 5, 0), ("", 9, 0), ("new one", 7, 1)}


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("kind", ["random", "chain", "empty"])
def test_components(spark, kind):
    rng = random.Random(7)
    n = 120
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)], "chain": [(k, k + 1) for k in range(n - 1)], "empty": []}[kind]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert [got.get(x, x) for x in range(n)] == union_find(n, edges)


def test_linked_rows(spark):
    rows = [(0, "p", "only 3 left"), (1, "p", "x"), (2, "q", "only 5 left"), (3, "r", "else"), (4, None, None), (5, " ", ""), (6, "only <num> left", "y")]
    df = spark.createDataFrame(rows, "row_id long, page_id string, text string")
    g = {r["row_id"]: r["group"] for r in components.linked_rows(df, "row_id", [F.col("page_id"), text.skeleton(F.col("text"))]).collect()}
    assert g == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_codes_are_dense_and_sorted(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "b", "ä", "c"]], "x string")
    assert {r["x"]: r["code"] for r in codes.factorised(df, "x").collect()} == {"a": 0, "b": 1, "c": 2, "ä": 3}


def test_macro_f1_counts_predicted_only_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b"), ("c", "b")], "y string, p string")
    r = metrics.summary(df).first()
    f1 = {"a": 2 / 3, "b": 2 / 3, "c": 0, "z": 0}
    assert math.isclose(r["macro_f1"], sum(f1.values()) / 4) and r["accuracy"] == 0.5
    assert metrics.MacroF1("y", "p").evaluate(df) == r["macro_f1"]


def test_grouped_folds_keep_groups(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(30), "ab"[rng.randrange(2)]) for k in range(300)]
    df = spark.createDataFrame(rows, "r long, g long, y string")
    folds = splits.grouped_folds(df, "r", "g", "y", k=3).join(df, "r")
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("c")).where("c > 1").count() == 0
    assert folds.groupBy("fold").agg(F.count_distinct("y").alias("c")).where("c = 2").count() == 3


def test_grouped_folds_deal_all_groups_by_class(spark):
    # class "rare" lives only in 150 groups of one row, far behind 2,200 groups of two
    rows = [(k, k // 2, "ab"[k % 2]) for k in range(4400)] + [(10_000 + k, 10_000 + k, "rare") for k in range(150)]
    rows += [(20_000 + k, 20_000 + k, "many") for k in range(3000)]
    df = spark.createDataFrame(rows, "r long, g long, y string")
    folds = splits.grouped_folds(df, "r", "g", "y").join(df, "r")
    assert folds.count() == len(rows) and folds.groupBy("g").agg(F.count_distinct("fold").alias("c")).where("c > 1").count() == 0
    for y, n in (("a", 2200), ("rare", 150), ("many", 3000)):
        held = [r["count"] for r in folds.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(held) == 5 and max(abs(h - n / 5) for h in held) <= max(1, n / 500)
    splits.validate_folds(folds, "g")
    with pytest.raises(splits.GateError):
        splits.validate_folds(folds.where("y <> 'rare' or fold > 0"), "g")


def test_split_gates(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "row_id long, group long")
    good = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "row_id long, side string")
    splits.validate_split(good, rows, "row_id")
    torn = spark.createDataFrame([(1, "train"), (2, "test"), (3, "test")], "row_id long, side string")
    short = good.where("row_id < 3")
    for bad in (torn, short):
        with pytest.raises(splits.GateError):
            splits.validate_split(bad, rows, "row_id")


def test_yeo_johnson_is_fitted_on_every_value(spark):
    """Beyond any number of distinct values, against the likelihood itself."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.exp(rng.normal(size=9000)), -np.exp(rng.normal(size=3000) - 1)])
    df = spark.createDataFrame([(float(v), 3.0, None) for v in x], "x double, constant double, none double")
    lam, mean, dev = scaling.power_parameters(df, ["x", "constant", "none"])["x"]

    def moved(v, lam):
        up, down = np.clip(v, 0, None), np.clip(-v, 0, None)
        return np.where(v >= 0, ((up + 1) ** lam - 1) / lam, -((down + 1) ** (2 - lam) - 1) / (2 - lam))

    def likelihood(lam):
        return -len(x) / 2 * np.log(moved(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    assert all(likelihood(lam) >= likelihood(lam + e) for e in (-1e-3, 1e-3))
    assert math.isclose(mean, moved(x, lam).mean(), rel_tol=1e-6) and math.isclose(dev, moved(x, lam).std(), rel_tol=1e-6)
    got = scaling.power_scaled(df, ["x", "constant", "none"]).agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("constant")), F.count("none")).first()
    assert abs(got[0]) < 1e-9 and math.isclose(got[1], 1, rel_tol=1e-9) and abs(got[2]) < 1e-9 and got[3] == 0


def test_strata_of_any_size_are_cut_exactly(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("r"), F.when(F.col("id") < 2500, "big").when(F.col("id") < 2990, "small").alias("y"))
    whole = {tuple(r) for r in splits.stratified(df, "r", "y").collect()}
    monkeypatch.setattr(codes, "DEALT", 40)
    cut = {tuple(r) for r in splits.stratified(df, "r", "y").collect()}
    assert whole == cut and len(cut) == 3000
    assert [sum(1 for r in cut if r[1] == y and r[2] == "test") for y in ("big", "small", None)] == [500, 98, 2]


def test_numbering_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] == r["n"] for r in codes.numbered(df, [F.col("x")]).collect())
    assert codes.numbered(df.limit(0), [F.col("x")]).count() == 0


def test_description_equals_pandas(spark):
    import pandas as pd

    x = [3.0, 1.0, 1.0, 7.5, 2.0, None, 9.0]
    df = spark.createDataFrame([(v, None) for v in x], "x double, y double")
    from plainsight.operators import describe

    got = {r["name"]: r.asDict() for r in describe.described(df, ["x", "y"]).collect()}
    want = pd.Series(x).describe()
    assert np.allclose([got["x"][k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")], want.to_numpy())
    assert got["y"]["count"] == 0 and got["y"]["q50"] is None


def test_oversampling_balances(spark):
    from plainsight.ml import models

    rows = [(k, [float(k % 5), float(k)], "big" if k < 12 else "small" if k < 19 else "single") for k in range(20)]
    df = spark.createDataFrame(rows, "r long, x array<double>, y string")
    got = {r["y"]: r["count"] for r in models.oversampled(df, "r", "x", "y").groupBy("y").count().collect()}
    assert got == {"big": 12, "small": 12, "single": 12}


def test_records(spark):
    ok = "p\tsome text\t1\tNagging"
    cases = [
        (1, ok, None), (2, ok + "\r\n", None), (3, '"a\tb"\t"x\n""y"""\t0\tNagging', None), (4, 'p\tx "q" y\t1\tNagging', None), (5, "\tx\t1\tNagging", None),
        (6, 'p\t"open\t1\tNagging', "quoting"), (7, 'p\t"a" b\t1\tNagging', "quoting"), (8, "p\tx\t1", "columns"), (9, ok + "\tz", "columns"),
        (10, "p\t  \t1\tNagging", "value"), (11, "p\tx\ttrue\tNagging", "value"), (12, "p\tx\t01\tNagging", "value"), (13, "p\tx\t1\tNaging", "value"),
        (14, None, "columns"), (15, "", "columns"), (16, 'p\t""\t1\tNagging', "value"), (17, 'p\t"' + "a" * 200_000 + '"\t1\tNagging', None),
        (18, 'p\t"' + 'x""' * 20_000 + '"\t1\tNagging', None), (19, "\t" * 3000, "columns"), (20, ok + "\n\n", "value"), (21, 'p\tx\t"1"\tNagging', None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "line_id long, text string").withColumn("reason", F.lit("clash")).withColumn("label", F.lit(7))
    kinds = spark.createDataFrame([("Nagging",), ("Nagging",), (None,)], "label string")
    got = {r["line_id"]: r["reason"] for r in records.parse_records(df, kinds).collect()}
    assert got == {a: c for a, _, c in cases}
    rows = {r["line_id"]: r for r in records.loaded(df, kinds).collect()}
    assert (rows[3]["page_id"], rows[3]["text"], rows[3]["label"]) == ("a\tb", 'x\n"y"', 0) and rows[5]["page_id"] == ""
    assert len(rows[18]["text"]) == 40_000
    assert records.rejected(df.limit(0), kinds).count() == 0


def test_files_come_back(spark, tmp_path):
    rows = [("p", 'a "quoted", text\nof two lines', "c", "u"), (None, "x", "c", None)]
    df = spark.createDataFrame(rows, readers.COLLECTED)
    readers.write_csv(df, str(tmp_path / "csv"))
    readers.gate_equal(df, readers.read_csv(spark, str(tmp_path / "csv"), readers.COLLECTED))
    (tmp_path / "x.tsv").write_text("page_id\ttext\tlabel\tpattern_category\np\tone\t1\tNagging\np\ttwo\t1\tNagging\textra\n")
    assert [r["text"] for r in readers.read_tsv(spark, str(tmp_path / "x.tsv")).collect()] == ["one"]
    with pytest.raises(splits.GateError):
        readers.gate_unique(df, F.col("source"))


def test_streaming_screens(spark, sf, tmp_path):
    from plainsight.streaming import screens

    src = spark.read.parquet(f"{sf}/features.parquet").select("row_id", "text", "source", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in {"screened": screens.screened(stream), "first": screens.first_arrivals(stream)}.items():
        run = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert spark.table("screened").count() == src.count()
    assert 0 < spark.table("first").count() <= src.count()


def test_content_hash_follows_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "row_id long, t string")
    b = spark.createDataFrame([(2, "x"), (1, "y"), (3, None)], a.schema)
    h = [splits.content_hash(d, "row_id", ["t"]).first()[0] for d in (a, a.repartition(3), b, a.na.fill("-"))]
    assert h[0] == h[1] and len({h[0], h[2], h[3]}) == 3


def test_calibration_is_monotone(spark):
    from plainsight.ml import models

    rng = random.Random(4)
    rows = []
    for _ in range(400):
        y = rng.randrange(3)
        rows.append(([rng.gauss(2.0 if c == y else -1.0, 1.5) for c in range(3)], y))
    df = spark.createDataFrame(rows, "margins array<double>, y int")
    fit = models.calibrated(df, 3)
    assert all(a > 0 for a, _ in fit)
    got = models.probabilities(df, fit).select("probs", "y").collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in got)
    assert sum(max(range(3), key=lambda c: r["probs"][c]) == r["y"] for r in got) > 280


def _rows(rng, n, width, k):
    from plainsight.ml import linear

    y = rng.integers(0, k, n)
    idx = [np.unique(np.concatenate([rng.integers(0, width, 6), [c * 3, c * 3 + 1]])) for c in y]
    return linear.Rows.of(idx, [rng.random(len(i)) for i in idx]), y


def test_svm_reaches_the_optimum():
    from plainsight.ml import linear

    rng = np.random.default_rng(1)
    rows, y = _rows(rng, 90, 40, 3)
    dense = np.zeros((90, 41))
    dense[np.repeat(np.arange(90), np.diff(rows.at)), rows.idx] = rows.val
    dense[:, -1] = 1
    products = linear.gram(rows)
    assert np.allclose(products, dense @ dense.T, atol=1e-4)
    w = linear.weights_of(rows, linear.linear_svm(products, linear.plain(90), y, 3, 1.0, tol=1e-6), 40)
    assert np.allclose(linear.margins(rows, w), dense @ w)
    for c in range(3):
        s = np.where(y == c, 1, -1)
        grad = w[:, c] - 2 * dense.T @ (s * np.maximum(1 - s * (dense @ w[:, c]), 0))
        assert np.linalg.norm(grad) < 1e-3


def test_gram_beyond_the_dense_columns(monkeypatch):
    from plainsight.ml import linear

    rows, _ = _rows(np.random.default_rng(2), 50, 300, 4)
    whole = linear.gram(rows)
    monkeypatch.setattr(linear, "_DENSE", 5)
    assert np.allclose(linear.gram(rows), whole, atol=1e-4)


def test_oversampled_mix_lies_between_neighbours():
    from plainsight.ml import linear

    rows, y = _rows(np.random.default_rng(3), 60, 40, 3)
    y[:40], y[40:59], y[59] = 0, 1, 2
    products = linear.gram(rows)
    mix, label = linear.oversampled_mix(products, y)
    assert np.bincount(label).tolist() == [40, 40, 40] and (mix.base[:60] == np.arange(60)).all()
    length = np.diagonal(products).astype(float)
    for b, o, c in zip(mix.base[60:], mix.other[60:], label[60:]):
        assert y[b] == y[o] == c
        if c == 1:
            d = {j: round(length[b] + length[j] - 2 * products[b, j], 4) for j in np.flatnonzero(y == 1) if j != b}
            assert d[o] <= sorted(d.values())[4] + 1e-3


def _labelled(spark, n=90):
    rng = random.Random(2)
    words = {"a": "hurry sale ends", "b": "cookie policy accept", "c": "cancel by phone only"}
    rows = []
    for k in range(n):
        y = "abc"[k % 3]
        x = " ".join(rng.sample(words[y].split(), 2) + rng.sample("the of and to page now item".split(), 3))
        rows.append((k, x, x, y, k % 3 + (k // 3) % 2, *[rng.randrange(3) for _ in SIGNALS]))
    return spark.createDataFrame(rows, "row_id long, text string, clean_text string, pattern_category string, fold int, " + ", ".join(f"{c} int" for c in SIGNALS))


def test_selection_calibration_and_files(spark, tmp_path):
    from plainsight.ml import models

    df = _labelled(spark).withColumn("fold", F.floor(F.col("row_id") / 3) % 2)
    names = models.class_names(df)
    ranked = models.selected_cost(df, names, grid=(0.5, 2.0))
    assert len(ranked) == 2 and ranked[0][1] >= ranked[1][1] > 0.8
    model = models.fitted_model(df, names, ranked[0][0])
    out = models.predicted(df, model)
    got = {r["row_id"]: r["probs"] for r in out.collect()}
    assert len(got) == 90 and all(abs(sum(p) - 1) < 1e-9 for p in got.values())
    assert sum(names[max(range(3), key=lambda c: p[c])] == "abc"[k % 3] for k, p in got.items()) > 80
    models.save(spark, model, str(tmp_path / "model"))
    again = {r["row_id"]: r["probs"] for r in models.predicted(df, models.load(spark, str(tmp_path / "model"))).collect()}
    assert again == got
    assert models.predicted(df.limit(0), model).count() == 0


def test_features_are_exact_and_fitted_on_train(spark):
    from collections import Counter

    from plainsight.ml import models

    texts = ["buy buy now", "buy later", "now or later", "unseen zzz now"]
    rows = [(k, x, *[(k + c) % 3 for c in range(12)]) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, text string, " + ", ".join(f"{c} int" for c in SIGNALS)).withColumn("t", F.col("row_id") < 3)
    counts = models.counted(df, models.CURRENT, "row_id", ["t"])
    fitted = models.fit_features(df, counts, models.CURRENT, ["t"])
    width = fitted[0].width
    got = {}
    for r in models.vectors(df, counts, fitted).collect():
        got[r["row_id"]] = np.zeros(width)
        got[r["row_id"]][r["idx"]] = r["val"]
    grams = [Counter(p[i : i + n] for w in x.split() for p in [f" {w} "] for n in range(2, 7) for i in range(len(p) - n + 1)) for x in texts]
    seen = Counter(g for c in grams[:3] for g in c)
    vocab = sorted(g for g, c in seen.items() if c >= 2)
    for k, c in enumerate(grams):
        w = np.array([(1 + math.log(c[g])) * (math.log(4 / (1 + seen[g])) + 1) if c[g] else 0.0 for g in vocab])
        assert len(got[k]) == len(vocab) + 12 and np.allclose(got[k][:-12], w / np.linalg.norm(w))
    assert np.allclose(np.mean([got[k][-12:] for k in range(3)], axis=0), 0)


def test_macro_f1_of_counts(spark):
    from plainsight.ml import models

    rows = [("a", "a"), ("a", "z"), ("b", "b"), ("c", "b")]
    table = [(ord(y), ord(p), 1) for y, p in rows]
    want = metrics.summary(spark.createDataFrame(rows, "y string, p string")).first()["macro_f1"]
    assert math.isclose(models.macro_f1(table), want) and models.macro_f1([]) == 0.0


def test_inflation_and_saved_splits(spark, tmp_path):
    from plainsight.operators import audit
    from plainsight.sources import readers

    r = audit.inflation(spark, [("m", 0.8, 0.6), ("none", 0.0, 0.0)]).collect()
    assert (r[0]["macro_f1_drop"], r[0]["relative_pct"]) == (0.2, 25.0) and r[1]["relative_pct"] is None
    # rows 0, 1, 2 are one group over a page and a template; row 3 stands apart
    rows = spark.createDataFrame([(0, "p", "Save 10% now"), (1, "p", "other words"), (2, "q", "Save 20% now"), (3, "r", "alone")], "row_id long, page_id string, text string")
    from plainsight.functions import text

    g = components.linked_rows(rows, "row_id", [F.col("page_id"), text.skeleton(F.col("text"))])
    assert {x["row_id"]: x["group"] for x in g.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    split = g.select("row_id", F.when(F.col("group") == 0, "train").otherwise("test").alias("side"))
    whole = rows.join(g, "row_id")
    saved = splits.content_hash(whole, "row_id", ["page_id", "text"]).first()[0]
    splits.validate_saved(split, saved, whole, "row_id", ["page_id", "text"])
    with pytest.raises(splits.GateError):
        splits.validate_saved(split, saved, whole.withColumn("text", F.lower("text")), "row_id", ["page_id", "text"])
    assert readers.read_optional(spark, str(tmp_path / "absent.csv"), readers.COLLECTED).count() == 0
    assert len(readers.read_classes(spark, str(tmp_path / "absent.json"))) == 14
    (tmp_path / "map.json").write_text('{"classes": ["x", "y"], "max_length": 64}')
    assert readers.read_classes(spark, str(tmp_path / "map.json")) == ["x", "y"]
    readers.write_text(spark.createDataFrame([("a",), ("b",)], "value string"), str(tmp_path / "t"))
    assert sorted(x[0] for x in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_windowed_stream(spark, sf, tmp_path):
    from plainsight.streaming import screens

    src = spark.read.parquet(f"{sf}/features.parquet").select("text", "source", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = screens.windowed_signals(stream, "urgency_kw_count")
    run = out.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("windows").where("n_signal > n").count() == 0
