"""Queries over the fitted models. No SQL fits them; tests check their parts, and what must hold of every result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.constants import SIGNALS
from plainsight.functions import scoring, text
from plainsight.functions.signals import with_signals
from plainsight.ml import models
from plainsight.operators import audit, metrics, splits
from plainsight.plans.general import _features, _groups, _skeletons, query
from plainsight.session import Scratch, spread, table


def _prepared(s, d) -> DataFrame:
    """Labelled rows with the signals and the clean text counted anew, and their page and template group."""
    f = with_signals(spread(_features(s, d).select("row_id", "text", "pattern_category").where("text is not null and pattern_category is not null")))
    f = f.select("row_id", "text", "pattern_category", text.clean_text(F.col("text")).alias("clean_text"), *SIGNALS)
    return Scratch(s, "prepared").save(f.join(_groups(s, d), "row_id"), "rows")


def _sides(f: DataFrame) -> DataFrame:
    """With ``side``: the first group-safe fold of five that holds every class is test."""
    side = splits.template_aware(f, "row_id", "group", "pattern_category")
    return Scratch(f.sparkSession, "sides").save(f.join(side, "row_id"), "rows")


def _folded(f: DataFrame, k: int) -> DataFrame:
    return f.join(splits.grouped_folds(f, "row_id", "group", "pattern_category", k), "row_id")


def _scored(out: DataFrame, model: models.Model, row: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in model.names]), models.leading(F.col("probs")) + 1)
    return out.select(row, name.alias("p"), F.array_max("probs").alias("score"))


def _selected(s, d, deployed: bool = False) -> tuple[DataFrame, list[models.Model]]:
    """Prepared rows with their side, and the model that selection on the training side's folds takes, calibrated.

    With ``deployed`` also the same model refitted on all rows. The features of all fits come from one pass.
    """
    rows = _sides(_prepared(s, d))
    train = rows.where("side = 'train'")
    names = models.class_names(rows)
    folds = [_folded(train, 5).select("row_id", F.col("fold").alias("f5")), _folded(train, 3).select("row_id", F.col("fold").alias("f3"))]
    if deployed:
        folds.append(_folded(rows.drop("side"), 3).select("row_id", F.col("fold").alias("f3_all")))
    data = rows
    for f in folds:
        data = data.join(f, "row_id", "left")
    on = F.col("side") == "train"
    parts = [*models.fold_parts("f5", 5, on), *models.fold_parts("f3", 3, on), models.whole_part(on)]
    wholes = {8: [5, 6, 7]}
    if deployed:
        parts += [*models.fold_parts("f3_all", 3), models.whole_part()]
        wholes[12] = [9, 10, 11]
    fits = models.Fits(data, parts, names, models.CURRENT)
    made = fits.models(wholes, models.ranked(fits, [*range(5)])[0][0])
    return rows, [made[k] for k in wholes]


@query("cv_selection", None)
def _(s, d):
    """Macro F1 of each cost over five group-safe folds of the training side, best first."""
    train = _sides(_prepared(s, d)).where("side = 'train'")
    return s.createDataFrame(models.selected_cost(_folded(train, 5), models.class_names(train)), "c double, macro_f1 double, deviation double")


@query("svm_macro_f1", None)
def _(s, d):
    """Accuracy and F1 of the selected, calibrated model on the group-safe test side."""
    rows, (model,) = _selected(s, d)
    test = rows.where("side = 'test'")
    out = _scored(models.predicted(test, model), model, "row_id").join(test.select("row_id", F.col("pattern_category").alias("y")), "row_id")
    return metrics.summary(out)


@query("calibrated_scores", None)
def _(s, d):
    """Every row of the test side with its leading class, calibrated probability, status and five best classes."""
    rows, (model,) = _selected(s, d)
    out = models.predicted(rows.where("side = 'test'"), model)
    best = scoring.top_classes(F.col("probs"), model.names)
    scored = _scored(out, model, "row_id").join(out.select("row_id", best.alias("best")), "row_id")
    return scored.select("row_id", F.col("p").alias("label"), "score", scoring.status(F.col("p"), F.col("score")).alias("status"), "best")


def _collected(s, d) -> DataFrame:
    o = table(s, d, "ood_real_test").where("text is not null").select("ood_id", "text", "pattern_category")
    o = with_signals(o)
    return o.select("ood_id", "text", "pattern_category", text.clean_text(F.col("text")).alias("clean_text"), *SIGNALS)


def _judged(out: DataFrame, rows: DataFrame, known: list[str]) -> DataFrame:
    """Scores of rows of a known class, beside that class."""
    y = rows.where(F.col("pattern_category").isin(known)).select("ood_id", F.col("pattern_category").alias("y"))
    return metrics.summary(out.join(y, "ood_id"))


@query("ood_macro_f1", None)
def _(s, d):
    """The collected texts under the selected model, and under the same model refitted on all rows for deployment."""
    _, (model, again) = _selected(s, d, deployed=True)
    o = _collected(s, d)
    each = [
        _judged(_scored(models.predicted(o, m, "ood_id"), m, "ood_id"), o, m.names).withColumn("model", F.lit(n))
        for n, m in (("selected", model), ("deployed", again))
    ]
    return each[0].unionByName(each[1])


@query("probe_scores", None)
def _(s, d):
    """Macro F1 that a balanced logistic model reaches from currency signs, text length and keywords alone."""
    rows = _sides(_prepared(s, d))
    t = F.col("text")
    data = rows.select("row_id", "side", "pattern_category", t.contains("$").cast("double").alias("dollar"), t.contains("₹").cast("double").alias("rupee"), F.length(t).cast("double").alias("length"))
    scores = [models.probe(data, name, columns) for name, columns in (("currency_symbol", ["dollar", "rupee"]), ("text_length", ["length"]))]
    return s.createDataFrame([*scores, models.keyword_probe(rows)], "probe string, macro_f1 double")


def _inflated(rows: DataFrame) -> list[tuple[str, float, float]]:
    """(model, macro F1 on the naive split, macro F1 on the group-safe split); ``rows`` has side."""
    naive = splits.stratified(rows, "row_id", "pattern_category").select("row_id", F.col("side").alias("naive"))
    data, names = rows.join(naive, "row_id"), models.class_names(rows)
    out = []
    for name, recipe in (("older words", models.LEGACY), ("characters", models.CURRENT)):
        parts = [models.Part(F.col(x) == "train", F.col(x) == "test", (recipe.c,)) for x in ("naive", "side")]
        table: dict[int, list] = {}
        for r in models.held_out(data, parts, names, recipe).groupBy("part", "y", models.leading(F.col("margins")).alias("p")).count().collect():
            table.setdefault(r["part"], []).append((r["y"], r["p"], r["count"]))
        out.append((name, models.macro_f1(table.get(0, [])), models.macro_f1(table.get(1, []))))
    return out


@query("inflation_table", None)
def _(s, d):
    """What a split that tears groups apart adds to each model's macro F1."""
    return audit.inflation(s, _inflated(_sides(_prepared(s, d))))


@query("tree_baseline", None)
def _(s, d):
    """The older features under trees, on the naive and on the group-safe split."""
    rows = _sides(_prepared(s, d))
    naive = splits.stratified(rows, "row_id", "pattern_category").select("row_id", F.col("side").alias("naive"))
    rows = Scratch(s, "treesides").save(rows.join(naive, "row_id"), "rows")
    return audit.inflation(s, [("older trees", *models.tree_baseline(rows, ["naive", "side"]))])


@query("model_comparison", None)
def _(s, d):
    """Models side by side on the group-safe test side and on the collected texts, best first."""
    rows = _sides(_prepared(s, d))
    train, test, o = rows.where("side = 'train'"), rows.where("side = 'test'"), _collected(s, d)
    names = models.class_names(rows)
    each = None
    for name, recipe in (("older words", models.LEGACY), ("characters", models.CURRENT)):
        m = models.fitted_model(_folded(train, 3), names, recipe.c, recipe)
        held = _scored(models.predicted(test, m), m, "row_id").join(test.select("row_id", F.col("pattern_category").alias("y")), "row_id")
        a = metrics.summary(held).select(F.lit(name).alias("model"), F.lit(m.fitted.width).alias("features"), F.col("accuracy").alias("test_accuracy"), F.col("macro_f1").alias("test_macro_f1"))
        b = _judged(_scored(models.predicted(o, m, "ood_id"), m, "ood_id"), o, names).select(F.lit(name).alias("model"), F.col("accuracy").alias("ood_accuracy"), F.col("macro_f1").alias("ood_macro_f1"))
        each = a.join(b, "model") if each is None else each.unionByName(a.join(b, "model"))
    return each.orderBy(F.desc("test_macro_f1"), "model")


@query("audit_report", None)
def _(s, d):
    """The whole audit as one document; stops where the group-safe split still leaks."""
    rows = _sides(_prepared(s, d))
    skeletons = _skeletons(s, d).select("row_id", "skeleton")
    t = F.col("text")
    data = rows.select("row_id", "side", "pattern_category", t.contains("$").cast("double").alias("dollar"), t.contains("₹").cast("double").alias("rupee"), F.length(t).cast("double").alias("length"))
    probes = [models.probe(data, name, columns) for name, columns in (("currency_symbol", ["dollar", "rupee"]), ("text_length", ["length"]))]
    return audit.report(rows.join(skeletons, "row_id"), _inflated(rows), [*probes, models.keyword_probe(rows)])
