"""Classification metrics from one pass of grouped counts."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """Long form: every pair of true and predicted label with its rows."""
    return df.groupBy(F.col(true).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: list[str], true: str = "y", pred: str = "p") -> DataFrame:
    """Dense: one row per label in the given order of columns, zeros where nothing fell."""
    spark = df.sparkSession
    wide = df.groupBy(F.col(true).alias("y")).pivot(pred, labels).count()
    return spark.createDataFrame([(x,) for x in labels], "y string").join(wide, "y", "left").na.fill(0)


def class_report(df: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per label of either side; divisions by zero give 0."""
    c = confusion(df, true, pred)
    sides = c.select(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"))
    sides = sides.unionByName(c.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")))
    by = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))

    return by.select(
        "label",
        ratio("tp", F.col("claimed")).alias("precision"),
        ratio("tp", F.col("support")).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("claimed")), F.lit(0.0)).alias("f1"),
        "support",
    )


def report_totals(df: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """The report's last lines: accuracy, and precision, recall and F1 averaged over labels, plainly and by support."""
    r = class_report(df, true, pred)
    hits = df.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("h"), F.count("*").alias("support"))
    weighed = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")]
    plain = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    return (
        hits.select(F.lit("accuracy").alias("label"), F.col("h").alias("precision"), F.col("h").alias("recall"), F.col("h").alias("f1"), "support")
        .unionByName(r.agg(*plain, F.sum("support").alias("support")).withColumn("label", F.lit("macro avg")))
        .unionByName(r.agg(*weighed, F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg")))
    )


def summary(df: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """Accuracy, macro F1 over the union of true and predicted labels, and the weighted F1."""
    r = class_report(df, true, pred)
    hits = df.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))
    scores = r.agg(
        F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")
    )
    return hits.crossJoin(scores)  # one row each


def covered(df: DataFrame, score: str, true: str = "y", pred: str = "p", threshold: float = 0.5) -> DataFrame:
    """Share of rows whose score reaches the threshold, and the accuracy among them."""
    sure = F.col(score) >= threshold
    return df.agg(
        F.avg(sure.cast("double")).alias("coverage"),
        F.avg(F.when(sure, (F.col(true) == F.col(pred)).cast("double"))).alias("accuracy_covered"),
    )


class MacroF1(Evaluator):
    """For model selection: macro F1 over the union of labels."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return summary(dataset, self.label, self.prediction).first()["macro_f1"]

    def isLargerBetter(self) -> bool:
        return True
