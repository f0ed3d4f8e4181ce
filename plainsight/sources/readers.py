"""Readers and sinks with declared schemas, and gates on what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.constants import CLASSES, SIGNALS
from plainsight.operators.splits import GateError

CORPUS = "page_id string, text string, label int, pattern_category string"
COLLECTED = "text string, pattern_category string, source string, url string"
SPLIT = "train array<bigint>, test array<bigint>, seed int, grouping string, dataset_sha256 string"
LABEL_MAP = "classes array<string>, max_length int"


def features_schema(head: str = CORPUS) -> str:
    return f"{head}, clean_text string, " + ", ".join(f"{s} int" for s in SIGNALS)


def read_tsv(spark: SparkSession, path: str, schema: str = CORPUS, bad: str = "skip") -> DataFrame:
    """``bad``: "skip" drops records of too many fields (short ones are padded with nulls), "fail" stops."""
    if bad == "fail":
        return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)
    rows = (
        spark.read.schema(f"{schema}, _extra string, _corrupt string").option("sep", "\t").option("header", True)
        .option("enforceSchema", True).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    )
    return rows.where("_extra is null").drop("_extra", "_corrupt")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold separators, doubled quotes and line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A source that may be missing: then an empty table of its schema."""
    return read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_classes(spark: SparkSession, path: str) -> list[str]:
    """Class names of a saved label map, or the built-in ones where there is none or it names no class."""
    if exists(spark, path):
        found = read_json_document(spark, path, LABEL_MAP).head(1)
        if found and found[0]["classes"]:
            return list(found[0]["classes"])
    return list(CLASSES)


def write_text(lines: DataFrame, path: str) -> None:
    """One string column as lines of text."""
    lines.write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Every row as one JSON document."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def gate_schema(df: DataFrame, schema: str) -> None:
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [tuple(x.strip().rsplit(" ", 1)) for x in schema.split(",")]
    if have != want:
        raise GateError(f"schema is {have}, not {want}")


def gate_unique(df: DataFrame, key) -> None:
    if df.groupBy(key.alias("k")).count().where("count > 1").head(1):
        raise GateError("a key occurs twice")


def gate_equal(a: DataFrame, b: DataFrame) -> None:
    """Equal as bags of rows: what was written is what is read back."""
    if a.exceptAll(b).head(1) or b.exceptAll(a).head(1):
        raise GateError("the tables differ")
