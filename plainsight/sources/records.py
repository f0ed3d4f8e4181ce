"""Loading undivided tab-separated records, with the reason for every record that cannot be loaded (problem 6).

Records are read permissively under an explicit schema that keeps the raw text of corrupt ones. Records the
reader rejects, and those whose quotes or line breaks it may have read its own way, are then classified by
walking their fields: quoting, number of columns, values, in this order.

Defined cases: a null record fails by ``columns``; an empty one has one field and fails by ``columns``; line
breaks inside an unquoted field are text; one line end that closes the record is dropped. Everything runs in
the JVM and needs no shuffle but the lookup of the categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["page_id", "text", "label", "pattern_category"]
_SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", _corrupt string"
_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
_WALK = "struct<open: boolean, bad: boolean, n: int, buf: string, fields: array<string>>"


def walked_fields(record: Column) -> Column:
    """Fields of a record by quoting rules: struct of bad (quoting), n (columns) and the first five fields."""

    def kept(s: Column, field: Column) -> Column:
        return F.when(F.size(s["fields"]) < len(FIELDS) + 1, F.concat(s["fields"], F.array(field))).otherwise(s["fields"])

    def state(opened, bad, n, buf, fields):
        return F.struct(opened.alias("open"), bad.alias("bad"), n.alias("n"), buf.alias("buf"), fields.alias("fields")).cast(_WALK)

    def step(s: Column, piece: Column) -> Column:
        quoted = s["open"] | piece.startswith('"')
        body = F.when(s["open"], piece).otherwise(F.substr(piece, F.lit(2)))
        at = F.instr(F.replace(body, F.lit('""'), F.lit("\x01\x01")), '"')
        ends = at > 0
        inner = F.when(ends, F.substr(body, F.lit(1), at - 1)).otherwise(body)
        text = F.concat(F.when(s["open"], F.concat(s["buf"], F.lit("\t"))).otherwise(""), F.replace(inner, F.lit('""'), F.lit('"')))
        closed = state(
            F.lit(False), s["bad"] | (at < F.length(body)), s["n"] + 1, F.lit(""), kept(s, text)
        )
        going = state(F.lit(True), s["bad"], s["n"], text, s["fields"])
        plain = state(F.lit(False), s["bad"], s["n"] + 1, F.lit(""), kept(s, piece))
        return F.when(~quoted, plain).when(ends, closed).otherwise(going)

    start = state(F.lit(False), F.lit(False), F.lit(0), F.lit(""), F.array().cast("array<string>"))
    end = F.aggregate(F.split(record, "\t", -1), start, step)
    return end


def parse_records(df: DataFrame, categories: DataFrame, record: str = "text") -> DataFrame:
    """All rows of ``df`` with struct ``loaded`` (null where the record fails) and ``reason`` (null where it loads).

    ``categories`` holds the valid names in its first column. Columns of ``df`` that bear one of these two names
    are replaced.
    """
    df = df.drop("loaded", "reason")
    closed = F.regexp_replace(F.col(record), r"(?:\r\n|\n|\r)\z", "")
    base = df.withColumn("_record", closed)
    read = base.withColumn("_read", F.from_csv("_record", _SCHEMA, _OPTIONS))
    doubtful = (
        F.col("_read._corrupt").isNotNull()
        | F.col("_record").contains('"')
        | F.col("_record").rlike(r"[\r\n]")
        | ~F.col("_record").contains("\t")  # the reader skips blank lines without calling them corrupt
    )
    seen = read.withColumn("_walk", F.when(doubtful, walked_fields(F.col("_record"))))
    faulty = F.coalesce(F.col("_walk.open") | F.col("_walk.bad"), F.lit(False))
    columns = F.when(F.col("_record").isNull(), 0).otherwise(F.coalesce("_walk.n", F.lit(len(FIELDS))))
    fields = [
        F.when(F.col("_walk").isNotNull(), F.try_element_at("_walk.fields", F.lit(k + 1))).otherwise(F.col(f"_read.{f}"))
        for k, f in enumerate(FIELDS)
    ]
    split = seen.select(
        *[F.col(f"`{c}`") for c in df.columns],
        faulty.alias("_faulty"),
        columns.alias("_columns"),
        F.struct(*[F.coalesce(x, F.lit("")).alias(f) for x, f in zip(fields, FIELDS)]).alias("_fields"),
    )
    valid = categories.select(F.col(categories.columns[0]).alias("_category")).distinct().withColumn("_known", F.lit(True))
    joined = split.join(valid, F.col("_fields.pattern_category") == F.col("_category"), "left")
    wrong = (
        F.col("_fields.text").rlike(r"(?U)^\s*$")
        | ~F.col("_fields.label").isin("0", "1")
        | F.col("_known").isNull()
    )
    reason = (
        F.when(F.col("_faulty"), "quoting").when(F.col("_columns") != len(FIELDS), "columns").when(wrong, "value")
    )
    return joined.withColumn("reason", reason).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(F.col("reason").isNull(), F.col("_fields")).alias("loaded"),
        "reason",
    )


def rejected(df: DataFrame, categories: DataFrame) -> DataFrame:
    return parse_records(df.select("line_id", "text"), categories).where("reason is not null").select("line_id", "reason")


def loaded(df: DataFrame, categories: DataFrame) -> DataFrame:
    rows = parse_records(df.select("line_id", "text"), categories).where("reason is null")
    return rows.select("line_id", "loaded.page_id", "loaded.text", F.col("loaded.label").cast("int").alias("label"), "loaded.pattern_category")


# DuckDB oracle: the same grammar as regular expressions.
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_CTE = rf"""
with r as (
  select line_id, regexp_replace(text, '(?:\r\n|\n|\r)\z', '') as rec from ccpa_dataset
), q as (
  select line_id, rec, regexp_full_match(rec, '{_FIELD}(?:\t{_FIELD})*') as sound,
    length(regexp_replace(rec, '(^|\t)"(?:[^"]|"")*"', '\1', 'g'))
      - length(replace(regexp_replace(rec, '(^|\t)"(?:[^"]|"")*"', '\1', 'g'), chr(9), '')) + 1 as n,
    regexp_extract(rec, '^({_FIELD})\t({_FIELD})\t({_FIELD})\t({_FIELD})$', ['p', 'a', 'b', 'c']) as f
  from r
), u as (
  select line_id, rec, sound, n, {", ".join(rf"""case when starts_with(f.{x}, '"') then replace(f.{x}[2:-2], '""', '"') else f.{x} end as {x}""" for x in "pabc")}
  from q
), v as (
  select *, case
    when rec is null then 'columns'
    when not sound then 'quoting'
    when n <> 4 then 'columns'
    when regexp_full_match(a, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]*')
      or b not in ('0', '1') or c not in (select label from guidance) then 'value'
  end as reason from u
)
"""
ORACLE = _CTE + "select line_id, reason from v where reason is not null"
ORACLE_LOADED = (
    _CTE + "select line_id, p as page_id, a as text, b::int as label, c as pattern_category from v where reason is null"
)
