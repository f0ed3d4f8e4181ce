"""Queries for the operators of the text screen, each with its oracle: name to (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsight import constants as C
from plainsight.functions import labels, scoring, text
from plainsight.functions.signals import signals, with_signals
from plainsight.operators import audit, codes, components, corpus, describe, metrics, sampling, scaling, splits, terms
from plainsight.session import Scratch, spread, table

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- pieces of SQL -------------------------------------------------------------------------------------------------


def _sql_count(low: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({low}, {_q(p)})::int" for p in patterns)


def _sql_flag(low: str, patterns: list[str]) -> str:
    return f"regexp_matches({low}, {_q('|'.join(patterns))})::int"


def sql_signals(raw: str) -> str:
    t, low = f"coalesce({raw}, '')", f"lower(coalesce({raw}, ''))"
    cells = [
        _sql_count(low, C.URGENCY), _sql_count(low, C.SCARCITY), _sql_flag(low, C.SHAME), _sql_count(low, C.CANCEL),
        _sql_flag(low, C.SOCIAL), _sql_flag(low, C.DRIP), _sql_flag(low, C.DISCOUNT), _sql_flag(low, C.NEG_OPTION),
        f"(length({t}) - length(replace({t}, '!', '')))::int", f"(length({t}) - length(replace({t}, '?', '')))::int",
        f"regexp_matches({t}, '[0-9]')::int", _sql_flag(low, [C.TIME_WORDS]),
    ]
    return ", ".join(f"{x} as {n}" for x, n in zip(cells, C.SIGNALS))


def sql_skeleton(raw: str) -> str:
    slots = "|".join(sorted({t.lower() for t in C.SLOT_TERMS}, key=lambda t: (-len(t), t)))
    s = f"lower({raw})"
    for pattern, mask in ((C.CURRENCY, "<cur>"), (C.PERCENT, "<pct>"), (slots, "<slot>"), (C.NUMBER, "<num>"), (r"\s+", " ")):
        s = f"regexp_replace({s}, {_q(pattern)}, {_q(mask)}, 'g')"
    return f"trim({s})"


def sql_key(raw: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({raw}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL_SIG = f"with sig as (select row_id, page_id, text as body, pattern_category as category, {sql_signals('text')} from features)"
SQL_SKEL = f"with sk as (select row_id, page_id, pattern_category, batch_id, {sql_skeleton('text')} as skeleton from features where text is not null)"


def _features(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "features")


def _recomputed(s: SparkSession, d: str) -> DataFrame:
    """Features with the signals counted anew (stored ones may be stale)."""
    return with_signals(spread(_features(s, d).select("row_id", "page_id", "text", "pattern_category", "label")))


def _skeletons(s: SparkSession, d: str) -> DataFrame:
    f = spread(_features(s, d).select("row_id", "page_id", "text", "pattern_category", "batch_id").where("text is not null"))
    return f.select("row_id", "page_id", "pattern_category", "batch_id", text.skeleton(F.col("text")).alias("skeleton"))


# --- signals -------------------------------------------------------------------------------------------------------


@query("signals12", f"{SQL_SIG} select row_id, {', '.join(C.SIGNALS)} from sig")
def _(s, d):
    return spread(_features(s, d).select("row_id", "text")).select("row_id", *signals(F.col("text")))


@query("signals12_ood", f"select ood_id, {sql_signals('text')} from ood_real_test")
def _(s, d):
    return table(s, d, "ood_real_test").select("ood_id", *signals(F.col("text")))


@query("signal_rates", f"{SQL_SIG} " + " union all ".join(f"select {_q(n)} as name, round(avg(({n} > 0)::int), 9) as rate from sig" for n in C.SIGNALS))
def _(s, d):
    return describe.signal_rates(_recomputed(s, d), C.SIGNALS).select("name", F.round("rate", 9).alias("rate"))


@query("mean_signals_by_class", f"{SQL_SIG} select category as pattern_category, " + ", ".join(f"round(avg({n}), 9) as {n}" for n in C.SIGNALS) + " from sig group by category")
def _(s, d):
    return _recomputed(s, d).groupBy("pattern_category").agg(*[F.round(F.avg(n), 9).alias(n) for n in C.SIGNALS])


@query("stale_signals", "with now as (select row_id, " + sql_signals("text") + " from features) " + " union all ".join(f"select {_q(n)} as name, count(*) as n_stale from features f join now using (row_id) where f.{n} is distinct from now.{n}" for n in C.SIGNALS))
def _(s, d):
    both = _features(s, d).select("text", *[F.col(n).alias(f"old_{n}") for n in C.SIGNALS]).select("*", *signals(F.col("text")))
    row = both.agg(*[F.count_if(~F.col(n).eqNullSafe(F.col(f"old_{n}"))).alias(n) for n in C.SIGNALS])
    return describe.unpivoted(row, C.SIGNALS, "n_stale")


# --- corpus --------------------------------------------------------------------------------------------------------


@query("normal_keys", f"select row_id, {sql_key('text')} as key from features")
def _(s, d):
    return _features(s, d).select("row_id", text.normalise(F.col("text")).alias("key"))


@query("keep_first", f"select key, row_id, source from (select *, row_number() over (partition by key order by row_id) as k from (select {sql_key('text')} as key, row_id, source from features where text is not null)) where k = 1")
def _(s, d):
    f = _features(s, d).where("text is not null").select(text.normalise(F.col("text")).alias("key"), "row_id", "source")
    return corpus.keep_first(f, "key", ["row_id"])


@query("duplicate_count", f"select count(*) - count(distinct coalesce(k, chr(1))) as n_duplicates from (select {sql_key('text')} as k from features)")
def _(s, d):
    return corpus.duplicate_count(_features(s, d), text.normalise(F.col("text")))


@query("corpus", f"""
with u as (
  select 0 as source_rank, row_id as seq, {SQL_STRIP.format("text")} as text, label, pattern_category from features
  where text is not null and pattern_category is not null and label is not null
  union all
  select 1, ood_id, {SQL_STRIP.format("text")}, (pattern_category <> 'Not a Dark Pattern')::int, pattern_category from ood_real_test
  where text is not null and pattern_category is not null
), k as (select *, {sql_key('text')} as key from u where length(text) >= 3)
select key, seq, text, label, pattern_category, source_rank from (
  select *, row_number() over (partition by key order by source_rank, seq) as n from k) where n = 1""")
def _(s, d):
    a = _features(s, d).select(F.col("row_id").alias("seq"), "text", "label", "pattern_category")
    o = table(s, d, "ood_real_test").select(F.col("ood_id").alias("seq"), "text", labels.binary_label(F.col("pattern_category")).alias("label"), "pattern_category")
    return corpus.build_corpus([a, o]).select("key", "seq", "text", "label", "pattern_category", "source_rank")


_TAXONOMY = ["Not Dark Pattern", "Urgency", "Scarcity", "Social Proof", "Misdirection", "Obstruction", "Sneaking", "Forced Action", "other"]


def _says(cues: list[str]) -> str:
    return "(" + " or ".join(f"contains(low, {_q(c)})" for c in cues) + ")"


@query("label_map", f"""
with x as (select row_id, lower(text) as low, ([{", ".join(_q(c) for c in _TAXONOMY)}])[(row_id % 9 + 1)::int] as cat from features where text is not null),
m as (select row_id, case
  when cat in ('Urgency', 'Scarcity') then 'False Urgency' when cat = 'Social Proof' then 'Disguised Advertisement'
  when cat = 'Misdirection' then case when {_says(labels.SHAME_CUES)} then 'Confirm Shaming' when {_says(labels.QUESTION_CUES)} then 'Trick Question' else 'Interface Interference' end
  when cat = 'Obstruction' then case when {_says(labels.CANCEL_CUES)} then 'Subscription Trap' else 'Interface Interference' end
  when cat = 'Sneaking' then case when {_says(labels.FEE_CUES)} then 'Drip Pricing' else 'Basket Sneaking' end
  when cat = 'Forced Action' then 'Forced Action' else 'Not a Dark Pattern' end as pattern_category from x)
select row_id, pattern_category, (pattern_category <> 'Not a Dark Pattern')::int as label from m""")
def _(s, d):
    cats = F.array(*[F.lit(c) for c in _TAXONOMY])
    f = _features(s, d).select("row_id", "text", F.element_at(cats, (F.col("row_id") % 9 + 1).cast("int")).alias("pattern_category"))
    return corpus.relabelled(f).select("row_id", "pattern_category", "label")


_COLUMNS = ["row_id", "page_id", "text", "label", "pattern_category", "clean_text", *C.SIGNALS, "source", "batch_id", "captured_at", "loaded_at"]


@query("null_counts", " union all ".join(f"select {_q(c)} as name, count(*) - count({c}) as n_null from features" for c in _COLUMNS))
def _(s, d):
    return describe.null_counts(_features(s, d).select(*_COLUMNS))


# --- skeletons, groups, leaks --------------------------------------------------------------------------------------


@query("skeletons", f"{SQL_SKEL} select row_id, skeleton from sk")
def _(s, d):
    return _skeletons(s, d).select("row_id", "skeleton")


@query("skeleton_stats", f"{SQL_SKEL} select count(*) as total_clusters, count_if(n > 1) as multi_row_clusters, max(n) as largest from (select count(*) as n from sk group by skeleton)")
def _(s, d):
    by = _skeletons(s, d).groupBy("skeleton").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("total_clusters"), F.count_if(F.col("n") > 1).alias("multi_row_clusters"), F.max("n").alias("largest"))


@query("skeleton_top5", f"{SQL_SKEL} select skeleton, count(*) as n from sk group by skeleton order by n desc, skeleton limit 5")
def _(s, d):
    return _skeletons(s, d).groupBy("skeleton").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skeleton").limit(5)


@query("batch_clusters", f"""{SQL_SKEL}, c as (select batch_id, count(*) as n_rows, count(distinct skeleton) as recounted from sk group by batch_id)
select audit_id, l.batch_id, l.skeleton_clusters.total_clusters as reported, c.recounted, c.n_rows from leak_audit l left join c using (batch_id)""")
def _(s, d):
    """The old audit's cluster counts beside recounted ones, per batch."""
    c = _skeletons(s, d).groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.count_distinct("skeleton").alias("recounted"))
    a = table(s, d, "leak_audit").select("audit_id", "batch_id", F.col("skeleton_clusters.total_clusters").alias("reported"))
    return a.join(c, "batch_id", "left").select("audit_id", "batch_id", "reported", "recounted", "n_rows")


SQL_GROUPS = f"""
with recursive k as (
  select row_id, case when page_id is not null and regexp_matches(page_id, '\\S') then 'p' || page_id end as p,
    case when text is not null and regexp_matches({sql_skeleton('text')}, '\\S') then 's' || {sql_skeleton('text')} end as t from features),
e as (select distinct p as a, t as b from k where p is not null and t is not null),
arcs as (select a, b from e union select b, a from e),
reach(node, root) as (
  select distinct p, p from k where p is not null union select distinct t, t from k where t is not null
  union select arcs.b, reach.root from reach join arcs on arcs.a = reach.node),
comp as (select node, min(root) as c from reach group by node),
g as (select row_id, coalesce(x.c, y.c, 'r' || row_id) as c from k left join comp x on x.node = k.p left join comp y on y.node = k.t),
"""


def _groups(s: SparkSession, d: str) -> DataFrame:
    f = spread(_features(s, d).select("row_id", "page_id", "text"))
    return components.linked_rows(f, "row_id", [F.col("page_id"), text.skeleton(F.col("text"))])


@query("connected_groups", SQL_GROUPS + "m as (select c, min(row_id) as first_row from g group by c) select row_id, first_row from g join m using (c)")
def _(s, d):
    return _groups(s, d).select("row_id", F.col("group").alias("first_row"))


@query("group_codes", SQL_GROUPS + "m as (select row_id, min(row_id) over (partition by c) as first_row from g) select row_id, dense_rank() over (order by first_row) - 1 as code from m")
def _(s, d):
    g = _groups(s, d)
    return g.join(codes.factorised(g, "group"), "group").select("row_id", "code")


@query("leak_by_skeleton", f"""{SQL_SKEL}, sp as (select distinct row_id, case when split_name = 'train' then 'train' else 'test' end as side from split_plan),
bg as (select skeleton, count_if(side = 'train') as t, count_if(side = 'test') as e from sk join sp using (row_id) group by skeleton)
select count_if(t > 0 and e > 0) as shared_groups, coalesce(sum(case when t > 0 and e > 0 then e end), 0)::bigint as leaked_test_rows, coalesce(sum(e), 0)::bigint as test_rows from bg""")
def _(s, d):
    sp = table(s, d, "split_plan").select("row_id", F.when(F.col("split_name") == "train", "train").otherwise("test").alias("side")).distinct()
    return splits.leak_count(_skeletons(s, d).join(sp, "row_id"), "skeleton")


@query("leak_by_source", """
with sp as (select distinct row_id, case when split_name = 'train' then 'train' else 'test' end as side from split_plan)
select source, count_if(side = 'train') as n_train, count_if(side = 'test') as n_test from features join sp using (row_id) where source is not null group by source""")
def _(s, d):
    sp = table(s, d, "split_plan").select("row_id", F.when(F.col("split_name") == "train", "train").otherwise("test").alias("side")).distinct()
    f = _features(s, d).where("source is not null").select("row_id", "source")
    return f.join(sp, "row_id").groupBy("source").agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"))


@query("stratified_split", """
with o as (select row_id, pattern_category, (row_id * 2654435761) % 4294967296 as o from features)
select row_id, pattern_category, case when row_number() over (partition by pattern_category order by o, row_id)
  <= floor(count(*) over (partition by pattern_category) * 0.2::double + 0.5::double) then 'test' else 'train' end as side from o""")
def _(s, d):
    order = (F.col("row_id") * 2654435761) % 4294967296
    return splits.stratified(_features(s, d), "row_id", "pattern_category", 0.2, order)


@query("grouped_folds", None)
def _(s, d):
    g = _groups(s, d).join(_features(s, d).select("row_id", "pattern_category"), "row_id")
    return splits.grouped_folds(g, "row_id", "group", "pattern_category")


def _grouped(s, d):
    return _groups(s, d).join(_features(s, d).select("row_id", "pattern_category"), "row_id")


@query("fold_summary", SQL_GROUPS + "k2 as (select row_id, c, pattern_category from g join features using (row_id)) select count(*) as n_rows, count(distinct c) as n_groups, 0::bigint as torn_groups, 5::bigint as n_folds, 0::bigint as missing_classes, 0::bigint as uneven_classes from k2")
def _(s, d):
    """What must hold of the folds: all rows and groups are there, none torn, no class of twenty groups or more misses a
    fold, and no class of small groups (none above a fiftieth of it) lies further than a fifth from even.
    """
    g = _grouped(s, d)
    f = Scratch(s, "foldcheck").save(splits.grouped_folds(g, "row_id", "group", "pattern_category").join(g, "row_id"), "folds")
    torn = f.groupBy("group").agg(F.count_distinct("fold").alias("k")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("torn_groups"))
    missing = splits.missing_classes(f, "group", "pattern_category").where("groups >= 20").agg(F.count("*").alias("missing_classes"))
    y = F.coalesce("pattern_category", F.lit(""))
    per = f.groupBy(y.alias("y"), "group").agg(F.count("*").alias("n"), F.first("fold").alias("fold"))
    whole = per.groupBy("y").agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    held = per.groupBy("y", "fold").agg(F.sum("n").alias("n")).join(whole, "y").where("largest * 50 <= total")
    uneven = held.where(F.abs(F.col("n") * 5 - F.col("total")) > F.col("total") * 0.2).agg(F.count_distinct("y").alias("uneven_classes"))
    rows = f.agg(F.count("*").alias("n_rows"), F.count_distinct("fold").alias("n_folds"))
    return rows.crossJoin(torn).crossJoin(missing).crossJoin(uneven)  # one row each


@query("template_split_leaks", "select 0::bigint as shared_groups, 0::bigint as leaked_test_rows, count(*) as n_rows from features")
def _(s, d):
    """Leaks of the group-safe split, and the rows it covers: no group is shared."""
    g = _grouped(s, d)
    side = Scratch(s, "sides").save(splits.template_aware(g, "row_id", "group", "pattern_category"), "sides")
    splits.validate_split(side, g, "row_id")
    return splits.leak_count(side.join(g, "row_id")).select("shared_groups", "leaked_test_rows").crossJoin(side.agg(F.count("*").alias("n_rows")))  # one row each


@query("content_hash", """
with l as (select sha256(concat_ws(chr(31), row_id::varchar, coalesce('=' || page_id, '-'), coalesce('=' || text, '-'), coalesce('=' || label, '-'), coalesce('=' || pattern_category, '-'))) as h from features)
select sha256(coalesce(sum(('0x' || h[1:15])::bigint)::hugeint, 0)::varchar) as content_sha256, count(*) as n_rows from l""")
def _(s, d):
    return splits.content_hash(_features(s, d), "row_id", ["page_id", "text", "label", "pattern_category"])


@query("leak_report", f"""{SQL_SKEL}, sp as (select distinct row_id, case when split_name = 'train' then 'train' else 'test' end as side from split_plan),
bg as (select skeleton, count(*) as n, count_if(side = 'train') as t, count_if(side = 'test') as e from sk left join sp using (row_id) group by skeleton)
select (select count(*) from features) as n_rows, (select count(distinct pattern_category) from features) as n_classes, count(*) as total_clusters,
  count_if(n > 1) as multi_row_clusters, count_if(t > 0 and e > 0) as cross_split_clusters, coalesce(sum(case when t > 0 and e > 0 then e end), 0)::bigint as leaked_test_rows,
  round(100 * sum(case when t > 0 and e > 0 then e end) / nullif(sum(e), 0), 9) as leaked_test_pct,
  (select list(n order by n desc, skeleton) from (select skeleton, count(*) as n from sk group by skeleton order by n desc, skeleton limit 5)) as largest_sizes from bg""")
def _(s, d):
    """One row of the audit: clusters, and what the plan in use leaks across its sides."""
    sp = table(s, d, "split_plan").select("row_id", F.when(F.col("split_name") == "train", "train").otherwise("test").alias("side")).distinct()
    by = _skeletons(s, d).join(sp, "row_id", "left").groupBy("skeleton").agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "test").alias("e")
    )
    torn = (F.col("t") > 0) & (F.col("e") > 0)
    hit = F.sum(F.when(torn, F.col("e")))
    clusters = by.agg(
        F.count("*").alias("total_clusters"), F.count_if(F.col("n") > 1).alias("multi_row_clusters"), F.count_if(torn).alias("cross_split_clusters"),
        F.coalesce(hit, F.lit(0)).alias("leaked_test_rows"), F.round(F.try_divide(100 * hit, F.sum("e")), 9).alias("leaked_test_pct"),
    )
    whole = _features(s, d).agg(F.count("*").alias("n_rows"), F.count_distinct("pattern_category").alias("n_classes"))
    return whole.crossJoin(clusters).crossJoin(audit.largest_clusters(_skeletons(s, d)).select(F.col("largest_clusters.n_rows").alias("largest_sizes")))  # one row each


@query("source_groups_shared", SQL_GROUPS + """
sp as (select distinct row_id, case when split_name = 'train' then 'train' else 'test' end as side from split_plan),
bg as (select c, count_if(side = 'train') as t, count_if(side = 'test') as e from g join sp using (row_id) group by c)
select count_if(t > 0 and e > 0) as shared_groups, coalesce(sum(case when t > 0 and e > 0 then e end), 0)::bigint as leaked_test_rows, coalesce(sum(e), 0)::bigint as test_rows from bg""")
def _(s, d):
    sp = table(s, d, "split_plan").select("row_id", F.when(F.col("split_name") == "train", "train").otherwise("test").alias("side")).distinct()
    return splits.leak_count(_groups(s, d).join(sp, "row_id"))


# --- metrics -------------------------------------------------------------------------------------------------------

_RULE = [("urgency_kw_count", "False Urgency"), ("cancel_diff_score", "Subscription Trap"), ("price_drip_flag", "Drip Pricing"), ("shame_phrase_flag", "Confirm Shaming"), ("neg_option_flag", "Basket Sneaking"), ("social_proof_flag", "Disguised Advertisement")]
SQL_PRED = f"{SQL_SIG}, yp as (select row_id, category as y, case " + " ".join(f"when {n} > 0 then {_q(c)}" for n, c in _RULE) + " else 'Not a Dark Pattern' end as p from sig where category is not null)"
SQL_REPORT = SQL_PRED + """, l as (select y as label from yp union select p from yp),
r as (select label, (select count(*) from yp where y = label and p = label) as tp, (select count(*) from yp where y = label) as support, (select count(*) from yp where p = label) as claimed from l)"""


def _predicted(s: SparkSession, d: str) -> DataFrame:
    f = _recomputed(s, d).where("pattern_category is not null")
    p = F.lit(C.BENIGN)
    for n, c in reversed(_RULE):
        p = F.when(F.col(n) > 0, c).otherwise(p)
    return f.select("row_id", F.col("pattern_category").alias("y"), p.alias("p"))


@query("confusion", SQL_PRED + " select y, p, count(*) as n from yp group by y, p")
def _(s, d):
    return metrics.confusion(_predicted(s, d))


@query("confusion_matrix", SQL_PRED + " select l.label as y, " + ", ".join(f'count_if(p = {_q(c)}) as "{c}"' for c in C.CLASSES) + " from (select unnest([" + ", ".join(_q(c) for c in C.CLASSES) + "]) as label) l left join yp on yp.y = l.label group by l.label")
def _(s, d):
    return metrics.confusion_matrix(_predicted(s, d), C.CLASSES)


@query("class_report", SQL_REPORT + " select label, round(coalesce(tp / nullif(claimed, 0), 0), 9) as precision, round(coalesce(tp / nullif(support, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(support + claimed, 0), 0), 9) as f1, support from r")
def _(s, d):
    r = metrics.class_report(_predicted(s, d))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("class_report_totals", SQL_REPORT + """, q as (select coalesce(tp / nullif(claimed, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2 * tp / nullif(support + claimed, 0), 0) as f1, support from r),
a as (select avg((y = p)::int) as h, count(*) as support from yp)
select 'accuracy' as label, round(h, 9) as precision, round(h, 9) as recall, round(h, 9) as f1, support::bigint as support from a
union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::bigint from q
union all select 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::bigint from q""")
def _(s, d):
    r = metrics.report_totals(_predicted(s, d))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("macro_f1", SQL_REPORT + ", f as (select coalesce(2 * tp / nullif(support + claimed, 0), 0) as f1, support from r) select round((select avg((y = p)::int) from yp), 9) as accuracy, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from f")
def _(s, d):
    return metrics.summary(_predicted(s, d)).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


# --- description ---------------------------------------------------------------------------------------------------

SQL_LEN = r"with n as (select length(text) as n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as n_words from features where text is not null)"


def _lengths(s, d):
    t = F.col("text")
    return _features(s, d).where("text is not null").select(F.length(t).alias("n_chars"), text.word_count(t).alias("n_words"))


@query("describe_lengths", SQL_LEN + " " + " union all ".join(f"select '{c}' as name, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as min, quantile_cont({c}, 0.25)::double as q25, quantile_cont({c}, 0.5)::double as q50, quantile_cont({c}, 0.75)::double as q75, max({c})::double as max from n" for c in ("n_chars", "n_words")))
def _(s, d):
    r = describe.described(_lengths(s, d), ["n_chars", "n_words"])
    return r.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("describe_signals", f"{SQL_SIG} " + " union all ".join(f"select '{c}' as name, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as min, quantile_cont({c}, 0.25)::double as q25, quantile_cont({c}, 0.5)::double as q50, quantile_cont({c}, 0.75)::double as q75, max({c})::double as max from sig" for c in C.SIGNALS))
def _(s, d):
    r = describe.described(_recomputed(s, d), C.SIGNALS)
    return r.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("correlations", f"{SQL_SIG} " + " union all ".join(f"select {_q(a)} as a, {_q(b)} as b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) as r from sig" for i, a in enumerate(C.SIGNALS) for b in C.SIGNALS[i + 1 :]))
def _(s, d):
    return describe.correlations(_recomputed(s, d), C.SIGNALS).withColumn("r", F.round("r", 6))


@query("category_counts", "select pattern_category, count(*) as n from features where pattern_category is not null group by pattern_category")
def _(s, d):
    return describe.value_counts(_features(s, d), "pattern_category")


@query("label_conflicts", "select row_id, label, pattern_category from features where label is not null and (label <> (pattern_category <> 'Not a Dark Pattern')::int)")
def _(s, d):
    c = F.col("pattern_category")
    return _features(s, d).where(F.col("label") != labels.binary_label(c)).select("row_id", "label", "pattern_category")


@query("currency_counts", "select count_if(contains(coalesce(text, ''), '$')) as n_dollar, count_if(contains(coalesce(text, ''), '₹')) as n_rupee from features")
def _(s, d):
    t = F.coalesce("text", F.lit(""))
    return _features(s, d).agg(F.count_if(t.contains("$")).alias("n_dollar"), F.count_if(t.contains("₹")).alias("n_rupee"))


@query("texts_by_category", "select distinct pattern_category, text from features where text is not null and pattern_category is not null")
def _(s, d):
    """The distinct texts of every class, in long form: a list of a hot class would not fit one row."""
    return _features(s, d).dropna(subset=["text", "pattern_category"]).select("pattern_category", "text").distinct()


@query("example_texts", "select pattern_category, list(text order by text)[1:5] as texts from (select distinct pattern_category, text from features where text is not null and pattern_category is not null) group by pattern_category")
def _(s, d):
    """The first five distinct texts of every class (a top-k report): each task keeps five a class."""
    f = _features(s, d).dropna(subset=["text", "pattern_category"]).select("pattern_category", "text").distinct()
    place = F.row_number().over(Window.partitionBy("pattern_category").orderBy("text"))
    return f.withColumn("place", place).where("place <= 5").groupBy("pattern_category").agg(F.array_sort(F.collect_list("text")).alias("texts"))


@query("top_sources", "select source, n, round(mean, 6) as mean from (select source, count(*) as n, avg(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', ''))) as mean from features where source is not null group by source) order by n desc, mean, source limit 5")
def _(s, d):
    """The sources of most rows with their mean of exclamation marks, counted anew."""
    f = _features(s, d).where("source is not null").select("source", *signals(F.col("text")))
    by = f.groupBy("source").agg(F.count("*").alias("n"), F.avg("exclamation_count").alias("mean"))
    return by.orderBy(F.desc("n"), "mean", "source").limit(5).withColumn("mean", F.round("mean", 6))


# --- terms ---------------------------------------------------------------------------------------------------------

SQL_TOKENS = "with t as (select row_id, unnest(regexp_extract_all(lower(text), '[a-z0-9₹$%]+|[!?]')) as token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9₹$%]+|[!?]'), 1) as pos from features where text is not null)"
SQL_VOCAB = SQL_TOKENS + ", v as (select token, row_number() over (order by r, a) + 1 as id from (select token, min(row_id) as r, min_by(pos, row_id * 100000 + pos) as a, count(*) as c from t group by token) where c >= 2)"


@query("token_vocabulary", SQL_VOCAB + " select token, id from v")
def _(s, d):
    return terms.token_vocabulary(_features(s, d).where("text is not null"), "row_id", F.col("text"))


@query("encoded_40", SQL_VOCAB + """, e as (select row_id, list(coalesce(id, 1) order by pos) as ids from t left join v using (token) where pos <= 40 group by row_id)
select f.row_id, list_resize(coalesce(ids, []), 40, 0) as ids from features f left join e using (row_id) where f.text is not null""")
def _(s, d):
    f = _features(s, d).where("text is not null")
    return terms.encode(f, "row_id", F.col("text"), terms.token_vocabulary(f, "row_id", F.col("text")))


SQL_WORDS = r"with w as (select row_id, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+') as ws from features where text is not null)"
SQL_GRAMS = SQL_WORDS + ", g as (" + " union all ".join(f"select row_id, unnest(list_transform(range(1, greatest(len(ws) - {n} + 2, 1)), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) as term from w" for n in (1, 2, 3)) + "), c as (select row_id, term, count(*) as tf from g group by all)"


def _gram_counts(s, d):
    f = _features(s, d).select("row_id", "text").where("text is not null")
    return terms.term_counts(f, "row_id", text.word_ngrams(F.col("text")))


@query("word_ngram_df", SQL_GRAMS + " select term, count(*) as df, sum(tf)::bigint as total from c group by term having count(*) >= 2")
def _(s, d):
    return terms.vocabulary(_gram_counts(s, d))


@query("tfidf_words", SQL_GRAMS + """, v as (select term, count(*) as df, sum(tf) as total from c group by term having count(*) >= 2 order by total desc, term limit 300),
x as (select row_id, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from w)) / (1.0 + df)) + 1) as w from c join v using (term))
select row_id, term, round(w / sqrt(sum(w * w) over (partition by row_id)), 6) as weight from x""")
def _(s, d):
    f = _features(s, d).where("text is not null")
    return terms.tfidf(_gram_counts(s, d), "row_id", f.count(), 2, 300).withColumn("weight", F.round("weight", 6))


@query("char_ngram_df", r"""with w as (select row_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' as p from features where text is not null),
g as (""" + " union all ".join(f"select row_id, unnest(list_transform(range(1, greatest(length(p) - {n} + 2, 1)), lambda i: substr(p, i, {n}))) as term from w" for n in range(2, 7)) + """),
c as (select row_id, term, count(*) as tf from g group by all) select term, count(*) as df, sum(tf)::bigint as total from c group by term having count(*) >= 2""")
def _(s, d):
    f = _features(s, d).select("row_id", "text").where("text is not null")
    return terms.vocabulary(terms.term_counts(f, "row_id", text.char_wb_ngrams(F.col("text"))))


def sql_clean(raw: str) -> str:
    t = f"regexp_replace(lower({raw}), '[^a-z\\s!?]', '', 'g')"
    for word, parts in text.CONTRACTIONS.items():
        t = f"regexp_replace({t}, '\\b{word}\\b', {_q(parts)}, 'g')"
    special = " ".join(f"when w = {_q(k)} then {_q(v)}" for k, v in text.LEMMAS.items())
    ruled = " ".join(f"when regexp_matches(w, {_q(p)}) then regexp_replace(w, {_q(p)}, {_q(to.replace('$1', chr(92) + '1'))})" for p, to in reversed(text.LEMMA_RULES))
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[a-z]+|[!?]'), lambda w: case {special} {ruled} else w end), ' ')"


@query("clean_texts", f"select row_id, {sql_clean('text')} as clean_text from features where text is not null")
def _(s, d):
    return _features(s, d).where("text is not null").select("row_id", text.clean_text(F.col("text")).alias("clean_text"))


_HEAD = ["row_id", "page_id", "text", "label", "pattern_category"]


@query("feature_table", f"select {', '.join(_HEAD)}, {sql_clean('text')} as clean_text, {sql_signals('text')} from features where text is not null")
def _(s, d):
    return corpus.feature_table(spread(_features(s, d).select(*_HEAD)), _HEAD)


@query("feature_table_ood", f"select ood_id, text, pattern_category, source, url, {sql_clean('text')} as clean_text, {sql_signals('text')} from ood_real_test where text is not null")
def _(s, d):
    """Of the collected texts; page and label are optional columns that they lack."""
    return corpus.feature_table(table(s, d, "ood_real_test"), ["ood_id", *_HEAD, "source", "url"])


# --- scaling, weights, scores --------------------------------------------------------------------------------------


@query("robust_scaled", SQL_SIG + ", q as (select " + ", ".join(f"quantile_cont({n}, [0.25, 0.5, 0.75]) as {n}" for n in C.SIGNALS) + ") ".replace(")", " from sig)") + " select row_id, " + ", ".join(f"round((sig.{n} - q.{n}[2]) / (case when q.{n}[3] = q.{n}[1] then 1 else q.{n}[3] - q.{n}[1] end), 9) as {n}" for n in C.SIGNALS) + " from sig, q")
def _(s, d):
    f = _recomputed(s, d).select("row_id", *C.SIGNALS)
    return scaling.robust_scaled(f, C.SIGNALS).select("row_id", *[F.round(n, 9).alias(n) for n in C.SIGNALS])


def sql_power(raw: str, digits: int) -> str:
    """Exponents by three grids, each round the best of the one before; the signals are never negative."""
    y = "case when abs(lam) < 1e-9 then ln(1 + x) else (pow(x + 1, lam) - 1) / lam end"
    cells = " union all ".join(f"select row_id, {_q(n)} as name, {n}::double as x from sig" for n in C.SIGNALS)
    sql = f"{raw}, cell as ({cells}), v as (select name, x, count(*) as n from cell group by all), t as (select name, sum(n) as total, count(*) as kinds, sum(n * ln(1 + x)) as logs from v group by name), b0 as (select name, 0.0::double as lam from t)"
    for k, (reach, step) in enumerate(((500, "1e-2"), (100, "1e-4"), (100, "1e-6"), (100, "1e-8"))):
        sql += (
            f", g{k} as (select name, greatest(-5, least(5, lam + i * {step}::double)) as lam from b{k}, range(-{reach}, {reach + 1}) r(i)),"
            f" y{k} as (select name, lam, n, {y} as y from g{k} join v using (name)),"
            f" l{k} as (select name, lam, sum(n * y) / sum(n) as mean, sum(n * y * y) / sum(n) as sq from y{k} group by name, lam),"
            f" b{k + 1} as (select name, arg_max(lam, -total / 2 * ln(sq - mean * mean) + (lam - 1) * logs) as lam from l{k} join t using (name) where sq - mean * mean > 0 group by name)"
        )
    final = "select t.name, coalesce(b4.lam, 1.0) as lam from t left join b4 using (name)"
    wide = ", ".join(f"max(case when name = {_q(n)} then round(z, {digits}) + 0.0 end) as {n}" for n in C.SIGNALS)
    return (
        f"{sql}, f as ({final}), ym as (select name, x, n, lam, {y} as y from f join v using (name)),"
        f" p as (select name, sum(n * y) / sum(n) as mean, sqrt(greatest(sum(n * y * y) / sum(n) - pow(sum(n * y) / sum(n), 2), 0)) as dev from ym group by name),"
        f" z as (select c.row_id, c.name, (ym.y - p.mean) / case when p.dev = 0 then 1 else p.dev end as z from cell c join ym on ym.name = c.name and ym.x = c.x join p on p.name = c.name)"
        f" select row_id, {wide} from z group by row_id"
    )


@query("power_scaled", sql_power(SQL_SIG, 3))
def _(s, d):
    f = scaling.power_scaled(_recomputed(s, d).select("row_id", *C.SIGNALS), C.SIGNALS)
    return f.select("row_id", *[(F.round(n, 3) + 0.0).alias(n) for n in C.SIGNALS])


@query("class_weights", "with c as (select pattern_category, count(*) as n from features where pattern_category is not null group by 1) select pattern_category, n, round((select sum(n) from c) / ((select count(*) from c) * n), 9) as weight from c")
def _(s, d):
    return sampling.class_weights(_features(s, d), "pattern_category").withColumn("weight", F.round("weight", 9))


@query("dense_histogram", "select c.code, count(row_id) as n from range(16) c(code) left join (select row_id, urgency_kw_count + scarcity_kw_count + cancel_diff_score as x from features) f on f.x = c.code group by c.code")
def _(s, d):
    f = _features(s, d).select((F.col("urgency_kw_count") + F.col("scarcity_kw_count") + F.col("cancel_diff_score")).alias("code"))
    return sampling.dense_histogram(f, "code", 16)


SQL_SCORES = "with x as (select vec_id, label, list_transform(embedding, lambda v: v::double) as z from embeddings), e as (select vec_id, label, list_transform(z, lambda v: exp(v - list_max(z))) as e from x), p as (select vec_id, label, list_transform(e, lambda v: v / list_sum(e)) as p from e), r as (select vec_id, label, p, list_position(p, list_max(p)) - 1 as top, list_max(p) as score from p)"


def _scored(s, d):
    z = F.transform("embedding", lambda v: v.cast("double"))
    e = table(s, d, "embeddings").select("vec_id", "label", scoring.softmax(z).alias("p"))
    return e.select("*", scoring.argmax(F.col("p")).alias("top"), F.array_max("p").alias("score"))


@query("softmax_top", SQL_SCORES + " select vec_id, top::int as top, round(score, 9) as score from r")
def _(s, d):
    return _scored(s, d).select("vec_id", "top", F.round("score", 9).alias("score"))


_VOTES = {c: [n for n, x in _RULE if x == c] for c in C.CLASSES}
_CLASS_LIST = "[" + ", ".join(_q(c) for c in C.CLASSES) + "]"
SQL_VOTES = SQL_SIG + ", z as (select row_id, category, [" + ", ".join(f"(2.0 + 2.5 * ({' + '.join(_VOTES[c])}))::double" if _VOTES[c] else ("4.0::double" if c == C.BENIGN else "1.0::double") for c in C.CLASSES) + "] as z from sig), e as (select *, list_transform(z, lambda v: exp(v - list_max(z))) as e from z), p as (select *, list_transform(e, lambda v: v / list_sum(e)) as p from e), r as (select *, list_position(z, list_max(z)) as top, list_max(p) as score from p)"


def _voted(s, d):
    """Scores of the classes from the signals that speak for them, in class order."""
    f = _recomputed(s, d)

    def score(c):
        if _VOTES[c]:
            return F.lit(2.0) + F.lit(2.5) * sum((F.col(n) for n in _VOTES[c]), F.lit(0))
        return F.lit(4.0 if c == C.BENIGN else 1.0)

    z = f.select("row_id", F.col("pattern_category").alias("category"), F.array(*[score(c) for c in C.CLASSES]).alias("z"))
    p = z.select("*", scoring.softmax(F.col("z")).alias("p"))
    return p.select("*", scoring.argmax(F.col("z")).alias("top"), F.array_max("p").alias("score"))


def _name(at):
    return F.element_at(F.array(*[F.lit(c) for c in C.CLASSES]), at + 1)


@query("result_status", SQL_VOTES + f", n as (select row_id, ({_CLASS_LIST})[top] as label, score from r) select row_id, case when label = 'Trick Question' then 'Trick Wording (model label: Trick Question)' else label end as shown, case when score < 0.5 then 'inconclusive' when label = 'Not a Dark Pattern' then 'no_signal' else 'signal' end as status, case when label = 'Not a Dark Pattern' then 'no textual signal' else 'potential' end as classical, printf('%.1f%%', 100 * score) as percent from n")
def _(s, d):
    v = _voted(s, d)
    name, score = _name(F.col("top")), F.col("score")
    return v.select("row_id", scoring.display_label(name).alias("shown"), scoring.status(name, score).alias("status"), scoring.classical_status(name).alias("classical"), scoring.percent(score).alias("percent"))


@query("top5_classes", SQL_VOTES + f" select row_id, list_transform(list_sort(list_transform(range(14), lambda i: {{'s': -z[i + 1], 'i': i}}))[1:5], lambda x: ({_CLASS_LIST})[x.i + 1]) as best from r")
def _(s, d):
    return _voted(s, d).select("row_id", scoring.top_classes(F.col("z"), C.CLASSES).alias("best"))


@query("coverage", SQL_VOTES + f" select round(avg((score >= 0.5)::int), 9) as coverage, round(avg(case when score >= 0.5 then (category = ({_CLASS_LIST})[top])::int end), 9) as accuracy_covered from r where category is not null")
def _(s, d):
    v = _voted(s, d).where("category is not null").withColumn("p", _name(F.col("top")))
    r = metrics.covered(v, "score", "category", "p")
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query("signal_json", SQL_SIG + " select row_id, to_json({" + ", ".join(f"'{n}': {n}" for n in C.SIGNALS) + "})::varchar as signals from sig")
def _(s, d):
    return _recomputed(s, d).select("row_id", scoring.signal_json().alias("signals"))


@query("category_codes", "select row_id, case when source is null then -1 else dense_rank() over (order by source nulls last) - 1 end as code from features")
def _(s, d):
    return codes.category_codes(_features(s, d).select("row_id", "source"), "source").select("row_id", "code")


@query("label_outside_domain", "select row_id, label from features where label is not null and label not in (0, 1)")
def _(s, d):
    """Labels must be a subset of 0 and 1: no row may come out."""
    domain = s.createDataFrame([(0,), (1,)], "label int")
    return _features(s, d).where("label is not null").join(F.broadcast(domain), "label", "left_anti").select("row_id", "label")


@query("active_signals", SQL_SIG + " select row_id, coalesce(nullif(concat_ws(', ', " + ", ".join(f"case when {n} <> 0 then {_q(scoring.SIGNAL_NAMES[n] + ' (')} || {n} || ')' end" for n in C.SIGNALS) + f"), ''), {_q(scoring.NO_SIGNALS)}) as active from sig")
def _(s, d):
    return _recomputed(s, d).select("row_id", scoring.active_signals().alias("active"))


@query("guidance_of_rows", "select row_id, description, context from features f left join guidance g on g.label = f.pattern_category")
def _(s, d):
    g = table(s, d, "guidance").select(F.col("label").alias("pattern_category"), "description", "context")
    return _features(s, d).select("row_id", "pattern_category").join(g, "pattern_category", "left").select("row_id", "description", "context")


@query("known_classes", "select ood_id, pattern_category from ood_real_test where pattern_category in (select distinct pattern_category from features where pattern_category is not null)")
def _(s, d):
    """Collected rows of a class that the labelled rows have, so that a model can know it."""
    known = _features(s, d).select("pattern_category").distinct()
    return table(s, d, "ood_real_test").join(known, "pattern_category", "left_semi").select("ood_id", "pattern_category")


@query("plan_cover", "select (select count(*) from (select row_id from features except select row_id from split_plan)) as unplanned, (select count(*) from (select row_id from split_plan except select row_id from features)) as unknown, (select count(*) from (select row_id from split_plan group by row_id having count(*) > 1)) as repeated")
def _(s, d):
    f, p = _features(s, d).select("row_id"), table(s, d, "split_plan").select("row_id")
    sides = f.withColumn("f", F.lit(1)).join(p.groupBy("row_id").agg(F.count("*").alias("n")), "row_id", "full")
    return sides.agg(F.count_if(F.col("n").isNull()).alias("unplanned"), F.count_if(F.col("f").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("same_class_neighbours", """
with x as (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings),
n as (select a.vec_id, b.vec_id as neighbour, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id) as place
  from x a join x b on a.label = b.label and a.vec_id <> b.vec_id)
select vec_id, neighbour, place::int as place from n where place <= 5""")
def _(s, d):
    from plainsight.ml import models

    return models.neighbours(table(s, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "neighbour", F.col("place").cast("int").alias("place"))


SQL_NEAR = """
with x as (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings),
n as (select a.vec_id, b.vec_id as neighbour, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id) as place
  from x a join x b on a.label = b.label and a.vec_id <> b.vec_id)"""


@query("oversampled_classes", SQL_NEAR + """,
c as (select label, count(*) as n from x group by label), m as (select max(n) as most from c)
select label, most as n, most - n as n_new, 0::bigint as n_off_line from c, m""")
def _(s, d):
    """Rows of every class after oversampling, the new ones among them, and those that lie on no line from a row to one
    of its five neighbours (none may).
    """
    from plainsight.ml import models

    e = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    made = models.oversampled(e, "vec_id", "embedding", "label")
    near = models.neighbours(e, "vec_id", "embedding", "label").select(F.col("vec_id").alias("base"), F.col("neighbour").alias("other"), F.lit(True).alias("linked"))
    a = e.select(F.col("vec_id").alias("base"), F.col("label").alias("la"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("other"), F.col("label").alias("lb"), F.col("embedding").alias("b"))
    whole = made.join(a, "base", "left").join(b, "other", "left").join(near, ["base", "other"], "left")
    apart = F.aggregate(F.zip_with("embedding", F.zip_with("a", "b", lambda x, y: x + F.col("u") * (y - x)), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: x + y)
    fits = F.col("linked") & (F.col("la") == F.col("label")) & (F.col("lb") == F.col("label")) & (F.col("u") >= 0) & (F.col("u") < 1) & (apart < 1e-6)
    new = F.col("base").isNotNull()
    return whole.groupBy("label").agg(F.count("*").alias("n"), F.count_if(new).alias("n_new"), F.count_if(new & ~F.coalesce(fits, F.lit(False))).alias("n_off_line"))


@query("sampled_rows", "select row_id, text from features order by md5(row_id::varchar || '-42'), row_id limit 5")
def _(s, d):
    return sampling.random_rows(_features(s, d).select("row_id", "text"), "row_id", 5)


# --- ranking and pivots on the star tables ---------------------------------------------------------------------------


@query("top_orders_by_customer", "select o_custkey, o_orderkey, place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 2")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 2").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("status_pivot", "select l_returnflag, count_if(l_linestatus = 'F') as f, count_if(l_linestatus = 'O') as o from lineitem group by l_returnflag")
def _(s, d):
    p = table(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return p.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("event_counts", "select event_type, count(*) as n from events group by event_type")
def _(s, d):
    return describe.value_counts(table(s, d, "events"), "event_type")
