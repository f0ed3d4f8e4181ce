import pytest

import __spark_entry__ as entry
from plainsight.plans import queries as core
from tests.oracle import rows_of_oracle, rows_of_query

ORACLES = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    assert rows_of_query(core.queries()[name](spark, sf)) == rows_of_oracle(ORACLES[name], sf)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 14


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_oracle_run(spark, sf):
    q = core.queries()
    n = spark.read.parquet(f"{sf}/features.parquet").count()
    assert q["grouped_folds"](spark, sf).count() == n
    assert q["cv_selection"](spark, sf).count() == 3
    report = q["audit_report"](spark, sf).first()
    assert report["leak_free_split"]["leaked_test_rows"] == 0 and len(report["models"]) == 2 and report["trivial_probes"]["keyword_only"]["macro_f1"] > 0
    scores = q["calibrated_scores"](spark, sf).collect()
    assert scores and all(0 < r["score"] <= 1 and len(r["best"]) == 5 and r["best"][0] == r["label"] for r in scores)
