"""Queries of the core and their DuckDB oracles."""

from __future__ import annotations

from plainsight.plans import general, models  # noqa: F401 - registers its queries
from plainsight.session import table
from plainsight.sources import records


def queries():
    own = {
        "p6_found": lambda s, d: records.rejected(table(s, d, "ccpa_dataset"), table(s, d, "guidance")),
        "p6_loaded": lambda s, d: records.loaded(table(s, d, "ccpa_dataset"), table(s, d, "guidance")),
    }
    return own | {name: q for name, (q, _) in general.QUERIES.items()}


def oracle_sql():
    return {"p6_found": records.ORACLE, "p6_loaded": records.ORACLE_LOADED} | {
        name: sql for name, (_, sql) in general.QUERIES.items() if sql is not None
    }
