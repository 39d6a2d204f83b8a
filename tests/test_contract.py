"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E


def test_oracles_match_registered_queries():
    queries, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(oracles) >= 59


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["position", "check", "status", "warnings", "affected", "affected_pct", "evidence", "observation"]
    rows = df.collect()
    assert sorted(r.position for r in rows) == list(range(1, 8))
    assert {r.status for r in rows} <= {"OK", "WARNING", "REVIEW"}
