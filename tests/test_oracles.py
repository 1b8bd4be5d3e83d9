"""Registered retail queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from basketry.plans import registry

DIR = Path("/root/testdata/sf0.001")
TABLES = ("lineitem", "orders", "part", "customer", "nation")


@pytest.mark.skipif(not DIR.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["clean_audit", "rfm_profiles", "catalog_items", "rfm_rule_segments", "segment_popularity", "item_cosine_neighbors", "recs_with_fallback", "cohort_counts", "drift_alerts", "rfm_log1p_standardized", "rfm_reconciliation", "rule_model_segments", "selection_manifest"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(DIR))
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want))


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
