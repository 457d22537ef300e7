"""Twins of cut queries that run over whole tables."""

from rankweave import catalog

DATA = "/root/testdata/sf0.001"


def test_full_upsert_merges_whole_tables(spark):
    rows = catalog.queries()["d01_upsert_full"](spark, DATA).groupBy("action").count().collect()
    assert {r.action for r in rows} == {"inserted", "kept", "updated"} and sum(r["count"] for r in rows) > 1000
