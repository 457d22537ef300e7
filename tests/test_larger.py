"""Plans that must hold on larger tables, and their rows on odd ones."""

import os

import pytest

from rankweave import catalog
from rankweave.sources.model import Model

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Sizes at which Spark chooses no broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_not_in_broadcasts_nothing(spark, no_broadcast):
    assert "Broadcast" not in plan(catalog.queries()["j08_not_in"](spark, DATA))


@pytest.mark.parametrize("reviewers, want", [([2, 2, None], [1, 3]), ([None], [None, 1, 2, 3]), ([], [None, 1, 2, 3])])
def test_not_in_with_nulls(spark, monkeypatch, reviewers, want):
    monkeypatch.setattr(Model, "members", lambda m: spark.createDataFrame([(1,), (2,), (3,), (None,)], "member_id long"))
    monkeypatch.setattr(Model, "reviews", lambda m: spark.createDataFrame([(r,) for r in reviewers], "member_id long"))
    got = [r.member_id for r in catalog.queries()["j08_not_in"](spark, DATA).collect()]
    assert sorted(got, key=lambda v: (v is not None, v)) == want


def test_mined_rules_broadcast_a_row_for_each_field_at_most(spark):
    assert plan(catalog.queries()["r11_mined_rules"](spark, DATA)).count("BroadcastExchange") <= 1


def test_profiles_are_spread(spark):
    from rankweave.plans.extraction import _profiles

    pages, _ = _profiles(Model(spark, DATA))
    assert "REPARTITION_BY_NUM" in plan(pages)


@pytest.mark.parametrize("name", ["e12_nested_fields", "e17_enclosing_cards"])
def test_pages_are_read_within_their_rows(spark, name):
    """All of a page's elements in one row: nothing sorted or joined but what forms the pages."""
    got = plan(catalog.queries()[name](spark, DATA))
    assert "Window" not in got and got.count("REPARTITION_BY_NUM") == 1


def test_contained_names_meet_by_equality(spark):
    """300 names that all share their rarest characters: no pair is tried but those that are linked."""
    from rankweave.operators.linkage import link_contained

    names = [f"{i:03}" for i in range(300)] + ["1", "12", "12", "x", "", None, "0120"]
    rows = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    got = link_contained(rows, rows.withColumnRenamed("i", "j"), "name", "i", "j", grams=1)
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and (a in b or b in a)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "contains(" not in plan(got).lower()


def test_pairs_of_a_name_are_dealt(spark, no_broadcast, monkeypatch):
    """One name alone still makes work for several tasks, and all of its pairs once."""
    monkeypatch.setattr(Model, "providers", lambda m: spark.createDataFrame([(i, "same") for i in range(40)] + [(50, "other"), (51, None), (52, None)], "provider_id long, name string"))
    df = catalog.queries()["j15_self_join"](spark, DATA)
    assert plan(df).count("REPARTITION_BY_NUM") == 2
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(40) if i != j]


def test_pairs_of_blocks_and_runs(spark):
    """Blocks and runs with rests: every pair once for each time that its rows stand there."""
    from rankweave.operators.linkage import equal_pairs

    rows = [(i, "many") for i in range(50)] + [(3, "many"), (100, "two"), (101, "two"), (102, "one"), (None, "many"), (103, None), (104, None)]
    df = spark.createDataFrame(rows, "id long, `a name` string")
    got = equal_pairs(df, "a name", "id", "other", block=8, run=3, other_run=4)
    want = sorted((i, j) for i, a in rows for j, b in rows if a and a == b and i is not None and j is not None and i != j)
    assert got.columns == ["id", "other"] and sorted(tuple(r) for r in got.collect()) == want


def test_pairs_of_a_name_take_little_disk(spark, monkeypatch, tmp_path):
    """Nine million pairs: a quarter of a byte each in Parquet at most."""
    monkeypatch.setattr(Model, "providers", lambda m: spark.range(3000).selectExpr("id provider_id", "'same' name"))
    catalog.queries()["j15_self_join"](spark, DATA).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3000 * 2999
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 3000 * 2999 / 4
