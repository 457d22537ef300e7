"""Sums and folds in an order against plain Python."""

import random
from decimal import Decimal
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from rankweave.operators import ordered


@pytest.fixture()
def parts(spark):
    """Ranges stay apart, so that sums must cross them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind,make", [("long", int), ("double", float), ("decimal(10,2)", Decimal)])
def test_running_total(spark, parts, kind, make):
    rng = random.Random(3)
    values = [None if i % 11 == 0 else make(rng.randint(-5, 9)) for i in range(500)]
    keys = rng.sample(range(10_000), 500)
    rows = spark.createDataFrame(list(zip(keys, values)), f"k long, v {kind}").repartition(5)
    got = {r.k: (r.running, r.number) for r in ordered.running_total(rows, ["k"], "v", number="number").collect()}
    by_key = [v for _, v in sorted(zip(keys, values))]
    sums = list(accumulate((v or make(0) for v in by_key)))
    assert got == {k: (sums[i], i + 1) for i, k in enumerate(sorted(keys))}


def test_running_total_descends_over_strings_and_replaces_columns(spark, parts):
    rows = spark.createDataFrame([(f"n{i:03}", i, "old") for i in range(100)], "name string, v int, running string").repartition(4)
    got = ordered.running_total(rows, [F.col("name").desc()], "v")
    assert got.columns == ["name", "v", "running"]
    assert {r.v: r.running for r in got.collect()} == {i: sum(range(i, 100)) for i in range(100)}


def test_empty_and_equal_rows(spark):
    assert ordered.running_total(spark.createDataFrame([], "k long, v long"), ["k"], "v").count() == 0
    same = spark.createDataFrame([(1, 2)] * 30 + [(None, None)] * 3, "k long, v long")
    assert sorted(r.running for r in ordered.running_total(same, ["k"], "v").collect()) == [0, 0, 0, *range(2, 62, 2)]


def floored(changes):
    n = 0
    for d in changes:
        n = max(n + (d or 0), 0)
    return n


def test_floored_counters(spark, parts):
    rng = random.Random(4)
    ops = [(None if i % 97 == 0 else 0 if i % 3 else rng.randint(1, 40), i, rng.choice([1, -1, -1, 2, None])) for i in range(3000)]
    df = spark.createDataFrame(ops, "k long, at long, d long").repartition(7)
    got = {r.k: r.n for r in ordered.floored_counters(df, "k", ["at"], "d").collect()}
    assert got == {k: floored([d for q, _, d in ops if q == k]) for k in {o[0] for o in ops}}


def test_removal_before_addition_counts_one(spark):
    df = spark.createDataFrame([("a", 1, -1), ("a", 2, 1), ("b", 1, 1), ("b", 2, -1), ("b", 3, -1), ("b", 4, 1)], "k string, at long, d long")
    assert {r.k: r.n for r in ordered.floored_counters(df, "k", ["at"], "d").collect()} == {"a": 1, "b": 1}


def files_in_order(sizes, most):
    out, held, no = [], 0, 0
    for s in sizes:
        if not no or held + (s or 0) > most:
            no, held = no + 1, 0
        out.append(no)
        held += s or 0
    return out


@pytest.mark.parametrize("sizes", ["mixed", "equal", "large", "none"])
def test_byte_cuts_equal_the_sequential_rule(spark, parts, sizes):
    rng = random.Random(8)
    given = {"mixed": [rng.choice([0, 1, 3, 10, 40, 99, 100, 101, 250, None]) for _ in range(400)], "equal": [10] * 200, "large": [500] * 20, "none": []}[sizes]
    df = spark.createDataFrame(list(enumerate(given)), "k long, size int").repartition(4)
    got = ordered.byte_cuts(df, ["k"], "size", 100)
    assert got.columns == ["k", "size", "file_no"]
    assert [r.file_no for r in sorted(got.collect(), key=lambda r: r.k)] == files_in_order(given, 100)
