"""The SQLite source: parts, pushed filters, types, and tables that others made."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from rankweave.sources.sqlite import SqliteReader, SqliteSource

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known(spark):
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def saved(df, path, mode="append"):
    df.write.format("sqlite").mode(mode).save(path)


def opened(spark, path, **options):
    return spark.read.format("sqlite").options(**options).load(path)


def test_a_table_comes_back_in_several_partitions(known, tmp_path):
    orders, path = known.read.parquet(f"{DATA}/orders.parquet"), str(tmp_path / "orders")
    saved(orders.repartition(3), path)
    back = opened(known, path, partitions=4)
    assert back.schema == orders.schema and back.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, orders.collect()))
    saved(orders.limit(5), path)
    assert opened(known, path).count() == orders.count() + 5
    saved(orders.limit(5), path, "overwrite")
    assert opened(known, path).count() == 5


def test_filters_are_pushed(known, tmp_path):
    orders, path = known.read.parquet(f"{DATA}/orders.parquet"), str(tmp_path / "orders")
    saved(orders, path)
    for cond in ("o_custkey >= 50 and o_custkey < 90", "o_orderstatus = 'F' and o_totalprice > 100000", "o_orderkey in (1, 2, 700)", "o_orderstatus is null", "o_orderstatus is not null and o_orderdate < timestamp '1997-01-01'", "o_orderpriority like '1%'"):
        assert sorted(map(tuple, opened(known, path).where(cond).collect())) == sorted(map(tuple, orders.where(cond).collect())), cond
    plan = opened(known, path).where("o_custkey = 5")._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan  # the file has answered it


def test_what_is_not_compared_alike_is_left_to_spark():
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not

    reader = SqliteReader({"path": "x"}, T.StructType.fromJson({"type": "struct", "fields": [{"name": "a", "type": "long", "nullable": True, "metadata": {}}, {"name": "t", "type": "timestamp", "nullable": True, "metadata": {}}]}))
    left = [GreaterThan(("t",), 3), Not(EqualTo(("a",), 1)), EqualTo(("s", "inner"), 1)]
    assert list(reader.pushFilters([EqualTo(("a",), 1), *left])) == left and reader.values == [1]


def test_types_and_nulls_survive(known, tmp_path):
    row = "1L a, 2 b, 1.5D c, 'ä\"' d, true e, date '2024-02-29' f, timestamp '2024-02-29 12:34:56.789012' g, cast(12.30 as decimal(6,2)) h, X'00ff' i, timestamp_ntz '2024-01-01 00:00:00' j"
    df = known.range(1).selectExpr(*row.split(", "))
    df = df.unionByName(df.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))
    saved(df, str(tmp_path / "t"))
    back = opened(known, str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_an_empty_table_and_a_foreign_file(known, tmp_path):
    saved(known.range(0), str(tmp_path / "none"))
    assert opened(known, str(tmp_path / "none")).count() == 0
    file = str(tmp_path / "foreign.db")
    db = sqlite3.connect(file)
    db.execute("CREATE TABLE shops (id INTEGER PRIMARY KEY, name VARCHAR(20), note, score FLOAT)")
    db.executemany("INSERT INTO shops VALUES (?, ?, ?, ?)", [(i, f"n{i}", None if i % 2 else "x", i / 4) for i in range(10)])
    db.commit()
    db.close()
    got = opened(known, file, table="shops", partitions=3)
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("note", "string"), ("score", "double")]
    assert sorted(map(tuple, got.where("id > 6").collect())) == [(i, f"n{i}", None if i % 2 else "x", i / 4) for i in range(7, 10)]
