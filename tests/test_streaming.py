"""Streams end with the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators import ledger
from rankweave.operators.maintain import capped_sessions, fail_streak
from rankweave.streaming import jobs, keyed

ROWS = [(i, i % 3, i * 7 % 50, i % 4 == 0) for i in range(60)]


@pytest.fixture()
def source(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "event_id long, user_id long, second long, ok boolean").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, second)")).drop("second")
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), tmp_path


def finish(df, name, mode, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_rate_limits(spark, source):
    batch, stream, tmp = source
    got = finish(jobs.rate_limit_breaches(stream, "user_id", "ts", 8), "breaches", "complete", spark, tmp)
    want = jobs.rate_limit_breaches(batch, "user_id", "ts", 8)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture()
def shuffled(spark, tmp_path):
    """Rows in random order over many files, one to a batch; a last file moves the watermark past all of them."""
    keyed.prepare(spark)
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 2, 3, None]), rng.randint(0, 40) * 60, rng.random() < 0.3, rng.choice([1, -1, -1, 2, None])) for i in range(200)]
    make = lambda data: spark.createDataFrame(data, "event_id long, user_id long, second long, ok boolean, d long").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, second)")).drop("second")
    path = str(tmp_path / "many")
    for k in range(5):
        make([r for r in rows if r[0] % 5 == k]).coalesce(1).write.mode("append").parquet(path)
    make([(10_000, 99, 10**6, True, 0)]).coalesce(1).write.mode("append").parquet(path)
    batch = make(rows)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path), tmp_path


def last_of(rows, key, value):
    """Each key's last row as the sink got them."""
    return {r[key]: r[value] for r in rows if r[key] != 99}


def in_time(batch, key):
    out = {}
    for r in sorted(batch.collect(), key=lambda r: (r.ts, r.event_id)):
        out.setdefault(r[key], []).append(r)
    return out


def test_counters_equal_batch_in_any_order(spark, shuffled):
    batch, stream, tmp = shuffled
    got = finish(jobs.running_counters(stream, "user_id", "ts", "event_id", "d", late="2 hours"), "counters", "append", spark, tmp)
    want = {}
    for user, rows in in_time(batch, "user_id").items():
        n = 0
        for r in rows:
            n = max(n + (r.d or 0), 0)
        want[user] = n
    assert last_of(got.collect(), "user_id", "n") == want
    assert {r.user_id: r.n for r in jobs.running_counters(batch, "user_id", "ts", "event_id", "d").collect()} == want


def test_streaks_equal_batch_in_any_order(spark, shuffled):
    batch, stream, tmp = shuffled
    got = finish(jobs.failure_streaks(stream.where("user_id is not null"), "user_id", "ok", "ts", "event_id", late="2 hours"), "streaks", "append", spark, tmp)
    want = fail_streak(batch.where("user_id is not null"), "user_id", ["ts", "event_id"], "ok")
    assert last_of(got.collect(), "user_id", "streak") == {r.user_id: r.streak for r in want.collect()}


def test_ledger_stream_equals_batch(spark, shuffled):
    batch, stream, tmp = shuffled
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("grant", "unlock", "unlock", "tier", "keep", "unlock")]), (F.col("event_id") % 6 + 1).cast("int"))
    shaped = lambda df: df.where("user_id is not null").select("user_id", F.col("event_id").alias("id"), kinds.alias("kind"), (F.col("event_id") % 5).alias("item"), (F.col("event_id") % 4).alias("credits"), F.col("ts").alias("at"))
    got = finish(keyed.in_order(shaped(stream), "user_id", "at", "id", ledger.Unlocks(), late="2 hours"), "ledger", "append", spark, tmp)
    want = ledger.fold_in_order(shaped(batch).withColumn("at", F.unix_micros("at")), "user_id", ["at", "id"], ledger.Unlocks())
    rows = sorted(map(tuple, want.collect()))
    assert len({r[3] for r in rows}) >= 4 and sorted(tuple(r) for r in got.collect() if r.user_id != 99) == rows


def test_session_cap_stream_equals_batch(spark, shuffled):
    batch, stream, tmp = shuffled
    device = F.concat(F.lit("d"), F.col("event_id") % 7)
    shaped = lambda df: df.where("user_id is not null").select("user_id", device.alias("device"), "ts")
    rows = finish(keyed.session_cap(shaped(stream), "user_id", "device", "ts"), "sessions", "update", spark, tmp).collect()
    newest = {r.user: max(x.version for x in rows if x.user == r.user) for r in rows}
    got = sorted((r.user, r.device, r.at) for r in rows if r.version == newest[r.user] and r.user != 99)
    want = capped_sessions(shaped(batch), "user_id", "device", "ts").select("user_id", "device", F.unix_micros("ts").alias("at"))
    assert got == sorted(map(tuple, want.collect()))


def test_expiry_timers_equal_batch(spark, tmp_path):
    keyed.prepare(spark)
    day = lambda *rows: spark.createDataFrame([(u, i, c, d) for u, i, c, d in rows], "user_id long, id long, credits long, day double").withColumn("ts", F.timestamp_micros(((F.col("day") + 1000) * 86_400_000_000).cast("long"))).drop("day")
    files = [[(1, 1, 5, 0.0), (2, 2, 1, 1.0)], [(1, 3, 2, 6.5), (1, 1, 5, 0.0), (2, 4, 1, 10.0)], [(1, 5, 1, 6.0), (3, 6, None, 2.5), (3, None, 9, 2.6)], [(1, 7, 4, 30.0), (9, 8, 0, 90.0)]]
    path = str(tmp_path / "grants")
    for rows in files:
        day(*rows).coalesce(1).write.mode("append").parquet(path)
    batch = day(*[r for f in files for r in f])
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = finish(keyed.expiries(stream, "user_id", "id", "credits", "ts", late="8 days"), "expiries", "append", spark, tmp_path)
    want = keyed.ended_sessions(batch, "user_id", "id", "credits", "ts")
    rows = sorted(tuple(r[c] for c in ("user", "first_ms", "ended_ms", "credits")) for r in want.where("user <> 9").collect())
    assert sorted(map(tuple, got.collect())) == rows and [r[3] for r in rows] == [8, 4, 1, 1, 0]


def test_first_of_repeated_ids(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 3, "c"), (1, 3, "a"), (2, 9, "z")], "id long, at long, v string")
    assert sorted(map(tuple, jobs.once_per_id(rows, "id", "at").collect())) == [(1, 3, "a"), (2, 9, "z")]


def test_daily_publish_runs_once_over_all_that_waits(spark, source):
    batch, stream, tmp = source
    seen = []
    for _ in range(2):
        jobs.daily_publish(stream, lambda df: seen.extend(r.event_id for r in df.collect()), str(tmp / "publish")).awaitTermination(120)
    assert sorted(seen) == sorted(r.event_id for r in batch.collect())


def test_repeated_ids(spark, source):
    batch, stream, tmp = source
    got = finish(jobs.once_per_id(stream, "event_id", "ts"), "once", "append", spark, tmp)
    assert got.count() == batch.select("event_id").distinct().count()


def test_recompute_touched(spark, source):
    batch, stream, tmp = source
    seen = {}
    q = jobs.recompute_touched(stream, lambda: batch, "user_id", lambda df: df.groupBy("user_id").count(), lambda df, _: seen.update({r.user_id: r["count"] for r in df.collect()}), str(tmp / "cp"))
    q.awaitTermination(120)
    assert seen == {r.user_id: r["count"] for r in batch.groupBy("user_id").count().collect()}
