"""Keyed state in streams: rows in event-time order, timers, and bounded maps.

They use ``transformWithState``, which needs the RocksDB state store; ``prepare``
sets it.  Rows of a key reach a processor in any order and in any number of
batches; ``in_order`` holds them until the watermark has passed, and folds them by
time with the same machines as in batch (``operators.ledger``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankweave.operators.ledger import Machine

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Set the state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _struct(ddl: str) -> T.StructType:
    """Made where the query is made: processors have no session to parse with."""
    return T.StructType.fromDDL(ddl)


class _InOrder(StatefulProcessor):
    """Folds a key's rows by (time, tie) once the watermark has passed them."""

    def __init__(self, machine: Machine, at: str, tie: str, schema: T.StructType, out: T.StructType) -> None:
        self.machine, self.at, self.tie, self.schema, self.out = machine, at, tie, schema, out
        self.folded = _struct(machine.state_schema)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.folded)
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        times = set()
        for row in rows:
            self.waiting.appendValue(tuple(row["__at" if f.name == self.at else f.name] for f in self.schema))
            times.add(row["__ms"])
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        names = [f.name for f in self.schema]
        held = [dict(zip(names, r)) for r in self.waiting.get()]
        due = sorted((r for r in held if r["__ms"] <= mark), key=lambda r: (r[self.at], r[self.tie]))
        if not due:  # an earlier timer of this batch has taken them
            return
        self.waiting.clear()
        for r in held:
            if r["__ms"] > mark:
                self.waiting.appendValue(tuple(r[n] for n in names))
        state = tuple(self.state.get()) if self.state.exists() else None
        for r in due:
            state, handed = self.machine.step(state, r)
            for x in handed:
                yield Row(*self.out.names)(key[0], *x)
        self.state.update(state)


def in_order(rows: DataFrame, key: str, at: str, tie: str, machine: Machine, late: str = "1 hour") -> DataFrame:
    """The machine's rows, key first, in append mode: a stream's ``fold_in_order``.

    ``at`` is a timestamp column; rows equal in it go by ``tie``.  Rows later than
    ``late`` behind the newest are dropped, as with any watermark.  The machine sees
    ``at`` in microseconds.  Held are a key's state and its rows of the last ``late``.
    """
    marked = rows.withWatermark(at, late)
    given = marked.select("*", F.unix_millis(F.col(at).cast("timestamp")).alias("__ms"), F.unix_micros(F.col(at).cast("timestamp")).alias("__at"))
    fields = [f for f in given.schema.fields if f.name not in (at, "__at")] + [T.StructField(at, T.LongType())]
    schema = T.StructType(fields)
    out = T.StructType([rows.schema[key], *_struct(machine.out_schema).fields])
    return given.groupBy(key).transformWithState(_InOrder(machine, at, tie, schema, out), out, "append", "eventTime")


class _Sessions(StatefulProcessor):
    """A user's latest devices, at most ``cap``."""

    def __init__(self, device: str, cap: int, ttl_ms: int, kind: T.StructField) -> None:
        self.device, self.cap, self.ttl_ms = device, cap, ttl_ms
        self.key, self.at, self.count = T.StructType([T.StructField("device", kind.dataType)]), _struct("at long"), _struct("n long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.devices = handle.getMapState("devices", self.key, self.at, self.ttl_ms)
        self.version = handle.getValueState("version", self.count)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest = {k[0]: v[0] for k, v in self.devices.iterator()}
        held = dict(latest)
        for row in rows:
            device, at = row[self.device], row["__at"]
            latest[device] = max(at, latest.get(device, at))
            if len(latest) > self.cap:  # the oldest goes; of equals the last by name, as in batch
                del latest[min(latest, key=lambda d: (latest[d], [-ord(c) for c in str(d)]))]
        for device in held.keys() - latest.keys():
            self.devices.removeKey((device,))
        for device, at in latest.items():
            if held.get(device) != at:
                self.devices.updateValue((device,), (at,))
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((n,))
        for device, at in latest.items():
            yield Row("user", "version", "device", "at")(key[0], n, device, at)


def session_cap(sessions: DataFrame, user: str, device: str, at: str, cap: int = 2, ttl: str = "30 days") -> DataFrame:
    """(user, version, device, at): after each batch, the ``cap`` latest devices of the users it touched.

    A device that comes again is refreshed; one more than ``cap`` evicts the oldest.
    Keeping the largest times is the same in any order, so late rows need no
    watermark.  A user's highest version holds; devices that are not seen for ``ttl``
    are forgotten.  ``at`` is in microseconds.
    """
    given = sessions.select(F.col(user), F.col(device), F.unix_micros(F.col(at).cast("timestamp")).alias("__at"))
    out = T.StructType([T.StructField("user", sessions.schema[user].dataType), *_struct("version long").fields, T.StructField("device", sessions.schema[device].dataType), *_struct("at long").fields])
    unit = {"days": 86_400_000, "hours": 3_600_000, "minutes": 60_000}
    number, name = ttl.split()
    return given.groupBy(user).transformWithState(_Sessions(device, cap, int(number) * unit[name], sessions.schema[device]), out, "update", "processingTime")


class _Expiry(StatefulProcessor):
    """Credits that end together, ``lasting`` after the last grant."""

    def __init__(self, lasting: int) -> None:
        self.lasting, self.key, self.value = lasting, _struct("id long"), _struct("ms long, credits long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grants = handle.getMapState("grants", self.key, self.value)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in rows:
            if row["id"] is not None and not self.grants.containsKey((row["id"],)):  # a repeated grant counts once
                self.grants.updateValue((row["id"],), (row["__ms"], row["credits"] or 0))
                self.handle.registerTimer(row["__ms"] + self.lasting)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        runs: list[list] = []  # grants that reach each other
        for (id_,), (ms, credits) in sorted(((tuple(k), tuple(v)) for k, v in self.grants.iterator()), key=lambda x: x[1][0]):
            if runs and ms <= runs[-1][1] + self.lasting:
                runs[-1][1:] = [ms, runs[-1][2] + credits, [*runs[-1][3], id_]]
            else:
                runs.append([ms, ms, credits, [id_]])
        for first, last, credits, ids in runs:
            if last + self.lasting <= mark:
                for id_ in ids:
                    self.grants.removeKey((id_,))
                yield Row("user", "first_ms", "ended_ms", "credits")(key[0], first, last + self.lasting, credits)


def expiries(grants: DataFrame, user: str, id_: str, credits: str, at: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """(user, first_ms, ended_ms, credits): credits that ended ``days`` after their last grant, by event-time timers.

    A grant lengthens what is still there.  Grants are deduplicated by id as long as
    their credits last; nulls are no grants.  A run of grants ends once the watermark
    has passed its end, so grants as late as ``late`` still count.
    """
    given = grants.withWatermark(at, late).select(F.col(user), F.col(at), F.col(id_).cast("long").alias("id"), F.col(credits).cast("long").alias("credits"), F.unix_millis(F.col(at).cast("timestamp")).alias("__ms"))
    out = T.StructType([T.StructField("user", grants.schema[user].dataType), *_struct("first_ms long, ended_ms long, credits long").fields])
    return given.groupBy(user).transformWithState(_Expiry(days * 86_400_000), out, "append", "eventTime")


def ended_sessions(grants: DataFrame, user: str, id_: str, credits: str, at: str, days: int = 7) -> DataFrame:
    """The batch form of ``expiries``, ended or not: runs of grants that reach each other."""
    once = grants.where(F.col(id_).isNotNull()).groupBy(user, id_).agg(F.min(F.struct(F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.coalesce(F.col(credits), F.lit(0)).cast("long").alias("credits"))).alias("g"))
    lasting = days * 86_400_000
    w = Window.partitionBy(user).orderBy("g.ms", id_)
    starts = once.withColumn("new", (F.col("g.ms") > F.lag("g.ms").over(w) + lasting).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return starts.groupBy(F.col(user).alias("user"), "run").agg(F.min("g.ms").alias("first_ms"), (F.max("g.ms") + lasting).alias("ended_ms"), F.sum("g.credits").alias("credits")).drop("run")
