"""Sums and folds in an order, over any number of tasks.

A window without partitions puts all rows into one task, and a window by a key
puts a hot key's rows there.  Here rows are dealt by ranges of their order and
sorted; each task scans its own range, and what the ranges before it come to, one
row for each task (or each task and key), is put in afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.operators.shared import materialize

#: Names or columns to sort by.
Order = list[str | Column]


def _sum_type(kind: T.DataType) -> T.DataType:
    """The type in which values of a type are added up."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else T.LongType()


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.decimal128(38, kind.scale) if isinstance(kind, T.DecimalType) else pa.float64() if isinstance(kind, T.DoubleType) else pa.int64()


def running_total(rows: DataFrame, order: Order, value: str | None = None, out: str = "running", number: str | None = None) -> DataFrame:
    """Add the sum of ``value`` (1 where it is None) over all rows up to each, in the order given.

    ``number`` names a column for the row's number, from 1.  The order should be a
    total one; rows that are equal in it come as they are read.  A null value adds
    nothing.  An empty table stays empty; a column named like a new one is replaced.
    """
    keep = [c for c in rows.columns if c not in (out, number)]
    kind = _sum_type(rows.schema[value].dataType) if value else T.LongType()
    added = F.coalesce(F.col(f"`{value}`").cast(kind), F.lit(0).cast(kind)) if value else F.lit(1).cast("long")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = dealt.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), added.alias("value"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("value")
            if isinstance(kind, T.DecimalType):  # Arrow adds up no decimals
                sums = pa.array(list(accumulate(values.to_pylist(), initial=total))[total is not None :], _arrow(kind))
                total = sums[-1].as_py()
            else:
                sums = pc.cumulative_sum(values, start=total) if total is not None else pc.cumulative_sum(values)
                total = sums[-1]
            place = pa.array(np.arange(n + 1, n + 1 + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("row"), sums.cast(_arrow(kind)), place, pa.array(np.full(batch.num_rows, part, np.int32))], names=["row", "sum", "n", "part"])

    schema = T.StructType([ranges.schema["row"], T.StructField("sum", kind), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType())])
    local = materialize(ranges.mapInArrow(scan, schema), "running")
    # a row for each task
    totals = sorted((r.part, r.sum, r.n) for r in local.groupBy("part").agg(F.max_by("sum", "n").alias("sum"), F.max("n").alias("n")).collect())
    zero = totals[0][1] * 0 if totals else 0
    sums, counts = ([*accumulate(x[:-1], initial=z)] if x else [] for x, z in (([t[1] for t in totals], zero), ([t[2] for t in totals], 0)))
    before = T.StructType([schema["part"], T.StructField("sum0", kind), T.StructField("n0", T.LongType())])
    offsets = local.sparkSession.createDataFrame([(t[0], s, c) for t, s, c in zip(totals, sums, counts)], before)
    placed = local.join(F.broadcast(offsets), "part")
    new = [(F.col("sum0") + F.col("sum")).cast(kind).alias(out)] + ([(F.col("n0") + F.col("n")).alias(number)] if number else [])
    return placed.select("row.*", *new)


def floored_counters(ops: DataFrame, key: str, order: list[str], delta: str, out: str = "n") -> DataFrame:
    """(key, n): each key's count after its signed changes in order, at no step under 0.

    A run of changes is summed up by its total and its least prefix, with which runs
    can be put together in any grouping: after a run that starts at x the count is
    total + max(x, -least).  So a hot key's changes are cut between tasks, each of
    which hands on one row of it.  A null change counts as 0; null keys are one key;
    ``order`` should be total, as for ``running_total``.
    """
    by = [f"`{key}`", *order]
    change = F.coalesce(F.col(f"`{delta}`").cast("long"), F.lit(0))
    ranges = ops.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(f"`{key}`").alias("key"), change.alias("change"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # of the key whose rows may go on: its (total, least)

        def handed(keys: pa.Array, totals: list[int], leasts: list[int]) -> pa.RecordBatch:
            n = len(totals)
            return pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, part, np.int32)), pa.array(totals, pa.int64()), pa.array(leasts, pa.int64())], names=["key", "part", "total", "least"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            runs = pc.run_end_encode(keys)
            stops = np.asarray(runs.run_ends)
            starts = np.concatenate([[0], stops[:-1]])
            sums = np.cumsum(batch.column("change").to_numpy())
            before = np.concatenate([[0], sums[stops[:-1] - 1]])
            totals, leasts = sums[stops - 1] - before, np.minimum.reduceat(sums, starts) - before
            heads = runs.values
            if held:
                name, total, least = held
                if name.equals(heads.slice(0, 1)):
                    leasts[0], totals[0] = min(least, total + leasts[0]), total + totals[0]
                else:
                    yield handed(name, [total], [least])
            if len(heads) > 1:
                yield handed(heads.slice(0, len(heads) - 1), totals[:-1].tolist(), leasts[:-1].tolist())
            held = heads.slice(len(heads) - 1), int(totals[-1]), int(leasts[-1])
        if held:
            yield handed(held[0], [held[1]], [held[2]])

    schema = T.StructType([T.StructField("key", ops.schema[key].dataType), *T.StructType.fromDDL("part int, total long, least long").fields])
    runs = ranges.mapInArrow(fold, schema).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "total", "least"))).alias("runs"))  # at most a run for each task
    count = F.aggregate("runs", F.lit(0).cast("long"), lambda x, r: r["total"] + F.greatest(x, -F.least(r["least"], F.lit(0))))
    return runs.select(F.col("key").alias(key), count.alias(out))


def byte_cuts(rows: DataFrame, order: Order, size: str, max_bytes: int, out: str = "file_no") -> DataFrame:
    """Add the number, from 1, of the file that each row goes to when files are filled in order.

    A row begins a new file if the file so far and it would hold more than
    ``max_bytes``; a longer row has a file of its own.  Where the file that a row
    begins would end is a search in the running sizes, made in bins of ``max_bytes``
    with no more rows than fit into a file; which rows begin files is found by
    pointers that double their reach, in as many rounds as the logarithm of the
    number of files.  A null size counts as 0.
    """
    placed = materialize(running_total(rows, order, size, out="__end", number="__n"), "placed")
    sized = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0))
    points = placed.select(F.col("__n").alias("n"), (F.col("__end") - sized).alias("start"), F.col("__end").alias("end"))
    bin_of = lambda c: F.floor(c / F.lit(max_bytes))
    # the last row whose end is not beyond start + max_bytes: of the next bin, or else of the start's own
    limits = points.select((bin_of(F.col("start")) + 1).alias("bin"), (F.col("start") + max_bytes).alias("at"), F.lit(None).cast("long").alias("row"), F.col("n").alias("asks"))
    ends = points.select(bin_of(F.col("end")).alias("bin"), F.col("end").alias("at"), F.col("n").alias("row"), F.lit(None).cast("long").alias("asks"))
    seen = F.max("row").over(Window.partitionBy("bin").orderBy("at", F.col("asks").isNotNull()).rangeBetween(Window.unboundedPreceding, 0))
    found = limits.unionByName(ends).withColumn("fits", seen).where("asks is not null").select(F.col("asks").alias("n"), "fits")
    lasts = points.groupBy(bin_of(F.col("end")).alias("bin")).agg(F.max("n").alias("last"))
    asked = points.join(found, "n").join(lasts, bin_of(F.col("start")) == F.col("bin"), "left")
    nexts = materialize(asked.select("n", "start", (1 + F.greatest("n", F.coalesce("fits", "last", "n"))).alias("next")), "nexts")
    jumps, begins = nexts.select("n", F.col("next").alias("to")), nexts.where("n = 1").select("n")
    count = begins.count()
    while count:
        more = begins.union(begins.join(jumps, "n").select(F.col("to").alias("n"))).distinct()
        begins = materialize(more.join(nexts.select("n"), "n", "left_semi"), "begins")
        if (now := begins.count()) == count:
            break
        count = now
        jumps = materialize(jumps.join(jumps.select(F.col("n").alias("to"), F.col("to").alias("far")), "to").select("n", F.col("far").alias("to")), "jumps")
    files = running_total(begins.join(nexts, "n"), ["n"], number=out)
    # a file's rows begin in its first row's bin or in the one after
    spread = files.select(F.explode(F.array(bin_of(F.col("start")), bin_of(F.col("start")) + 1)).alias("bin"), F.col("n").alias("first"), "next", out)
    place = points.select("n", bin_of(F.col("start")).alias("bin")).join(spread, "bin").where("n >= first and n < next").select(F.col("n").alias("__n"), out)
    return placed.join(place, "__n").drop("__n", "__end")
