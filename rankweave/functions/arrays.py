"""Array expressions over the elements of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that ``running`` takes one by one.
RUN = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a costly value several times but computes it once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each number of an array, what ``step`` makes of ``start`` and all numbers before it.

    ``step`` must be associative, with ``start`` as its neutral value.  Runs of ``RUN`` numbers
    are taken one by one and then put together: growing one array would be quadratic.
    """
    at = lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    empty = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(values, i + 1, RUN))

    def joined(runs: Column) -> Column:
        before = F.aggregate(runs, empty, lambda acc, r: at(acc, r["at"]))["out"]
        return F.flatten(F.zip_with(runs, before, lambda r, b: F.transform(r["out"], lambda v: step(b, v))))

    return bind(F.transform(cut, lambda part: F.aggregate(part, empty, at)), joined)
