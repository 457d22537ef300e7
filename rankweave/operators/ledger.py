"""State machines over each key's rows in order: credits that unlock items.

A machine is small: a state and a step.  ``fold_in_order`` streams each key's rows
through it in batch, in a task's constant memory, and ``streaming.keyed`` keeps the
same states for streams, so that both run the same code.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Machine(Protocol):
    """What a key's rows are folded with.

    ``state_schema`` and ``out_schema`` are DDL; ``step`` takes a state (a tuple, or
    None at first) and a row, and gives the new state and the rows to hand out.
    """

    state_schema: str
    out_schema: str

    def step(self, state: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[tuple]]: ...


def fold_in_order(rows: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """(key, what the machine hands out): each key's rows, in order, through the machine.

    A key's rows are streamed, never held: a task has one state at a time.  The order
    should be total; null keys are one key; an empty table gives an empty one.
    """
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)
    names = T.StructType.fromDDL(machine.out_schema)
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *names.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    now, state, begun = row[key], None, True
                state, handed = machine.step(state, row)
                out += [(now, *x) for x in handed]
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return sorted_rows.mapInArrow(run, schema)


class Unlocks:
    """Credits that unlock items: rows have ``kind``, ``item``, ``credits``, ``at`` (microseconds) and ``id``.

    * ``grant``: adds credits, and all of them then last for ``days`` from now.
    * ``tier``: a paying member (credits of 1 or more) or none (0) from now on.
    * ``keep``: the item is unlocked for good.
    * ``unlock``: granted to paying members; for items unlocked for good; for items unlocked
      before while credits last; else for one credit, if any is left and they last.
      A request after the credits' end empties them.

    Of every request, its id, whether it was granted, why, and the credits left are handed out.
    Items are remembered once a credit or a ``keep`` was given for them, so the state grows
    with what was given, not with what was asked.
    """

    state_schema = "credits long, until long, paying boolean, opened array<bigint>, kept array<bigint>"
    out_schema = "id long, granted boolean, reason string, credits long"

    def __init__(self, days: int = 7) -> None:
        self.lasting = int(dt.timedelta(days=days).total_seconds()) * 1_000_000

    def step(self, state: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[tuple]]:
        credits, until, paying, opened, kept = state or (0, None, False, [], [])
        kind, item, at = row["kind"], row["item"], row["at"]
        if kind == "grant":
            credits, until = credits + (row["credits"] or 0), at + self.lasting
        elif kind == "tier":
            paying = (row["credits"] or 0) > 0
        elif kind == "keep":
            kept = kept if item in kept else [*kept, item]
        elif kind == "unlock":
            lasts = until is not None and until >= at
            if paying:
                granted, why = True, "tier"
            elif item in kept:
                granted, why = True, "kept"
            elif item in opened and until is not None and until > at:
                granted, why = True, "open"
            elif not lasts:
                granted, why, credits, until = False, "expired", 0, None
            elif credits > 0:
                granted, why, credits = True, "spent", credits - 1
                opened = opened if item in opened else [*opened, item]
            else:
                granted, why = False, "empty"
            return (credits, until, paying, opened, kept), [(row["id"], granted, why, credits)]
        return (credits, until, paying, opened, kept), []


class Floored:
    """A count after signed changes (``change``), at no step under 0; hands out the count after each row."""

    state_schema = "n long"
    out_schema = "n long"

    def step(self, state: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[tuple]]:
        n = max((state[0] if state else 0) + (row["change"] or 0), 0)
        return (n,), [(n,)]


class Streak:
    """Failures since the last success (``ok``); hands out the streak after each row."""

    state_schema = "streak long"
    out_schema = "streak long"

    def step(self, state: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[tuple]]:
        streak = 0 if row["ok"] else (state[0] if state else 0) + 1
        return (streak,), [(streak,)]
