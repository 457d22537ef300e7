"""SQLite as a data source: a file, or a folder of files that hold parts of one table.

``spark.dataSource.register(SqliteSource)`` makes format ``sqlite`` known, with options
``path``, ``table`` (default ``rows``), and ``partitions`` (of each file, default 4).
Files are read in ranges of row numbers; simple comparisons go into each file's WHERE,
if ``spark.sql.python.filterPushdown.enabled`` is on.  As SQLite has one writer for a
file, each task writes a file of its own into the folder, and committing lists them;
what failed tasks leave is in no list.  Paths must be mounted on every executor.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

LIST = "_parts.json"
#: Comparisons that SQLite makes as Spark does.
COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
NAMES = {T.LongType: "BIGINT", T.IntegerType: "INT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "REAL", T.StringType: "TEXT", T.BooleanType: "BOOLEAN", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP_NTZ"}
KINDS = {name: kind for kind, name in NAMES.items()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    """The Spark type of a column as it was declared; foreign declarations go by SQLite's affinity rules."""
    name = (declared or "").upper()
    if m := re.fullmatch(r"DECIMAL\((\d+), ?(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if name in KINDS:
        return KINDS[name]()
    if "INT" in name:
        return T.LongType()
    if re.search("CHAR|CLOB|TEXT", name):
        return T.StringType()
    if "BLOB" in name:
        return T.BinaryType()
    return T.DoubleType() if re.search("REAL|FLOA|DOUB", name) else T.StringType()


def _stored(value: Any) -> Any:
    """A value as SQLite keeps it: dates, times and decimals as text."""
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.UTC).replace(tzinfo=None).isoformat(" ") if value.tzinfo else value.isoformat(" ")
    return value.isoformat() if isinstance(value, dt.date) else value


def _read(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return str(value) if isinstance(kind, T.StringType) else float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def _files(path: str) -> list[str]:
    """The files of a table: the path itself, or those that its folder lists."""
    if not os.path.isdir(path):
        return [path]
    with open(os.path.join(path, LIST)) as f:
        return [os.path.join(path, name) for name in json.load(f)["parts"]]


def _opened(path: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


@dataclass
class Range(InputPartition):
    """Rows of one file, by row number."""

    path: str
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.table, self.parts, self.schema = options["path"], options.get("table", "rows"), int(options.get("partitions", 4)), schema
        self.where, self.values = ["1"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take comparisons of whole columns of numbers and texts; hand back the others."""
        plain = {f.name for f in self.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.StringType, T.BooleanType))}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, (IsNull, IsNotNull)) and column:
                self.where.append(f"{_quoted(column)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            elif column in plain and type(f) in COMPARED:
                self.where.append(f"{_quoted(column)} {COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif column in plain and isinstance(f, In) and len(f.value) < 500:
                self.where.append(f"{_quoted(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            with _opened(path) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                width = max(1, -(-(high - low + 1) // self.parts))
                out += [Range(path, at, min(at + width, high + 1)) for at in range(low, high + 1, width)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        names, kinds = ", ".join(_quoted(f.name) for f in self.schema) or "1", [f.dataType for f in self.schema]
        with _opened(partition.path) as db:
            found = db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ? AND {' AND '.join(self.where)}", [partition.low, partition.high, *self.values])
            for row in found:
                yield tuple(_read(v, k) for v, k in zip(row, kinds))


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool) -> None:
        self.path, self.table, self.schema, self.overwrite = options["path"], options.get("table", "rows"), schema, overwrite

    def write(self, rows: Iterator) -> Part:
        """A file with this task's rows, written in one transaction."""
        first = next(rows, None)
        if first is None:
            return Part(None)
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.db"
        columns = ", ".join(f"{_quoted(f.name)} {NAMES.get(type(f.dataType)) or f.dataType.simpleString()}" for f in self.schema)

        def stored() -> Iterator[tuple]:
            yield tuple(map(_stored, first))
            for row in rows:
                yield tuple(map(_stored, row))

        with closing(sqlite3.connect(os.path.join(self.path, name))) as db, db:
            db.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", stored())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        """List the new files, after those there before unless they are overwritten."""
        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, LIST)
        before = [] if self.overwrite or not os.path.exists(target) else [os.path.basename(p) for p in _files(self.path)]
        parts = before + sorted(m.name for m in messages if m and m.name)
        with open(target + ".new", "w") as f:
            json.dump({"parts": parts, "schema": self.schema.jsonValue()}, f)
        os.replace(target + ".new", target)  # readers see the old list or the new one

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m and m.name and os.path.exists(os.path.join(self.path, m.name)):
                os.remove(os.path.join(self.path, m.name))


class SqliteSource(DataSource):
    """Format ``sqlite``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        path, table = self.options["path"], self.options.get("table", "rows")
        if os.path.isdir(path):
            with open(os.path.join(path, LIST)) as f:
                return T.StructType.fromJson(json.load(f)["schema"])
        with _opened(path) as db:
            return T.StructType([T.StructField(r[1], _kind(r[2])) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(dict(self.options), schema, overwrite)
