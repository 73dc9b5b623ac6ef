"""SQLite files as a Spark source: read only, in ranges of rowid, with columns and filters handed to SQLite.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", ...).option("table", ...).load()

The file has to be in reach of every executor (a shared folder).
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from .candles import DataError

#: Rows of a partition, by rowid.
ROWS = 250_000
BATCH = 20_000


def connect(path: str) -> sqlite3.Connection:
    """A connection that can't write, and makes no file."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if not os.path.isfile(plain):
        raise DataError(f"no database at {path}")
    return sqlite3.connect(f"file:{plain}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """Tables and views in order of their names, without SQLite's own."""
    with contextlib.closing(connect(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def columns(path: str, table: str) -> list[tuple[str, str]]:
    """(name, Spark type) by SQLite's rules of affinity."""
    with contextlib.closing(connect(path)) as db:
        found = db.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    if not found:
        raise DataError(f"no table {table}")

    def kind(declared: str) -> str:
        d = declared.upper()
        if "INT" in d:
            return "bigint"
        if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
            return "string"
        if "BLOB" in d:
            return "binary"
        return "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"

    return [(r[1], kind(r[2] or "")) for r in found]


def _condition(f: Filter) -> tuple[str, list] | None:
    """SQL and its parameters for a filter that SQLite judges as Spark does; None leaves it to Spark."""
    if len(f.attribute) != 1:
        return None
    at = _name(f.attribute[0])
    signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if type(f) in signs and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
        return f"{at} {signs[type(f)]} ?", [f.value]
    if isinstance(f, In) and all(isinstance(v, (int, float, str)) and not isinstance(v, bool) for v in f.value) and len(f.value) <= 500:
        return f"{at} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, IsNotNull):
        return f"{at} IS NOT NULL", []
    if isinstance(f, IsNull):
        return f"{at} IS NULL", []
    return None


@dataclass
class Range(InputPartition):
    """Rows of ids from low to high; all rows where there are no ids (a view)."""

    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = _condition(f)
            if found is None:
                yield f
            else:
                self.conditions.append(found)

    def partitions(self) -> Sequence[InputPartition]:
        with contextlib.closing(connect(self.path)) as db:
            if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'view' AND name = ?", [self.table]).fetchone():
                return [Range(None, None)]
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowids
                return [Range(None, None)]
        if low is None:
            return [Range(0, -1)]
        return [Range(at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]

    def sql(self, part: Range) -> tuple[str, list]:
        conditions = list(self.conditions)
        if part.low is not None:
            conditions.append(("rowid BETWEEN ? AND ?", [part.low, part.high]))
        where = " AND ".join(c for c, _ in conditions)
        asked = ", ".join(_name(f.name) for f in self.schema.fields)
        return f"SELECT {asked} FROM {_name(self.table)}" + (f" WHERE {where}" if where else ""), [v for _, vs in conditions for v in vs]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[f.dataType.simpleString()] for f in self.schema.fields]
        casts = {"bigint": int, "double": float, "string": str, "binary": bytes}
        convert = [casts[f.dataType.simpleString()] for f in self.schema.fields]
        with contextlib.closing(connect(self.path)) as db:
            cursor = db.execute(*self.sql(partition))
            while rows := cursor.fetchmany(BATCH):
                held = [[None if x is None else c(x) for x in column] for c, column in zip(convert, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types, strict=True)], names=[f.name for f in self.schema.fields])


class SqliteSource(DataSource):
    """Options: path, table, columns (names with commas; all by default) and rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        found = columns(self.options["path"], self.options["table"])
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if missing := set(wanted) - {n for n, _ in found}:
            raise DataError(f"no column {sorted(missing)[0]}")
        types = dict(found)
        return ", ".join(f"`{n}` {types[n]}" for n in wanted or types)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", ROWS)))


def read_table(spark: SparkSession, path: str, table: str, columns: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """A table's columns (all by default). Filters that follow reach SQLite where the session allows it, which is set here."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("columns", ",".join(columns)).option("rows", rows).load()


def candle_rows(spark: SparkSession, path: str, table: str, mapping: dict[str, str | None], symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Rows of one source under their logical names: only its columns are read, and only its symbol and timeframe."""
    there = {k: v for k, v in mapping.items() if v}
    df = read_table(spark, path, table, list(dict.fromkeys(there.values())))
    for key, value in (("symbol", symbol), ("timeframe", timeframe)):
        if key in there and value is not None:
            df = df.where(df[there[key]] == value)
    return df.select(*(df[v].alias(k) for k, v in there.items()))
