"""Tables of SQLite files as a Spark data source: read in ranges of rowid, with conditions that the database checks.

The file must be where all executors see it. Nothing is copied: each task opens the file for reading only and asks for its
range of rows, so a table is never whole in one place.

Conditions are given with the table. Those of later where() calls aren't handed over: Spark 4.1.2 keeps the conditions that
a Python source took for one query in the relation, and a further query on it without any would read with the old ones.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

ROWS, PARTS = 10_000, 8
#: A condition: column, one of these or `in`, and a value, a list of them, or None for the last two.
COMPARED = ("=", "<>", "<", "<=", ">", ">=", "is null", "is not null")
Condition = tuple[str, str, Any]


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> DataType:
    """Spark's type of a declared one, by the affinity the database gives it."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if not d or "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


class Range(InputPartition):
    """Rows with first <= rowid < end; all rows of what has no rowid if there are no bounds."""

    def __init__(self, first: int | None, end: int | None) -> None:
        self.first, self.end = first, end


class TableReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        self.parts = int(options.get("parts", PARTS))
        self.wheres: list[str] = []
        self.values: list[Any] = []
        for column, how, value in json.loads(options.get("conditions", "[]")):
            self._hand_over(column, how, value)

    def _hand_over(self, column: str, how: str, value: Any) -> None:
        """Add a condition on a column as it is read, that is after its cast."""
        if column not in self.schema.names or how not in (*COMPARED, "in"):
            raise ValueError(f"not a condition: {column} {how}")
        values = [] if how.endswith("null") else value if how == "in" else [value]
        marks = f"({', '.join('?' * len(values))})" if how == "in" else "?" * len(values)
        self.wheres.append(f"{self._cast(column)} {how} {marks}")
        self.values += values

    def _cast(self, name: str) -> str:
        kind = {LongType: "integer", DoubleType: "real", StringType: "text"}.get(type(self.schema[name].dataType))
        return f"cast({_named(name)} as {kind})" if kind else _named(name)

    def partitions(self) -> list[Range]:
        with _opened(self.path) as db:
            if db.execute("select 1 from sqlite_master where name = ? and type = 'view'", [self.table]).fetchone():
                return [Range(None, None)]
            try:
                least, most = db.execute(f"select min(rowid), max(rowid) from {_named(self.table)}").fetchone()
            except sqlite3.OperationalError as e:
                if "no such column" not in str(e):
                    raise
                return [Range(None, None)]  # a table without rowid
        if least is None:
            return [Range(0, 0)]
        step = max(1, -(-(most + 1 - least) // self.parts))
        return [Range(at, min(at + step, most + 1)) for at in range(least, most + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        wheres, values = list(self.wheres), list(self.values)
        if partition.first is not None:
            wheres, values = [*wheres, "rowid >= ?", "rowid < ?"], [*values, partition.first, partition.end]
        asked = f"select {', '.join(self._cast(f.name) for f in self.schema)} from {_named(self.table)}"
        db = _opened(self.path)
        try:
            rows = db.execute(asked + (" where " + " and ".join(wheres) if wheres else ""), values)
            while some := rows.fetchmany(ROWS):
                yield from some
        finally:
            db.close()


class SqliteTable(DataSource):
    """Format `sqlite_table`: options path, dbtable, parts (ranges of rowid, PARTS by default), conditions (in JSON)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _opened(self.options["path"]) as db:
            columns = db.execute(f"pragma table_info({_named(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']} in {self.options['path']}")
        return StructType([StructField(name, _kind(declared)) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(dict(self.options), schema)


def database_table(spark: SparkSession, path: str, table: str, conditions: list[Condition] | None = None, parts: int = PARTS) -> DataFrame:
    """The rows of a table or view of the SQLite file at `path` that meet all conditions; a null meets none but `is null`.

    Values of other types than their column's are cast as the database casts.
    """
    spark.dataSource.register(SqliteTable)
    options = {"path": path, "dbtable": table, "parts": str(parts), "conditions": json.dumps(conditions or [])}
    return spark.read.format("sqlite_table").options(**options).load()
