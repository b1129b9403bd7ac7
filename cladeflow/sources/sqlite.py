"""SRC-09: SQLite tables, read only.

`read_table` is a Spark data source over one database file. On a cluster Spark ships the file to every executor (`addFile`, which
takes paths of any Hadoop file system; two files of one name can't be shipped in a session), and each task reads a range of rowids of the columns that are asked for, so no rows
pass through the driver; it only asks the file for its columns and the ends of its rowids.

`scan` runs a query in each of many small databases that are values of a column, as `binaryFile` reads them; `pack` makes
such databases out of rows, one a shard.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 20_000
#: Declared types by what their names hold, in SQLite's own order of precedence.
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The Spark type of a column's declared type; one that is not declared, or numeric, is read as a double if it is a number by name, else as a string."""
    upper = (declared or "").upper()
    for part, kind in AFFINITY:
        if part in upper:
            return kind
    return "double" if any(x in upper for x in ("NUM", "DEC")) else "string"


def own(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def located(path: str) -> str:
    """Where a task finds the file: at its own path if that is on this machine, as in local mode and on shared disks, else where Spark has put it."""
    return own(path) if os.path.exists(own(path)) else SparkFiles.get(os.path.basename(path))


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)


class Rows(InputPartition):
    """Rowids from low to high, or all rows if there are no rowids."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def _select(self, what: str, *conditions: str) -> str:
        given = [f"{quoted(self.options['equalcolumn'])} = ?"] if "equalcolumn" in self.options else []
        where = " AND ".join([*given, *conditions])
        return f"SELECT {what} FROM {quoted(self.options['table'])}" + (f" WHERE {where}" if where else "")

    def _given(self) -> list:
        if "equalcolumn" not in self.options:
            return []
        value = self.options["equalvalue"]
        return [int(value) if self.options["equaltype"] == "int" else value]

    def partitions(self) -> list[InputPartition]:
        with closing(connect(located(self.options["file"]))) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # a table without rowids
                return [Rows(None, None)]
            if low is None:  # no rows, or a view, whose rowids are null
                return [Rows(None, None)]
        n = max(1, min(int(self.options["partitions"]), high - low + 1))
        edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
        return [Rows(a, b - 1) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        columns = ", ".join(quoted(c) for c in schema.names) or "NULL"
        ranged = partition.low is not None
        sql = self._select(columns, *(["rowid BETWEEN ? AND ?"] if ranged else []))
        with closing(connect(located(self.options["file"]))) as db:
            rows = db.execute(sql, self._given() + ([partition.low, partition.high] if ranged else []))
            while batch := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), schema)], schema=schema)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def table_schema(path: str, table: str) -> dict[str, str]:
    """Columns and their Spark types."""
    with closing(connect(path)) as db:
        columns = db.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not columns:
        raise ValueError(f"no table {table} in {path}")
    return {name: spark_type(declared) for _, name, declared, *_ in columns}


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, equal: tuple[str, int | str] | None = None, partitions: int = 8) -> DataFrame:
    """A table or view of a database file. equal: a column and the value that its rows must have; this and `columns` are done by SQLite."""
    if not (re.match(r"local($|\[)", spark.sparkContext.master) and os.path.exists(own(path))):
        spark.sparkContext.addFile(path)
    kinds = table_schema(located(path), table)
    chosen = columns or list(kinds)
    if missing := [c for c in [*chosen, *(equal[:1] if equal else [])] if c not in kinds]:
        raise ValueError(f"{table} has no columns {missing}")
    schema = StructType.fromDDL(", ".join(f"`{c.replace('`', '``')}` {kinds[c]}" for c in chosen))
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format(SqliteSource.name()).schema(schema).option("file", path).option("table", table).option("partitions", partitions)
    if equal:
        reader = reader.option("equalcolumn", equal[0]).option("equalvalue", equal[1]).option("equaltype", type(equal[1]).__name__)
    return reader.load()


def pack(df: DataFrame, table: str, shards: int) -> DataFrame:
    """(shard, database): the rows dealt into `shards` databases with the one table; a shard must fit into a task."""
    names = df.columns
    columns = ", ".join(quoted(c) for c in names)
    made = f"CREATE TABLE {quoted(table)} ({columns})"
    put = f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})"

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        with closing(sqlite3.connect(":memory:")) as db:
            db.execute(made)
            for batch in rows.select(names).to_batches(BATCH):
                db.executemany(put, zip(*(c.to_pylist() for c in batch.columns)))
            db.commit()
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "database": pa.array([db.serialize()], pa.binary())})

    dealt = df.withColumn("__shard", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(shards)))
    return dealt.groupBy("__shard").applyInArrow(one, "shard long, database binary")


def scan(databases: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of a read-only query in each of the databases in column `database`."""
    whole = StructType.fromDDL(schema)
    names, kinds = whole.names, to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(value.as_py())
                    db.execute("PRAGMA query_only = ON")
                    rows = db.execute(sql)
                    while part := rows.fetchmany(BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kinds)], names)

    return databases.select("database").mapInArrow(run, whole)
