"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import cut, shared_folder

#: ASCII white space, the separators of words `[^\x20\x09-\x0D]+`; bytes.split() splits on just these.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
ORIGINAL = "__row"

__all__ = ["ORIGINAL", "WHITE", "WORD", "checkpoint_folder", "cut", "mix64", "named", "own", "packed", "slices", "table", "with_fields", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return F.col(f"`{column.replace('`', '``')}`")


def own(column: str) -> Column:
    """A column of the packed row."""
    return F.col(f"{ORIGINAL}.`{column.replace('`', '``')}`")


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows as one struct column beside their text, so that no column of the input clashes with computed ones."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias(ORIGINAL), F.coalesce(named(text).cast("string"), F.lit("")).alias("__text"))


def with_fields(rows: DataFrame, kept: list[str], added: str) -> StructType:
    """The schema of some columns of rows and of new ones, given as DDL; no name of a kept one is parsed."""
    return StructType([rows.schema[c] for c in kept] + StructType.fromDDL(added).fields)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set and the master is local, as in tests."""
    return shared_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: Parquet, which packs rows closer than a checkpoint does."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes; a single longer text is a part of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 arrays."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
