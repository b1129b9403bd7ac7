"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may do without: it gets one of its own, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Rows of a table that is sent to every executor at most.
SMALL_ROWS = 1_000_000


def if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """The rows, marked to be broadcast if a count says that they are few; else they are joined by shuffle."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= (SMALL_ROWS if most is None else most) else rows


#: Rows of a task, about, that sorts or holds them, whatever the size of the table.
TASK_ROWS = 300_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, ranges: bool = False) -> DataFrame:
    """The rows dealt by keys, or by ranges of them, into as many tasks as keep each at about TASK_ROWS; `rows` is their number, if known.

    Sizes in bytes don't bound a task: files and shuffled rows of repeated strings are a tenth of what they are in memory.
    """
    n = df.count() if rows is None else rows
    return (df.repartitionByRange if ranges else df.repartition)(max(1, -(-n // TASK_ROWS)), *keys)


def join_frequent(left: DataFrame, right: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """An inner join in which a key that many rows of `left` share is joined where they are, so that no task gets them all.

    Such keys have over a tenth of TASK_ROWS rows each, so they are few; with their rows of `right` they are sent to all tasks, if a
    count allows that; the rest is dealt by key. `rows` is the number of left rows, if known. Keys that are null find nothing.
    """
    n = left.count() if rows is None else rows
    often = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > TASK_ROWS // 10).select(*on)
    near = cut(right.join(F.broadcast(cut(often)), on, "left_semi"))
    if n <= TASK_ROWS:
        return left.join(right, on)
    others = dealt(right, *on, rows=n).hint("merge")
    if near.isEmpty():
        return dealt(left, *on, rows=n).join(others, on)
    near = if_small(near)
    keys = near.select(*on).distinct()
    # not by the session's number of partitions, which does not grow with the table
    rest = dealt(left.join(F.broadcast(keys), on, "left_anti"), *on, rows=n).join(others, on)
    return left.join(near, on).unionByName(rest)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
