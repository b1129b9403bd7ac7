"""Publishing tables: versions beside each other, and a log that says which one is the table.

A published path holds `_versions`, a folder for each write, and `_log`, a numbered file for each publish. A version is
written whole before its number is put into the log, in one step that fails if the number is there already. So a
reader finds the last whole table at every moment, a failed write leaves what was there, and of two writers that began
from the same table one is told that it came too late. What a table was made from is in the same file, so table and
manifest can't disagree. Old versions stay for their readers until `sweep`.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_NUMBER = re.compile(r"^(\d{20})\.json$")


class ConcurrentPublish(RuntimeError):
    """Another writer published first."""


class IncompleteMerge(ValueError):
    """A part is missing or is not what it should be."""


@dataclass(frozen=True)
class Entry:
    """A publish: its number, the folder of its version, and what it was made from."""

    number: int
    folder: str
    fmt: str = "parquet"
    facts: dict = field(default_factory=dict)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file in one step, unless there is one; whether it is ours.

    The file is written beside its place and moved there: a rename to a name that is taken fails on HDFS and what
    follows it; on a local disk, where it would replace, a link does. `text` must be unlike that of other writers.
    """
    fs, target = file_system(spark, path)
    parent = target.getParent()
    staged = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}.staged")
    fs.mkdirs(parent)
    out = fs.create(staged, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            nio = spark._jvm.java.nio.file
            ends = [nio.Paths.get(fs.makeQualified(x).toUri()) for x in (target, staged)]
            nio.Files.createLink(*ends)
            return True
        if fs.rename(staged, target):
            return True
    except Py4JJavaError:
        if not fs.exists(target):
            raise
    finally:
        fs.delete(staged, False)
    # an answer may be lost on its way: the file says whose it is
    return fs.exists(target) and _text(spark, path) == text


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, log = file_system(spark, f"{path.rstrip('/')}/_log")
    if not fs.exists(log):
        return []
    found = (_NUMBER.match(x.getPath().getName()) for x in fs.listStatus(log))
    return sorted(int(m[1]) for m in found if m)


def _log_file(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/_log/{number:020d}.json"


def entry(spark: SparkSession, path: str, number: int) -> Entry:
    made = json.loads(_text(spark, _log_file(path, number)))
    return Entry(number, f"{path.rstrip('/')}/_versions/{made['version']}", made["format"], made["facts"])


def current(spark: SparkSession, path: str) -> Entry | None:
    """The last publish, or none."""
    for last_try in (False, False, True):
        numbers = _numbers(spark, path)
        if not numbers:
            return None
        try:
            return entry(spark, path, numbers[-1])
        except Py4JJavaError:  # swept since it was listed: there is a later one
            if last_try:
                raise
    return None


def publish(df: DataFrame, path: str, fmt: str = "parquet", facts: dict | None = None, after: int | None = None, **options) -> int:
    """SRC-13: the rows as the next version of the table at `path`; its number.

    after: the publish that these rows follow on (0: none), by default the last one now. If another has come since, the rows are
    dropped and ConcurrentPublish is raised.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    if after is None:
        now = current(spark, path)
        after = now.number if now else 0
    folder = f"{path.rstrip('/')}/_versions/{version}"
    done = False
    try:
        df.write.format(fmt).options(**options).save(folder)
        commit(spark, path, after, facts or {}, version, fmt)
        done = True
    finally:
        if not done:
            fs, p = file_system(spark, folder)
            fs.delete(p, True)
    return after + 1


def commit(spark: SparkSession, path: str, after: int, facts: dict, version: str | None = None, fmt: str = "parquet") -> None:
    """Make facts, and the version that they are of, the publish that follows `after`."""
    text = json.dumps({"version": version, "format": fmt, "facts": facts, "at": time.time(), "by": uuid.uuid4().hex}, sort_keys=True)
    if not put_if_absent(spark, _log_file(path, after + 1), text):
        raise ConcurrentPublish(f"{path} was published by another writer after version {after}")


def read_published(spark: SparkSession, path: str, number: int | None = None, **options) -> DataFrame:
    """The table as last published, or as of a publish that was not swept."""
    found = entry(spark, path, number) if number is not None else current(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.format(found.fmt).options(**options).load(found.folder)


def sweep(spark: SparkSession, path: str, keep: int = 2, grace_seconds: float = 86_400) -> int:
    """Delete versions but for the last `keep`, and what failed writers left; nothing younger than the grace. How many folders went.

    The grace must be longer than a write and than a read of a version takes.
    """
    check_positive(keep=keep)
    numbers = _numbers(spark, path)
    kept = {entry(spark, path, n).folder.rsplit("/", 1)[1] for n in numbers[-keep:]}
    fs, versions = file_system(spark, f"{path.rstrip('/')}/_versions")
    if not fs.exists(versions):
        return 0
    before, gone = (time.time() - grace_seconds) * 1000, set()
    for x in fs.listStatus(versions):
        if x.getPath().getName() not in kept and x.getModificationTime() <= before:
            gone.add(x.getPath().getName())
            fs.delete(x.getPath(), True)
    for n in numbers[:-keep]:
        if entry(spark, path, n).folder.rsplit("/", 1)[1] in gone:
            fs.delete(file_system(spark, _log_file(path, n))[1], False)
    return len(gone)


def complete(spark: SparkSession, path: str) -> bool:
    """ORC-02: whether a folder of files is there and was committed."""
    fs, p = file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def is_current(spark: SparkSession, path: str, facts: dict) -> bool:
    """ORC-03: whether the table at `path` was made from these facts."""
    now = current(spark, path)
    return now is not None and now.facts == json.loads(json.dumps(facts))


def stage_table(df_of: Callable[[], DataFrame], spark: SparkSession, path: str, facts: dict, **options) -> DataFrame:
    """ORC-02: a stage's table, made only if it is missing or stale."""
    if not is_current(spark, path, facts):
        publish(df_of(), path, facts=facts, **options)
    return read_published(spark, path)


def merge_parts(spark: SparkSession, parts: list[str], path: str, combine: Callable[[DataFrame], DataFrame], facts: dict | None = None) -> int:
    """ORC-07: the published parts as one table; nothing is published if one is missing, or was not made from `facts` if these are given.

    The manifest has the number of each part, so that `merge_is_current` sees a part that was published anew.
    """
    found = {p: current(spark, p) for p in parts}
    bad = [p for p, x in found.items() if x is None or facts is not None and x.facts != json.loads(json.dumps(facts))]
    if bad or not parts:
        raise IncompleteMerge(f"parts are missing or stale: {bad or 'all'}")
    rows = reduce(DataFrame.unionByName, [read_published(spark, p, x.number) for p, x in found.items()])
    return publish(combine(rows), path, facts={"parts": {p: x.number for p, x in found.items()}})


def merge_is_current(spark: SparkSession, parts: list[str], path: str) -> bool:
    """Whether the merged table was made from the parts as they are now."""
    now = {p: current(spark, p) for p in parts}
    return all(now.values()) and is_current(spark, path, {"parts": {p: x.number for p, x in now.items()}})


def check_positive(**values: float) -> None:
    """ORC-09: sizes must be positive."""
    for name, v in values.items():
        if v <= 0:
            raise ValueError(f"{name} must be positive, not {v}")


def check_not_negative(**values: float) -> None:
    for name, v in values.items():
        if v < 0:
            raise ValueError(f"{name} must not be negative, not {v}")
