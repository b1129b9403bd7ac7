"""Publishing: readers and writers at once, failures, manifests, merges and sweeping."""

import threading

import pytest
from pyspark.sql import functions as F

from cladeflow.sources import publish


def table(spark, n, parts=4):
    """n * 10 rows that all hold n, in several files."""
    return spark.range(0, n * 10, 1, parts).select(F.lit(n).alias("n"))


def folders(path):
    return sorted(p.name for p in (path / "_versions").iterdir())


def test_publish_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert publish.stage_table(make, spark, path, {"d": 2}).count() == 3
    assert publish.stage_table(make, spark, path, {"d": 2}).count() == 3 and len(calls) == 1
    assert publish.stage_table(make, spark, path, {"d": 3}).count() == 3 and len(calls) == 2
    assert publish.is_current(spark, path, {"d": 3}) and not publish.is_current(spark, path, {"d": 2})
    assert publish.current(spark, path).number == 2 and publish.current(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, str(tmp_path / "none"))


def test_a_reader_during_publishes(spark, tmp_path):
    """Twenty tables are published while two readers go on reading: each read is one whole table, and none is older than one before."""
    path, stop, seen, wrong = str(tmp_path / "t"), threading.Event(), [], []
    publish.publish(table(spark, 1), path)

    def read():
        last = 0
        while not stop.is_set():
            try:
                rows = [r.n for r in publish.read_published(spark, path).collect()]
                if len(set(rows)) != 1 or len(rows) != rows[0] * 10 or rows[0] < last:
                    wrong.append(rows[:3])
                last = rows[0]
                seen.append(last)
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    readers = [threading.Thread(target=read) for _ in range(2)]
    for t in readers:
        t.start()
    for n in range(2, 22):
        assert publish.publish(table(spark, n), path) == n
        publish.sweep(spark, path, keep=2)  # younger than its grace: versions that are read stay
    stop.set()
    for t in readers:
        t.join()
    assert not wrong and len(set(seen)) > 5
    assert {r.n for r in publish.read_published(spark, path).collect()} == {21}


def test_one_of_two_writers_wins(spark, tmp_path):
    path = tmp_path / "t"
    publish.publish(table(spark, 1), str(path))
    publish.publish(table(spark, 2), str(path), after=1)
    with pytest.raises(publish.ConcurrentPublish):
        publish.publish(table(spark, 3), str(path), after=1)
    assert publish.read_published(spark, str(path)).count() == 20 and len(folders(path)) == 2

    began, results = threading.Barrier(4), []

    def write(n):
        began.wait()
        try:
            results.append(publish.publish(table(spark, n), str(path), after=2))
        except publish.ConcurrentPublish:
            results.append(None)

    writers = [threading.Thread(target=write, args=(n,)) for n in range(4, 8)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert sorted(results, key=str) == [3, None, None, None]
    assert len(folders(path)) == 3


def test_a_name_is_given_once(spark, tmp_path):
    path, began, won = str(tmp_path / "log" / "1.json"), threading.Barrier(16), []

    def put(i):
        began.wait()
        if publish.put_if_absent(spark, path, f"writer {i}"):
            won.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "log" / "1.json").read_text() == f"writer {won[0]}"
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_failures_leave_the_old_table(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    publish.publish(table(spark, 3), str(path))
    with pytest.raises(Exception, match="no"):
        publish.publish(spark.range(1).select(F.raise_error(F.lit("no"))), str(path))
    monkeypatch.setattr(publish, "put_if_absent", lambda *_: (_ for _ in ()).throw(OSError("disk is full")))
    with pytest.raises(OSError):
        publish.publish(table(spark, 5), str(path))
    monkeypatch.undo()
    assert publish.read_published(spark, str(path)).count() == 30 and len(folders(path)) == 1
    assert publish.publish(table(spark, 5), str(path), fmt="json") == 2
    assert publish.read_published(spark, str(path)).count() == 50
    assert publish.read_published(spark, str(path), 1).count() == 30


def test_sweep(spark, tmp_path):
    path = tmp_path / "t"
    for n in range(1, 6):
        publish.publish(table(spark, n), str(path))
    (path / "_versions" / "left_by_a_failed_writer").mkdir()
    assert publish.sweep(spark, str(path), keep=2) == 0
    assert publish.sweep(spark, str(path), keep=2, grace_seconds=-5) == 4
    assert len(folders(path)) == 2
    assert [publish.read_published(spark, str(path), n).count() for n in (4, 5)] == [40, 50]
    with pytest.raises(Exception):
        publish.read_published(spark, str(path), 3)
    assert publish.publish(table(spark, 6), str(path)) == 6
    with pytest.raises(ValueError):
        publish.sweep(spark, str(path), keep=0)


def test_merges_are_whole(spark, tmp_path):
    parts = [str(tmp_path / x) for x in "abc"]
    whole, combine = str(tmp_path / "whole"), lambda df: df.groupBy("n").count()
    for i, p in enumerate(parts[:2]):
        publish.publish(table(spark, i + 1), p, facts={"run": 1})
    with pytest.raises(publish.IncompleteMerge, match="/c"):
        publish.merge_parts(spark, parts, whole, combine)
    publish.publish(table(spark, 3), parts[2], facts={"run": 2})
    with pytest.raises(publish.IncompleteMerge, match="/c"):
        publish.merge_parts(spark, parts, whole, combine, {"run": 1})
    with pytest.raises(publish.IncompleteMerge):
        publish.merge_parts(spark, [], whole, combine)
    assert publish.current(spark, whole) is None
    publish.merge_parts(spark, parts, whole, combine)
    assert {(r.n, r["count"]) for r in publish.read_published(spark, whole).collect()} == {(1, 10), (2, 20), (3, 30)}
    assert publish.merge_is_current(spark, parts, whole)
    publish.publish(table(spark, 4), parts[0])
    assert not publish.merge_is_current(spark, parts, whole)
