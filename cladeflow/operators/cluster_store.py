"""CLU-03: clusters that grow by batches of windows, kept as files.

A store has a folder of memberships and one of centroids for each batch, and a log of which of them are the clusters (see
`sources.publish`). A batch meets the stored centroids; what they reach joins them, and the rest is clustered among
itself. Nothing that is stored is clustered or written again (members are read only to know repeated windows), and the result
is that of one run over all windows in the order in which they came.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalise_gaps
from ..sources import publish
from ..sources.shared import cut
from . import clustering

MEMBERS = "gene string, id long, member string, rep_id long, rep string, divergence int"
CENTROIDS = "gene string, id long, sequence string"


def _parts(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    now = publish.current(spark, path)
    folders = [f"{path.rstrip('/')}/{p[what]}" for p in now.facts["batches"]] if now else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def members(spark: SparkSession, path: str) -> DataFrame:
    """All memberships: gene, id, member, rep_id, rep, divergence."""
    return _parts(spark, path, "members", MEMBERS)


def centroids(spark: SparkSession, path: str) -> DataFrame:
    return _parts(spark, path, "centroids", CENTROIDS)


def add(unique: DataFrame, path: str, max_divergence: int = 2, window: int = 60) -> int:
    """Cluster a batch (gene, seq_num, sequence) onto what is stored; how many batches there are now.

    Its windows come after all stored ones, in the order of their numbers. A window that is stored already, letter for letter, is
    left as it is. Batches of one store share their settings; of two writers at once one fails.
    """
    spark = unique.sparkSession
    now = publish.current(spark, path)
    facts = now.facts if now else {"max_divergence": max_divergence, "window": window, "next": 0, "batches": []}
    if (facts["max_divergence"], facts["window"]) != (max_divergence, window):
        raise ValueError(f"{path} holds clusters of divergence {facts['max_divergence']} and window {facts['window']}")
    stored = members(spark, path).select("gene", F.col("member").alias("sequence"))
    least = unique.agg(F.min("seq_num")).first()[0]
    if least is None:
        return len(facts["batches"])
    rows = cut(clustering.numbered_windows(unique.join(stored, ["gene", "sequence"], "left_anti"), facts["next"] - least))
    last = rows.agg(F.max("id")).first()[0]
    if last is None:
        return len(facts["batches"])
    # near pairs of a batch grow with its square where no centroid is known yet: those of its first windows are found first
    size = max(clustering.FIRST, (clustering.GROWTH - 1) * facts["next"])
    reached, new = clustering.extend_growing(rows, centroids(spark, path), max_divergence, window, facts["next"], last, size)
    name = uuid.uuid4().hex
    part = {"members": f"members/{name}", "centroids": f"centroids/{name}"}
    # the rows' own centroids are among the stored or the new ones
    known = centroids(spark, path).unionByName(new)
    clustering.named_members(reached, known, rows).write.parquet(f"{path.rstrip('/')}/{part['members']}")
    new.select("gene", "id", "sequence").write.parquet(f"{path.rstrip('/')}/{part['centroids']}")
    publish.commit(spark, path, now.number if now else 0, {**facts, "next": last + 1, "batches": [*facts["batches"], part]})
    return len(facts["batches"]) + 1


def compact(spark: SparkSession, path: str) -> None:
    """The batches' files as one batch, for stores of very many; readers that began before keep the old files until `sweep`."""
    now = publish.current(spark, path)
    if now is None or len(now.facts["batches"]) < 2:
        return
    name = uuid.uuid4().hex
    part = {"members": f"members/{name}", "centroids": f"centroids/{name}"}
    for what, rows in (("members", members(spark, path)), ("centroids", centroids(spark, path))):
        rows.repartitionByRange("gene", "id").sortWithinPartitions("gene", "id").write.parquet(f"{path.rstrip('/')}/{part[what]}")
    publish.commit(spark, path, now.number, {**now.facts, "batches": [part]})


def sweep(spark: SparkSession, path: str, grace_seconds: float = 86_400) -> int:
    """Delete files of no batch of the store as it is now, of compactions and failed writers, once they are older than the grace. How many folders went."""
    now = publish.current(spark, path)
    kept = {p[what] for p in (now.facts["batches"] if now else []) for what in ("members", "centroids")}
    before, gone = (time.time() - grace_seconds) * 1000, 0
    for what in ("members", "centroids"):
        fs, folder = publish.file_system(spark, f"{path.rstrip('/')}/{what}")
        for x in fs.listStatus(folder) if fs.exists(folder) else []:
            if f"{what}/{x.getPath().getName()}" not in kept and x.getModificationTime() <= before:
                fs.delete(x.getPath(), True)
                gone += 1
    return gone


def look_up(windows: DataFrame, path: str) -> DataFrame:
    """JOIN-07: (gene, sequence) rows with the stored representative of their gap-normalised sequence; null if there is none."""
    known = members(windows.sparkSession, path).select("gene", normalise_gaps("member").alias("__key"), "rep").distinct()
    return windows.withColumn("__key", normalise_gaps("sequence")).join(known, ["gene", "__key"], "left").drop("__key")


def cluster_chunked(unique: DataFrame, size: int, path: str, max_divergence: int = 2, window: int = 60) -> DataFrame:
    """CLU-03: a store made of chunks of one size of the order, read back; the result is that of `clustering.cluster`."""
    publish.check_positive(size=size)
    low, high = unique.agg(F.min("seq_num"), F.max("seq_num")).first()
    while low is not None and low <= high:
        add(unique.where(F.col("seq_num").between(low, low + size - 1)), path, max_divergence, window)
        low += size
    return members(unique.sparkSession, path).select("gene", "member", "rep", "divergence")
