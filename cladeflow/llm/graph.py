"""Connected components over links between keys, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: every node points its neighbours (the larger ones, or the smaller ones and itself) at its least neighbour."""
    if larger:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")) if larger else near.groupBy("u").agg(F.min("v").alias("m"))
    # hubs have many larger neighbours: the least ones are written, so that the join can be split
    told = near.join(cut(least) if larger else least, "u")
    if larger:
        out = told.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b): rows (key, root) of every linked key, the root being the least key of its component.

    Stars end when a round leaves the links as they were; each round is written to the checkpoint folder.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        links = cut(_star(_star(links, True), False))
    roots = links.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct()
    return cut(links.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(roots))
