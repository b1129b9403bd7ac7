"""Numbering rows in a total order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut


def numbered(df: DataFrame, order: list[str], keys: tuple[str, ...] = (), name: str = "place", start: int = 1) -> DataFrame:
    """SRT-02, WIN-03, WIN-08: rows with their number in the order, in each group of `keys`.

    Rows are dealt into ranges, which are numbered each on its own; then the rows of earlier ranges are added.
    Only groups that go over the edge of a range have any, so that table has a row a range at most.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).select("*", F.spark_partition_id().alias("__range")))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.sum("__n").over(earlier).alias("__before")).where("__before > 0")
    on = F.col("__range") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = F.row_number().over(W.partitionBy("__range", *keys).orderBy(*order))
    place = F.coalesce("__before", F.lit(0)) + F.col("__within") + (start - 1)
    return ranged.withColumn("__within", within).join(F.broadcast(before), on, "left").select(*df.columns, place.cast("bigint").alias(name))
