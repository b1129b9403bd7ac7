"""Shapes that the report tables take: shares, completion, binning, lumping, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(df: DataFrame, value: str, keys: list[str], name: str = "share") -> DataFrame:
    """AGG-22, WIN-06: a value over its group's total."""
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*keys))))


def complete(df: DataFrame, left: DataFrame, right: DataFrame, fill: dict[str, int]) -> DataFrame:
    """RSH-05, RSH-06: all combinations of two small lists of keys, missing values filled."""
    return left.distinct().crossJoin(right.distinct()).join(df, [*left.columns, *right.columns], "left").fillna(fill)


def binned(c: Column | str, most: int) -> Column:
    """RSH-09: counts over a limit pooled as `>limit`."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x > most, F.lit(f">{most}")).otherwise(x.cast("string"))


def lump(df: DataFrame, name: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """SRT-04, RSH-10: names outside the top n by median value, ties kept, become one."""
    medians = df.groupBy(name).agg(F.median(value).alias("m"))
    top = medians.withColumn("place", F.rank().over(W.orderBy(F.col("m").desc()))).where(F.col("place") <= n).select(name, F.lit(True).alias("__top"))
    return df.join(top, name, "left").withColumn(name, F.when(F.col("__top"), F.col(name)).otherwise(F.lit(other))).drop("__top")


def wide(df: DataFrame, key: str, name: str, value: str, levels: list, fill: int | None = None) -> DataFrame:
    """RSH-01, RSH-02: named levels as columns; levels are given, so there is no extra pass to find them."""
    out = df.groupBy(key).pivot(name, levels).agg(F.sum(value))
    return out.fillna(fill) if fill is not None else out


def marker_label(c: Column | str = "marker") -> Column:
    """FIL-23: a short name of a marker."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^S3.\d+.", ""), r"^(.*?)ribosomal_protein", "$1RP"), r"^(.*?)ribosomal", "$1R")


def marker_number(c: Column | str = "marker") -> Column:
    """SRT-06: markers in the order of their numbers."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(x, r"^S3\.(\d+)", 1).try_cast("int")


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-21: median and range across markers."""
    return df.groupBy(*keys).agg(F.median(value).alias(f"median_{value}"), F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}"))


def cohort(c: Column | str = "stratum") -> Column:
    """FIL-21"""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin("all", "year"), "all").when(x.isin("human_all", "human_per_year"), "human-gut")
