"""FASTA files and their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col, header_map, normalise_gaps


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-02, SRC-25: (header, sequence, file); lines of a sequence are joined, entries without one dropped."""
    raw = spark.read.option("lineSep", ">").text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_entries(raw.where("value <> ''"))


def parse_entries(raw: DataFrame) -> DataFrame:
    """From entries without their `>` in `value`."""
    parts = F.split("value", "\n", 2)
    out = raw.select(F.trim(F.regexp_replace(parts[0], "\r", "")).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"), *[c for c in raw.columns if c != "value"])
    return out.where("sequence <> ''")


def parse_header(header: Column | str = "header") -> dict[str, Column]:
    """SRC-03, SRC-04: unknown and hits must be there; occurrences default to 1 and summed hits to hits."""
    m, h = header_map(header), col(header)
    number = lambda k: F.get(F.filter(F.array(m[k]), lambda x: x.isNotNull()), F.lit(0)).try_cast("bigint")
    must = lambda k: F.when(m[k].isNull(), F.raise_error(F.concat(F.lit(f"no {k} in header "), h)).cast("bigint")).otherwise(number(k))
    hits = must("hits")
    return {
        "sample": F.get(F.split(h, "\\|"), F.lit(1)),
        "unknown": must("unknown"),
        "hits": hits,
        "n_occurrences": F.coalesce(number("n_occurrences"), F.lit(1).cast("bigint")),
        "sum_hits": F.coalesce(number("sum_hits"), hits),
    }


def with_header(df: DataFrame, header: str = "header") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in parse_header(header).items()])


def representative_id(header: Column | str = "header") -> Column:
    """SRC-05: the tokens without `=`."""
    return F.array_join(F.filter(F.split(col(header), "\\|"), lambda t: F.instr(t, "=") == 0), "|")


def headers_to_wide(df: DataFrame, keys: list[str], header: str = "header") -> DataFrame:
    """SRC-06: id and a column for each key; a key that was not announced is an error."""
    m = header_map(header)
    known = F.array(*map(F.lit, keys))
    named = F.map_keys(F.map_filter(m, lambda k, v: v.isNotNull()))
    extra = F.array_except(named, known)
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("new header key "), F.array_join(extra, ",")))).otherwise(representative_id(header))
    return df.select(checked.alias("id"), *[m[k].alias(k) for k in keys])


def to_rows(df: DataFrame) -> DataFrame:
    """SRC-18: (sequence, n_occurrences, sum_hits) with gaps as N, for collated entries that are one occurrence each."""
    h = parse_header("header")
    return df.select(normalise_gaps("sequence").alias("sequence"), h["n_occurrences"].alias("n_occurrences"), h["sum_hits"].alias("sum_hits"))
