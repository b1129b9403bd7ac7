"""Archive tables of operational taxonomic units: JSON with a list of field names and rows of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "struct<version:int,fields:array<string>,otus:array<array<string>>>"
# The field names of version 4, in order.
FIELDS = (
    "gene", "sample", "sequence", "num_hits", "coverage", "taxonomy", "read_names", "nucleotides_aligned", "taxonomy_by_known?",
    "read_unaligned_sequences", "equal_best_hit_taxonomies", "taxonomy_assignment_method",
)


def field(name: str) -> Column:
    """A value of the row `otu` by its field's name; null where the archive has no such field."""
    place = F.array_position("fields", name)
    return F.when(place > 0, F.get("otu", (place - 1).cast("int")))


def read_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-01: one row a unit, with `source_file` and the place in its file. A file is one JSON value; gzip is read as it is."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    return parse_archive(raw)


def parse_archive(raw: DataFrame) -> DataFrame:
    parsed = raw.select("source_file", F.from_json("value", SCHEMA).alias("j"))
    rows = parsed.select("source_file", F.col("j.fields").alias("fields"), F.posexplode("j.otus").alias("ordinal", "otu"))
    return rows.select(
        "source_file", F.col("ordinal").cast("bigint"),
        *[field(n).alias(n) for n in ("gene", "sample", "sequence", "num_hits", "taxonomy", "taxonomy_assignment_method")],
        F.from_json(field("read_names"), "array<string>").alias("read_names"),
    )


def _otu(gene: Column, sample: str) -> Column:
    values = {"gene": gene, "sample": F.lit(sample), "sequence": F.col("sequence"), "num_hits": F.lit("1"), "coverage": F.lit("1.0"), "taxonomy": F.lit(""), "nucleotides_aligned": F.lit(None).cast("string")}
    return F.array(*[values.get(n, F.lit(None).cast("string")) if n != "read_names" else F.to_json(F.array("id")) for n in FIELDS])


def _value() -> Column:
    whole = F.struct(F.lit(4).alias("version"), F.array(*map(F.lit, FIELDS)).alias("fields"), F.transform("rows", lambda r: r["otu"]).alias("otus"))
    return F.to_json(whole).alias("value")


def write_archive(representatives: DataFrame, gene: str, sample: str = "representatives") -> DataFrame:
    """SRC-15: (id, sequence) as one JSON value, ids carried in read_names. For one batch of a bounded size: the value is one string."""
    packed = representatives.select("id", _otu(F.lit(gene), sample).alias("otu")).agg(F.array_sort(F.collect_list(F.struct("id", "otu"))).alias("rows"))
    return packed.select(_value())


def write_archives(representatives: DataFrame, size: int, sample: str = "representatives") -> DataFrame:
    """SRC-15: (gene, seq_num, id, sequence) as archives (gene, batch, value) of up to `size` sequence numbers each, in their order; every row is written."""
    if size <= 0:
        raise ValueError("size must be positive")
    rows = representatives.select("gene", F.floor(F.col("seq_num") / size).alias("batch"), "seq_num", "id", _otu(F.col("gene"), sample).alias("otu"))
    packed = rows.groupBy("gene", "batch").agg(F.array_sort(F.collect_list(F.struct("seq_num", "id", "otu"))).alias("rows"))
    return packed.select("gene", "batch", _value())


def representative_taxonomy(otus: DataFrame) -> DataFrame:
    """SRC-16: (id, domain, phylum) from a renewed archive; the id is the first read name, or else the sample."""
    from ..functions.scalars import taxonomy_token

    return otus.select(
        F.coalesce(F.get("read_names", F.lit(0)), F.col("sample")).alias("id"), taxonomy_token("taxonomy", "d__").alias("domain"), taxonomy_token("taxonomy", "p__").alias("phylum")
    )
