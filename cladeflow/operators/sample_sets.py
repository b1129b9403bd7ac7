"""Sets of samples that merge.

Samples are numbered once. A representative's set is kept as words of 64 bits, a row for each word that holds any: a
singleton is one row, a set of thousands one row for 64 neighbours. Parts of a run, whether they share samples and
representatives or not, merge by `or`, where counts could only be added up for parts that share nothing. Sizes, unions over
clusters and histograms of any stratum are read off the merged sets; a stratum is such a set itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import if_small
from .numbering import numbered
from .strata import HUMAN, valid_year

BITS = 64


def number_samples(samples: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(sample, number) of all samples, by name. With `known`, its numbers stay, and samples that are not in it follow."""
    names = samples.select("sample").where("sample IS NOT NULL").distinct()
    if known is None:
        return numbered(names, ["sample"], name="number", start=0)
    top = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    return known.select("sample", "number").unionByName(numbered(names.join(known, "sample", "left_anti"), ["sample"], name="number", start=top))


def _word(number: str = "number") -> tuple[Column, Column]:
    """The word of a number, and its bit there."""
    n = F.col(number)
    one = F.lit(1).cast("bigint")
    return F.expr(f"{number} div {BITS}").alias("word"), F.call_function("shiftleft", one, (n % BITS).cast("int"))


def sample_sets(pairs: DataFrame, numbers: DataFrame, keys: tuple[str, ...] = ("gene", "rep")) -> DataFrame:
    """AGG-03: (keys, word, bits) of the samples of each key; pairs: (keys, sample), repeated or not. A sample without a number is an error."""
    met = pairs.join(numbers, "sample", "left")
    checked = F.when(F.col("number").isNull() & F.col("sample").isNotNull(), F.raise_error(F.concat(F.lit("sample without a number: "), "sample")).cast("bigint")).otherwise(F.col("number"))
    word, bit = _word()
    return met.withColumn("number", checked).where("number IS NOT NULL").select(*keys, word, bit.alias("bit")).groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def merge_sets(*parts: DataFrame) -> DataFrame:
    """AGG-11: the sets of parts as one; samples and representatives may be in several of them."""
    whole = reduce(DataFrame.unionByName, parts)
    keys = [c for c in whole.columns if c != "bits"]
    return whole.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def sizes(sets: DataFrame) -> DataFrame:
    """AGG-03: distinct samples of each key."""
    keys = [c for c in sets.columns if c not in ("word", "bits")]
    return sets.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_samples"))


def united(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """SET-06: sets of (gene, rep) as sets of the cluster that each is in; clusters: (gene, member, rep). One that is in none stays its own."""
    of = clusters.select("gene", F.col("member").alias("rep"), F.col("rep").alias("__rep")).distinct()
    moved = sets.join(of, ["gene", "rep"], "left").select("gene", F.coalesce("__rep", "rep").alias("rep"), "word", "bits")
    return moved.groupBy("gene", "rep", "word").agg(F.bit_or("bits").alias("bits"))


def strata_sets(metadata: DataFrame, numbers: DataFrame, human: str = HUMAN) -> DataFrame:
    """The strata of the reports as sets: samples up to each year, human ones, and human ones up to each year: (stratum, stratum_value, word, bits).

    Each is as large as the samples over 64; there are as many as there are years, twice.
    """
    rows = metadata.select(F.col("acc").alias("sample"), valid_year().alias("y"), F.coalesce(F.col("organism") == human, F.lit(False)).alias("human")).join(numbers, "sample")
    cuts = metadata.select(valid_year().alias("cut")).where("cut IS NOT NULL").distinct().agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    word, bit = _word()
    words = rows.select("y", "human", word, bit.alias("bit")).groupBy("y", "human", "word").agg(F.bit_or("bit").alias("bits"))
    after = F.filter("cuts", lambda c: c >= F.col("y")).cast("array<string>")
    each = words.crossJoin(F.broadcast(cuts)).select(
        "word", "bits",
        F.explode(F.array_compact(F.array(
            F.when(F.col("y").isNotNull(), F.struct(F.lit("year").alias("stratum"), after.alias("values"))), F.when(F.col("human"), F.struct(F.lit("human_all").alias("stratum"), F.array(F.lit("all")).alias("values"))),
            F.when(F.col("human") & F.col("y").isNotNull(), F.struct(F.lit("human_per_year").alias("stratum"), after.alias("values"))),
        ))).alias("s"),
    )
    return each.select("s.stratum", F.explode("s.values").alias("stratum_value"), "word", "bits").groupBy("stratum", "stratum_value", "word").agg(F.bit_or("bits").alias("bits"))


def histogram(sets: DataFrame, strata: DataFrame) -> DataFrame:
    """AGG-08, AGG-09: representatives by how many samples of each stratum they are in; those in none are left out."""
    # a word may be in most sets, so the masks, which are few, go to the sets where a count allows it
    masks = if_small(strata.withColumnRenamed("bits", "mask"))
    shared = sets.join(masks, "word").select("gene", "rep", "stratum", "stratum_value", F.bit_count(F.col("bits").bitwiseAND(F.col("mask"))).alias("n")).where("n > 0")
    per = shared.groupBy("gene", "rep", "stratum", "stratum_value").agg(F.sum("n").cast("bigint").alias("sample_count"))
    return per.groupBy("gene", "stratum", "stratum_value", "sample_count").agg(F.count("*").alias("species_count"))


def prevalence(sets: DataFrame) -> DataFrame:
    """AGG-06, AGG-11: representatives of each marker by their number of samples."""
    return sizes(sets).groupBy("gene", F.col("n_samples").alias("sample_count")).agg(F.count("*").alias("species_count"))
