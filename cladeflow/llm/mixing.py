"""Mixing sources to target weights by capped water-filling.

Targets: the sources share all words by weight; a source is clamped at `max_epochs` times its size and the
excess goes to the others by weight, until none is above. With the sources in order of size / weight the
clamped ones are a prefix, so the fixed point of that loop is read off running sums, exactly.

Sampling: a source is taken floor(target / size) whole times. The fraction left is filled in the order of a
seeded hash: documents are dealt into hash buckets, buckets below the quota are taken, and the bucket
that straddles the quota is dealt again by more bits of the hash, until it is one hash. So no task ever holds a
source, or orders documents; ids, sources, hashes and sizes are written once for that and texts stay out of it.
Sources are ordered in one task, which is fit for up to some millions of them.

Defined results: a null text has size 0; the null source is a source, last in order; documents of the same
id and text share a hash and are interchangeable; documents without words are taken 0 times, and sources without
words have target 0; a very long text is counted whole, in its row; repeated rows are documents each; an empty
table gives an empty result. Extra columns are ignored by `mix` and kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ORIGINAL, WORD, cut, own, packed, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
HASH_BITS = 52
#: Bits of the hash that each round looks at.
ROUNDS = (12, 24, 36, 52)
#: The per-source table is broadcast up to this many rows; beyond, it is joined by shuffle, salted.
BROADCAST_SOURCES = 10_000
SALT = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row a source: target, whole repetitions and the words still wanted."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    rows = rows.withColumn("ratio", F.col("source_size") / F.col("weight"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, all_rows = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    rows = rows.select(
        "*",
        F.row_number().over(up).alias("place"),
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        F.sum("weight").over(after).alias("rest_weight"),
    )
    open_ = F.col("cap") * F.col("rest_weight") >= F.col("rest") * F.col("weight")
    rows = rows.withColumn("first_open", F.min(F.when(open_, F.col("place"))).over(all_rows))
    at = F.col("place") == F.col("first_open")
    rows = rows.select(
        "*",
        F.max(F.when(at, F.col("rest"))).over(all_rows).alias("pool"),
        F.max(F.when(at, F.col("rest_weight"))).over(all_rows).alias("pool_weight"),
    )
    shared = (F.col("pool") * F.col("weight")).cast("double") / F.col("pool_weight").cast("double")
    target = F.when(F.col("place") < F.col("first_open"), F.col("cap").cast("double")).otherwise(shared)
    rows = rows.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole)
    return rows.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("quota"))


def _sized(documents: DataFrame, text: str, source: str) -> DataFrame:
    rows = packed(documents, text).select(ORIGINAL, "__text", own(source).alias("source"))
    key = F.concat_ws("|", F.lit(SEED), F.coalesce(own("doc_id").cast("string"), F.lit("")), F.md5("__text"))
    rows = rows.withColumn("h", F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long"))
    return rows.select(ORIGINAL, "source", "h", F.regexp_count("__text", F.lit(WORD)).cast("long").alias("size"))


def _few(rows: DataFrame) -> DataFrame:
    """A table of sources, broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rows


def _quotas(slim: DataFrame, mine: DataFrame) -> DataFrame:
    """One row a source: `lower`, below which all hashes are taken, and `edge`, the hash (or null) of whose rows the first `some` of `ties` are.

    The hash is looked at a few bits more in each round: buckets that end within the quota are taken, and only the one
    that straddles it is opened in the next. So no round has more than 2^16 buckets of a source.
    """
    state = mine.select("s", "quota", F.lit(0).cast("long").alias("lower"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("edge_below"))
    seen = 0
    for bits in ROUNDS:
        shift = HASH_BITS - bits
        inside = slim.join(_few(state.where("edge IS NOT NULL").select("s", "edge")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", HASH_BITS - seen) == F.col("edge"))) if seen else slim
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        own_rows = buckets.join(_few(state.where("edge IS NOT NULL")), F.col("source").eqNullSafe(F.col("s")))
        after = F.col("edge_below") + F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        filled = own_rows.select("s", "bucket", "quota", "words", after.alias("after")).withColumn("below", F.col("after") - F.col("words"))
        straddles = (F.col("below") < F.col("quota")) & (F.col("after") > F.col("quota"))
        found = filled.groupBy("s").agg(
            F.max(F.when(F.col("after") <= F.col("quota"), F.col("bucket"))).alias("full"), F.min(F.when(straddles, F.struct("bucket", "below"))).alias("next")
        )
        lower = F.greatest("lower", F.shiftleft(F.col("full") + 1, shift))
        state = cut(state.alias("a").join(found.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")), "left").select(
            "a.s", "quota", lower.alias("lower"), F.col("next.bucket").alias("edge"), F.coalesce("next.below", F.lit(0)).cast("long").alias("edge_below")
        ))
        seen = bits
    order = W.partitionBy("source").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    tied = slim.join(_few(state.where("edge IS NOT NULL")), F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("edge")))
    middle = F.col("edge_below") + F.sum("size").over(order) - F.col("size") / 2
    counted = tied.select("s", (middle <= F.col("quota")).alias("in")).groupBy("s").agg(F.count_if("in").alias("some"), F.count("*").alias("ties"))
    return state.alias("a").join(counted.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")), "left").select("a.s", "lower", "edge", F.coalesce("some", F.lit(0)).alias("some"), F.coalesce("ties", F.lit(0)).alias("ties"))


def mix_documents(documents: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Every document packed as one struct column, with size, source_size, target, repetitions and taken."""
    rows = _sized(documents, text, source)
    slim = written(rows.select(own("doc_id").alias("doc_id"), "source", "h", "size"))
    mine = cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "s"))
    plan = cut(mine.alias("m").join(_quotas(slim, mine).alias("q"), F.col("m.s").eqNullSafe(F.col("q.s"))).select(
        "m.s", "source_size", "target", "whole", "lower", "edge", "some", "ties"
    ))
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")), "inner")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt_", F.pmod("h", F.lit(SALT)).cast("int")).join(
            salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt_") == F.col("salt")), "inner"
        )
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    parted = at_edge & (F.col("some") > 0) & (F.col("some") < F.col("ties"))
    extra = (F.col("h") < F.col("lower")) | (at_edge & (F.col("some") > 0))
    repetitions = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(0).cast("long")
    shown = (ORIGINAL, "size", "source_size", "target", repetitions.alias("repetitions"), (F.col("size") * repetitions).alias("taken"))
    if plan.where("some > 0 AND some < ties").isEmpty():
        return joined.withColumn("extra", extra).select(*shown)
    # rows of one hash that share the rest of the quota: copies of one row, or two rows by chance
    place = F.row_number().over(W.partitionBy("source").orderBy(own("doc_id"), "size"))
    close = joined.where(parted).withColumn("extra", place <= F.col("some"))
    return joined.where(~parted).withColumn("extra", extra).select(*shown).unionByName(close.select(*shown))


def mix(documents: DataFrame, **settings) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken and repetitions."""
    slim = documents.select("doc_id", "text", "source")
    return mix_documents(slim, **settings).select(
        own("doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "repetitions"
    )


def materialise(mixed: DataFrame) -> DataFrame:
    """A row for each repetition."""
    return mixed.where("repetitions > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repetitions"))))
