"""Filter interaction audit by inclusion-exclusion.

Five filters are evaluated once a document. For each part (a source), joint-failure counts are aggregated for all
32 sets of filters, each as the sum of a product of failure flags. Everything else is read off these sums: a Moebius
inversion over the subsets of S gives what survives S, differences of survivors give what a step removes, what only
one filter fails and what is redundant, and the Harsanyi dividends (the signed joint counts) give each filter's
Shapley value. So no order is ever run: 120 orders cost what one pass costs.

A document fails E if any smaller id has the same text. Identical texts fail the same other filters, so documents
are first counted by (text's name, flags, part, labels): a text copied a million times is few rows before it meets its
least id. Names are 128-bit digests; texts are not shuffled.

Defined results: a null text is empty, a null source is the part ''; a null id has no smaller one and is smaller than
none, so it neither fails E nor makes others fail; repeated rows each count, and rows of one id do not fail E for each
other; a document is good (toxic) if any of its label rows says so, labels without an id are ignored; extra columns
are ignored; a very long text is measured on its own; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import permutations
from math import factorial
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import named, slices

FILTERS = "ABCDE"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOL = re.compile(rb"[#$%&*|]")
SUBSETS = range(1 << len(FILTERS))
ALL = len(SUBSETS) - 1


def flags(text: str) -> int:
    """The failure bits of a whole text in the filters A to D."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    bits = 1 * (len(words) < 50)
    bits |= 2 * (100 * len(set(words)) < 65 * len(words))
    bits |= 4 * (100 * (len(data) - len(data.translate(None, _UPPER))) > 5 * len(text))
    return bits | 8 * (_SYMBOL.search(data) is not None)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            texts = batch.column(2).to_pylist()
            names = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(map(flags, texts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "name", "bits"])


def flagged(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, part, the name of its text, and the failure bits of A to D."""
    slim = documents.select(
        named("doc_id").cast("long").alias("doc_id"), F.coalesce(named("source").cast("string"), F.lit("")).alias("part"), F.coalesce(named("text").cast("string"), F.lit("")).alias("text")
    )
    return slim.mapInArrow(_flagged, "doc_id long, part string, name binary, bits int")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with `good` and `toxic` (0 or 1). Rows without an id have no labels and stay out of the join."""
    one = lambda c: F.max(F.coalesce((named(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where(named("doc_id").isNotNull()).groupBy(named("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good + toxic > 0")
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select(*rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return known.unionByName(rows.where("doc_id IS NULL").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def patterns(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by (part, bits of all five filters, good, toxic): part, bits, good, toxic, n."""
    each = flagged(documents).groupBy("doc_id", "part", "name", "bits").agg(F.count("*").alias("n"))
    kinds = ["name", "part", "bits", "good", "toxic"]
    # rows of a text become one a kind before they meet its least id; that id's own rows are kept apart
    copies = _labelled(each, labels).groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_none")
    )
    first = copies.withColumn("first", F.min("least").over(W.partitionBy("name")))
    free = F.col("n_none") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.array(F.struct(F.col("bits").alias("bits"), free.alias("n")), F.struct(F.col("bits").bitwiseOR(F.lit(16)).alias("bits"), (F.col("n") - free).alias("n")))
    rows = first.select("part", "good", "toxic", F.explode(split).alias("x")).where("x.n > 0")
    return rows.groupBy("part", F.col("x.bits").alias("bits"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def joint_failures(counted: DataFrame) -> DataFrame:
    """One row a part, with arrays of 32 sums: place S of `n`, `good` and `toxic` holds the documents that fail every filter of S."""
    flags_of = counted.select("*", *[F.shiftright("bits", b).bitwiseAND(F.lit(1)).alias(f"fails_{b}") for b in range(len(FILTERS))])

    def sums(weight: str) -> Column:
        # the product of S's flags, which is 1 for the empty set
        products = [" * ".join([weight, *(f"fails_{b}" for b in range(len(FILTERS)) if s >> b & 1)]) for s in SUBSETS]
        return F.expr(f"array({', '.join(f'sum({p})' for p in products)})")

    return flags_of.groupBy("part").agg(sums("n").alias("n"), sums("n * good").alias("good"), sums("n * toxic").alias("toxic"))


def _combined(joint: str, weights: dict[int, int]) -> str:
    return " + ".join(f"({w}) * {joint}[{s}]" for s, w in weights.items())


def survivors(joint: str) -> Column:
    """Moebius inversion: place S of the array holds the documents that fail no filter of S."""
    return F.expr(f"array({', '.join(_combined(joint, {t: (-1) ** t.bit_count() for t in SUBSETS if t & s == t}) for s in SUBSETS)})")


def shapley(joint: str) -> Column:
    """Each filter's removed documents summed over all orders: its share of every dividend that it takes part in, times the number of orders."""
    orders = factorial(len(FILTERS))
    each = [{t: (-1) ** (t.bit_count() + 1) * (orders // t.bit_count()) for t in SUBSETS if t >> b & 1} for b in range(len(FILTERS))]
    return F.expr(f"array({', '.join(_combined(joint, x) for x in each)})")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Each part, order of the filters and step: what the step keeps, removes, finds removed already, and so on."""
    joint = joint_failures(patterns(documents, labels))
    parts = joint.select("part", F.col("n").alias("joint"), *[survivors(c).alias(c) for c in ("n", "good", "toxic")], shapley("n").alias("shapley"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def set_of(letters: Column) -> Column:
        return reduce(add, (F.when(F.instr(letters, x) > 0, 1 << b).otherwise(0) for b, x in enumerate(FILTERS)))

    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    rows = steps.select(
        "*", place.alias("f"), set_of(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("before"), set_of(F.substring("filter_order", F.lit(1), F.col("step"))).alias("after")
    )
    lost = {c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")] for c in ("n", "good", "toxic")}
    own = F.col("after").bitwiseXOR(F.col("before"))
    return rows.select(
        "part", "filter_order", "step", F.col("n")[F.col("after")].alias("kept"), lost["n"].alias("removed"), (F.col("joint")[own] - lost["n"]).alias("redundant"),
        (F.col("n")[F.lit(ALL).bitwiseXOR(own)] - F.col("n")[F.lit(ALL)]).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.col("shapley")[F.col("f")].alias("shapley"),
    )
