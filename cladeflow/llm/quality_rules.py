"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one failure bit a rule;
policies are versioned masks over these bits, so changing a policy, or asking what one rule does
(ablation), is bitwise work over the ledger and never reads a text again.

Defined results: a null text has no words and fails `few_words`; repeated rows and null ids keep their
rows; a very long text is measured on its own, in memory in proportion to its length; extra columns of the input
are ignored by `ledger` and kept by `filter_documents`; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ORIGINAL, WHITE, named, packed, slices, with_fields

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: name -> the condition under which a document fails, over the measurements; a rule's bit is its place here.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_upper > 6 * n_letters AND n_letters > 0",
    "long_words": "word_chars > 40 * n_words",
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines"),
    "v3": (*BASE, "symbols", "duplicate_lines", "shouting", "long_words"),
}
PRODUCTION = "v3"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    white = sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeated = 0
    if n > 3:
        counts = Counter(zip(words, words[1:], words[2:]))
        if len(counts) < n - 2:
            end = 0  # of the words counted so far
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if counts[w] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    letters = text.isascii()
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if letters else sum(c.isupper() for c in text)
    lower = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz")) if letters else sum(c.islower() for c in text)
    return n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, upper + lower


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            columns = zip(*[measure(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], [ORIGINAL, *MEASURES])


def failure_bits() -> Column:
    return sum((F.when(F.expr(cond), F.lit(bit(r))).otherwise(F.lit(0)) for r, cond in RULES.items()), F.lit(0)).cast("long")


def _ledger(documents: DataFrame, text: str) -> DataFrame:
    rows = packed(documents, text)
    schema = with_fields(rows, [ORIGINAL], ", ".join(f"{m} long" for m in MEASURES))
    measured = rows.mapInArrow(_measured, schema)
    return measured.select(ORIGINAL, *MEASURES, failure_bits().alias("fail_bits"))


def ledger(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, measurements and `fail_bits`."""
    slim = documents.select(named(id_column).alias("doc_id"), named(text).alias("text"))
    return _ledger(slim, "text").select(F.col(f"{ORIGINAL}.doc_id").alias("doc_id"), *MEASURES, "fail_bits")


def passes(policy: str = PRODUCTION) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    return entries.withColumn("kept", passes(policy))


def filter_documents(documents: DataFrame, policy: str = PRODUCTION, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they were."""
    return _ledger(documents, text).where(passes(policy)).select(f"{ORIGINAL}.*")


def ablation(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept if the rule were left out.

    One pass: each row's masked bits are counted per bit pattern first (at most 2^rules patterns), and the
    rules are then read off the patterns.
    """
    whole = mask(policy)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.withColumn("r", F.explode(rules))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | alone, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )
