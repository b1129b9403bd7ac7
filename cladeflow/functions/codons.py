"""The genetic code and what a substitution in a codon does."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import col

# The standard genetic code, bases in the order TCAG, the third changing fastest.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
TRANSITIONS = ("AG", "GA", "CT", "TC")

CODE = dict(zip(map("".join, product(BASES, repeat=3)), AMINO_ACIDS))


def expected_rows() -> list[tuple[str, int, int, int]]:
    """For each sense codon, how many of its 9 single changes are synonymous, not, and stops."""
    rows = []
    for codon, acid in CODE.items():
        if acid == "*":
            continue
        new = [CODE[codon[:i] + b + codon[i + 1 :]] for i in range(3) for b in BASES if b != codon[i]]
        syn, stop = new.count(acid), new.count("*")
        rows.append((codon, syn, 9 - syn - stop, stop))
    return rows


def expected_table(spark: SparkSession) -> DataFrame:
    """DOM-01: 61 rows, as fractions."""
    rows = spark.createDataFrame(expected_rows(), "rep_codon string, syn int, nonsyn int, stop int")
    return rows.select("rep_codon", *[(F.col(c) / 9.0).alias(f"exp_{c}") for c in ("syn", "nonsyn", "stop")])


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def translate_codon(c: Column | str) -> Column:
    """FN-05"""
    return F.element_at(_map(CODE), col(c))


def expected_ninths(c: Column | str, kind: str) -> Column:
    """Ninths of a sense codon's single changes of a kind; whole numbers, so that sums do not depend on their order."""
    at = {"syn": 1, "nonsyn": 2, "stop": 3}[kind]
    return F.element_at(_map({r[0]: r[at] for r in expected_rows()}), col(c))


def _base(c: Column | str, i: int) -> Column:
    return F.substring(col(c), i + 1, 1)


def n_diff(a: Column | str, b: Column | str) -> Column:
    """FN-13: how many of three bases differ."""
    return sum(((_base(a, i) != _base(b, i)).cast("int") for i in range(3)), F.lit(0))


def diff_position(a: Column | str, b: Column | str) -> Column:
    """FN-06: the first place that differs, 3 if the others do not."""
    return F.when(_base(a, 0) != _base(b, 0), 1).when(_base(a, 1) != _base(b, 1), 2).otherwise(3)


def effect(a: Column | str, b: Column | str) -> Column:
    """FN-07: of amino acids."""
    return F.when(col(a) == col(b), "syn").when(col(b) == "*", "stop").otherwise("nonsyn")


def is_transition(a: Column | str, b: Column | str) -> Column:
    """FN-08: whether the first differing base of two codons is a transition."""
    pos = diff_position(a, b)
    change = F.concat(F.substr(col(a), pos, F.lit(1)), F.substr(col(b), pos, F.lit(1)))
    return change.isin(*TRANSITIONS)
