"""Scalar functions over columns; all native, so they stay in whole-stage code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = ("Bacteria", "Archaea", "Eukaryota")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_gaps(c: Column | str) -> Column:
    """FN-01: gaps count as unknown bases."""
    return F.translate(col(c), "-", "N")


def taxonomy_token(c: Column | str, prefix: str) -> Column:
    """FN-02: the first token of a `;`-separated lineage that has the prefix and more; null without one."""
    tokens = F.transform(F.split(col(c), ";"), lambda x: F.trim(x))
    return F.get(F.filter(tokens, lambda x: x.startswith(prefix) & (x != prefix)), F.lit(0))


def species_of(c: Column | str) -> Column:
    """FN-03: the last token of a lineage, whatever its rank."""
    return F.trim(F.element_at(F.split(col(c), ";"), -1))


def header_map(c: Column | str) -> Column:
    """FN-04: `key=value` tokens of a `|`-separated header; id tokens are keys without a value."""
    return F.str_to_map(F.regexp_replace(col(c), "^>", ""), F.lit("[|]"), F.lit("="))


def domain_of(c: Column | str) -> Column:
    """FN-14: the first of the domains named anywhere in a lineage; null without one."""
    out = F.lit(None).cast("string")
    for d in reversed(DOMAINS):
        out = F.when(col(c).contains(f"d__{d}"), F.lit(d)).otherwise(out)
    return out


def sample_name(c: Column | str) -> Column:
    """FN-15: the file name of a path without its archive suffix."""
    return F.regexp_replace(F.regexp_extract(col(c), r"([^/]*)$", 1), r"[.](json[.]gz|json|gz)$", "")


def f_class(c: Column | str) -> Column:
    """FN-11: classes of how often a sequence occurs; null and 0 fall through as they do in the source."""
    x = col(c)
    return (
        F.when(x == 1, "f1").when(x == 2, "f2").when(x == 3, "f3").when(x < 10, "f4-9").when(x < 100, "f10-99").otherwise("f100+")
    )


def parent_class(c: Column | str) -> Column:
    """FN-11: classes of how often the parent occurs."""
    x = col(c)
    return F.when(x < 10, "p<10").when(x < 100, "p10-99").when(x < 1000, "p100-999").otherwise("p1000+")


def clamp01(c: Column | str) -> Column:
    """FN-12: into [0, 1]; null stays null."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def safe_int(c: Column | str) -> Column:
    """FIL-06: an integer, 0 where it is none."""
    return F.coalesce(col(c).cast("string").try_cast("int"), F.lit(0))


def lgamma(c: Column | str) -> Column:
    """Logarithm of the gamma function for x > 0 by Stirling's series at x + 10."""
    x = col(c).cast("double")
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    series = series + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return series - F.log(product)


def lchoose(n: Column | str, k: Column | str) -> Column:
    """FN-09: logarithm of n over k for 0 <= k <= n."""
    a, b = col(n).cast("double"), col(k).cast("double")
    return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)


def hamming(a: Column | str, b: Column | str) -> Column:
    """FN-10: places in which two strings of one length differ; gaps count as N."""
    one, other = F.split(normalise_gaps(a), ""), F.split(normalise_gaps(b), "")
    return F.aggregate(F.zip_with(one, other, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def known_bases(c: Column | str) -> Column:
    """A window in which everything but A, C, G and T is N: gaps, other codes and lower case."""
    return F.regexp_replace(col(c), "[^ACGT]", "N")


def packed_bases(c: Column | str, words: int = 2) -> Column:
    """A window as array<bigint>: for each 30 bases two bits a base, then a mask of unknown ones, so that Hamming distance is a few bit counts."""
    seq = known_bases(c)
    parts = []
    for w in range(words):
        piece = F.rpad(F.substring(seq, 30 * w + 1, 30), 30, "A")
        parts.append(F.conv(F.translate(piece, "ACGTN", "01230"), 4, 10).cast("bigint"))
        parts.append(F.conv(F.translate(piece, "ACGTN", "00001"), 4, 10).cast("bigint"))
    return F.array(*parts)


def packed_hamming(a: Column | str, b: Column | str, words: int = 2) -> Column:
    """Hamming distance of packed windows; unknown equals unknown and differs from every base."""
    out, low = F.lit(0), F.lit(0x0555555555555555).cast("bigint")
    for w in range(words):
        x = col(a)[2 * w].bitwiseXOR(col(b)[2 * w])
        m = col(a)[2 * w + 1].bitwiseXOR(col(b)[2 * w + 1])
        differs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(m).bitwiseAND(low)
        out = out + F.bit_count(differs)
    return out
