"""Secret scan, native: only DataFrame functions.

Base spans come from three patterns. A pattern's places are found without a UDF: the pieces between the
matches (`split`) and the matches (`regexp_extract_all`) alternate, so running sums of their lengths are the
places in code points.

The method adds spans of kind `entropy`: candidate strings are tried by a sliding window of Shannon entropy
over their own character class. The window moves one character at a time and keeps counts and
sum(c * log2 c) incrementally. Allow-listed candidates are suppressed. A candidate that base spans cover in part
is tried whole, and if it is no secret, so are those of its uncovered parts that fill a window. One that base spans
cover entirely is not tried, as its text is found already.

Defined results: a null text is empty; repeated rows and null ids keep their rows; extra columns are ignored
by `scan` and kept by `redact`; an empty table gives an empty result. Long texts, and long candidates, cost in
proportion to their length; n matches of a text cost n steps, and n * n / 256 comparisons of their places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, packed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, group to measure, least length). Runs of one class cannot be retried inside, so their least length is in the pattern.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}+", 0, 16),
    "hex": (r"[0-9a-f]{32,}+", 0, 32),
}
KINDS = (*BASE, "entropy")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: class -> (alphabet, least entropy in bits over a window)
CLASSES: dict[str, tuple[str, float]] = {
    "hex": ("0123456789abcdefABCDEF", 3.0),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.75),
}
WINDOW = 20
#: Candidates that match one of these are no secrets.
ALLOW = (
    r"^(?!(?:.*?[A-Z][a-z]{1,2}(?=[A-Z])){3})[^0-9]*$",  # letters alone, unless their case changes as no name's does
    r"^[0-9+/_=-]*$",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx",
    r"(.)\1{7}",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$",
)
MASK = "[SECRET]"
SPAN = "struct<start int, rank int, end int, value string>"
#: items of an array that are folded, or compared, together
BLOCK = 256


def _let(value: Column, use) -> Column:
    """use(value), evaluated once however often it is named there; inside lambdas nothing is shared otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(array: Column) -> Column:
    """An array in parts of BLOCK items."""

    def parts(items: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(items) > 0, some).otherwise(F.slice(F.array(items), 1, 0))

    return _let(array, parts)


def _before(values: Column, combine) -> Column:
    """For each of an array of whole numbers, the sum (or maximum) of those before it, 0 at first.

    An array grows by copying it, so blocks are summed first and their insides then: copies are of BLOCK items, or of the blocks.
    """
    grown = lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v)))

    def sums(blocks: Column) -> Column:
        edges = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine)), F.array(F.lit(0)), grown)
        return F.flatten(F.zip_with(blocks, F.slice(edges, F.lit(1), F.size(blocks)), lambda b, at: F.slice(F.aggregate(b, F.array(at), grown), F.lit(1), F.size(b))))

    return _let(_blocks(values), sums)


def _places(text: Column, pattern: str, rank: int, kept) -> Column:
    """The spans of a pattern as array<struct<start, rank, end, value>>; kept: a condition on (match, index)."""
    p = F.lit(pattern)
    groups = F.regexp_extract_all(text, p, F.lit(2 if rank == 0 else 0))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), groups.alias("group"))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        fields = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value"))
        return F.struct(kept(x).alias("kept"), fields.cast(SPAN).alias("span"))

    def spans(zipped: Column) -> Column:
        # the last gap is before no match
        ends = _before(F.transform(zipped, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))), lambda a, b: a + b)
        return F.transform(F.filter(F.zip_with(zipped, ends, span), lambda x: x["kept"]), lambda x: x["span"])

    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _bits(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of a window sliding over a string of an alphabet, by incremental counts.

    The string becomes letter codes once; each is paired with the one that leaves the window as it comes in (0: none yet).
    """
    struct = "struct<counts array<int>, s double, n int, best double>"
    letters = F.lit(alphabet)
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("best")).cast(struct)
    codes = F.transform(F.slice(F.split(value, ""), F.lit(1), F.length(value)), lambda x: F.instr(letters, x))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes))

    def step(state: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        n_new, n_old = F.element_at(state["counts"], new), F.element_at(state["counts"], F.greatest(old, F.lit(1)))
        same = old == new
        s = F.when(same, state["s"]).otherwise(
            state["s"] + _bits(n_new + 1) - _bits(n_new) + F.when(old > 0, _bits(n_old - 1) - _bits(n_old)).otherwise(F.lit(0.0))
        )
        moved = F.transform(state["counts"], lambda c, j: c + (j + 1 == new).cast("int") - (j + 1 == old).cast("int"))
        return F.struct(F.when(same, state["counts"]).otherwise(moved).alias("counts"), s.alias("s"), (state["n"] + 1).alias("n"), highest(state).alias("best")).cast(struct)

    def highest(state: Column) -> Column:
        return F.when(state["n"] >= window, F.greatest(state["best"], F.lit(math.log2(window)) - state["s"] / window)).otherwise(state["best"])

    return F.aggregate(F.arrays_zip(codes.alias("new"), leaving.alias("old")), start, step, highest)


def is_secret(value: Column, allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> Column:
    """Whether a candidate's entropy passes its class's limit and no allow-list entry matches."""
    allowed = F.lit(False)
    for p in allow:
        allowed = allowed | value.rlike(p)
    hexes, wide = CLASSES["hex"], CLASSES["base64"]
    high = F.when(value.rlike("^[0-9a-fA-F]+$"), window_entropy(value, hexes[0], window) >= hexes[1]).otherwise(window_entropy(value, wide[0], window) >= wide[1])
    return F.when(allowed, F.lit(False)).otherwise(high)


def _uncovered(c: Column, blocks: Column) -> Column:
    """A candidate with `tried`, whether base spans leave some of it uncovered, and those parts; no parts where no base span meets it. blocks: of base spans."""
    meets = lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])

    def part(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.alias("start"), c["rank"].alias("rank"), b.alias("end"), F.substring(c["value"], a - c["start"] + 1, b - a).alias("value")).cast(SPAN))

    def step(state: Column, b: Column) -> Column:
        parts = F.when(b["start"] > state["at"], F.concat(state["parts"], part(state["at"], b["start"]))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), parts.alias("parts")).cast(f"struct<at int, parts array<{SPAN}>>")

    start = F.struct(c["start"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts")).cast(f"struct<at int, parts array<{SPAN}>>")
    end = lambda s: F.when(s["at"] < c["end"], F.concat(s["parts"], part(s["at"], c["end"]))).otherwise(s["parts"])

    def judged(near: Column) -> Column:
        parts = F.when(F.size(near) > 0, F.aggregate(near, start, step, end)).otherwise(start["parts"])
        return _let(parts, lambda p: F.struct(c.alias("whole"), ((F.size(near) == 0) | (F.size(p) > 0)).alias("tried"), p.alias("parts")))

    return _let(F.filter(F.flatten(F.transform(F.filter(blocks, meets), lambda b: b["spans"])), meets), judged)


def _scanned(rows: DataFrame, allow: tuple[str, ...]) -> DataFrame:
    """Adds __base and __all, sorted arrays of spans, to rows that hold __text."""
    text = F.col("__text")
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        part = "group" if group else "hit"
        rows = rows.withColumn(f"__{kind}", _places(text, pattern, rank, lambda x, part=part, least=least: F.length(x[part]) >= least))
    rows = rows.withColumn("__candidates", _places(text, CANDIDATE, len(BASE), lambda x: F.length(x["hit"]) >= 0))
    rows = rows.withColumn("__base", F.array_sort(F.concat(*[F.col(f"__{k}") for k in BASE])))
    base = F.col("__base")
    fenced = F.transform(_blocks(base), lambda b: F.struct(F.array_min(b["start"]).alias("start"), F.array_max(b["end"]).alias("end"), b.alias("spans")))
    free = _let(fenced, lambda blocks: F.filter(F.transform("__candidates", lambda c: _uncovered(c, blocks)), lambda x: x["tried"]))
    rows = rows.withColumn("__free", F.when(F.size("__candidates") > 0, free))

    def passing(x: Column) -> Column:
        parts = F.filter(x["parts"], lambda p: (F.length(p["value"]) >= WINDOW) & is_secret(p["value"], allow))
        return F.when(is_secret(x["whole"]["value"], allow), F.array(x["whole"])).otherwise(parts)

    added = F.flatten(F.transform("__free", passing))
    return rows.withColumn("__all", F.when(F.size("__candidates") > 0, F.array_sort(F.concat(base, added))).otherwise(base))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(documents: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row a document: doc_id, counts a kind, and the spans as arrays and joined."""
    rows = _scanned(documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")), allow)
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__all")).alias("spans"),
        (F.size("__all") - F.size("__base")).cast("long").alias("n_entropy"),
    )


def redact(documents: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The documents with every span replaced by MASK; overlapping spans become one. Other columns stay; an n_chars column is recounted."""
    rows = _scanned(packed(documents, text), allow)
    whole = F.col("__text")
    reach = F.zip_with("__all", _before(F.transform("__all", lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda x, at: F.struct(x["start"].alias("start"), x["end"].alias("end"), at.alias("at")))

    def masked(x: Column, piece: Column, lo: Column) -> Column:
        # the text since the last span, and one mask for spans that overlap
        return F.when(x["start"] < x["at"], F.lit("")).otherwise(F.concat(F.substring(piece, x["at"] - lo + 1, x["start"] - x["at"]), F.lit(MASK)))

    def block(b: Column) -> Column:
        # a place in a text is found by walking to it, so each block's part of the text is taken out first
        lo = F.element_at(b, 1)["at"]
        part = F.struct(F.substring(whole, lo + 1, F.array_max(b["end"]) - lo).alias("text"), lo.alias("lo"))
        return _let(part, lambda x: F.array_join(F.transform(b, lambda y: masked(y, x["text"], x["lo"])), ""))

    pieces = F.transform(_blocks(reach), block)
    clean = F.concat(F.array_join(pieces, ""), F.substring(whole, F.array_max(F.col("__all.end")) + 1, F.length(whole)))
    rows = rows.withColumn("__clean", F.when(F.size("__all") > 0, clean).otherwise(own(text)))
    columns = []
    for c in documents.columns:
        if c == text:
            columns.append(F.col("__clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.size("__all") > 0, F.length("__clean").cast(documents.schema[c].dataType)).otherwise(own(c)).alias(c))
        else:
            columns.append(own(c).alias(c))
    return rows.select(*columns)
