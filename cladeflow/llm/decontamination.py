"""Benchmark decontamination by winnowing.

Of every document the minimum k-gram hash of each sliding window of w k-grams is kept as a fingerprint.
With k + w - 1 = 10 words, every shared span of 10 words holds a fingerprint that the benchmark has too. A fingerprint among
the k-grams of the benchmark is extended to the windows of 10 words that hold it, and these windows are joined with the
benchmark's as words, so hits are exact. Items of fewer than 10 words are one window each and are joined by their own length.

The benchmark is a table of windows and k-gram hashes that Spark makes (`index_of`); it never passes through the driver. What
is sent to the workers is a filter of hash bits, of a size that is bounded whatever the benchmark's (`filter_bits`): it only
spares the join what the benchmark cannot have. A benchmark of more windows than the filter is made for lets more through, and the
join decides. Documents are read once to find windows; what is joined are a text's distinct windows, once for all rows of that text.
A window that occurs in many places, there or here, meets once, and never in pairs of places.

Defined results: null or wordless texts have no words and no hits; a null item id counts as the item ''
and repeated item ids as one item; repeated rows and null doc_ids keep their rows; extra columns are ignored
by `find` and kept by `filter_documents`; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import if_small
from .common import ORIGINAL, mix64, named, packed, slices, with_fields, written

WINDOW_WORDS = 10
K = 5
#: Words of benchmark text that the filter is made for; it has BITS bits for each.
BLOCK_WORDS = 1 << 24
BITS = 16
#: Bytes of text that word hashes are computed for at once; the hash of a longer word is a digest.
PIECE = 1 << 18
_SPACE = ord(" ")
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else _SPACE for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, _BASE, np.uint64)])
_INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, pow(_BASE, -1, 1 << 64), np.uint64)])


class Words:
    """The lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of some texts, by where they are."""

    def __init__(self, texts: list[bytes]):
        self.clean = b" ".join(texts).translate(_TABLE)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        inside = np.zeros(len(self.clean) + 2, bool)
        inside[1:-1] = np.frombuffer(self.clean, np.uint8) != _SPACE
        self.edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = self.edges[::2], self.edges[1::2]
        #: the first word of each text, and after the last one
        self.first = np.searchsorted(self.begin, np.r_[0, np.cumsum(sizes)])
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        #: words from each one to the end of its text
        self.room = self.first[1:][self.text] - np.arange(len(self.begin))

    def hashes(self) -> np.ndarray:
        """A hash of each word: equal words have equal ones, whatever surrounds them."""
        out, a = np.empty(len(self.begin), np.uint64), 0
        data = np.frombuffer(self.clean, np.uint8)
        while a < len(out):
            base = self.begin[a]
            b = int(np.searchsorted(self.end, base + PIECE, "right"))
            if b == a:
                out[a] = int.from_bytes(hashlib.blake2b(self.clean[base : self.end[a]], digest_size=8).digest(), "little")
                a += 1
                continue
            size = self.end[b - 1] - base
            terms = np.zeros(size + 1, np.uint64)
            np.multiply(data[base : base + size], _POWERS[:size], out=terms[:-1])
            sums = np.add.reduceat(terms, self.edges[2 * a : 2 * b] - base)[::2]
            out[a:b] = sums * _INVERSES[self.begin[a:b] - base]
            a = b
        return mix64(out)

    def window(self, start: int, n: int) -> bytes:
        """n words from a start on, with a space between them."""
        return b" ".join(self.clean[self.begin[start] : self.end[start + n - 1]].split())


def gram_hashes(words: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A hash of the n words from each start on, by default from every one that has as many, of the hashes of words."""
    starts = np.arange(max(0, len(words) - n + 1)) if starts is None else starts
    h = np.zeros(len(starts), np.uint64)
    for i in range(n):
        h = mix64(h ^ (words[starts + i] + np.uint64(i + 1)))
    return h


# ---- the benchmark ----

_INDEX = "key long, window binary, n int, item string"


def _index_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 18):
                names, words = batch.column(0).to_pylist(), Words(batch.column(1).to_pylist())
                h = words.hashes()
                for i, name in enumerate(names):
                    a, size = int(words.first[i]), int(words.counts[i])
                    n = min(size, window)
                    if not n:
                        continue
                    own = h[a : a + size]
                    distinct = {words.window(s, n): s - a for s in range(a, a + size - n + 1)}
                    keys = gram_hashes(own, n, np.fromiter(distinct.values(), np.int64))
                    grams = np.unique(gram_hashes(own, k)) if n == window else np.empty(0, np.uint64)
                    extra = len(grams)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.r_[keys, grams].view(np.int64)),
                            pa.array([*distinct, *[None] * extra], pa.binary()),
                            pa.array([*[n] * len(keys), *[None] * extra], pa.int32()),
                            pa.array([*[name] * len(keys), *[None] * extra], pa.string()),
                        ],
                        ["key", "window", "n", "item"],
                    )

    return run


def index_of(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The distinct windows of each item (window, n words, item) with their hash `key`; rows without a window are hashes of k-grams."""
    text = F.coalesce(named("text").cast("string"), F.lit("")).cast("binary")
    items = benchmark.select(F.coalesce(named("item_id").cast("string"), F.lit("")).alias("item"), text.alias("text"))
    return written(items.mapInArrow(_index_rows(window, min(K, window)), _INDEX).distinct())


def filter_bits(index: DataFrame, block_words: int) -> np.ndarray:
    """Two bits for each key, in words of 64: a power of two of bits, for the keys there are or 2 * block_words of them at most."""
    keys = min(index.count(), 2 * block_words)
    bits = max(64, 1 << min(28, (keys * BITS // 2).bit_length()))
    key = F.col("key")
    place = F.explode(F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))))
    set_bits = F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))"))
    filled = index.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(set_bits.alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


class Filter:
    """Which windows of texts the benchmark may have."""

    def __init__(self, bits: np.ndarray, lengths: list[int], window: int):
        self.bits, self.lengths, self.window, self.k = bits, lengths, window, min(K, window)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        most = np.uint64(64 * len(self.bits) - 1)
        out = np.ones(len(h), bool)
        for place in (h & most, (h >> np.uint64(32)) & most):
            out &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).view(np.int64) > 0
        return out

    def candidates(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """Lengths, and the starts of windows of that length which the benchmark may have."""
        h = words.hashes() if self.lengths else np.empty(0, np.uint64)
        for n in self.lengths:
            starts = self._near_fingerprints(h, words.room) if n == self.window else np.flatnonzero(words.room >= n)
            yield n, starts[self.may_have(gram_hashes(h, n, starts))]

    def _near_fingerprints(self, h: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The starts of windows that hold a fingerprint of the document that the benchmark may have."""
        k, window = self.k, self.window
        whole = np.flatnonzero(room >= window)
        if not len(whole):
            return whole
        grams = gram_hashes(h, k)
        least = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
        kept = np.unique(least[whole] + whole)
        places = kept[self.may_have(grams[kept])]
        near = np.zeros(len(h) + 1, np.int64)
        np.add.at(near, np.maximum(places - (window - k), 0), 1)
        np.add.at(near, places + 1, -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (room >= window))


# ---- documents ----

_FOUND = pa.list_(pa.struct([("window", pa.binary()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))]))
_SCANNED = "__key binary, n_words long, found array<struct<window: binary, n: int, starts: array<int>>>"


def _scan(sent, kept: int):
    """For each text: its number of words and the distinct windows that the benchmark may have, with their places; the text's digest if it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, kept, 1 << 18):
                texts = batch.column(kept).to_pylist()
                words = Words(texts)
                found: list[dict[bytes, tuple[int, list[int]]]] = [{} for _ in texts]
                for n, starts in sent.value.candidates(words):
                    for s, t in zip(starts.tolist(), words.text[starts].tolist()):
                        found[t].setdefault(words.window(s, n), (n, []))[1].append(s - int(words.first[t]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:kept],
                        pa.array([hashlib.md5(t).digest() if f else None for t, f in zip(texts, found)], pa.binary()),
                        pa.array(words.counts, pa.int64()),
                        pa.array([[{"window": w, "n": n, "starts": at} for w, (n, at) in f.items()] for f in found], _FOUND),
                    ],
                    [*batch.schema.names[:kept], "__key", "n_words", "found"],
                )

    return run


def _scanned(rows: DataFrame, index: DataFrame, window: int, block_words: int) -> DataFrame:
    """Rows of some columns and, last, a text: the columns, __key, n_words and found."""
    lengths = sorted(r.n for r in index.where("window IS NOT NULL").select("n").distinct().collect())  # at most `window` of them
    sent = rows.sparkSession.sparkContext.broadcast(Filter(filter_bits(index, block_words), lengths, window))
    kept = rows.columns[:-1]
    return rows.mapInArrow(_scan(sent, len(kept)), with_fields(rows, kept, _SCANNED))


def _hit_windows(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """__key, n_words, window, n, starts: the windows of each distinct text that the benchmark has."""
    texts = scanned.where("__key IS NOT NULL").select("__key", "n_words", "found").dropDuplicates(["__key"])
    each = texts.select("__key", "n_words", F.explode("found").alias("w")).select("__key", "n_words", "w.*")
    return each.join(index.where("window IS NOT NULL").select("window"), "window", "left_semi")


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of marked runs, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the words of each text that its hit windows cover."""
    for batch in batches:
        n_hit, hits = [], []
        for size, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            edges = np.zeros(size + 1, np.int64)
            for w in windows:
                starts = np.array(w["starts"], np.int64)
                edges[starts] += 1  # the starts of one window differ
                edges[starts + w["n"]] -= 1
            hit = np.cumsum(edges[:-1]) > 0
            n_hit.append(int(hit.sum()))
            hits.append(_runs(hit))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(pa.int32())), batch.column(3)], ["__key", "n_hit", "hits", "items"]
        )


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, hits (word runs), items (ids with occurring windows)."""
    index = index_of(benchmark, window)
    rows = documents.select(named("doc_id").alias("doc_id"), F.coalesce(named("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    scanned = written(_scanned(rows, index, window, block_words))
    windows = _hit_windows(scanned, index)
    places = windows.groupBy("__key").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("n", "starts")).alias("windows"))
    named_items = windows.select("__key", "window").join(index.where("window IS NOT NULL").select("window", "item"), "window")
    items = named_items.groupBy("__key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = places.join(items, "__key").select("__key", "n_words", "windows", "items")
    hits = hits.mapInArrow(_spread, "__key binary, n_hit long, hits array<int>, items array<string>")
    # texts without a candidate have no key, and do not meet in one task for want of it
    none = (F.lit(0).cast("long"), F.expr("CAST(array() AS array<int>)"), F.expr("CAST(array() AS array<string>)"))
    clean = scanned.where("__key IS NULL").select("doc_id", "n_words", none[0].alias("n_hit"), none[1].alias("hits"), none[2].alias("items"))
    met = scanned.where("__key IS NOT NULL").select("doc_id", "n_words", "__key").join(hits, "__key", "left")
    return clean.unionByName(met.select("doc_id", "n_words", *[F.coalesce(c, empty).alias(c) for c, empty in zip(("n_hit", "hits", "items"), none)]))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `find`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def filter_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a hit, with their columns as they were. They are read twice: for windows, and without the texts that have hits."""
    index = index_of(benchmark, window)
    rows = packed(documents)
    found = _scanned(rows.select(F.col("__text").cast("binary").alias("text")), index, window, block_words).where("__key IS NOT NULL")
    hit = _hit_windows(written(found), index).select("__key").distinct()
    return rows.withColumn("__key", F.unhex(F.md5("__text"))).join(if_small(hit), "__key", "left_anti").select(f"{ORIGINAL}.*")


def items_sha256(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
