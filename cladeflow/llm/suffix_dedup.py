"""Removal of repeated byte strings by hash names at content-sampled anchors; it takes the place of prefix doubling.

A byte goes if a string of SPAN (400) bytes that covers it also starts anywhere else, in any text, the same
one included. There is no suffix array, no doubling of offsets and no reranking by pairs: the strings at a position
get hash names at three fixed lengths, called ranks below, and equal strings have equal ranks. What has become
unique at one length is dropped before the next; what is left at the threshold is repeated. README.md has the figures
of an attempt at doubling.

Positions are sampled by content: every string of 400 bytes names one anchor in it, the start of the rarest-ranked
100-byte string among its 301 (a sliding minimum of their hashes). Equal strings name the same place in them, so it
is enough to rank anchors, about one in 150 positions:

1. Length 100: anchors whose 100-byte string is unique are dropped, with all strings that name them.
2. Length 700 around the anchor (300 before, 400 after, less at a text's ends): anchors of equal rank have
   all their strings repeated and are done.
3. Length 400: what is left are anchors near an edge of a repeat. One context per rank pair is compared with
   those of the same 100-byte rank: all strings of 400 bytes that name the anchor, by offset.
   Hot ranks (over HOT contexts) are dealt out by string instead of by rank.

The strings that name an anchor and are repeated cover one stretch around it; a text's stretches are merged.

Passages: 51 words often take less than 400 bytes, so a passage of over 50 words that documents share may keep all
its bytes. It is reported beside, by the same rounds over words `[^\\x20\\x09-\\x0D]+` in place of bytes (strings of 51
words, anchors of 8) and with other documents only: `n_passages` counts the maximal runs of such words of a text.

No table of counts is joined in the stage that made it, so that joins on hot ranks can be split.

Ranks are 63-bit polynomial names, equal for equal strings; two strings that differ share a name with
odds of about 2^-63 and only matter within the same rank of the round before.

Defined results: a null text is empty; texts under 400 bytes keep all, texts under 51 words have no passage; repeated
rows count as texts each for bytes and as one document for passages; null ids keep their rows; a very long text is a
part of its own and takes memory in proportion to its length; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, written

SPAN, GRAM = 400, 100
REACH = SPAN - GRAM
PASSAGE, PASSAGE_GRAM = 51, 8
#: Unit, the lowest bit of a rank: bytes or words -> symbols of a string and of an anchor.
UNITS = ((SPAN, GRAM), (PASSAGE, PASSAGE_GRAM))
#: Bytes of the shortest text that can have an anchor: 51 words of a letter.
LEAST = min(SPAN, 2 * PASSAGE - 1)
SLICE = 2 << 20
#: Contexts of one rank up to which one task compares them.
HOT = 20_000
_BASE = 0xC2B2AE3D27D4EB4F
_BYTES = mix64(np.arange(1001, 1257, dtype=np.uint64))
_INVERSE = pow(_BASE, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept for the longest n so far."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(max(n, SLICE) + 1, base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


class Names:
    """Polynomial names of all substrings of an array of symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * _power(_BASE, self.n)[: self.n], out=self.prefix[1:])
        self.inverse = _power(_INVERSE, self.n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def grams(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        return (self.prefix[length:] - self.prefix[:n]) * self.inverse[:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < w:
        return x[:0]
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Anchors(NamedTuple):
    """Anchors of a list of texts: the text, where in it the anchor and the first and last string that names it start, and two ranks."""

    text: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rank: np.ndarray
    context: np.ndarray


def _anchors(names: Names, starts: np.ndarray, lengths: np.ndarray, unit: int) -> Anchors:
    """The anchors of texts that lie in one array of symbols."""
    span, gram = UNITS[unit]
    room = lengths - span + 1
    some = np.flatnonzero(room > 0)
    if not len(some):
        return Anchors(*(np.empty(0, np.int64),) * 4, *(np.empty(0, np.uint64),) * 2)
    begins, ends = starts[some], (starts + room)[some]  # of the strings of a text
    h = names.grams(gram)
    low = np.uint64((1 << 32) - 1)  # ties of the upper half go to the leftmost, wherever the slice starts
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), span - gram + 1) & low
    # a string begins a run where it names another anchor than the one before, or is its text's first
    new = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, begins)
    text = np.searchsorted(begins, new, side="right") - 1
    inside = (text >= 0) & (new < ends[text])
    last = np.minimum(np.append(new[1:], len(least)), ends[text])[inside] - 1
    new, of = new[inside], some[text[inside]]
    at = least[new].astype(np.int64)
    a, b = np.maximum(at - (span - gram), starts[of]), np.minimum(at + span, (starts + lengths)[of])
    around = mix64(names.of(a, b) ^ ((at - a).astype(np.uint64) << np.uint64(32)) ^ (b - at).astype(np.uint64))
    rank = mix64(h[at]) & ~np.uint64(1) | np.uint64(unit)
    return Anchors(of, at - starts[of], new - starts[of], last - starts[of], rank, around)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    edge = np.diff(np.concatenate(([False], ~_WHITE[data], [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _symbols(names: Names, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words as symbols."""
    return mix64(names.of(starts, ends) ^ (ends - starts).astype(np.uint64))


def anchors(texts: list[bytes]) -> tuple[Anchors, Anchors]:
    """The anchors of whole texts, over bytes and over words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    names = Names(_BYTES[data])
    a, b = _words(data)
    first = np.searchsorted(a, starts)
    counts = np.diff(np.concatenate((first, [len(a)])))
    return _anchors(names, starts, lengths, 0), _anchors(Names(_symbols(names, a, b)), first, counts, 1)


def _anchored(full: bool):
    """Ranks of anchors; if full, with their text (d, k), and `at`: its place and how far before it its strings start, at most and at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                for x in anchors([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]):
                    rank = pa.array(x.rank.view(np.int64))
                    if not full:
                        yield pa.RecordBatch.from_arrays([rank], ["r"])
                        continue
                    index = pa.array(x.text)
                    at = x.place << 20 | (x.place - x.first) << 10 | (x.place - x.last)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(index), batch.column(1).take(index), pa.array(at), rank, pa.array(x.context.view(np.int64))], ["d", "k", "at", "r", "c"]
                    )

    return run


def _rows(documents: DataFrame) -> DataFrame:
    """(doc_id, d, k, text): d and k together tell texts apart; rows that share both have the same text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _press(texts: list[str]) -> pa.Array:
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed, the last column, before they are shuffled."""
    for whole in batches:
        last = whole.num_columns - 1
        for batch in slices(whole, last):
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], _press(batch.column(last).to_pylist())], [*batch.schema.names[:last], "packed"])


_CONTEXT = "r long, c long, several boolean, hot boolean, doc long, body binary, at int, low int, high int"
_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes, or the words as symbols, around the wanted anchors of each text; copies of a row that follow it are left out.

    `doc` names the document of a context, 0 where several have it.
    """
    press = zstandard.ZstdDecompressor()
    last = None
    for batch in batches:
        out: list[list] = [[] for _ in _CONTEXT_TYPES]
        for d, k, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (d, k) == last:
                continue
            last = (d, k)
            data = press.decompress(packed)
            words = None
            for x in wanted:
                unit, (place, most, least) = x["r"] & 1, (x["at"] >> 20, x["at"] >> 10 & 1023, x["at"] & 1023)
                span, gram = UNITS[unit]
                if unit and words is None:
                    raw = np.frombuffer(data, np.uint8)
                    words = _symbols(Names(_BYTES[raw]), *_words(raw))
                a = max(0, place - span + gram)
                body = words[a : place + span].tobytes() if unit else data[a : place + span]
                doc = 0 if x["several"] else (d ^ k * 31 | 1) & (1 << 63) - 1
                values = (x["r"], x["c"], x["several"], x["hot"], doc, body, place - a, place - most - a, place - least - a)
                for column, v in zip(out, values):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CONTEXT_TYPES)], [f.split()[0] for f in _CONTEXT.split(", ")])


def _strings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset of the anchor in the string, name) of every string that names a context's anchor; a name's lowest bit is its unit."""
    bodies = batch.column(5).to_pylist()
    ranks = np.asarray(batch.column(0), dtype=np.int64).view(np.uint64)
    at, low, high = (np.asarray(batch.column(i), dtype=np.int64) for i in (6, 7, 8))
    parts = []
    for unit, (span, _) in enumerate(UNITS):
        rows = np.flatnonzero((ranks & np.uint64(1)) == unit)
        joined = b"".join([bodies[i] for i in rows])
        symbols = np.frombuffer(joined, np.uint64) if unit else _BYTES[np.frombuffer(joined, np.uint8)]
        lengths = np.array([len(bodies[i]) for i in rows], np.int64) // (8 if unit else 1)
        starts = np.cumsum(lengths) - lengths
        n = high[rows] - low[rows] + 1
        index = np.repeat(np.arange(len(rows)), n)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[rows][index]
        where = begin + starts[index]
        row = rows[index]
        offset = at[row] - begin
        name = mix64(mix64(Names(symbols).of(where, where + span) ^ ranks[row]) + offset.astype(np.uint64))
        parts.append((row, offset, name & ~np.uint64(1) | np.uint64(unit)))
    return tuple(np.concatenate(x) for x in zip(*parts))


_REACHED = "r long, c long, most int, least int"


def _settled(t: pa.RecordBatch) -> pa.RecordBatch:
    """For whole ranks: the contexts, of those of one document, with strings that another context has, and the largest and smallest offset of these."""
    row, offset, name = _strings(t)
    doc = np.asarray(t.column(4), dtype=np.int64)[row]
    order = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    size = np.diff(np.concatenate((first, [len(order)])))
    several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
    in_words = (name[order][first] & np.uint64(1)) == 1
    on = np.zeros(len(name), bool)
    on[order] = np.repeat(np.where(in_words, several, size > 1), size)
    on &= ~np.asarray(t.column(2).to_numpy(zero_copy_only=False))[row]
    row, offset = row[on], offset[on]
    by = np.argsort(row, kind="stable")
    rows, at = np.unique(row[by], return_index=True)
    most, least = (f.reduceat(offset[by], at) if len(rows) else rows for f in (np.maximum, np.minimum))
    index = pa.array(rows)
    return pa.RecordBatch.from_arrays([t.column(0).take(index), t.column(1).take(index), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32))], ["r", "c", "most", "least"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by rank: which of their strings another context of the rank has. Whole ranks are compared at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < 3000:
            continue
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ranks = np.asarray(joined.column(0), dtype=np.int64)
        whole = int(np.flatnonzero(ranks == ranks[-1])[0])
        if whole:
            yield _settled(joined.slice(0, whole))
        held, size = [joined.slice(whole)], 0 if whole else size
    if held:
        yield _settled(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of contexts of hot ranks, each a row."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            batch = whole.slice(i, 1000)
            row, offset, name = _strings(batch)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), batch.column(2).take(index), batch.column(4).take(index), pa.array(offset.astype(np.int32)), pa.array(name.view(np.int64))],
                ["r", "c", "several", "doc", "offset", "name"],
            )


def _merged(stretches: list[dict]) -> list[list[int]]:
    """Stretches a to b as runs that neither meet nor overlap."""
    runs: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in stretches):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for packed, stretches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = press.decompress(packed)
            spans, passages = (_merged([s for s in stretches or () if s["unit"] == unit]) for unit in (0, 1))
            kept = b"".join([data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)])])
            for x, v in zip(out, (len(data), len(data) - len(kept), len(spans), len(passages), kept)):
                x.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept"])


def _unit(rank: str = "r") -> Column:
    return F.col(rank).bitwiseAND(F.lit(1).cast("long"))


def stretches(documents: DataFrame) -> DataFrame:
    """(d, k, stretches): the removed stretches of bytes (unit 0) and the passages in words (unit 1) of each text that has any, unmerged."""
    rows = _rows(documents).where(F.octet_length("text") >= LEAST).select("d", "k", "text")
    # the anchors are made twice: a scan and a linear pass cost less than a disk copy of all
    ranks = written(rows.mapInArrow(_anchored(False), "r long").groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r"))
    found = written(rows.mapInArrow(_anchored(True), "d long, k long, at long, r long, c long").join(ranks, "r"))
    pairs = found.groupBy("r", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "at")).alias("one"), F.max(F.struct("d", "k")).alias("other"))
    other = (F.col("one.d") != F.col("other.d")) | (F.col("one.k") != F.col("other.k"))
    pairs = written(pairs.select("r", "c", "one", F.when(_unit() == 0, F.col("n") > 1).otherwise(other).alias("several")))
    # round 3 is for ranks of more than one context, if one of these is not done
    open_ = written(pairs.groupBy("r").agg(F.count("*").alias("n"), F.count_if(~F.col("several")).alias("left")).where("n > 1 AND left > 0").select("r", (F.col("n") > HOT).alias("hot")))
    wanted = pairs.join(open_, "r").groupBy("one.d", "one.k").agg(F.collect_list(F.struct("r", "c", "one.at", "several", "hot")).alias("wanted"))
    packed = rows.mapInArrow(_packed, "d long, k long, packed binary")
    contexts = written(packed.join(written(wanted), ["d", "k"]).mapInArrow(_contexts, _CONTEXT))
    few = contexts.where("NOT hot").repartition("r").sortWithinPartitions("r").mapInArrow(_reached, _REACHED)
    strings = contexts.where("hot").mapInArrow(_dealt, "r long, c long, several boolean, doc long, offset int, name long")
    repeated = F.when(_unit("name") == 0, F.col("n") > 1).otherwise(F.col("low") != F.col("high"))
    twice = written(strings.groupBy("name").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).where(repeated).select("name"))
    many = strings.where("NOT several").join(twice, "name", "left_semi").groupBy("r", "c").agg(F.max("offset").alias("most"), F.min("offset").alias("least"))
    done = pairs.where("several").select("r", "c", F.lit(None).cast("int").alias("most"), F.lit(None).cast("int").alias("least"))
    reached = written(few.unionByName(many).unionByName(done))
    at = F.col("at")
    place, first, last = F.shiftright(at, 20), F.shiftright(at, 10).bitwiseAND(F.lit(1023).cast("long")), at.bitwiseAND(F.lit(1023).cast("long"))
    span = F.when(_unit() == 0, SPAN).otherwise(PASSAGE)
    covered = found.join(reached, ["r", "c"]).select("d", "k", _unit().alias("unit"), (place - F.coalesce("most", first)).alias("a"), (place - F.coalesce("least", last) + span).alias("b"))
    return written(covered.groupBy("d", "k").agg(F.collect_set(F.struct("unit", "a", "b")).alias("stretches")))


def strip(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, n_passages and the kept bytes."""
    slim = documents.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    packed = _rows(slim).mapInArrow(_packed, f"doc_id {kind}, d long, k long, packed binary")
    return packed.join(stretches(slim), ["d", "k"], "left").select("doc_id", "packed", "stretches").mapInArrow(
        _cleaned, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, n_passages long, kept binary"
    )


def dedup(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passages."""
    return strip(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
