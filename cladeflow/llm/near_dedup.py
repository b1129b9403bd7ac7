"""Near-duplicate groups by BagMinHash.

A document is the multiset of its shingles of five words. For every shingle and every dyadic interval of
its multiplicity a Poisson process runs whose points carry an arrival time, a place in the interval and a
signature slot; a point counts where its place is within the multiplicity. The earliest point a slot sees is
the slot's value, so two documents agree in a slot with probability sum(min) / sum(max), their weighted
Jaccard similarity. Arrivals are drawn in order and stop at a horizon at which all slots are filled.

Signatures are cut into bands. Documents that share a band are compared exactly, by multiset overlap, and
linked at the threshold; groups are the connected components of the links.

Work on hot groups: exact copies are one key. In a bucket of up to SMALL keys all pairs are compared. In a
larger one a leader is compared with all others and the links are made components. Where a bucket has keys
of several components then, those outside its largest one are compared with all of it: both sides are dealt
into blocks, a pair of blocks is a cell, and a cell's texts meet in one task, which gives a spanning forest of
the links it finds. So no pair that meets in a band is passed over unless its component is known already,
texts are sent once a cell and not once a pair, and no list of pairs is made. Nothing is capped and no bucket
is dropped.

Tables that say something of a bucket or component are written before they are joined, so that the joins on hot
ones can be split.

Defined results: null and wordless texts are groups of their own; documents of fewer than five words have
one shingle of all their words; repeated rows are exact copies; null ids stay null and never name a group
that has another id, and groups of null or repeated ids are told apart by `class_key`; a very long text is sketched
on its own, in memory in proportion to its length; extra columns are ignored by `groups` and kept by
`drop_duplicates`, which keeps of rows of one id and text the least by all columns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, named, slices
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Expected points a slot at the first horizon; documents with an empty slot are drawn again to twice the horizon.
HORIZON = 9.0
SMALL = 8
#: Keys and text bytes that a block of a hot bucket is dealt for; a cell holds two blocks.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Columns of the matrices that a cell multiplies at a time.
COLUMNS = 4096
#: Keys up to which a list of keys is broadcast; beyond, the same join is by shuffle.
BROADCAST_KEYS = 500_000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15 | 1
_UNIT = 2.0**-53


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, documents in order, and the words of each document."""
    lengths = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_WHITE[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(data)
    power = _powers(_BASE, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=prefix[1:])
    # prefix[end] - prefix[start] is the word's polynomial times base^start; times base^(n - start) and the inverse of base^n it is the same everywhere
    inverse = np.uint64(pow(pow(_BASE, n, 2**64), -1, 2**64))
    words = mix64((prefix[ends] - prefix[starts]) * power[n - starts] * inverse)
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    counts = np.bincount(doc, minlength=len(texts))
    m = len(words) - size + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for i in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + m]
        same = doc[:m] == doc[size - 1 :]
        h, d = mix64(h[same]), doc[:m][same]
    else:
        h, d = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.zeros(len(short), np.uint64)
        for j, x in enumerate(short):
            for w in words[first[x] : first[x] + counts[x]]:
                extra[j : j + 1] = mix64(extra[j : j + 1] * np.uint64(31) + w)
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return d, h, counts


def bags(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of n documents: (document, hash, multiplicity), sorted by both."""
    bounds = np.searchsorted(d, np.arange(n + 1))
    parts = [np.unique(h[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]
    sizes = [len(p[0]) for p in parts]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.repeat(np.arange(n), sizes), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _points(d, h, w, level, horizon, slots):
    """Points of the processes in time order, in growing blocks: (document, slot, time, identity)."""
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    low = np.where(level == 0, 0.0, rate)
    seed = mix64(h + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    time, at, block = np.zeros(len(d)), 0, 1
    while len(d):
        step = np.arange(at, at + block, dtype=np.uint64)
        r = mix64(seed[:, None] + step[None] * np.uint64(0xE7037ED1A0B428DB))
        gaps = -np.log1p(-((r >> np.uint64(11)) * _UNIT)) / rate[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        on = times <= horizon[d][:, None]
        part = np.flatnonzero(low + rate > w)  # only there a place can be beyond the multiplicity
        if len(part):
            on[part] &= low[part, None] + (mix64(r[part]) >> np.uint64(11)) * _UNIT * rate[part, None] < w[part, None]
        row, col = np.nonzero(on)
        who = r[row, col]
        # the time has the upper 53 bits, the slot the lower 11
        yield d[row], ((who & np.uint64(2047)) * np.uint64(slots) >> np.uint64(11)).astype(np.int64), times[row, col], who
        live = times[:, -1] <= horizon[d]
        d, w, seed, rate, low, time = d[live], w[live], seed[live], rate[live], low[live], times[live, -1]
        at, block = at + block, min(block * 2, 32)


def signatures(d: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, slots: int = SLOTS, factor: float = HORIZON) -> np.ndarray:
    """BagMinHash signatures of n multisets, as identities of the winning points; empty multisets have zeros."""
    if slots > 1024:
        raise ValueError("a point has 11 bits for its slot, which is too few for more than 1024 slots")
    best, who = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    total = np.bincount(d, w, minlength=n)
    level = np.ceil(np.log2(w)).astype(np.int64) + 1 if len(w) else w
    level = np.where(w == 1, 1, level)  # processes of an element: dyadic intervals (0,1], (1,2], (2,4], ...
    index = np.repeat(np.arange(len(d)), level)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(level) - level, level)
    horizon = factor * slots / np.maximum(total, 1)
    for doc, slot, time, identity in _points(d[index], h[index], w[index], nth, horizon, slots):
        cell = doc * slots + slot
        new = time < best[cell]
        cell, time, identity = cell[new], time[new], identity[new]
        np.minimum.at(best, cell, time)
        won = best[cell] == time
        who[cell[won]] = identity[won]
    who = who.reshape(n, slots)
    again = np.flatnonzero((total > 0) & np.isinf(best.reshape(n, slots)).any(axis=1))
    if len(again):
        keep = np.isin(d, again)
        who[again] = signatures(np.searchsorted(again, d[keep]), h[keep], w[keep], len(again), slots, factor * 2)
    return who


def band_hashes(who: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = who.reshape(len(who), bands, -1)
    h = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return h.view(np.int64)


def key_of(text: Column) -> Column:
    """128 bits of a text, null for one without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2, 2 << 20):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            d, h, counts = shingles(texts)
            rows = bags(d, h, len(texts))
            bands = band_hashes(signatures(*rows, len(texts)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "key", "bands"])


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, key, bands) of every document that has words."""
    slim = documents.select("doc_id", key_of(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where("key IS NOT NULL")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_sketched, f"doc_id {kind}, key binary, bands array<long>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (hashes, multiplicities)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum() + b[1].sum()) - common)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    d, h, _ = shingles([text.encode("utf-8", "surrogatepass")])
    return np.unique(h, return_counts=True)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, bag = None, None
    for batch in batches:
        keep = []
        for b, one, other in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if b != last:
                last, bag = b, _bag(other)
            keep.append(overlap(_bag(one), bag) >= THRESHOLD)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose multisets overlap by the threshold."""
    one, other = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    full = pairs.join(one, "a").join(other, "b").select("a", "b", "ta", "tb")
    return full.sortWithinPartitions("b").mapInArrow(_verified, "a binary, b binary")


def _elements(text: str) -> np.ndarray:
    """A bag as a set: every occurrence of a shingle is an element of its own, so common elements are sum(min)."""
    h, m = _bag(text)
    nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return mix64(np.repeat(h, m) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def near_pairs(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two lists of element sets, or i < j of one list, that overlap by the threshold.

    What a set shares with the other side as a whole bounds each of its overlaps; sets below that are left
    out before the matrix of common elements is made.
    """
    sides = [a] if b is None else [a, b]
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    held = [np.concatenate([*side, np.empty(0, np.uint64)]) for side in sides]
    row = [np.repeat(np.arange(len(n)), n) for n in sizes]
    for _ in range(3):
        if b is None:
            _, place, df = np.unique(held[0], return_inverse=True, return_counts=True)
            shared = [df[place] > 1]
        else:
            shared = [np.isin(held[0], held[1]), np.isin(held[1], held[0])]
        before = sum(map(len, held))
        for k, on in enumerate(shared):
            able = np.bincount(row[k], on, minlength=len(sizes[k])) >= THRESHOLD * sizes[k] - 1e-6
            on = on & able[row[k]]
            held[k], row[k] = held[k][on], row[k][on]
        if sum(map(len, held)) == before:
            break
    if b is None:
        held, row, sizes = held * 2, row * 2, sizes * 2
    left = [np.unique(r) for r in row]
    row = [np.searchsorted(u, r) for u, r in zip(left, row)]
    names = np.unique(held[0])
    column = [np.searchsorted(names, x) for x in held]
    order = [np.argsort(c, kind="stable") for c in column]
    column, row = [c[o] for c, o in zip(column, order)], [r[o] for r, o in zip(row, order)]
    common = np.zeros((len(left[0]), len(left[1])))
    for at in range(0, len(names), COLUMNS):
        parts = []
        for k in (0, 1):
            low, high = np.searchsorted(column[k], (at, at + COLUMNS))
            part = np.zeros((len(left[k]), COLUMNS), np.float32)
            part[row[k][low:high], column[k][low:high] - at] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    union = sizes[0][left[0]][:, None] + sizes[1][left[1]][None] - common
    i, j = np.nonzero(common / np.maximum(union, 1) >= THRESHOLD)
    i, j = left[0][i], left[1][j]
    return (i[i < j], j[i < j]) if b is None else (i, j)


def _cell(rows: pa.Table) -> pa.Table:
    """Links of one cell that join different components: a spanning forest of them."""
    key, root, second, text = (rows.column(c).to_pylist() for c in ("key", "root", "second", "text"))
    label = np.unique(np.array([r.hex() for r in root]), return_inverse=True)[1]
    sets = [_elements(t) for t in text]
    one, two = (np.flatnonzero(np.array(second) == x) for x in (False, True))
    if len(two):
        i, j = near_pairs([sets[x] for x in one], [sets[x] for x in two])
        i, j = one[i], two[j]
    else:
        i, j = near_pairs(sets)
    found = []
    for x in np.unique(i):
        for y in j[i == x]:
            if label[x] != label[y]:
                found.append((key[x], key[y]))
                label[label == label[y]] = label[x]
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})


def _within_hot(left: DataFrame, texts: DataFrame) -> DataFrame:
    """From (bucket, key, root) of buckets of several components: links (a, b) between these, a spanning forest a cell."""
    left = cut(left.join(texts.select("key", F.octet_length("text").alias("bytes")), "key"))
    main = cut(left.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m")))
    sided = left.join(main.select("bucket", F.col("m.root").alias("main")), "bucket").withColumn("rest", F.col("root") != F.col("main")).drop("main")

    def blocks(on: Column) -> Column:
        n, size = F.count(F.when(on, 1)), F.coalesce(F.sum(F.when(on, F.col("bytes"))), F.lit(0))
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))

    dealt = cut(sided.groupBy("bucket").agg(blocks(F.col("rest")).alias("r"), blocks(~F.col("rest")).alias("m")))
    rows = sided.join(dealt, "bucket").withColumn("i", F.pmod(F.xxhash64("key"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))))
    rest = F.sequence(F.lit(0).cast("long"), F.col("r") - 1)
    with_rest = F.transform(rest, lambda j: F.struct(F.lit(False).alias("main"), F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), (j < F.col("i")).alias("second")))
    with_main = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.struct(F.lit(True).alias("main"), F.col("i").alias("x"), j.alias("y"), F.lit(False).alias("second"))
    )
    of_main = F.transform(rest, lambda j: F.struct(F.lit(True).alias("main"), j.alias("x"), F.col("i").alias("y"), F.lit(True).alias("second")))
    cells = rows.select("bucket", "key", "root", F.explode(F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(of_main)).alias("c"))
    full = cells.select("bucket", "key", "root", "c.*").join(texts, "key")
    return full.groupBy("bucket", "main", "x", "y").applyInArrow(_cell, "a binary, b binary")


def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on `key`, by broadcast only if the keys are few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, "key", how)


def _pairs_in(buckets: DataFrame) -> DataFrame:
    a, b = buckets.select("bucket", F.col("key").alias("a")), buckets.select("bucket", F.col("key").alias("b"))
    return a.join(b, "bucket").where("a < b").select("a", "b")


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def components_of(drawn: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, root) of every linked key, from sketches; documents: where the texts are."""
    entries = drawn.select("key", "bands").dropDuplicates(["key"]).select("key", F.explode("bands").alias("bucket"))
    sizes = cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(entries.join(sizes, "bucket"))
    wanted = met.select("key").distinct()
    rows = documents.select(key_of(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where("key IS NOT NULL")
    texts = cut(among(rows, cut(wanted), "left_semi").dropDuplicates(["key"]))
    large = met.where(F.col("n") > SMALL).select("bucket", "key", "n")
    # the first leader of a bucket is the key that meets most others anywhere: in a hot group, the text the others were made from
    weight = large.groupBy("key").agg(F.sum("n").alias("centre"))
    large = cut(large.join(weight, "key").select("bucket", "key", "centre"))
    leader = cut(large.groupBy("bucket").agg(F.max(F.struct("centre", "key")).alias("l")).select("bucket", F.col("l.key").alias("b")))
    pairs = large.join(leader, "bucket").where("key <> b").select(F.col("key").alias("a"), "b").unionByName(_pairs_in(met.where(F.col("n") <= SMALL)))
    found = cut(verify(pairs.distinct(), texts))
    roots = components(found)
    # buckets whose keys are all of one component have nothing left to find
    rows = _with_root(large.select("bucket", "key"), roots)
    several = cut(rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"))
    new = cut(_within_hot(rows.join(several, "bucket"), texts).distinct())
    return roots if new.isEmpty() else components(found.unionByName(new))


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key) of every document with words, (key, root) of linked keys, and (root, head, class_size)."""
    drawn = cut(sketches(documents))
    roots = components_of(drawn, documents)
    members = _with_root(drawn.select("doc_id", "key"), roots)
    heads = members.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))).alias("head"), F.count("*").alias("class_size")
    )
    return drawn.select("doc_id", "key"), roots, cut(heads)


def groups(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its group), class_size, class_key (null: a group of its own, without words)."""
    rows, roots, heads = _classes(documents.select("doc_id", "text"))
    found = _with_root(rows, roots).join(heads, "root").select("doc_id", F.col("head.id").alias("class_id"), "class_size", F.hex("root").alias("class_key"))
    bare = documents.where(key_of(F.col("text")).isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("string").alias("class_key")
    )
    return found.unionByName(bare)


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """The documents with one of each group left, the one of the least id; their columns as they were."""
    drawn, roots, heads = _classes(documents.select("doc_id", "text"))
    # counted before the join on keys, so that copies of one text are not kept in one task for it
    copies = drawn.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    judged = _with_root(copies, roots).join(heads.select("root", "head"), "root")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    judged = cut(judged.where(~is_head | (F.col("copies") > 1)).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), is_head.alias("__head")))
    few = judged.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = documents.select(F.struct(*[named(c) for c in documents.columns]).alias("__row"), key_of(F.col("text")).alias("__k"), F.col("doc_id").alias("__d"))

    def on(x: DataFrame) -> Column:
        return (F.col("__k") == F.col("__key")) & F.col("__d").eqNullSafe(F.col("__id"))

    listed = F.broadcast(judged) if few else judged
    single = rows.join(listed, on(listed), "left_anti").select("__row.*")
    twice = judged.where("__head")
    twice = F.broadcast(twice) if few else twice
    # of rows that share id and text the least by all their columns
    repeated = rows.join(twice, on(twice), "left_semi").groupBy("__k", "__d").agg(F.min_by("__row", F.to_json("__row", {"ignoreNullFields": "false"})).alias("__row")).select("__row.*")
    return single.unionByName(repeated)
