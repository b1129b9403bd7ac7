"""Greedy clustering of windows by Hamming distance, as joins.

A window is a centroid if no earlier centroid is within the distance; others join their nearest earlier
centroid, the earliest of equals. Candidates share two of max_divergence + 2 blocks (pigeonhole), so no
theta join is needed.

The order-dependent rule is solved in growing chunks of the order. A chunk is joined with the centroids so far;
what they reach is a member and takes no part in choosing, so groups of like windows shrink to their centroids
before they meet each other. The rest of a chunk is a graph of near pairs. If no marker has more than LOCAL_EDGES of
them, one task a marker walks its pairs in order, so a chain of windows, however long, takes no round. Otherwise rounds
make the graph smaller first: what has no undecided or chosen earlier neighbour becomes a centroid, its later neighbours
become members, and the edges of both are dropped.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import known_bases, normalise_gaps, packed_bases
from ..sources.shared import cut

#: Sequence numbers a marker in the first chunk, and how many times as many each next one has.
FIRST, GROWTH = 4096, 4
#: Near pairs of a marker, in a chunk, that one task walks at most (about 120 bytes each while it does).
LOCAL_EDGES = 2_000_000


def _edges(max_divergence: int, window: int) -> list[int]:
    n = max_divergence + 2
    return [window * i // n for i in range(n + 1)]


def _keys(max_divergence: int, window: int) -> Column:
    """Of each pair of blocks its place and a hash of both."""
    edges = _edges(max_divergence, window)
    part = [F.substring("sequence", a + 1, b - a) for a, b in zip(edges, edges[1:])]
    pairs = combinations(range(max_divergence + 2), 2)
    return F.array(*[F.struct(F.lit(k).alias("combo"), F.xxhash64(part[i], part[j]).alias("part")) for k, (i, j) in enumerate(pairs)])


def differing(words: int) -> list[Column]:
    """For each 30 bases of two packed windows in columns a0, a1, ... and b0, b1, ... a word with a bit for each base that differs."""
    out = []
    for w in range(words):
        x, unknown = (F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")) for i in (2 * w, 2 * w + 1))
        out.append(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(unknown).bitwiseAND(F.lit(0x0555555555555555).cast("bigint")))
    return out


def differences_in(low: int, high: int, words: int) -> Column:
    """How many bases from low to before high differ, by the words of `differing` in columns d0, d1, ..."""
    count = F.lit(0)
    for w in range(words):
        bits = sum(1 << 2 * (29 - p % 30) for p in range(max(low, 30 * w), min(high, 30 * w + 30)))
        if bits:
            count = count + F.bit_count(F.col(f"d{w}").bitwiseAND(F.lit(bits).cast("bigint")))
    return count


def near_pairs(left: DataFrame, right: DataFrame, max_divergence: int = 2, window: int = 60) -> DataFrame:
    """CLU-02, JOIN-22: pairs (gene, a, b, divergence) within a distance; left and right: (gene, id, sequence), gaps as N.

    Windows meet by id and packed bases in every pair of blocks that they share. A pair is kept in the first only,
    so there is nothing to deduplicate. Letters other than A, C, G and T are one unknown base, N.
    """
    if max_divergence < 0:
        raise ValueError("max_divergence must not be negative")
    words, n = -(-window // 30), max_divergence + 2

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.length("sequence") == window).select("gene", F.col("id").alias(name), known_bases("sequence").alias("sequence"))
        rows = rows.select("gene", name, packed_bases("sequence", words).alias("bits"), F.explode(_keys(max_divergence, window)).alias("x"))
        return rows.select("gene", "x.combo", "x.part", name, *[F.col("bits")[i].alias(f"{name}{i}") for i in range(2 * words)])

    met = side(left, "a").hint("merge").join(side(right, "b").hint("merge"), ["gene", "combo", "part"])  # see refmatch.shuffled
    met = met.select("gene", "combo", "a", "b", *[d.alias(f"d{w}") for w, d in enumerate(differing(words))])
    divergence = sum((F.bit_count(f"d{w}") for w in range(words)), F.lit(0))
    edges, same = _edges(max_divergence, window), F.lit(0)
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        same = same + F.when(differences_in(low, high, words) == 0, 1 << k).otherwise(0)
    # for each set of shared blocks the first pair of them
    places = {pair: k for k, pair in enumerate(combinations(range(n), 2))}
    first = [places.get(tuple(i for i in range(n) if shared >> i & 1)[:2], -1) for shared in range(1 << n)]
    near = met.where(divergence <= max_divergence).where(F.get(F.lit(first), same) == F.col("combo"))
    return near.select("gene", "a", "b", divergence.alias("divergence"))


def bucket_sizes(rows: DataFrame, max_divergence: int = 2, window: int = 60) -> DataFrame:
    """CLU-02: what `near_pairs` of rows with themselves will meet: of each marker and pair of blocks the buckets, the largest of them, and the pairs to compare.

    Windows of low complexity share a bucket; their number is what to look at before a large run.
    """
    keys = rows.where(F.length("sequence") == window).select("gene", known_bases("sequence").alias("sequence")).select("gene", F.explode(_keys(max_divergence, window)).alias("x"))
    sizes = keys.groupBy("gene", "x.combo", "x.part").agg(F.count("*").alias("n"))
    pairs = F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    return sizes.groupBy("gene", "combo").agg(F.count("*").alias("n_buckets"), F.max("n").alias("largest"), pairs.alias("candidate_pairs"))


def _walk(edges: pa.Table) -> pa.Table:
    """Of a marker's pairs (a before b) those b that an earlier centroid reaches."""
    a, b = (edges.column(c).to_numpy() for c in ("a", "b"))
    order = np.lexsort((a, b))
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    first, later = places[: len(a)][order].tolist(), places[len(a) :][order].tolist()
    member = bytearray(len(ids))
    for x, y in zip(first, later):  # by the later end: whether x is a centroid is known by then
        if not member[x]:
            member[y] = 1
    reached = ids[np.frombuffer(member, np.uint8) == 1]
    return pa.table({"gene": pa.array([edges.column("gene")[0].as_py()] * len(reached), pa.string()), "id": reached})


def _chosen(rows: DataFrame, max_divergence: int, window: int) -> DataFrame:
    """The centroids (gene, id) that the rule picks among rows alone."""
    edges = cut(near_pairs(rows, rows, max_divergence, window).where("a < b").select("gene", "a", "b"))
    open_, chosen = rows.select("gene", "id"), []
    while True:
        largest = edges.groupBy("gene").count().agg(F.max("count")).first()[0] or 0
        if largest <= LOCAL_EDGES:
            break
        heads = cut(open_.join(edges.select("gene", F.col("b").alias("id")), ["gene", "id"], "left_anti"))
        chosen.append(heads)
        members = edges.join(heads.withColumnRenamed("id", "a"), ["gene", "a"], "left_semi").select("gene", F.col("b").alias("id"))
        gone = cut(heads.unionByName(members).distinct())
        open_ = cut(open_.join(gone, ["gene", "id"], "left_anti"))
        for end in ("a", "b"):
            edges = edges.join(gone.withColumnRenamed("id", end), ["gene", end], "left_anti")
        edges = cut(edges)
    if largest:
        members = edges.groupBy("gene").applyInArrow(_walk, "gene string, id long")
        open_ = open_.join(members, ["gene", "id"], "left_anti")
    return reduce(DataFrame.unionByName, [*chosen, open_])


def numbered_windows(unique: DataFrame, start: int = 0) -> DataFrame:
    """(gene, seq_num, sequence) as the rows that are clustered: gene, id, sequence with gaps as N, and the member as it is written."""
    return unique.select("gene", (F.col("seq_num") + start).alias("id"), normalise_gaps("sequence").alias("sequence"), F.col("sequence").alias("member"))


def extend(rows: DataFrame, centroids: DataFrame, max_divergence: int, window: int) -> tuple[DataFrame, DataFrame]:
    """One chunk after those that gave the centroids: its rows' (gene, id, rep_id, divergence), and its own centroids (gene, id, sequence)."""
    part = rows.select("gene", "id", "sequence")
    old = cut(near_pairs(centroids, part, max_divergence, window))
    rest = part.join(old.select("gene", F.col("b").alias("id")), ["gene", "id"], "left_anti")
    new = cut(part.join(_chosen(rest, max_divergence, window), ["gene", "id"], "left_semi"))
    own = new.select("gene", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("divergence"))
    met = old.unionByName(near_pairs(new, part, max_divergence, window).where("a < b")).unionByName(own)
    # the least centroid at each distance, since the least (distance, centroid) would not be aggregated by hash
    least = {d: F.col(f"__{d}") for d in range(max_divergence + 1)}
    best = met.groupBy("gene", "b").agg(*[F.min(F.when(F.col("divergence") == d, F.col("a"))).alias(f"__{d}") for d in least])
    nearest = F.coalesce(*[F.when(c.isNotNull(), F.lit(d)) for d, c in least.items()])
    return cut(best.select("gene", F.col("b").alias("id"), F.coalesce(*least.values()).alias("rep_id"), nearest.alias("divergence"))), new


def extend_growing(rows: DataFrame, centroids: DataFrame, max_divergence: int, window: int, low: int, high: int, size: int, growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """`extend` over ids from low to high in chunks of `size` ids, each next one of `growth` times as many: the result is that of one chunk."""
    found, new = [], []
    while low <= high:
        reached, own = extend(rows.where(F.col("id").between(low, low + size - 1)), reduce(DataFrame.unionByName, new, centroids), max_divergence, window)
        found, new = [*found, reached], [*new, own]
        low, size = low + size, size * growth
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, new)


def cluster(unique: DataFrame, max_divergence: int = 2, window: int = 60, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """CLU-01: (gene, member, rep, divergence) of every window; unique: (gene, seq_num, sequence), earlier numbers first."""
    rows = cut(numbered_windows(unique))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    none = rows.limit(0).select("gene", "id", "sequence")
    if low is None:
        return none.select("gene", F.col("sequence").alias("member"), F.col("sequence").alias("rep"), F.lit(0).alias("divergence"))
    found, centroids = extend_growing(rows, none, max_divergence, window, low, high, first, growth)
    return named_members(found, centroids, rows).select("gene", "member", "rep", "divergence")


def named_members(found: DataFrame, centroids: DataFrame, rows: DataFrame) -> DataFrame:
    """Memberships by id with the member as it is written and the centroid's sequence."""
    names = centroids.select("gene", F.col("id").alias("rep_id"), F.col("sequence").alias("rep"))
    members = rows.select("gene", "id", "member")
    return found.join(names, ["gene", "rep_id"]).join(members, ["gene", "id"]).select("gene", "id", "member", "rep_id", "rep", F.col("divergence").cast("int").alias("divergence"))


def resolve_chains(rounds: DataFrame) -> DataFrame:
    """CLU-04: (member, rep) with reps followed to the end, by pointer doubling; a rep that is no member is an end. A ring is an error."""
    now = cut(rounds.select("member", "rep"))
    for _ in range(now.count().bit_length() + 1):
        nxt = now.select(F.col("member").alias("rep"), F.col("rep").alias("next"))
        moved = now.join(nxt, "rep", "left").select("member", F.coalesce("next", "rep").alias("rep"), (F.col("next") != F.col("rep")).alias("moved"))
        moved = cut(moved)
        if moved.where("moved").isEmpty():
            return moved.select("member", "rep")
        now = moved.select("member", "rep")
    raise ValueError("representatives form a ring")


def greedy(windows: list[str], max_divergence: int = 2) -> list[int]:
    """The rule in plain Python, for tests: the centroid's place for each window."""
    chosen: list[int] = []
    out = []
    for i, w in enumerate(windows):
        near = [(sum(x != y for x, y in zip(w, windows[c])), c) for c in chosen if len(windows[c]) == len(w)]
        near = [x for x in near if x[0] <= max_divergence]
        if near:
            out.append(min(near)[1])
        else:
            chosen.append(i)
            out.append(i)
    return out

