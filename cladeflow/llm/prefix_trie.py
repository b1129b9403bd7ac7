"""Conversation prefix trie, family first.

Conversations of a family share a base id. Each family's turns meet in one cogroup (the base conversation on one side, the
others on the other), are rebuilt there, and give the family's small trie. Only these combined nodes are shuffled: nodes
of one name are merged over all families.

Sums over subtrees need no climbing of the whole trie. Every merged node is given to one family, that of its smallest
member, and each family sums what it was given over the subtrees of its own small trie; the sums of all families for a node
add up to the node's, as whatever is below a node in the whole trie is below it in the family that it was given to.

A turn is a 128-bit digest of role and text, and a node's name is a 128-bit sum over its turns of digests that
depend on the turn's place, so that texts are read once and never shuffled, and names of families agree.

A family of more than FAMILY_ROWS turns (a conversation of that length is in it, as a family has at most 199 ids) does not
go through one task: its turns are numbered, named and summed over ranges, and give rows of the same kind.

Defined results: rows without a conversation id belong to none and are left out; a null role or text is empty; turns
are ordered with null first, and equal turns by the MD5 of role and text; repeated rows are turns of their own; the
base of a negative id is rounded towards zero, as % does; extra columns are ignored; texts count in code
points at any length; an empty table has no conversations and gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, mix64, named, written

FAMILY = 100
HEADS = 6
#: turns of a family that one task takes at most
FAMILY_ROWS = 500_000
#: families whose lists of ids are joined before a node's are hashed, one after the other
BLOCK = 256

NODE = "base long, place int, up int, depth long, hi long, lo long, size long, n long, least long, inner boolean, ends string"
PART = "hi long, lo long, depth long, n long, least long, parent_least long, children long, leaves long, saved long"


def head_turns(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return crc32(str(conv_id).encode()) % HEADS


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def turns(conversations: DataFrame) -> DataFrame:
    """Rows of base, conv_id, turn, the digest of role and text, and the text's code points."""
    role, text = (F.coalesce(named(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    conv = named("conv_id").cast("long")
    return conversations.where(named("conv_id").isNotNull()).select(
        base_of(conv).alias("base"), conv.alias("conv_id"), named("turn").cast("long").alias("turn"), digest.alias("key"), F.length(text).cast("long").alias("size")
    )


def _digests(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _terms(hi: np.ndarray, lo: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the turns add to the names of the nodes that they and all later turns end."""
    d = depth.astype(np.uint64)
    return mix64(hi ^ mix64(lo + d)), mix64(lo ^ mix64(hi + (d << np.uint64(32))))


def _family(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """The trie of a family, from the turns of its base and those of its other conversations."""
    rows, base = pa.concat_tables([left, right]), key[0].as_py()
    conv = rows.column("conv_id").to_numpy()
    turn, known = rows.column("turn").fill_null(0).to_numpy(), rows.column("turn").is_valid().to_numpy()
    hi, lo = _digests(rows.column("key"))
    order = np.lexsort((lo, hi, turn, known, conv))
    ids, first, counts = np.unique(conv[order], return_index=True, return_counts=True)
    mine = {int(c): order[a : a + n] for c, a, n in zip(ids, first, counts)}
    lead = mine.get(base, order[:0])
    rebuilt = [np.concatenate([lead[: head_turns(c)], own[head_turns(c) :]]) for c, own in mine.items()]
    sizes = np.array([len(x) for x in rebuilt])
    flat = np.concatenate(rebuilt)
    ends = np.cumsum(sizes)
    depth = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) + 1
    names = []
    for term in _terms(hi[flat], lo[flat], depth):
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]
        names.append(total[1:] - np.repeat(total[ends - sizes], sizes))
    # nodes in the order in which conversations, ascending, come to them first; the root is the first
    by_name = np.lexsort((*names[::-1],))
    new = np.r_[True, np.any([x[by_name][1:] != x[by_name][:-1] for x in names], axis=0)] if len(flat) else np.zeros(0, bool)
    firsts = by_name[new]
    rank = np.argsort(np.argsort(firsts)) + 1
    node = np.zeros(len(flat), np.int64)
    node[by_name] = rank[np.cumsum(new) - 1] if len(flat) else 0
    firsts = np.sort(firsts)
    up = np.r_[-1, np.where(depth[firsts] > 1, node[firsts - 1], 0)]
    inner = np.zeros(len(firsts) + 1, bool)
    inner[up[1:]] = True
    ended = defaultdict(list)
    for c, n, e in zip(mine, sizes.tolist(), ends.tolist()):
        ended[int(node[e - 1]) if n else 0].append(str(c))
    whole = len(firsts) + 1
    return pa.table(
        {
            "base": np.full(whole, base),
            "place": np.arange(whole, dtype=np.int32),
            "up": up.astype(np.int32),
            "depth": np.r_[0, depth[firsts]],
            **{c: np.r_[np.zeros(1, np.uint64), x[firsts]].view(np.int64) for c, x in zip(("hi", "lo"), names)},
            "size": np.r_[0, rows.column("size").to_numpy()[flat[firsts]]],
            "n": np.r_[len(mine), np.bincount(node, minlength=whole)[1:]],
            "least": np.r_[ids[0], np.repeat(ids, sizes)[firsts]],
            "inner": inner,
            "ends": pa.array([",".join(ended[k]) if k in ended else None for k in range(whole)], pa.string()),
        }
    )


def family_tries(rows: DataFrame) -> DataFrame:
    """The nodes of every family, base conversations cogrouped with the others."""
    leads, others = (rows.where(which).toDF(*rows.columns) for which in ("conv_id = base", "conv_id <> base"))
    return leads.groupBy("base").cogroup(others.groupBy("base")).applyInArrow(_family, NODE)


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes of one name over all families: members, the smallest of them, the weight and whether it is a leaf."""
    whole = nodes.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("size").alias("size"), (~F.bool_or("inner")).alias("leaf"))
    return whole.select("hi", "lo", "n", "least", ((F.col("n") - 1) * F.col("size")).alias("weight"), "leaf")


def _below(family: pa.Table) -> pa.Table:
    """A family's part of each of its nodes' sums: over the nodes below that the family was given."""
    family = family.take(np.argsort(family.column("place").to_numpy()))
    up, least, given = (family.column(c).to_numpy() for c in ("up", "least", "given"))
    saved = np.where(given, family.column("weight").to_numpy(), 0)
    leaves = (given & family.column("leaf").to_numpy()).astype(np.int64)
    children = np.zeros(len(up), np.int64)
    np.add.at(children, up[1:][given[1:]], 1)
    # paths of nodes that follow each other; a path hangs on a node of an earlier one, so the last is summed first
    tops = np.r_[0, np.flatnonzero(up[1:] != np.arange(len(up) - 1)) + 1]
    for a, b in reversed(list(zip(tops.tolist(), [*tops[1:].tolist(), len(up)]))):
        for x in (saved, leaves):
            x[a:b] = np.cumsum(x[a:b][::-1])[::-1]
            if a:
                x[up[a]] += x[a]
    above = pa.array(least[np.maximum(up, 0)], mask=up < 0)
    kept = {c: family.column(c) for c in ("hi", "lo", "depth")}
    return pa.table({**kept, "n": family.column("total"), "least": least, "parent_least": above, "children": children, "leaves": leaves, "saved": saved})


def subtree_parts(nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """Each family's part of its nodes' sums."""
    known = nodes.select("base", "place", "up", "depth", "hi", "lo").join(whole.withColumnRenamed("n", "total"), ["hi", "lo"])
    given = known.withColumn("given", base_of(F.col("least")) == F.col("base"))
    return given.groupBy("base").applyInArrow(_below, PART)


# ---- families that are too large for a task ----


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Rows with running sums in a total order within keys, over ranges that are summed each on its own; sums: column -> new name."""
    ranged = cut(df.repartitionByRange(*map(F.col, keys), *order).select("*", F.spark_partition_id().alias("__range")))
    parts = ranged.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__{n}") for c, n in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    # only keys that go over the edge of a range have any: a row a range at most
    before = parts.select(*keys, "__range", *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums.values()]).where(f"__{next(iter(sums.values()))} IS NOT NULL")
    within = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(c).over(within).alias(n) for c, n in sums.items()]).join(F.broadcast(before), [*keys, "__range"], "left")
    return summed.select(*df.columns, *[(F.col(n) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in sums.values()])


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        halves = []
        for x in _terms(*_digests(batch.column("key")), batch.column("depth").to_numpy()):
            halves += [x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)]
        names = ["base", "conv_id", "depth", "size"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x.astype(np.int64)) for x in halves)], [*names, "h1", "h0", "l1", "l0"])


def _word(high: Column, low: Column) -> Column:
    """The low 64 bits of high * 2^32 + low."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.shiftleft((high + F.shiftright(low, 32)).bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def large_paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns of whole families as (base, conv_id, depth, size, hi, lo, up_hi, up_lo), with a root each, and the conversations' lengths."""
    placed = written(numbered(rows, ["turn", "key"], ("base", "conv_id")))
    own = placed.groupBy("base", "conv_id").agg(F.count("*").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    leads = own.where("conv_id = base").select("base", F.col("own").alias("lead"))
    convs = written(own.join(leads, "base", "left").select("base", "conv_id", "h", "own", F.least("h", F.coalesce("lead", F.lit(0))).alias("head")))
    lengths = convs.select("base", "conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    heads = convs.join(placed.where(f"conv_id = base AND place < {HEADS}").select("base", F.col("place").alias("depth"), "key", "size"), "base").where("depth <= head")
    tails = placed.join(convs.drop("base"), "conv_id").where("place > h").select("base", "conv_id", (F.col("head") + F.col("place") - F.col("h")).alias("depth"), "key", "size")
    rebuilt = heads.select("base", "conv_id", "depth", "key", "size").unionByName(tails)
    terms = rebuilt.mapInArrow(_with_terms, "base long, conv_id long, depth long, size long, h1 long, h0 long, l1 long, l0 long")
    parts = ("h1", "h0", "l1", "l0")
    summed = running(terms, ["conv_id"], [F.col("depth")], {c: f"sum_{c}" for c in parts})
    s, p = {c: F.col(f"sum_{c}") for c in parts}, {c: F.col(f"sum_{c}") - F.col(c) for c in parts}
    paths = summed.select(
        "base", "conv_id", "depth", "size", _word(s["h1"], s["h0"]).alias("hi"), _word(s["l1"], s["l0"]).alias("lo"), _word(p["h1"], p["h0"]).alias("up_hi"), _word(p["l1"], p["l0"]).alias("up_lo")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("base", "conv_id", zero.alias("depth"), zero.alias("size"), zero.alias("hi"), zero.alias("lo"), none.alias("up_hi"), none.alias("up_lo"))
    return written(paths.unionByName(roots)), lengths


def large_nodes(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of such families, as `family_tries` has them but for their places in a task."""
    ended = F.col("depth") == F.col("length")
    nodes = paths.join(lengths.drop("base"), "conv_id").groupBy("base", "hi", "lo").agg(
        F.max("depth").alias("depth"), F.max("size").alias("size"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.bool_or(F.col("depth") < F.col("length")).alias("inner"),
        F.array_sort(F.collect_list(F.when(ended, F.col("conv_id")))).alias("ended"),
    )
    none = F.lit(None).cast("int")
    ends = F.when(F.size("ended") > 0, F.array_join(F.col("ended").cast("array<string>"), ","))
    return nodes.select("base", none.alias("place"), none.alias("up"), "depth", "hi", "lo", "size", "n", "least", "inner", ends.alias("ends"))


def large_parts(paths: DataFrame, whole: DataFrame) -> DataFrame:
    """Such families' parts: the nodes that a conversation is the smallest member of end its path, so running sums from its end give them."""
    known = paths.join(whole.withColumnRenamed("n", "total"), ["hi", "lo"])
    given = F.col("least") == F.col("conv_id")
    x = known.select("*", F.when(given, F.col("weight")).otherwise(0).alias("x"), F.when(given & F.col("leaf"), 1).otherwise(0).cast("long").alias("l"))
    summed = running(x.drop("base", "size", "weight", "leaf"), ["conv_id"], [F.desc("depth")], {"x": "saved", "l": "leaves"})
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    sums = summed.select("hi", "lo", "depth", F.col("total").alias("n"), "least", none.alias("parent_least"), zero.alias("children"), "leaves", "saved")
    above = whole.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("least").alias("parent_least"))
    steps = x.where("least = conv_id AND depth > 0").join(above, ["up_hi", "up_lo"])
    to_children = steps.select("hi", "lo", "depth", F.col("total").alias("n"), "least", "parent_least", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
    to_parents = steps.select(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), none.alias("depth"), none.alias("n"), none.alias("least"), none.alias("parent_least"), F.lit(1).cast("long").alias("children"), zero.alias("leaves"), zero.alias("saved"))
    return sums.unionByName(to_children).unionByName(to_parents)


# ---- the whole ----


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node over its blocks in order; a node's rows follow each other."""
    now, state = None, None

    def out(name, digest):
        return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([digest.hexdigest()])], ["hi", "lo", "ends_sha256"])

    for batch in batches:
        for hi, lo, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (hi, lo) != now:
                if now is not None:
                    yield out(now, state)
                now, state = (hi, lo), hashlib.sha256()
            else:
                state.update(b",")
            state.update(block.encode())
    if now is not None:
        yield out(now, state)


def end_digests(nodes: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ids of conversations that end there. A family's ids are joined already and lie between those of its
    neighbours; blocks of families are joined next, and a digest, which is made in order, goes through few rows a node."""
    ends = nodes.where("ends IS NOT NULL").select("hi", "lo", "base", "ends")
    width = FAMILY * BLOCK
    blocks = ends.groupBy("hi", "lo", (F.col("base") - F.pmod("base", F.lit(width))).alias("block")).agg(F.array_sort(F.collect_list(F.struct("base", "ends"))).alias("parts"))
    joined = blocks.select("hi", "lo", "block", F.array_join(F.col("parts.ends"), ",").alias("ends"))
    ordered = joined.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "block")
    return ordered.select("hi", "lo", "ends").mapInArrow(_hashed, "hi long, lo long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = turns(conversations)
    # at most a row for every FAMILY_ROWS turns
    large = cut(rows.groupBy("base").count().where(F.col("count") > FAMILY_ROWS).select("base"))
    if large.isEmpty():
        nodes, all_nodes, paths = written(family_tries(rows)), None, None
    else:
        nodes = written(family_tries(rows.join(F.broadcast(large), "base", "left_anti")))
        paths, lengths = large_paths(rows.join(F.broadcast(large), "base", "left_semi"))
        all_nodes = nodes.unionByName(written(large_nodes(paths, lengths)))
    all_nodes = nodes if all_nodes is None else all_nodes
    whole = merged(all_nodes)
    parts = subtree_parts(nodes, whole)
    if paths is not None:
        whole = written(whole)
        parts = subtree_parts(nodes, whole).unionByName(large_parts(paths, whole))
    made = parts.groupBy("hi", "lo").agg(*[F.max(c).alias(c) for c in ("depth", "n", "least", "parent_least")], *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    return made.join(end_digests(all_nodes), ["hi", "lo"], "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
