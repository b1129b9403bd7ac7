"""The trie against one that is built whole in Python, through families and through ranges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeflow.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


def made(df):
    assert df.columns == list(NAMES)
    return Counter(map(tuple, df.collect()))


def conversations(seed, n=120):
    """Families with and without a base, shared beginnings, nulls, equal turns, repeated rows, ids below 0 and conversations of one turn."""
    pick = random.Random(seed)
    ids = [pick.randrange(-250, 700) for _ in range(n)] + [0, 100, 300, -100, 10**15, 10**15 + 7]
    rows = []
    for c in set(ids):
        shared = pick.random() < 0.6
        for turn in range(pick.choice([1, 1, 2, 3, 6, 9])):
            text = f"t{turn if shared else pick.randrange(3)}" + "é" * pick.randrange(1 if shared else 3)
            rows.append((c, pick.choice([turn, turn, turn, turn, None, 1]), pick.choice(["user", "user", None]), pick.choice([text, text, text, None])))
    rows += [(None, 1, "user", "x"), (None, None, None, None)] + pick.sample(rows, 10)
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_a_whole_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert made(prefix_trie.trie(df)) == brute(rows)


def test_large_families_go_over_ranges(spark, monkeypatch):
    """All families, or only some, through ranges; the rows are the same. One conversation holds a third of all rows."""
    rows = conversations(9) + [(205, i, "user", f"long {i % 50}") for i in range(300)] + [(i, None, "user", "alone") for i in range(1000, 1100)]
    df, want = spark.createDataFrame(rows, COLUMNS).repartition(5), brute(rows)
    for most in (0, 40, 10**6):
        monkeypatch.setattr(prefix_trie, "FAMILY_ROWS", most)
        assert made(prefix_trie.trie(df)) == want, most


def test_rows_and_columns(spark):
    rows = conversations(4, 30)
    df = spark.createDataFrame(rows, COLUMNS)
    want = brute(rows)
    more = df.select("*", *[F.lit("x").alias(c) for c in ("base", "key", "size", "depth", "hi", "lo", "n", "least", "place", "a.b")])
    assert made(prefix_trie.trie(more)) == want
    assert prefix_trie.trie(df.limit(0)).count() == 0
    turnless = [(c, 0, "user", "only") for c in range(101, 140)]  # no base, and more heads than turns
    assert made(prefix_trie.trie(spark.createDataFrame(turnless, COLUMNS))) == brute(turnless)


def test_deep_and_wide(spark, monkeypatch):
    """A path of thousands of turns that families share, and a node with thousands of children and ends over many blocks of families."""
    deep = [(c, i, "user", f"turn {i}") for c in (0, 100, 150) for i in range(3000)] + [(150, 3000, "user", "last")]
    wide = [(c, 0, "user", "same" if c % 3 else f"other {c}") for c in range(600, 4000)]
    wide = [x for x in wide if x[0] % 100]
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    got = made(prefix_trie.trie(spark.createDataFrame(deep + wide, COLUMNS).repartition(6)))
    short = [r for r in deep if r[1] < 400 or r[1] >= 3000]  # a whole trie in Python is quadratic in depth
    assert sum(got.values()) == len(got)
    top = {(r[0], r[1]): r for r in got}
    assert top[(0, 2000)][3] == 3 and top[(150, 3001)][5] == 1
    assert top[(0, 2000)][6] == sum(2 * len(f"turn {i}") for i in range(1999, 3000))
    monkeypatch.setattr(prefix_trie, "FAMILY_ROWS", 5000)
    assert made(prefix_trie.trie(spark.createDataFrame(short + wide, COLUMNS))) == brute(short + wide)
