"""The filter audit against running every order, with nulls, repeats, ties of ids, labels that clash and copies by the thousand."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from cladeflow.llm import filter_audit

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every order run over every document."""
    fails, least = [], {}
    for i, t, _, _, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t) is not None, i is not None and i > least[t]]
        mine = [x for x in labels if x[0] == i and i is not None]
        fails.append((source or "", {f for f, b in zip("ABCDE", bad) if b}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {x[0] for x in fails}:
            here = [x for x in fails if x[0] == part]
            alive = here
            for step, f in enumerate(order, 1):
                gone, alive = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(alive), len(gone), sum(f in x[1] for x in here) - len(gone), sum(x[1] == {f} for x in here), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def made(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def random_rows(n, seed):
    pick = random.Random(seed)
    texts = []
    for _ in range(n // 3):
        size = pick.choice([0, 3, 49, 50, 51, 80])
        words = [pick.choice(["alpha", "Beta", "ΓAMMA", "x#y", "UPPER", "d|e", "w"]) + str(pick.randrange(40) if pick.random() < 0.9 else "") for _ in range(size)]
        texts.append(pick.choice([" ", "\n", "\x0b "]).join(words))
    texts += [None, "", "a b " * 60, "é" * 40]
    ids = [*range(n // 2), None]
    return [(pick.choice(ids), pick.choice(texts), None, pick.choice(["s1", "s2", "", None, "Ŝ"]), None) for _ in range(n)]


def test_against_every_order(spark):
    rows = random_rows(240, 7)
    pick = random.Random(8)
    labels = [(pick.choice([*range(120), None]), pick.choice([0, 1, None]), pick.choice([0, 1, None])) for _ in range(150)]
    docs, marks = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, LABELS)
    want = brute(rows, labels)
    assert made(filter_audit.audit(docs, marks)) == want
    more = docs.repartition(5).select("*", *[F.lit(1).alias(c) for c in ("part", "bits", "name", "good", "toxic", "n", "step", "joint")])
    assert made(filter_audit.audit(more, marks.select("*", F.lit("x").alias("good"), F.lit("x").alias("n")))) == want
    assert made(filter_audit.audit(docs, marks.limit(0))) == brute(rows, [])
    assert filter_audit.audit(docs.limit(0), marks).count() == 0


def test_shared_fixture(spark, docs, rows, crowded):
    marks = spark.createDataFrame([(0, 1, 0), (5, 1, 1), (1, 0, 1), (99, 1, 1)], LABELS)
    want = brute(rows, [(0, 1, 0), (5, 1, 1), (1, 0, 1)])
    assert made(filter_audit.audit(docs, marks)) == want == made(filter_audit.audit(crowded, marks))


def test_copies_meet_their_least_id_as_few_rows(spark):
    """A text of thousands of copies: one of each stays, whatever part it is in, and copies are counted before they are shuffled by text."""
    rows = [(i, "the same text", None, f"s{i % 2}", None) for i in range(5000, 0, -1)] + [(1, "the same text", None, "s1", None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    counted = filter_audit.patterns(docs, marks)
    got = defaultdict(int)
    for r in counted.collect():
        got[r.part, r.bits >> 4, r.good] += r.n
    assert got == {("s1", 0, 1): 2, ("s1", 1, 0): 2499, ("s0", 1, 1): 1, ("s0", 1, 0): 2499}
