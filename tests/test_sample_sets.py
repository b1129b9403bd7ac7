"""Sets of samples that merge, against sets in Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import sample_sets, strata


def pairs(seed, n=3000):
    pick = random.Random(seed)
    return [(pick.choice(["g", "h"]), f"r{min(pick.randrange(40), pick.randrange(40))}", f"s{pick.randrange(200):03d}") for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "gene string, rep string, sample string")


def test_overlapping_parts_merge_to_the_whole(spark):
    rows = pairs(1)
    parts = [rows[:1500], rows[1000:2500], rows[2000:]]
    numbers = sample_sets.number_samples(frame(spark, rows))
    sets = [sample_sets.sample_sets(frame(spark, p), numbers) for p in parts]
    want = defaultdict(set)
    for g, r, s in rows:
        want[g, r].add(s)
    got = {(r.gene, r.rep): r.n_samples for r in sample_sets.sizes(sample_sets.merge_sets(*sets)).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    # adding counts of parts that share samples does not give it
    added = strata.merge(*[sample_sets.prevalence(x) for x in sets])
    merged = sample_sets.prevalence(sample_sets.merge_sets(*sets))
    assert Counter(map(tuple, merged.collect())) == Counter((g, n, c) for (g, n), c in Counter((g, len(v)) for (g, _), v in want.items()).items())
    assert Counter(map(tuple, added.collect())) != Counter(map(tuple, merged.collect()))
    assert Counter(map(tuple, sample_sets.merge_sets(sets[0], sets[0]).collect())) == Counter(map(tuple, sets[0].collect()))


def test_parts_that_share_representatives_are_told(spark):
    a, b, c = (spark.createDataFrame(x, "gene string, rep string") for x in ([("g", "1"), ("g", "1")], [("g", "2"), ("h", "1")], [("h", "1")]))
    strata.check_disjoint(a, b)
    strata.check_disjoint(a, a.limit(0))
    with pytest.raises(ValueError, match="h.*1"):
        strata.check_disjoint(a, b, c)


def test_numbers_stay(spark):
    first = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "sample string")
    known = sample_sets.number_samples(first)
    assert {r.sample: r.number for r in known.collect()} == {"a": 0, "b": 1}
    more = sample_sets.number_samples(spark.createDataFrame([("0",), ("a",), ("c",)], "sample string"), known)
    assert {r.sample: r.number for r in more.collect()} == {"a": 0, "b": 1, "0": 2, "c": 3}
    with pytest.raises(Exception, match="without a number"):
        sample_sets.sample_sets(frame(spark, [("g", "r", "zz")]), known).collect()
    assert sample_sets.sample_sets(frame(spark, [("g", "r", None)]), known).count() == 0
    assert sample_sets.number_samples(first.limit(0)).count() == 0


def test_unions_of_clusters(spark):
    rows = pairs(2, 600)
    sets = sample_sets.sample_sets(frame(spark, rows), sample_sets.number_samples(frame(spark, rows)))
    to = {f"r{i}": f"r{i // 4 * 4}" for i in range(36)}
    clusters = spark.createDataFrame([(g, m, r) for m, r in to.items() for g in "gh"] * 2, "gene string, member string, rep string")
    want = defaultdict(set)
    for g, r, s in rows:
        want[g, to.get(r, r)].add(s)
    got = {(r.gene, r.rep): r.n_samples for r in sample_sets.sizes(sample_sets.united(sets, clusters)).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_strata_of_sets(spark):
    """Histograms of strata from the sets are those of the tags, over samples of 64 and of more."""
    pick = random.Random(3)
    rows = pairs(4)
    meta = [(f"s{i:03d}", pick.choice(["2001", "2005", "2010", "x", None]), pick.choice([strata.HUMAN, "soil", None])) for i in range(190)]
    hits = frame(spark, rows)
    m = spark.createDataFrame(meta, "acc string, year string, organism string")
    known = {a: (int(y) if y and y.isdigit() else None, o == strata.HUMAN) for a, y, o in meta}
    want = Counter()
    per = defaultdict(set)
    for g, r, s in rows:
        per[g, r].add(s)
    for (g, _), samples in per.items():
        for stratum, value, has in [("human_all", "all", lambda y, h: h), *[(n, str(c), (lambda y, h, c=c, n=n: y is not None and y <= c and (h or n == "year"))) for c in (2001, 2005, 2010) for n in ("year", "human_per_year")]]:
            n = sum(has(*known[s]) for s in samples if s in known)
            if n:
                want[g, stratum, value, n] += 1
    numbers = sample_sets.number_samples(hits)
    sets = sample_sets.sample_sets(hits, numbers)
    got = sample_sets.histogram(sets, sample_sets.strata_sets(m, numbers)).collect()
    assert {(r.gene, r.stratum, r.stratum_value, r.sample_count): r.species_count for r in got} == dict(want)
    assert sample_sets.histogram(sets.limit(0), sample_sets.strata_sets(m.limit(0), numbers)).count() == 0
    assert sample_sets.sizes(sets).agg(F.sum("n_samples")).first()[0] == sum(map(len, per.values()))
