"""Numbers over ranges against one window."""

import random

from cladeflow.operators.numbering import numbered


def test_numbers(spark):
    pick = random.Random(3)
    rows = [(pick.choice(["a", "a", "a", "b", None]), pick.randrange(10**6), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "gene string, at long, n long").repartition(7)
    got = sorted((r.gene or "", r.at, r.n, r.seq) for r in numbered(df, ["at", "n"], ("gene",), "seq", 0).collect())
    want, seen = [], {}
    for g, at, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want.append((g or "", at, n, seen.setdefault(g, 0)))
        seen[g] += 1
    assert got == want
    whole = sorted((r.at, r.n, r.place) for r in numbered(df, ["at", "n"]).collect())
    assert [p for _, _, p in whole] == list(range(1, 2001))
    assert numbered(df.limit(0), ["at"]).count() == 0
