"""Clustering against the rule in plain Python."""

import os
import random

import pytest

import __spark_entry__ as entry
from cladeflow.operators import cluster_store, clustering, refmatch
from cladeflow.plans import domain


def windows(n, seed=1):
    pick = random.Random(seed)
    bases = ["".join(pick.choice("ACGT") for _ in range(60)) for _ in range(8)]
    out = {}
    while len(out) < n:
        w = list(pick.choice(bases))
        for _ in range(pick.randrange(5)):
            w[pick.randrange(60)] = pick.choice("ACGTN")
        out["".join(w)] = None
    return list(out)


def frame(spark, ws):
    return spark.createDataFrame([("m", i, w) for i, w in enumerate(ws)], "gene string, seq_num long, sequence string")


def test_greedy_clusters(spark):
    ws = windows(150)
    got = {r.member: r.rep for r in clustering.cluster(frame(spark, ws)).collect()}
    assert got == {w: ws[c] for w, c in zip(ws, clustering.greedy(ws))}
    assert all(got[r] == r for r in got.values())


def test_near_pairs(spark):
    ws = windows(80, 2)
    rows = frame(spark, ws).withColumnRenamed("seq_num", "id")
    got = {(r.a, r.b): r.divergence for r in clustering.near_pairs(rows, rows).where("a < b").collect()}
    d = lambda x, y: sum(p != q for p, q in zip(x, y))
    assert got == {(i, j): d(ws[i], ws[j]) for i in range(80) for j in range(i + 1, 80) if d(ws[i], ws[j]) <= 2}


def test_chains_and_chunks(spark, tmp_path):
    rounds = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("d", "c")], "member string, rep string")
    assert {r.member: r.rep for r in clustering.resolve_chains(rounds).collect()} == dict.fromkeys("abcd", "c")
    ws = windows(40, 3)
    whole = {r.member: r.rep for r in clustering.cluster(frame(spark, ws)).collect()}
    parts = {r.member: r.rep for r in cluster_store.cluster_chunked(frame(spark, ws), 15, str(tmp_path / "c")).collect()}
    assert parts == whole
    assert clustering.cluster(frame(spark, ws).limit(0)).count() == 0
    growing = {r.member: r.rep for r in clustering.cluster(frame(spark, ws), first=4, growth=2).collect()}
    assert growing == whole


def test_a_batch_meets_its_first_centroids_before_itself(spark, tmp_path, monkeypatch):
    """A large batch of a new store: only its first windows and what their centroids don't reach are compared with each other."""
    monkeypatch.setattr(clustering, "FIRST", 8)
    ws = list(dict.fromkeys(["ACGT" * 15] + ["ACGT" * 7 + x + y + "ACGT" * 7 + "AC" for x in "ACGT" for y in "ACGT"] + windows(40, 6)))
    compared, aggregated, real = [], [], clustering._chosen
    monkeypatch.setattr(clustering, "_chosen", lambda rows, *rest: compared.append(rows.count()) or real(rows, *rest))
    keep = clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df: aggregated.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    for k, n in ((0, 50), (50, len(ws))):
        cluster_store.add(frame(spark, ws[k:n]), str(tmp_path / "s"))
    got = {r.member: r.rep for r in cluster_store.members(spark, str(tmp_path / "s")).collect()}
    assert got == {w: ws[c] for w, c in zip(ws, clustering.greedy(ws))}
    assert len(compared) == 4 and compared[0] == 8 and compared[1] < 24
    assert not any("SortAggregate" in plan for plan in aggregated)


def test_a_ring_ends(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "member string, rep string")
    with pytest.raises(ValueError, match="ring"):
        clustering.resolve_chains(ring)


@pytest.mark.parametrize("d,window", [(0, 60), (1, 45), (3, 60), (2, 90)])
def test_near_pairs_of_other_lengths(spark, d, window):
    pick = random.Random(d)
    ws = sorted({"".join(c if pick.random() > 0.03 else pick.choice("ACGTN") for c in ("ACGTTGCA" * 12)[:window]) for _ in range(60)})
    rows = frame(spark, ws).withColumnRenamed("seq_num", "id")
    got = sorted((r.a, r.b, r.divergence) for r in clustering.near_pairs(rows, rows, d, window).where("a < b").collect())
    far = lambda x, y: sum(p != q for p, q in zip(x, y))
    assert got == [(i, j, far(ws[i], ws[j])) for i in range(len(ws)) for j in range(i + 1, len(ws)) if far(ws[i], ws[j]) <= d]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_chunked_query_is_whole(spark, tmp_path, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").where("l_orderkey % 5 = 0").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(domain, "CHUNK", 700)
    whole, parts = (sorted(map(tuple, entry.queries()[n](spark, str(tmp_path)).collect())) for n in ("CLU-01_greedy_clusters", "CLU-03_chunked_clusters"))
    assert len(whole) > 2 * 600
    assert parts == whole


def files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.read_bytes()) for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_batches_onto_stored_clusters(spark, tmp_path):
    """Five batches, the last two in a later run, give the clusters of one run over all windows; what is stored is not written again."""
    ws, store = windows(120, 5), tmp_path / "store"
    cuts = [0, 30, 31, 70, 100, 120]
    whole = {r.member: (r.rep, r.divergence) for r in clustering.cluster(frame(spark, ws)).collect()}
    for n, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        before = files(store) if n > 1 else {}
        assert cluster_store.add(frame(spark, ws[a:b]), str(store)) == n  # numbers start at 0 in each batch
        after = files(store)
        assert {k: after[k] for k in before} == before
    got = {r.member: (r.rep, r.divergence) for r in cluster_store.members(spark, str(store)).collect()}
    assert got == whole
    ids = [r.id for r in cluster_store.members(spark, str(store)).collect()]
    assert sorted(ids) == list(range(120))
    assert cluster_store.centroids(spark, str(store)).count() == len({r for r, _ in whole.values()})
    # windows that are stored, and none at all, add no batch; other settings are refused
    assert cluster_store.add(frame(spark, ws[:50]), str(store)) == 5
    assert cluster_store.add(frame(spark, []), str(store)) == 5
    with pytest.raises(ValueError, match="divergence"):
        cluster_store.add(frame(spark, ws[:1]), str(store), max_divergence=3)
    # one batch of all files, onto which the next one comes
    assert cluster_store.sweep(spark, str(store), -5) == 0
    cluster_store.compact(spark, str(store))
    assert cluster_store.sweep(spark, str(store)) == 0 and cluster_store.sweep(spark, str(store), -5) == 10
    assert {r.member: (r.rep, r.divergence) for r in cluster_store.members(spark, str(store)).collect()} == whole
    more = windows(140, 5)[120:]
    assert cluster_store.add(frame(spark, more), str(store)) == 2
    longer = {r.member: (r.rep, r.divergence) for r in clustering.cluster(frame(spark, ws + more)).collect()}
    assert {r.member: (r.rep, r.divergence) for r in cluster_store.members(spark, str(store)).collect()} == longer
    asked = spark.createDataFrame([("m", ws[7]), ("m", "A" * 60), ("other", ws[7])], "gene string, sequence string")
    assert {(r.gene, r.sequence): r.rep for r in cluster_store.look_up(asked, str(store)).collect()} == {("m", ws[7]): whole[ws[7]][0], ("m", "A" * 60): None, ("other", ws[7]): None}


def chain(n, seed=6):
    """Windows of which each is two bases from the one before it, and further from all others: every other one is a centroid."""
    pick = random.Random(seed)
    w, out = [pick.choice("ACGT") for _ in range(60)], []
    for i in range(n):
        out.append("".join(w))
        for p in (2 * i % 60, (2 * i + 1) % 60):
            w[p] = pick.choice([c for c in "ACGT" if c != w[p]])
    return out


def test_a_long_chain_takes_no_round(spark, monkeypatch):
    """10,000 windows each near the next: rounds would be thousands, one walk a marker is enough."""
    ws = list(dict.fromkeys(chain(10_000)))
    assert len(ws) == 10_000
    rounds, real = [], clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df: rounds.append(1) or real(df))
    got = {r.member: r.rep for r in clustering.cluster(frame(spark, ws), first=20_000).collect()}
    place = {w: i for i, w in enumerate(ws)}
    far = lambda x, y: sum(p != q for p, q in zip(x, y))
    assert all(far(ws[i], ws[i + 1]) == 2 for i in range(0, 9_999, 97))
    # a chain's neighbours only: its rule is known without comparing all pairs
    alone = [i for i in range(9_999) if got[ws[i]] == ws[i] and got[ws[i + 1]] == ws[i + 1]]
    assert not alone
    assert all(abs(place[got[w]] - i) <= 1 or far(got[w], w) <= 2 for i, w in enumerate(ws))
    assert len(rounds) <= 6
    short = ws[:400]
    assert {r.member: r.rep for r in clustering.cluster(frame(spark, short), first=500).collect()} == {w: short[c] for w, c in zip(short, clustering.greedy(short))}


@pytest.mark.parametrize("most", (0, 60))
def test_rounds_where_pairs_are_many(spark, monkeypatch, most):
    """Rounds until few enough pairs are left for a walk, or none, give the same clusters."""
    monkeypatch.setattr(clustering, "LOCAL_EDGES", most)
    ws = windows(150, 8)
    got = {r.member: r.rep for r in clustering.cluster(frame(spark, ws)).collect()}
    assert got == {w: ws[c] for w, c in zip(ws, clustering.greedy(ws))}


@pytest.mark.parametrize("radii,window", [((2, 4, 8), 60), ((2,), 60), ((4,), 60), ((0, 1, 3), 45), ((5, 9), 90)])
def test_widening_search(spark, radii, window):
    """Each query's nearest reference within the last radius, the least id of equals, against all pairs."""
    pick = random.Random(window + len(radii))
    refs = ["".join(pick.choice("ACGT") for _ in range(window)) for _ in range(40)]
    refs += [r[:5] + "N" + r[6:] for r in refs[:5]] + refs[:3]
    queries = []
    for _ in range(150):
        w = list(pick.choice(refs))
        for p in pick.sample(range(window), pick.randrange(13)):
            w[p] = pick.choice("ACGTN-")
        queries.append("".join(w))
    queries += [queries[0], "A" * window, "ACGT"]
    q = spark.createDataFrame([("m", f"q{i:03d}", w) for i, w in enumerate(queries)], "gene string, id string, sequence string")
    r = spark.createDataFrame([("m", f"r{(i * 7) % 48:03d}", w, f"Root; d__D{i}; p__P{i}") for i, w in enumerate(refs)] + [("other", "r", "A" * window, "d__X")], "gene string, id string, sequence string, taxonomy string")
    ids = {f"r{(i * 7) % 48:03d}": (w, f"Root; d__D{i}; p__P{i}") for i, w in enumerate(refs)}
    want = {}
    for i, w in enumerate(queries):
        w = w.replace("-", "N")
        near = sorted((sum(x != y for x, y in zip(w, s)), k) for k, (s, _) in ids.items()) if len(w) == window else []
        near = [x for x in near if x[0] <= radii[-1]]
        want[f"q{i:03d}"] = (*near[0], ids[near[0][1]][1], "matched") if near else (None, None, None, f"none_within_{radii[-1]}" if len(w) == window else "other_length")
    got = {x.query: (x.divergence, x.ref_id, x.taxonomy, x.status) for x in refmatch.nearest_widening(q, r, radii, window).collect()}
    assert got == want
    assert {x[3] for x in want.values()} == {"matched", f"none_within_{radii[-1]}", "other_length"}
    taxa = {x.id: (x.domain, x.phylum) for x in refmatch.assign_taxonomy(q, r, radii, window).collect()}
    assert taxa == {k: (None, None) if v[2] is None else tuple(v[2].split("; ")[1:]) for k, v in want.items()}
    assert refmatch.nearest_widening(q.limit(0), r, radii, window).count() == 0
    assert {x.status for x in refmatch.nearest_widening(q, r.limit(0), radii, window).collect()} == {f"none_within_{radii[-1]}", "other_length"}


def test_letters_that_are_no_bases(spark):
    """Codes of several bases, lower case and gaps are all one unknown base, in pairs, in wide searches and in clusters."""
    pick = random.Random(11)
    base = "".join(pick.choice("ACGT") for _ in range(60))
    ws = list(dict.fromkeys("".join(c if pick.random() > 0.05 else pick.choice("ACGTNRYacgt-*") for c in base) for _ in range(80)))
    plain = ["".join(c if c in "ACGT" else "N" for c in w) for w in ws]
    far = lambda x, y: sum(p != q for p, q in zip(x, y))
    rows = frame(spark, ws).withColumnRenamed("seq_num", "id")
    for find, most in ((clustering.near_pairs, 2), (refmatch.far_pairs, 2), (refmatch.far_pairs, 5)):
        got = {(r.a, r.b): r.divergence for r in find(rows, rows, most).where("a < b").collect()}
        assert got == {(i, j): far(plain[i], plain[j]) for i in range(len(ws)) for j in range(i + 1, len(ws)) if far(plain[i], plain[j]) <= most}, (find, most)
    centres = clustering.greedy(plain)
    assert {r.member: r.rep for r in clustering.cluster(frame(spark, ws)).collect()} == {w: ws[c].replace("-", "N") for w, c in zip(ws, centres)}


def test_radii_must_grow(spark):
    q = frame(spark, ["A" * 60]).withColumnRenamed("seq_num", "id")
    for radii in ((), (4, 2), (2, 2), (-1,)):
        with pytest.raises(ValueError):
            refmatch.nearest_widening(q, q, radii)


def test_searches_send_no_windows_through_the_driver(spark):
    rows = spark.createDataFrame([("m", w, w, "Root; d__D; p__P; s__S") for w in windows(60)], "gene string, id string, sequence string, taxonomy string")
    found = (clustering.near_pairs(rows, rows), refmatch.far_pairs(rows, rows, 8), refmatch.nearest(rows, rows), refmatch.nearest_widening(rows, rows))
    for df in found:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
