"""Distances of many markers and of windows over 60 bases."""

from cladeflow.operators import distances


def test_all_markers_and_whole_windows(spark):
    ends = ("A" * 30, "C" * 3 + "A" * 27, "C" * 7 + "A" * 23)
    rows = [(f"S3.{m}.x", f"s{i}", "ACGTA" * 12 + e) for m in range(14) for i, e in enumerate(ends)]
    unique = spark.createDataFrame(rows, "marker string, species string, sequence string")
    got = {(r.marker, r.metric, r.distance): r["count"] for r in distances.inter(unique, 3).collect()}
    every, near = {3: 2, 7: 2, 4: 2}, {3: 2, 4: 1}
    assert got == {(f"S3.{m}.x", f"inter_sampled_{n}", d): k for m in range(14) for n, h in (("all", every), ("nearest", near)) for d, k in h.items()}
    one = spark.createDataFrame([("S3.1.x", "s", r[2]) for r in rows[:3]], unique.schema)
    assert {(r.metric, r.distance): r["count"] for r in distances.intra(one).collect()} == {("intra_pair", 3): 1, ("intra_pair", 7): 1, ("intra_pair", 4): 1, ("intra_diameter", 7): 1}
