"""The pipeline's stages on a small table, one after the other."""

import corpus_pipeline
from cladeflow.llm import quality_rules


def test_stages(spark, docs, rows, tmp_path):
    base = rows[0][1].split()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(base[30:60]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen.append(now.count())
        if name != "mix_sources":
            assert now.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and seen == sorted(seen, reverse=True)
    out = corpus_pipeline.run(spark, str(tmp_path))
    texts = [r.text for r in out.collect()]
    assert texts and len(texts) == len(set(texts))
    assert not any("24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in t or " ".join(base[30:60]) in t for t in texts)
    assert all(quality_rules.measure(t)[0] >= 50 for t in texts)
