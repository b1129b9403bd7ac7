"""The pipeline over empty tables, over documents that all go, and over nulls and repeated rows."""

import pytest

import corpus_pipeline
from tests.llm.conftest import COLUMNS, words

FULL = ("doc_id", "text", "lang", "source", "n_chars")


def write(spark, folder, documents, items):
    spark.createDataFrame(documents, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("case", ("no documents", "no benchmark", "all too short", "all in the benchmark"))
def test_edges(spark, tmp_path, case):
    good = [(i, " ".join(words(120, 50 + i)), "en", "s", 1) for i in range(6)]  # one source, whose target is all of it
    documents = {"no documents": [], "all too short": [(1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0)]}.get(case, good)
    items = {"no benchmark": [], "all in the benchmark": [(d[0], d[1]) for d in good]}.get(case, [(1, "one two three four five six seven eight nine ten eleven")])
    write(spark, str(tmp_path), documents, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(FULL) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == (6 if case == "no benchmark" else 0)
    if rows:
        assert {r.text for r in rows} == {d[1] for d in good}


def test_nulls_and_repeated_rows(spark, tmp_path):
    """A text that is in several rows, some with null ids and sources, stays once; other rows keep what they had."""
    text = " ".join(words(120, 70))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text, None, None, None), (None, " ".join(words(120, 71)), None, None, None), (5, None, "en", "s", None)]
    write(spark, str(tmp_path), rows, [])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == sorted([text, rows[3][1]])
    other = next(r for r in got if r.text == rows[3][1])
    assert (other.doc_id, other.lang, other.source, other.n_chars) == (None, None, None, None)
