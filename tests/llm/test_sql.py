"""The operators' queries on the driver's smallest tables, against their SQL or the library."""

import hashlib
import os

import duckdb
import pytest

from cladeflow.llm import sentence_pieces
from cladeflow.llm.queries import QUERIES, SQL
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_pieces_of_all_documents(spark, tables):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentence_pieces.model_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, t in tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = library.encode(t, add_eos=True)
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in QUERIES["op13_sentence_pieces"](spark, SF).collect()} == want
