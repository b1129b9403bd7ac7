"""Benchmark windows in texts of repeated words, words before tokens past any white space, and charsets that are declared late."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from cladeflow.llm import decontamination, pii, warc
from tests.llm.test_operators import contaminated, multiset


@pytest.mark.parametrize("seed", range(3))
def test_windows_of_few_words(spark, seed):
    """Two and three words in all: windows occur in many places of items and documents, and items of every short length."""
    pick = random.Random(seed)
    letters = "ab" if seed else "abc"
    items = [(i, " ".join(pick.choices(letters, k=pick.choice([1, 4, 9, 10, 11, 30])))) for i in range(12)] + [(3, "a " * 50), (None, "b " * 9)]
    texts = [" ".join(pick.choices(letters + "zA", [8] * len(letters) + [1, 1], k=pick.randrange(120))) for _ in range(60)] + ["a " * 300, None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (10**6, 15):
        got = decontamination.digest(decontamination.find(docs, bench, block_words=block)).drop("doc_id")
        assert multiset(got) == Counter(contaminated(texts, items)), block


def test_one_word_over_and_over(spark):
    """20,000 equal words against an item of 1,000 of them, and a hundred items of the same words, in seconds."""
    items = [(i, "same " * 1000) for i in range(100)] + [(200, "other words " * 30)]
    texts = ["same " * 20_000, "Same, " * 10, "same " * 9, "x " + "same " * 3000 + "other words " * 700]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decontamination.find(docs.limit(1), bench.limit(1)).count()
    began = time.perf_counter()
    got = {r.doc_id: r for r in decontamination.find(docs, bench).collect()}
    assert time.perf_counter() - began < 20
    assert [got[i].n_hit for i in range(4)] == [20_000, 10, 0, 4400]
    assert [len(got[i]["items"]) for i in range(4)] == [100, 100, 0, 101]

def test_words_of_any_length_and_a_full_filter(spark):
    """A word has one hash wherever it stands, beyond the length of a piece too; a filter that lets all through changes no row."""
    long = b"x" * (decontamination.PIECE + 5)
    texts = [b"one Two " + long + b" three", b"", b"TWO", long + b"," + long[:-1], " É é1".encode()]
    words = decontamination.Words(texts)
    h = dict(zip(range(8), words.hashes().tolist()))
    assert words.counts.tolist() == [4, 0, 1, 2, 2] and words.room.tolist() == [4, 3, 2, 1, 1, 2, 1, 2, 1]
    assert h[1] == h[4] and h[2] == h[5] and len({h[0], h[1], h[2], h[3], h[6], h[7]}) == 6
    assert words.window(0, 2) == b"one two" and words.window(7, 2) == "É é1".encode()
    pick = random.Random(5)
    texts = [" ".join(pick.choices("ab" + "cdefghij" * (i % 3), k=80)) + " " + "y" * 300_000 + " z" * 9 for i in range(12)]
    items = [(1, texts[3][:60]), (2, texts[4][100:]), (3, "b a"), (4, texts[0][20:50])]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (10**6, 1):
        got = decontamination.digest(decontamination.find(docs, bench, block_words=block)).drop("doc_id")
        assert multiset(got) == Counter(contaminated(texts, items)), block
        kept = decontamination.filter_documents(docs, bench, block_words=block)
        assert kept.count() == sum(not r[4] for r in contaminated(texts, items)), block


def test_the_filter_has_every_key(spark):
    """Each key of the benchmark passes, whatever the size of the filter, and few others do if it is made for them."""
    pick = random.Random(6)
    items = [(i, " ".join(f"w{pick.randrange(500)}" for _ in range(40))) for i in range(50)]
    index = decontamination.index_of(spark.createDataFrame(items, "item_id long, text string"))
    keys = np.array([r.key for r in index.select("key").collect()], np.int64).view(np.uint64)
    others = np.array([pick.getrandbits(64) for _ in range(20_000)], np.uint64)
    for block in (1, 100, 1 << 24):
        bits = decontamination.filter_bits(index, block)
        made = decontamination.Filter(bits, [10], 10)
        assert made.may_have(keys).all()
        assert len(bits) * 64 <= max(64, 2 * decontamination.BITS * 2 * block)
    assert made.may_have(others).mean() < 0.05

def test_the_word_before_is_whole():
    """Past any white space; a word of any length is taken whole if the field has weights for words as long, and is one without weights if not."""
    long = "a" * 60
    assert pii.word_before("Call" + " \n" * 40 + "555", 84) == "call"
    assert pii.word_before(f"x {long} 5", 63) == "" and pii.word_before(f"x {long} 5", 63, 60) == long
    assert pii.word_before("Kreditkarte: 4539", 13) == "kreditkarte"
    assert pii.word_before("a1 5", 3) == pii.word_before("   5", 3) == pii.word_before("5", 0) == ""
    rows = pii.labelled_table()
    field = pii.train(rows)
    assert 0 < field.longest <= pii.LONGEST
    far = pii.train([(s, p, long if w == "call" else w, t, y) for s, p, w, t, y in rows])
    assert far.longest == 60 and not np.array_equal(far.emission("555-0199", long), far.emission("555-0199", long[:-1]))


def test_a_charset_declared_late():
    page = b"<html><head>" + b"<!-- " + b"x" * 3000 + b" --><META http-equiv=x content='text/html; charset=shift_jis'></head><p>" + "日本".encode("shift_jis") + b"</p>"
    assert "日本" in warc.decoded(page)
    assert "日本" not in warc.decoded(page, "text/html; charset=iso-8859-1")
    assert warc.decoded(b"<p>" + b"x" * 2000 + "é charset=utf-16 ".encode()) .endswith("é charset=utf-16 ")
