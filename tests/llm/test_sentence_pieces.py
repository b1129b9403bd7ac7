"""Merge rounds against merging one by one, and the whole against the library that the model file is for."""

import hashlib
import random
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.llm import sentence_pieces as sp

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def model():
    return sp.Model(sp.model_path())


def one_by_one(model, symbols):
    """The rule itself: the pair of the least rank, the leftmost of those, until there is none."""
    table = {k: (r, i) for k, r, i in zip(model.keys.tolist(), model.ranks.tolist(), model.results.tolist())}
    symbols = list(symbols)
    while True:
        pairs = [(*table[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] * model.base + symbols[i + 1]) in table]
        if not pairs:
            return symbols
        _, made, i = min(pairs, key=lambda x: (x[0], x[2]))
        symbols[i : i + 2] = [made]


@pytest.mark.parametrize("seed", range(12))
def test_rounds_against_one_by_one(seed):
    """Random vocabularies in random orders, with ranks that pieces share: merges that make pairs of lower rank are common."""
    pick = random.Random(seed)
    names = ["".join(p) for n in (1, 2, 3, 4) for p in product("abc"[: 2 + seed % 2], repeat=n) if n == 1 or pick.random() < 0.5]
    model = object.__new__(sp.Model)
    model.size = len(names)
    levels = len(names) if seed % 3 else 4
    model._tables({x: i for i, x in enumerate(names)}, [-float(pick.randrange(levels)) for _ in names])
    texts = ["".join(pick.choices("abc"[: 2 + seed % 2], k=pick.randrange(1, 30))) for _ in range(400)]
    symbols = np.array([model.symbol_of[ord(c)] for t in texts for c in t], np.int32)
    word = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got, where = sp.merge_words(model, symbols, word)
    for k, t in enumerate(texts):
        assert got[where == k].tolist() == one_by_one(model, [model.symbol_of[ord(c)] for c in t]), (t, names)


def cases():
    pick = random.Random(3)
    fixed = ["", " ", "  ", "\n", " \n", "a ", "▁a", "hello  world\n x ", "日本語 😀 é\0 �", "\t\r\n ", "<s> </s> <unk> <0x0A>", "1234567", "é", "\U0010ffff", "x" * 500]
    spaces = [f"{a}{' ' * n}{b}" for n in range(40) for a in ("", "a") for b in ("", "b", "\n")]
    letters = ["abcdefghijklmnopqrstuvwxyz", "abt he in", " ▁aén", "ABCdef123 .,-_\n", "".join(map(chr, range(32, 1200))), "日本語中文字的是了 "]
    return fixed + spaces + ["".join(pick.choices(a, k=pick.randrange(0, 80))) for a in letters for _ in range(100)]


def test_against_the_library(spark, library, rows):
    texts = [*cases(), None, *(r[1] for r in rows)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sp.decode(sp.encode(df)).collect()}
    digests = {r.doc_id: r for r in sp.digest(df).collect()}
    assert len(got) == len(digests) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert got[i].ids == ids, t
        assert got[i].decoded == library.decode(ids), t
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert [r.ids for r in sp.encode(df.where("doc_id = 7"), with_end=False).collect()] == [library.encode(texts[7])]


def test_chunks_change_nothing(model, library):
    texts = [t for t in cases() if t] + ["", " ".join(cases()), "", "word " * 400, "a" * 700]
    want = [library.encode(t, add_eos=True) for t in texts]
    for most in (7, 64, 1000):
        assert [x.tolist() for part in sp.encode_texts(model, texts, True, most) for x in part] == want


def test_decode_any_ids(model, library):
    """Ids in any order: bytes that are no text, controls first, pieces that begin with a space."""
    pick = random.Random(5)
    runs = [[], [2], [1, 264], [264, 264], [0, 264], [230, 264], [2, 28705, 28705], [227, 132], [264, 227]]
    runs += [[pick.choice([pick.randrange(260), pick.randrange(model.size), 28705]) for _ in range(pick.randrange(12))] for _ in range(2000)]
    got = sp.decode_ids(model, np.array([i for r in runs for i in r], np.int64), np.cumsum([len(r) for r in runs]))
    assert [(r, x) for r, x in zip(runs, got)] == [(r, library.decode(r)) for r in runs]
    with pytest.raises(ValueError):
        sp.decode_ids(model, np.array([model.size]), np.array([1]))


def test_long_texts_are_quick(model, library):
    pick = random.Random(2)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoinshr", "a", " ", "aA"):
        text = "".join(pick.choices(letters, k=200_000))
        began = time.perf_counter()
        ids = [x.tolist() for part in sp.encode_texts(model, [text]) for x in part]
        assert time.perf_counter() - began < 20, letters
        assert ids == [library.encode(text, add_eos=True)]


def test_rows_and_columns(spark, docs, crowded, rows):
    plain = sorted(map(tuple, sp.digest(docs).collect()), key=str)
    assert len(plain) == len(rows)
    assert sorted(map(tuple, sp.digest(crowded.select("*", F.lit("x").alias("ids"), F.lit("x").alias("decoded"))).collect()), key=str) == plain
    assert sp.digest(docs.limit(0)).count() == 0
    tokens = spark.createDataFrame([([264, 2], 1, "y"), (None, 2, "y"), ([], 3, "y")], "ids array<int>, `a.b` long, decoded string")
    assert [(r["a.b"], r.decoded) for r in sp.decode(tokens).collect()] == [(1, "a"), (2, ""), (3, "")]
