"""Token counts: greedy longest-match piece lengths by a linear automaton.

The vocabulary is a trie over bytes with an end-of-word mark. Every node has a failure link and the number of
pieces that are popped when the link is taken, both computed beforehand: leaving node v pops the longest
pieces that cover v's string up to where the link continues. So a word is read once, its pieces are counted
and never built. Words repeat, so each is looked up in a bounded cache of its worker first.

Words are what ASCII white space parts, with A-Z lower-cased. The vocabulary file's own normaliser (NFC, Unicode
lower case) and pre-tokeniser (letters, single digits, other signs apart) are not applied, so counts are not that
tokenizer's where capitals beyond ASCII, digits or punctuation occur.

The count of a word that greedy longest-match cannot cover is one unknown piece. Vocabularies that have all
256 bytes, plain and with the end mark, cover everything.

Defined results: a null or wordless text has 0 tokens; repeated rows and null ids keep their rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/word_bpe_49k.json")
END_MARK = "</w>"
END = 256
CACHE_WORDS = 400_000
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def byte_symbols() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The pieces as byte strings; a piece that ends a word ends with END."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    symbols, special = byte_symbols(), {x["content"] for x in data.get("added_tokens", [])}
    pieces = []
    for piece in data["model"]["vocab"]:
        if piece in special:
            continue
        body, end = (piece[: -len(END_MARK)], (END,)) if piece.endswith(END_MARK) else (piece, ())
        if all(c in symbols for c in body):
            pieces.append((*(symbols[c] for c in body), *end))
    return pieces


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        parent, symbol, depth, final = [0], [-1], [0], [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in children[v]:
                    children[v][c] = len(children)
                    children.append({})
                    parent.append(v), symbol.append(c), depth.append(depth[v] + 1), final.append(False)
                v = children[v][c]
            final[v] = v != 0
        self.children = children
        #: failure link, -1: none; pieces popped on the way
        self.link, self.popped = [-1] * len(children), [0] * len(children)
        for v in sorted(range(1, len(children)), key=depth.__getitem__):
            if final[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            u, n, c = self.link[parent[v]], self.popped[parent[v]], symbol[v]
            while u >= 0 and c not in children[u]:
                n, u = n + self.popped[u], self.link[u]
            if u >= 0:
                self.link[v], self.popped[v] = children[u][c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word followed by the end mark; 1 if it can't be covered."""
        children, link, popped = self.children, self.link, self.popped
        v, n = 0, 0
        for c in (*word, END):
            while c not in children[v]:
                if v == 0 or link[v] < 0:
                    return 1
                n += popped[v]
                v = link[v]
            v = children[v][c]
        while v > 0:
            if link[v] < 0:
                return 1
            n += popped[v]
            v = link[v]
        return n


def _counted(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cache = automaton.value.count, {}
        for whole in batches:
            for batch in slices(whole, 1):
                n_bytes, n_words, n_tokens, longest = [], [], [], []
                for text in batch.column(1).to_pylist():
                    data = (text or "").encode("utf-8", "surrogatepass")
                    words = data.translate(_LOWER).split()
                    total, most = 0, 0
                    for w, times in Counter(words).items():
                        k = cache.get(w)
                        if k is None:
                            k = count(w)
                            if len(w) <= 64:
                                if len(cache) >= CACHE_WORDS:
                                    cache.clear()
                                cache[w] = k
                        total += k * times
                        most = max(most, k)
                    n_bytes.append(len(data)), n_words.append(len(words)), n_tokens.append(total), longest.append(most)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens, longest))],
                    ["doc_id", "n_bytes", "n_words", "n_tokens", "most_in_word"],
                )

    return run


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_words, n_tokens, most_in_word. The vocabulary file is read by the driver."""
    slim = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    automaton = documents.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_counted(automaton), f"doc_id {kind}, n_bytes long, n_words long, n_tokens long, most_in_word long")


def greedy_pieces(pieces: set[tuple[int, ...]], word: bytes, longest: int) -> int:
    """Brute force for tests: the pieces of a word by longest match."""
    symbols, at, n = (*word, END), 0, 0
    while at < len(symbols):
        for size in range(min(longest, len(symbols) - at), 0, -1):
            if symbols[at : at + size] in pieces:
                break
        else:
            return 1
        at, n = at + size, n + 1
    return n


__all__ = ["Automaton", "count_tokens", "greedy_pieces", "read_vocabulary"]
