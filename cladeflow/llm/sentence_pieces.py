"""SentencePiece encoding and decoding (byte-pair models with byte fallback) by vectorised merge rounds.

The pieces of a batch of texts lie in one flat array of symbols. Text is parted wherever two neighbouring characters
occur side by side in no piece, as no merge can go across; these parts are the words, and each distinct word of a
batch is encoded once. In a round every word finds the least rank of its pairs, all its pairs of that rank are merged
at once from the left without overlap, and the arrays are compacted; words without a pair leave. Rounds end when
no word is left.

One at a time, as the rule has it, a merge can make a pair that comes before the next one of the same rank. So a round
takes a word's merges up to and including the first whose new neighbour pairs rank as low or lower, and the rest is left
to later rounds: the result is that of merging one by one. Ranks that pieces share (runs of spaces) would take a round
a merge; where such pieces combine only with each other, and come last, one pass over the word ends it.

Decoding spells ids from a table of bytes; the leading space that encoding adds is dropped, single bytes that are no
text become U+FFFD.

Defined results: a null or empty text has no pieces, so only the end id where one is asked for; repeated rows and null
ids keep their rows; extra columns are ignored by `encode` and kept by `decode`; an empty table gives an empty
result. Texts of more than CHUNK characters are encoded in chunks that end where words do, so memory beside the ids is
bounded unless one word is longer. Characters that are no piece become the ids of their UTF-8 bytes. Null ids to decode
give an empty text, ids that are not in the vocabulary are an error.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ORIGINAL, mix64, named, own, with_fields

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: characters of a part of a batch
CHUNK = 1 << 19
NONE = np.iinfo(np.int32).max
_POINTS = 0x110000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Model:
    """The tables of a model file; read once by the driver and broadcast."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=path)
        self.size = n = file.get_piece_size()
        kind = [0 if file.is_control(i) else 1 if file.is_unknown(i) else 2 if file.is_byte(i) else 3 for i in range(n)]
        if kind.count(2) != 256:
            raise ValueError(f"{path} has no ids for single bytes")
        self.end = file.eos_id()
        names = [file.id_to_piece(i) for i in range(n)]
        plain = {names[i]: i for i in range(n) if kind[i] == 3}
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if kind[i] == 2:
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.control = np.array(kind) == 0
        self.leads = np.array([k == 3 and x.startswith(SPACE) for k, x in zip(kind, names)])
        spelled = {0: lambda x: b"", 1: lambda x: " ⁇ ".encode(), 2: lambda x: bytes([int(x[3:5], 16)]), 3: lambda x: x.replace(SPACE, " ").encode()}
        words = [spelled[k](x) for k, x in zip(kind, names)]
        self.spelling, self.spelling_ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(x) for x in words])
        self._tables(plain, [file.get_score(i) for i in range(n)])

    def _tables(self, plain: dict[str, int], scores: list[float]) -> None:
        # a character that is part of a piece but none itself has a symbol beyond the pieces; `size` stands for all others
        self.characters = sorted({c for x in plain for c in x} - set(plain))
        symbol = plain | {c: self.size + 1 + k for k, c in enumerate(self.characters)}
        self.base = self.size + 1 + len(self.characters)
        self.symbol_of = np.full(_POINTS, self.size, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in plain.values()}, reverse=True))}
        merges = sorted((symbol[x[:k]] * self.base + symbol[x[k:]], i, order[scores[i]]) for x, i in plain.items() for k in range(1, len(x)) if x[:k] in symbol and x[k:] in symbol)
        self.keys, results, ranks = (np.array(c) for c in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 3
        self.results, self.ranks = results.astype(np.int32), ranks.astype(np.int32)
        pairs = {(a, b) for x in plain for a, b in zip(x, x[1:])}
        within = sorted({c for p in pairs for c in p})
        self.class_of = np.zeros(_POINTS, np.uint16)
        self.class_of[[ord(c) for c in within]] = np.arange(1, len(within) + 1)
        self.joined = np.zeros((len(within) + 1,) * 2, bool)
        for a, b in pairs:
            self.joined[self.class_of[ord(a)], self.class_of[ord(b)]] = True
        self.last = self._shared_last_rank()

    def _shared_last_rank(self) -> int:
        """The last rank, if its pieces combine only to pieces of the same rank; else -1."""
        last = int(self.ranks.max(initial=-1))
        made = np.unique(self.results[self.ranks == last])
        uses = np.isin(self.keys // self.base, made) | np.isin(self.keys % self.base, made)
        return last if bool(np.all(self.ranks[uses] == last)) else -1

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the piece of pairs; NONE where there is no piece."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.results[at]

    @cached_property
    def merge_table(self) -> dict[int, int]:
        """Pairs of the last rank, for the single pass."""
        mine = self.ranks == self.last
        return dict(zip(self.keys[mine].tolist(), self.results[mine].tolist()))

    def finish(self, symbols: list[int]) -> list[int]:
        """Merge pairs of the last rank one by one from the left: what is on the stack has none."""
        stack: list[int] = []
        for s in symbols:
            while stack and (made := self.merge_table.get(stack[-1] * self.base + s)) is not None:
                stack.pop()
                s = made
            stack.append(s)
        return stack


def _firsts(word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)


def merge_words(model: Model, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and the number of the word that each is in, in order; returned merged until no pair remains."""
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    same = np.r_[word[1:] == word[:-1], False] if len(word) else np.zeros(0, bool)
    rank, made = np.full(len(word), NONE, np.int32), np.zeros(len(word), np.int32)
    at = np.flatnonzero(same)
    rank[at], made[at] = model.look_up(symbols[at], symbols[at + 1])
    while len(word):
        first = _firsts(word)
        least = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.r_[first, len(word)])
        if (over := (least == NONE) | (least == model.last)).any():
            out = np.repeat(over, sizes)
            for k in np.flatnonzero(least == model.last):
                a, b = first[k], first[k] + sizes[k]
                rest = np.array(model.finish(symbols[a:b].tolist()), np.int32)
                ended.append((rest, np.full(len(rest), word[a])))
                out[a:b] = False
            ended.append((symbols[out], word[out]))
            go_on = ~np.repeat(over, sizes)
            symbols, word, rank, made = symbols[go_on], word[go_on], rank[go_on], made[go_on]
            least, sizes = least[~over], sizes[~over]
            if not len(word):
                break
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        run = np.r_[True, np.diff(hit) > 1]
        place = np.arange(len(hit))
        chosen = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        mine, new = word[chosen], made[chosen]
        # the neighbours at the time of each merge, those on its left being done
        before, after = chosen - 1, chosen + 2
        left = np.where(np.r_[False, chosen[1:] == chosen[:-1] + 2], np.r_[0, new[:-1]], symbols[before])
        has_left = (before >= 0) & (word[before] == mine)
        has_right = (after < len(word)) & (word[np.minimum(after, len(word) - 1)] == mine)
        right = symbols[np.minimum(after, len(word) - 1)]
        nearest = np.minimum(np.where(has_left, model.look_up(left, new)[0], NONE), np.where(has_right, model.look_up(new, right)[0], NONE))
        early = nearest <= rank[chosen]
        seen = np.cumsum(early) - early
        start = _firsts(mine)
        chosen = chosen[seen == np.repeat(seen[start], np.diff(np.r_[start, len(mine)]))]
        symbols[chosen] = made[chosen]
        stay = np.ones(len(word), bool)
        stay[chosen + 1] = False
        symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
        moved = chosen - np.arange(len(chosen))
        near = np.concatenate([moved, moved[moved > 0] - 1])
        follows = (near + 1 < len(word)) & (word[np.minimum(near + 1, len(word) - 1)] == word[near])
        rank[near[~follows]] = NONE
        near = near[follows]
        rank[near], made[near] = model.look_up(symbols[near], symbols[near + 1])
    if not ended:
        return symbols, word
    symbols, word = (np.concatenate(x) for x in zip(*ended))
    order = np.argsort(word, kind="stable")
    return symbols[order].astype(np.int32), word[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _bytes_for(model: Model, ids: np.ndarray, word: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no piece become the ids of their bytes; points: the first character of each word."""
    odd = np.flatnonzero(ids >= model.size)
    if not len(odd):
        return ids, word
    spelled = [chr(points[w]) if s == model.size else model.characters[s - model.size - 1] for s, w in zip(ids[odd].tolist(), word[odd].tolist())]
    data = [x.encode("utf-8", "surrogatepass") for x in spelled]
    sizes = np.ones(len(ids), np.int64)
    sizes[odd] = [len(x) for x in data]
    out, first = np.repeat(ids, sizes), np.cumsum(sizes) - sizes
    out[_spread(first[odd], sizes[odd])] = model.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
    return out, np.repeat(word, sizes)


def encode_parts(model: Model, parts: list[str]) -> list[np.ndarray]:
    """The ids of escaped texts, or of chunks of them that end where words do."""
    sizes = np.array([len(x) for x in parts])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return [np.zeros(0, np.int32) for _ in parts]
    starts = np.ones(len(points), bool)
    kinds = model.class_of[points]
    starts[1:] = ~model.joined[kinds[:-1], kinds[1:]]
    begin = np.cumsum(sizes) - sizes
    starts[begin[sizes > 0]] = True
    at = np.flatnonzero(starts)
    length = np.diff(np.r_[at, len(points)])
    place = np.arange(len(points)) - np.repeat(at, length)
    name = np.add.reduceat(mix64(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), at)
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    if not (np.array_equal(length, length[first][which]) and np.array_equal(points, points[np.repeat(at[first][which], length) + place])):
        first = which = np.arange(len(at))  # two words share a name: none is shared
    mine = _spread(at[first], length[first])
    ids, word = merge_words(model, model.symbol_of[points[mine]], np.repeat(np.arange(len(first)), length[first]))
    ids, word = _bytes_for(model, ids, word, points[at[first]])
    counts = np.bincount(word, minlength=len(first))
    each = counts[which]
    flat = ids[_spread((np.cumsum(counts) - counts)[which], each)]
    # ids before each part: those of the words that begin before it
    total = np.r_[0, np.cumsum(each)]
    edges = total[np.r_[np.searchsorted(at, begin), len(at)]]
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


def chunks(model: Model, text: str, most: int = CHUNK) -> Iterator[str]:
    """An escaped text in parts of about `most` characters that end where words do."""
    a = 0
    while len(text) - a > most:
        size = most
        while True:
            points = np.frombuffer(text[a : a + size + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = model.class_of[points]
            ends = np.flatnonzero(~model.joined[kinds[:-1], kinds[1:]])
            if len(ends) or a + size >= len(text):
                break
            size *= 2
        b = a + int(ends[-1]) + 1 if len(ends) else len(text)
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


def encode_texts(model: Model, texts: list[str], with_end: bool = True, most: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """Lists of the ids of texts, in order; parts of about `most` characters are encoded together."""
    waiting: list[str] = []
    begun: list[bool] = []  # whether a part is the first of its text
    size, done, carry = 0, [], []

    def flush():
        nonlocal size
        for ids, new in zip(encode_parts(model, waiting), begun):
            if new and carry:
                done.append(np.concatenate(carry))
                carry.clear()
            carry.append(ids)
        waiting.clear(), begun.clear()
        size = 0

    for text in texts:
        escaped = SPACE + text.replace(" ", SPACE) if text else ""
        for k, part in enumerate(chunks(model, escaped, most) if escaped else [""]):
            waiting.append(part), begun.append(k == 0)
            size += len(part)
            if size >= most:
                flush()
                if done:
                    yield _ended(model, done, with_end)
                    done = []
    flush()
    if carry:
        done.append(np.concatenate(carry))
    yield _ended(model, done, with_end)


def _ended(model: Model, ids: list[np.ndarray], with_end: bool) -> list[np.ndarray]:
    return [np.append(x, np.int32(model.end)) for x in ids] if with_end else ids


def _encoded(model, with_end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a = batch.column(0), 0
            for ids in encode_texts(model.value, batch.column(1).to_pylist(), with_end):
                ends = np.cumsum([0, *(len(x) for x in ids)])
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, len(ids)), column], ["doc_id", "ids"])
                a += len(ids)

    return run


def encode(documents: DataFrame, path: str | None = None, with_end: bool = True) -> DataFrame:
    """One row a document: doc_id and its ids, with the end id at the end if asked for."""
    model = documents.sparkSession.sparkContext.broadcast(Model(path or model_path()))
    slim = documents.select(named("doc_id").alias("doc_id"), F.coalesce(named("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(_encoded(model, with_end), with_fields(slim, ["doc_id"], "ids array<int>"))


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


def decode_ids(model: Model, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of runs of ids that lie one after the other and end at `ends`."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < model.size:
        raise ValueError("an id is not in the vocabulary")
    sizes = np.diff(np.r_[0, model.spelling_ends])[ids]
    data = model.spelling[_spread(model.spelling_ends[ids] - sizes, sizes)].tobytes()
    spoken = np.flatnonzero(~model.control[ids])
    begin = np.r_[0, ends[:-1]]
    first = np.searchsorted(spoken, begin)  # the first id of each run that is spelled
    there = first < len(spoken)
    lead = np.zeros(len(ends), bool)
    lead[there] = (spoken[first[there]] < ends[there]) & model.leads[ids[spoken[first[there]]]]
    places = np.r_[0, np.cumsum(sizes)]
    codecs.register_error("each_byte", _each_byte)  # workers unpickle this function alone
    return [data[places[a] + cut : places[b]].decode("utf-8", "each_byte") for a, b, cut in zip(begin.tolist(), ends.tolist(), lead.tolist())]


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, (4 * CHUNK * whole.num_rows) // max(1, whole.column(1).nbytes))
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                runs = batch.column(1)
                ids = np.asarray(runs.flatten().to_numpy(zero_copy_only=False), np.int64)
                ends = np.cumsum(np.asarray(runs.value_lengths().fill_null(0), np.int64))
                texts = decode_ids(model.value, ids, ends) if len(runs) else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [ORIGINAL, "__decoded"])

    return run


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; a column of that name is replaced."""
    model = tokens.sparkSession.sparkContext.broadcast(Model(path or model_path()))
    kept = [c for c in tokens.columns if c.lower() != into.lower()]
    rows = tokens.select(F.struct(*[named(c) for c in kept]).alias(ORIGINAL), named(ids).cast("array<int>").alias("__ids"))
    spoken = rows.mapInArrow(_decoded(model), with_fields(rows, [ORIGINAL], "__decoded string"))
    return spoken.select(*[own(c).alias(c) for c in kept], F.col("__decoded").alias(into))


def digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The digests of a document's ids, written in decimal, and of the text that they decode to."""
    both = decode(encode(documents, path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
