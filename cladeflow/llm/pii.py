"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features.

Base spans are those of four patterns with their checks (parts at most 255, Luhn, digit counts). The
patterns are searched in linear time on any text: e-mail addresses from their `@` outwards, the others with
possessive runs that a run's inside cannot restart.

The field labels white-space tokens. Tokens without a digit or `@` are clamped to O, so the chain falls apart
exactly there, and only runs of other tokens are decoded: by Viterbi over numpy batches of runs. So it finds what has
digits or `@`, and no names or addresses. Features are of the whole token's shape and of the word before a run. It is
trained, in the driver, from a small labelled table of written formats. Its spans are added where no base span is.

Defined results: a null text is empty; repeated rows and null ids keep their rows; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = str.maketrans("", "", " ().+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind, sorted."""
    spans = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                spans.append((a, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].translate(_DIGITS)
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_DIGITS)) <= 15:
                spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


# ---- the field ----------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_SHAPES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_RUN = re.compile(r"([dxX])\1{4,}")
_GROUP = re.compile("[0-9]+")
_CHANGE = re.compile("d(?=x)|x(?=d)")
_TRIM = "\"'.,;:!?#*%&$<>[]{}|"
CACHE = 200_000


def shape(token: str) -> str:
    """Digits d, letters x and X, other characters as they are; runs of 5 and more as one sign and +."""
    return _RUN.sub(lambda m: m[1] + "+", token.strip(_TRIM).translate(_SHAPES))


def token_features(s: str, before: str = "") -> list[str]:
    """Features of a shape, and of the word before the token."""
    n = s.count("d") + 4 * s.count("d+")
    body = re.sub(r"[dxX]\+?|[xX]", "", s)
    flat = re.sub(r"([dx])(?:\1|\+)*", r"\1", s.replace("X", "x"))
    own = ["bias", f"shape={s}", f"flat={flat}", f"digits={min(n, 17)}", f"at={s.count('@')}", f"dots={min(s.count('.'), 5)}", f"marks={''.join(sorted(set(body)))}", f"head={s[:2]}", f"tail={s[-2:]}", f"letters={'x' in s or 'X' in s}", f"inner={bool(re.search('[dx]@[dx]', flat))}", f"changes={min(len(_CHANGE.findall(flat)), 5)}"]
    return [*own, f"before={before}"] if before else own


def run_features(tokens: list[str]) -> list[list[str]]:
    """Of each token of a run: the digits and tokens of the whole run, its place in it, its digits and its longest group of these."""
    groups = [[len(g) for g in _GROUP.findall(t)] for t in tokens]
    n, longest = min(sum(map(sum, groups)), 21), min(max((max(g, default=0) for g in groups)), 7)
    whole = [f"total={n}", f"tokens={min(len(tokens), 6)}", f"groups={min(sum(map(len, groups)), 6)} of {longest}"]
    return [
        [*whole, f"place={(j == 0) + 2 * (j == len(tokens) - 1)}", f"total={n} place={j == 0}", f"own={min(sum(g), 17)}", f"group={min(max(g, default=0), 7)}"]
        for j, g in enumerate(groups)
    ]


def word_before(text: str, at: int, longest: int | None = None) -> str:
    """The word before a place, past any white space, in lower case without marks, if it is letters alone.

    longest: of the words that the field has weights for, by default of the labelled table; a longer word is known to have none.
    """
    longest = LONGEST if longest is None else longest
    end = at
    while end and text[end - 1] in WHITE:
        end -= 1
    start = end
    while start and text[start - 1] not in WHITE:
        start -= 1
    word = text[start:end].strip(_TRIM).lower()
    return word if len(word) <= longest and word.isalpha() else ""


# ---- the labelled table: formats (digits as #) and the words before them, in four languages ----

FORMATS: dict[str, tuple[str, ...]] = {
    "phone": (
        "+1 (###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "+## ## #### ####", "+## ### ######", "1-###-###-####", "(###)###-####", "0## ### ####", "+##-##-###-####",
        "0##/#######", "### ### ####", "+# ### ### ####", "0#### ######", "+## (0)## ### ####", "00## ## #######",
    ),
    "card": (
        "#### #### #### ####", "####-####-####-####", "################", "#### ###### #####", "###############", "####-######-#####", "#### #### #### #### ###", "####.####.####.####",
    ),
    "ip": ("##.##.##.##", "1##.1##.##.1##", "10.#.#.#", "192.168.#.##", "2##.2##.1##.2##", "#.#.#.#", "172.1#.##.#:####", "##.##.##.##/##"),
    "email": (
        "ann.##@mail#.example.com", "x##@host.org", "first.last@mail.example.net", "team-#@example.com", "a_b+c@sub.example.org", "info@example.com", "j.doe@localhost", "bob@intranet", "sales##@shop.co.uk",
    ),
    "": (
        "20##", "#", "##", "###", "#,###", "#.##", "v#.#.#", "##:##", "20##-0#-1#", "@handle", "@name##", "no.##", "##%", "x##x", "b#########a#f##c#", "(#)", "#)", "##.", "# #", "## ##", "### ### ###", "### ##", "#/#",
        "$##", "$#,###.##", "####", "#####", "abc@", "@", "######", "#######", "##/##/20##", "##-##-##", "ISBN-##########", "#.#.#", "##x##", "1#th", "#-#", "###-###", "########", "#.###.###", "id=#####", "§##", "##°",
        "c##e#d####a#b#", "########-####-4###-b###-#########a##", "#f##a#d#####e##c", "f###d#c##", "key=##a##e#####d",
    ),
}
WORDS_BEFORE: dict[str, tuple[str, ...]] = {
    "phone": ("call", "phone", "tel", "telephone", "mobile", "fax", "dial", "ring", "telefon", "handy", "anrufen", "téléphone", "appelez", "portable", "teléfono", "llame", "móvil", "whatsapp", "number", "at"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay", "karte", "kreditkarte", "carte", "bancaire", "tarjeta", "crédito", "number", "charged", "with"),
    "ip": ("ip", "host", "address", "server", "from", "ping", "login", "adresse", "dirección", "serveur", "servidor", "client", "at"),
    "email": ("mail", "email", "write", "contact", "to", "from", "schreiben", "courriel", "écrire", "correo", "escriba", "kontakt", "contacto", "at"),
    "": ("in", "page", "chapter", "version", "the", "of", "about", "year", "seite", "jahr", "page", "année", "año", "página", "und", "et", "y", "and", "total", "order", "isbn", "at", "to", "from", "with", "number"),
}
LONGEST = max(len(w) for words in WORDS_BEFORE.values() for w in words)
#: Each HELD-th format of a kind is held out in tests.
HELD = 4
_MARK = re.compile(r"(?<=[#0-9])[-. /](?=[#0-9])")
_HEX = re.compile("(?=#*[a-f])[a-f#]{8,}")
_PART = re.compile(r"(?<![0-9#])[0-9]?#+(?=\.|$)")


def varied(pick: random.Random, kind: str, written: str) -> str:
    """A format as it is written, or, in every second row, with one of the marks between its digits made another, an address with parts of other lengths, or a hexadecimal name of another length."""
    if kind == "email" or pick.random() < 0.5:
        return written
    if _HEX.fullmatch(written):
        return "".join(pick.choice("##########abcdef") for _ in range(pick.randrange(8, 65)))
    if kind == "ip":
        return _PART.sub(lambda m: "#" * pick.randrange(1, 4), written)
    marks = sorted(set(_MARK.findall(written)))
    if not marks:
        return written
    old, new = pick.choice(marks), pick.choice("-. " if kind == "card" else "-. /")
    return _MARK.sub(lambda m: new if m[0] == old else m[0], written)


def labelled_table(rows: int = 900, seed: int = 7, held: bool | None = None, fold: int = HELD - 1) -> list[tuple[int, int, str, str, str]]:
    """The small labelled table: (sequence, place, word before, token, label), from the written formats and words.

    For tests, from the formats that a fold holds out, as they are written (held is True), or from the others, varied (False).
    """
    pick = random.Random(seed)
    chosen = {k: tuple(f for i, f in enumerate(v) if held is None or (i % HELD == fold) == held) for k, v in FORMATS.items()}
    out = []
    names = list(FORMATS)
    for i in range(rows):
        kinds = [names[i % len(names)]] if i % 3 else [names[i % len(names)], ""]
        place, before = 0, pick.choice(("", *WORDS_BEFORE[kinds[0]]))
        for kind in kinds:
            written = pick.choice(chosen[kind])
            text = re.sub("#", lambda _: pick.choice("0123456789"), written if held else varied(pick, kind, written))
            tail = pick.choice(("", "", "", ".", ",", "%%%", "!!"))
            tokens = text.split(" ")
            for j, t in enumerate(tokens):
                t += tail if j == len(tokens) - 1 else ""
                out.append((i, place, before, t, f"{'I' if j else 'B'}-{kind}" if kind else "O"))
                place, before = place + 1, ""
    return out


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.longest = max((len(f) - len("before=") for f in names if f.startswith("before=")), default=0)
        self.cache: dict[str | bytes, np.ndarray] = {}  # long shapes by their hash

    def emission(self, token: str, before: str = "") -> np.ndarray:
        """The scores of a token's labels; a word before it counts if training has it."""
        row = self.names.get(f"before={before}") if before else None
        return self._of_shape(token) if row is None else self._of_shape(token) + self.emit[row]

    def run_emissions(self, tokens: list[str], before: str = "") -> list[np.ndarray]:
        """The scores of the labels of a run's tokens."""
        out = []
        for j, (token, more) in enumerate(zip(tokens, run_features(tokens))):
            rows = [self.names[f] for f in more if f in self.names]
            out.append(self.emission(token, "" if j else before) + self.emit[rows].sum(axis=0))
        return out

    def _of_shape(self, token: str) -> np.ndarray:
        s = shape(token)
        key = s if len(s) <= 64 else hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()
        e = self.cache.get(key)
        if e is None:
            rows = [self.names[f] for f in token_features(s) if f in self.names]
            e = self.emit[rows].sum(axis=0)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[key] = e
        return e

    def decode(self, lengths: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        """Viterbi over many runs at once. Runs lie one after the other in `emissions`; both ends border on O."""
        if not len(lengths):
            return np.empty(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        n, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        best = self.move[0] + emissions[starts]
        back = np.zeros((len(emissions), len(LABELS)), np.int8)
        ends = np.empty((len(n), len(LABELS)))
        live = len(n)
        for t in range(1, int(n[0]) + 1):
            now = int(np.searchsorted(-n, -t, "left"))  # runs longer than t come first
            ends[now:live] = best[now:live]
            live = now
            if not live:
                break
            paths = best[:live, :, None] + self.move[None]
            back[starts[:live] + t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + emissions[starts[:live] + t]
        label = (ends + self.move[:, 0]).argmax(axis=1)
        out = np.zeros(len(emissions), np.int64)
        at, left = starts + n - 1, n.copy()
        rows = np.arange(len(n))
        while len(rows):
            out[at[rows]] = label[rows]
            label[rows] = back[at[rows], label[rows]]
            at[rows] -= 1
            left[rows] -= 1
            rows = rows[left[rows] > 0]
        return out


def train(table: list[tuple[int, int, str, str, str]], steps: int = 120, rate: float = 0.15, penalty: float = 2e-3) -> Field:
    """Maximum likelihood by forward-backward over padded sequences, with Adam steps."""
    sequences: dict[int, list[tuple[str, str, str]]] = {}
    for i, _, before, token, label in sorted(table):
        sequences.setdefault(i, []).append((before, token, label))
    names: dict[str, int] = {}
    k, runs = len(LABELS), list(sequences.values())
    longest = max(map(len, runs))
    cells, y, mask = [], np.zeros((len(runs), longest), np.int64), np.zeros((len(runs), longest), bool)
    for i, run in enumerate(runs):
        whole = run_features([token for _, token, _ in run])
        for t, (before, token, label) in enumerate(run):
            y[i, t], mask[i, t] = LABELS.index(label), True
            cells += [(i * longest + t, names.setdefault(f, len(names))) for f in (*token_features(shape(token), before), *whole[t])]
    cell, feature = np.array(cells).T
    by_cell, by_feature = np.argsort(cell, kind="stable"), np.argsort(feature, kind="stable")
    first_of_cell, cells_there = np.flatnonzero(np.diff(cell[by_cell], prepend=-1)), np.unique(cell)
    first_of_feature = np.flatnonzero(np.diff(feature[by_feature], prepend=-1))
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    hot = np.zeros((len(runs), longest, k))
    hot[np.arange(len(runs))[:, None], np.arange(longest), y] = mask
    length = mask.sum(axis=1)
    last = np.arange(longest) == length[:, None] - 1
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move)]
    for step in range(1, steps + 1):
        e = np.zeros((len(runs) * longest, k))
        e[cells_there] = np.add.reduceat(emit[feature[by_cell]], first_of_cell)
        e = e.reshape(len(runs), longest, k)
        fore, aft = np.zeros_like(e), np.zeros_like(e)
        log = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        fore[:, 0] = move[0] + e[:, 0]
        for t in range(1, longest):
            fore[:, t] = log(fore[:, t - 1, :, None] + move[None], 1) + e[:, t]
        for t in range(longest - 1, -1, -1):
            inner = log(move[None] + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2) if t + 1 < longest else np.zeros((len(runs), k))
            aft[:, t] = np.where(last[:, t, None], move[:, 0], inner)
        total = log(np.take_along_axis(fore, (length - 1)[:, None, None], 1)[:, 0] + move[:, 0], 1)
        marginal = np.exp(fore + aft - total[:, None, None]) * mask[..., None]
        gap = (hot - marginal).reshape(-1, k)
        g_emit = np.add.reduceat(gap[cell[by_feature]], first_of_feature)
        g_move = np.zeros_like(move)
        g_move[0] += gap.reshape(e.shape)[:, 0].sum(axis=0)
        g_move[:, 0] += (gap.reshape(e.shape) * last[..., None]).sum(axis=(0, 1))
        for t in range(1, longest):
            on = mask[:, t]
            pair = np.exp(fore[on, t - 1, :, None] + move[None] + (e[on, t] + aft[on, t])[:, None, :] - total[on, None, None])
            g_move += np.einsum("ni,nj->ij", hot[on, t - 1], hot[on, t]) - pair.sum(axis=0)
        for x, g, s in ((emit, g_emit / len(runs) - penalty * emit, state[0]), (move, g_move / len(runs) - penalty * move, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Field(names, emit, move)


def runs_of(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens with a digit or @, as (start, end), that only white space parts."""
    run: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        if run and text[run[-1][1] : m.start()].strip(WHITE):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the field labels in each text, trimmed of marks around them."""
    tokens, lengths, owner, emissions = [], [], [], []
    for i, text in enumerate(texts):
        for run in runs_of(text):
            lengths.append(len(run))
            owner += [i] * len(run)
            tokens += run
            emissions += field.run_emissions([text[a:b] for a, b in run], word_before(text, run[0][0], field.longest))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not tokens:
        return out
    labels = field.decode(np.array(lengths), np.array(emissions))
    first = np.zeros(len(tokens), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    open_: list[int] | None = None
    for j, (a, b) in enumerate(tokens):
        x = int(labels[j])
        if open_ and (first[j] or x == 0 or x % 2 == 1 or (x - 1) // 2 != open_[1]):
            out[open_[3]].append(_trimmed(texts[open_[3]], *open_[:3]))
            open_ = None
        if x:
            if open_:
                open_[2] = b
            else:
                open_ = [a, (x - 1) // 2, b, owner[j]]
    if open_:
        out[open_[3]].append(_trimmed(texts[open_[3]], *open_[:3]))
    return [[s for s in spans if s[2] > s[0]] for spans in out]


def _trimmed(text: str, a: int, kind: int, b: int) -> tuple[int, int, int]:
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    while a < b and text[a] in _TRIM:
        a += 1
    return a, kind, b


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


ALL_KINDS = (*KINDS, *(f"crf_{k}" for k in KINDS))


def _found(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                counts, digests, spans = [[] for _ in KINDS], [], []
                for text, added in zip(texts, field_spans(model, texts)):
                    base = base_spans(text)
                    for k, c in enumerate(counts):
                        c.append(sum(s[1] == k for s in base))
                    digests.append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                    free = _free(base, added)
                    spans.append(joined(sorted(base + [(a, k + len(KINDS), b) for a, k, b in free]), ALL_KINDS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return run


def _free(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of `added`, sorted, that overlap none of `base`, sorted by start; both are walked once."""
    out, i, reach = [], 0, 0
    for a, k, b in added:
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append((a, k, b))
    return out


def find(documents: DataFrame, table: list[tuple[int, int, str, str, str]] | None = None) -> DataFrame:
    """One row a document: doc_id, counts a kind, base_sha256 and all spans."""
    slim = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    field = documents.sparkSession.sparkContext.broadcast(train(labelled_table() if table is None else table))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_found(field), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
