"""URL filter: block and allow rules, and logistic regression on hashed character n-grams of host and path.

A rule `host/path` fits its host and all subdomains if the url's path starts with the rule's; the longest
fitting rule wins. Urls without a rule are judged by the model, trained on a small labelled table.

Defined results: a null url, or one without `://`, has empty host and path and is judged by the model, which
allows it; repeated rows and null ids keep their rows; extra columns are ignored; an empty table gives an
empty result. Long urls are read whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The small labelled table: hosts are put together from these words by `labelled_urls`; label 1 is to be blocked.
BLOCKED_WORDS = (
    "casino", "poker", "slots", "jackpot", "roulette", "lottery", "bet", "bets", "betting", "wager", "winner", "prize", "bonus", "spam", "pills", "pharmacy", "viagra", "meds", "steroids", "replica",
    "payday", "loans", "cash", "forex", "porn", "xxx", "adult", "sex", "nude", "escort", "singles", "cams", "hookup", "ads", "adserver", "banner", "popup", "clicks", "tracking", "affiliate",
    "warez", "crack", "keygen", "torrent", "malware", "phishing", "scam", "botnet",
)
#: Words that either kind of host has.
SHARED_WORDS = ("free", "best", "top", "my", "online", "shop", "store", "net", "world", "zone", "club", "now", "win", "hot", "cheap", "live", "24", "365", "x", "pro", "farm", "track")
ALLOWED_WORDS = (
    "library", "museum", "university", "weather", "garden", "history", "cooking", "astronomy", "council", "data", "school", "science", "books", "music", "radio", "botany", "travel", "chess", "philosophy", "archive",
    "journal", "health", "nature", "river", "mountain", "coffee", "bakery", "design", "studio", "photo", "software", "linux", "python", "forum", "wiki", "news", "daily", "market", "energy", "bank",
    "hospital", "football", "cycling", "theatre", "opera", "poetry", "law", "union", "church", "railway", "harbour", "island", "forest", "animal", "kitchen", "family", "teacher", "student", "engineer", "geology",
)
SUBDOMAINS = ("", "", "www.", "blog.", "m.", "en.")
SUFFIXES = (".com", ".org", ".info", ".example.com", ".example.org", ".example.net", ".co.uk", ".de")
PATHS = ("", "/", "/index.html", "/en/{n}", "/fr/{n}/", "/de/{n}.html", "/es/{n}", "/articles/{n}", "/about", "/a/b/{n}", "/2021/05/{n}.html", "/p/{n}")
#: Urls of either kind by their path alone.
BLOCKED_PATHS = ("/casino/{n}", "/buy-viagra/{n}", "/xxx/{n}.html", "/adult/videos/{n}", "/ads/click/{n}", "/keygen/{n}.zip", "/betting/odds/{n}", "/free-porn/{n}")
ALLOWED_PATHS = ("/history/{n}", "/science/physics/{n}", "/recipes/{n}.html", "/weather/today/{n}", "/docs/install/{n}", "/music/albums/{n}", "/travel/maps/{n}", "/books/{n}")
HOSTS, SEED = 500, 11

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: The least at which nothing but one in a hundred blocked urls of held-out hosts is clean.
THRESHOLD = 0.4


def labelled_urls(hosts: int = HOSTS, seed: int = SEED, without: frozenset[str] = frozenset()) -> list[tuple[str, str, int]]:
    """Rows (host, path, label): hosts of a blocked word with one or two others, and three times as many of allowed words or made-up ones.

    Paths are drawn alike for both, but for every tenth row, whose host is made up and whose path tells. `without`: names of hosts to leave out.
    """
    pick = random.Random(seed)

    def invented() -> str:
        return "".join(pick.choice("bcdfghjklmnprstvwz") + pick.choice(("a", "e", "i", "o", "u", "ou", "ea", "")) + pick.choice(("", "n", "r", "s", "th", "sh", "nd")) for _ in range(pick.randrange(2, 5)))

    def name(words: tuple[str, ...]) -> str:
        parts = [pick.choice(words), *pick.choices((*words, *SHARED_WORDS), k=pick.choice((0, 1, 1, 1, 2)))]
        pick.shuffle(parts)
        return pick.choice(("-", "-", "", "")).join(parts) + pick.choice(("", "", "", "1", "24"))

    rows = []
    for i in range(4 * hosts):
        label = int(i % 4 == 0)
        by_path = i % 10 == 0
        host = invented() if by_path or (not label and i % 2) else name(BLOCKED_WORDS if label else ALLOWED_WORDS)
        path = pick.choice((BLOCKED_PATHS if label else ALLOWED_PATHS) if by_path else PATHS)
        if host not in without:
            rows.append((pick.choice(SUBDOMAINS) + host + pick.choice(SUFFIXES), path.format(n=pick.randrange(10_000)), label))
    return rows


def features(hosts: list[str], paths: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every hashed n-gram; host and path are marked so that their n-grams differ."""
    data = [f"\x01{h}\x02{p}\x03".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)]
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    lengths = np.array([len(x) for x in data])
    row = np.repeat(np.arange(len(data)), lengths)
    part = np.concatenate([np.arange(len(x)) > x.index(b"\x02") for x in data])
    rows, cells = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        same = row[: len(row) - n + 1] == row[n - 1 :]
        h = np.full(int(same.sum()), n, np.uint64)
        at = np.flatnonzero(same)
        for i in range(n):
            h = h * np.uint64(257) + text[at + i] + np.uint64(1)
        h = mix64(h ^ (part[at].astype(np.uint64) << np.uint64(60)))
        rows.append(row[at])
        cells.append((h % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cells)


def train(rows: list[tuple[str, str, int]], buckets: int = BUCKETS, steps: int = 300, rate: float = 20.0, penalty: float = 1e-4) -> np.ndarray:
    """Weights, the last one the intercept, by full-batch gradient descent on length-normalised counts."""
    r, c = features([x[0] for x in rows], [x[1] for x in rows], buckets)
    y = np.array([x[2] for x in rows], float)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(r, minlength=len(rows))))
    weights, bias = np.zeros(buckets), 0.0
    balance = 1 / max(1, len(rows))  # classes as they come: what has no known n-gram falls to the larger one
    for _ in range(steps):
        z = np.bincount(r, weights[c], minlength=len(rows)) * norm + bias
        g = (1 / (1 + np.exp(-z)) - y) * balance
        weights -= rate * (np.bincount(c, (g * norm)[r], minlength=buckets) + penalty * weights)
        bias -= rate * g.sum()
    return np.append(weights, bias)


def score(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    buckets = len(weights) - 1
    r, c = features(hosts, paths, buckets)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(r, minlength=len(hosts))))
    z = np.bincount(r, weights[c], minlength=len(hosts)) * norm + weights[-1]
    return np.where([bool(h or p) for h, p in zip(hosts, paths)], 1 / (1 + np.exp(-z)), 0.0)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. Rules are tried from the longest on."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda x: len(x[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(weights.value, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "score"])

    return run


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: list[tuple[str, str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    slim = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    weights = pages.sparkSession.sparkContext.broadcast(train(labelled if labelled is not None else labelled_urls()))
    kind = slim.schema["page_id"].dataType.simpleString()
    scored = slim.mapInArrow(_scored(weights), f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "score")
