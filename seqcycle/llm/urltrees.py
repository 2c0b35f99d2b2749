"""URL filter: rules first, then gradient-boosted trees on lexical features.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path is what
follows up to ``?``, ``#`` or the end. A rule (host, path) fits its host and all subdomains of it if the path starts with the
rule's; the longest rule that fits decides. The rest is judged by trees trained on labelled URLs (1 is block) and on nothing else. The
features: lengths of URL, host and path; numbers of labels, hyphens, path parts, parameters, and letter-digit changes; ratios of digits in host
and path; entropies of host and path; whether there is a fragment or an extension; and statistics of five suffixes (the host's last label, its last two, the path's first
part, that part with the last label, and the extension), each the share of blocked URLs in its bucket, drawn to the overall share where there are few.
Statistics are counted over all labelled rows, into ``BUCKETS`` hashed buckets, so what is sent to the executors has a fixed size.
Where the labels themselves come from rules, the suffixes that rules name say nothing about other URLs; ``named_by`` tells which,
and ``train`` masks them, so the trees cannot learn the rules back.

Trees are grown by histograms of at most 32 bins, level by level, on second-order gains of the logistic loss, on a bounded sample of
distinct labelled URLs (at most ``SAMPLE`` of them and ``SAMPLE_BYTES`` bytes, whole, by hash of the URL), each with the share of its labels and weighed by its rows. All
rows of one host together weigh as much as those of any other, so no leaf learns a few large hosts by their features. Hosts fall into two halves
by hash, and a row trains with the statistics of the other half, so its own label never reaches its features. Trees of one half judge the other, which gives
the limit: the score that at most ``FALSE_BLOCKS`` of the allowed weight exceeds, and at least 0.5. A URL without a rule is blocked above the limit.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path, no rule, and is judged by the trees as an
empty text. Repeated rows are judged alike; null ids pass through; extra columns are ignored. A labelled URL that does not fit within the bytes that are left is
skipped. Without labelled rows of both classes, URLs without a rule are allowed, or blocked if all labelled rows are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, pieces, written

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE, SAMPLE_BYTES, BUCKETS, BINS, TREES, LEVELS, RATE, SMOOTH, FALSE_BLOCKS = 20_000, 20_000_000, 1 << 14, 32, 60, 4, 0.15, 20.0, 0.05
#: The suffixes that have statistics.
SUFFIXES = ("last", "two", "part", "pair", "extension")
#: How many features ``lexical`` gives.
FEATURES = 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str, host_: str, path_: str) -> list[float]:
    """Features of the text alone."""
    query = url.partition("#")[0].partition("?")[2]
    parts = [x for x in path_.split("/") if x]
    digits = lambda s: sum(map(str.isdigit, s)) / len(s) if s else 0.0
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(host_ + path_, (host_ + path_)[1:], strict=False))
    return [
        len(url), len(host_), len(path_), host_.count(".") + 1, host_.count("-"), len(parts), len([x for x in query.split("&") if x]), changes,
        digits(host_), digits(path_), _entropy(host_), _entropy(path_), float("#" in url), float(bool(parts) and "." in parts[-1]), max(map(len, host_.split("."))),
    ]


def bucket(suffix: str) -> int:
    return zlib.crc32(suffix.encode()) % BUCKETS


def suffixes(host_: str, path_: str) -> list[int]:
    """The buckets of a URL's suffixes."""
    labels = host_.split(".")
    part, name = path_[1:].partition("/")[0], path_.rpartition("/")[2]
    extension = name.rpartition(".")[2] if "." in name else ""
    return [bucket(labels[-1]), bucket("2:" + ".".join(labels[-2:])), bucket("p:" + part), bucket(f"q:{labels[-1]}/{part}"), bucket("x:" + extension)]


def _suffixes(host_: Column, path_: Column) -> Column:
    """array<long>: the same in SQL functions."""
    labels = F.split(host_, r"\.", -1)
    last, two = F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    part, name = F.element_at(F.split(F.substr(path_, F.lit(2)), "/", -1), 1), F.substring_index(path_, "/", -1)
    extension = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    names = [last, F.concat(F.lit("2:"), two), F.concat(F.lit("p:"), part), F.concat(F.lit("q:"), last, F.lit("/"), part), F.concat(F.lit("x:"), extension)]
    return F.array(*[F.crc32(c.cast("binary")) % BUCKETS for c in names])


def named_by(rules=RULES) -> set[str]:
    """The suffixes whose statistics give away under which of these rules a URL falls: those of the host, and of the path if a rule has one."""
    return {"last", "two", "pair"} | ({"part"} if any(p != "/" for _, _, p in rules) else set()) if rules else set()


@dataclass
class Trees:
    """Boosted trees of one depth: level by level, each node's feature and limit; values of the leaves."""

    start: float
    features: list[np.ndarray]
    limits: list[np.ndarray]
    leaves: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (x[rows, f[at]] > limit[at])
            out += leaf[at - (2**LEVELS - 1)]
        return out


def _cuts(column: np.ndarray) -> np.ndarray:
    """Limits at quantiles, halfway to the next value that occurs, so a value between two groups falls to the nearer one."""
    values = np.unique(column)
    low = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
    low = low[low < values[-1]]
    return (low + values[np.searchsorted(values, low, side="right")]) / 2


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, trees: int = TREES, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Boosting with the logistic loss; every tree has ``LEVELS`` levels, and a node that no split improves sends all rows left."""
    w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    share = min(max(float(np.dot(w, y) / w.sum()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
    out = Trees(math.log(share / (1 - share)), [], [], [])
    if not len(y) or y.min() == y.max():
        return out
    cuts = [_cuts(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), out.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        feature, limit = np.zeros(2**LEVELS - 1, np.int64), np.full(2**LEVELS - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(LEVELS):
            first = 2**level - 1
            local = at - first
            best = np.zeros(2**level)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (BINS + 1) + binned[:, j]
                gs = np.bincount(key, g, 2**level * (BINS + 1)).reshape(2**level, -1)
                hs = np.bincount(key, h, 2**level * (BINS + 1)).reshape(2**level, -1)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                gain = gain[:, : len(c)]
                k = gain.argmax(axis=1)
                top = gain[np.arange(2**level), k]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + 2**level][better] = j
                limit[first : first + 2**level][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = at - (2**LEVELS - 1)
        value = -rate * np.bincount(leaf, g, 2**LEVELS) / (np.bincount(leaf, h, 2**LEVELS) + ridge)
        margin += value[leaf]
        out.features.append(feature)
        out.limits.append(limit)
        out.leaves.append(value)
    return out


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


@dataclass
class Judge:
    trees: Trees
    blocked: np.ndarray  # by half and bucket
    total: np.ndarray
    share: float
    masked: np.ndarray  # which suffixes have no statistics
    limit: float = 0.5

    def rows(self, urls: list[str | None], hosts: list[str], paths: list[str], half: np.ndarray | None = None) -> np.ndarray:
        """Features of each URL; with ``half``, the statistics are those of the other half."""
        text = [lexical(u or "", h, p) for u, h, p in zip(urls, hosts, paths, strict=True)]
        at = np.array([suffixes(h, p) for h, p in zip(hosts, paths, strict=True)], np.int64).reshape(len(urls), len(SUFFIXES))
        if half is None:
            blocked, total = self.blocked.sum(axis=0)[at], self.total.sum(axis=0)[at]
        else:
            blocked, total = 2 * self.blocked[1 - half[:, None], at], 2 * self.total[1 - half[:, None], at]
        statistics = (blocked + SMOOTH * self.share) / (total + SMOOTH)
        statistics[:, self.masked] = self.share
        return np.concatenate([np.array(text, np.float64).reshape(len(urls), FEATURES), statistics], axis=1)

    def scores(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        return _probability(self.trees.margin(self.rows(urls, hosts, paths))) if urls else np.empty(0)


def _limit(scores: np.ndarray, allowed: np.ndarray, share: float) -> float:
    """The smallest score, 0.5 at least, that no more than ``share`` of the allowed weight exceeds."""
    order = np.argsort(-scores, kind="stable")
    above = np.cumsum(allowed[order])
    beyond = np.flatnonzero(above > share * allowed.sum())
    return max(0.5, float(scores[order[beyond[0]]])) if len(beyond) else 0.5


def train(labelled: DataFrame, *, masked: set[str] = frozenset(), sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Judge:
    """``labelled`` has url and label (1: block). Statistics take all rows but those of ``masked`` suffixes; the trees take a sample of distinct URLs."""
    half = F.pmod(F.xxhash64("host"), F.lit(2)).cast("int")
    rows = labelled.where("label in (0, 1) and url is not null").groupBy("url").agg(F.sum(F.col("label").cast("long")).alias("b"), F.count(F.lit(1)).alias("n"))
    rows = rows.select("url", "b", "n", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = written(rows.withColumn("half", half), "labelled")
    found = rows.select("half", "b", "n", F.explode(_suffixes(F.col("host"), F.col("path"))).alias("bucket"))
    blocked, total = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for r in found.groupBy("half", "bucket").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect():  # at most 2 * BUCKETS rows
        blocked[r.half, r.bucket], total[r.half, r.bucket] = r.b, r.n
    count, b, n = rows.agg(F.count(F.lit(1)), F.sum("b"), F.sum("n")).first()
    taken, left = [], sample_bytes
    for r in hashed_sample(rows, "url", count, sample).toLocalIterator():
        left -= (size := len(r.url.encode()))
        if left < 0:
            left += size
        else:
            taken.append(r)
    y, halves = np.array([r.b / r.n for r in taken], np.float64), np.array([r.half for r in taken], np.int64)
    of_host = Counter()
    for r in taken:
        of_host[r.host] += r.n
    w = np.array([r.n / of_host[r.host] for r in taken], np.float64)
    judge = Judge(Trees(0.0, [], [], []), blocked, total, b / n if n else 0.0, np.array([s in masked for s in SUFFIXES]))
    x = judge.rows([r.url for r in taken], [r.host for r in taken], [r.path for r in taken], halves)
    unseen = np.zeros(len(y))
    for k in (0, 1):
        other, own = halves != k, halves == k
        unseen[own] = _probability(grow(x[other], y[other], w[other]).margin(x[own])) if other.any() else 0.0
    judge.trees, judge.limit = grow(x, y, w), _limit(unseen, w * (1 - y), FALSE_BLOCKS)
    return judge


def judged(pages: DataFrame, judge: Judge, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of every row."""
    held = pages.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            urls, hosts, paths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(held.value.scores(urls, hosts, paths))], names=["page_id", "host", "path", "rule", "says", "score"])

    h, p = host(F.col("url")), path(F.col("url"))
    split = pages.select("page_id", "url", h.alias("host"), p.alias("path"))
    name, says = rule(F.col("host"), F.col("path"), rules)
    ready = split.select("page_id", "url", "host", "path", name.alias("rule"), says.alias("says"))
    out = ready.mapInArrow(run, "page_id long, host string, path string, rule string, says string, score double")
    verdict = F.coalesce("says", F.when(F.col("score") > judge.limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
