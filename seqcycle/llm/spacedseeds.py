"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into tokens (runs of letters and digits). A seed is a window of tokens seen through a
fixed mask that ignores some positions, so a substituted token under an ignored position does not hide an overlap. Seeds
of documents meet equal seeds of benchmark items; each hit gives an alignment (a diagonal), and around it every span is judged in which
at least three of four tokens agree (a match counts 1, a substitution -3, and the sum is not below 0). The overlap of an alignment is the span of most matching
tokens, the first of equal ones. A document is contaminated by an item if an overlap has at least ``MIN_MATCH`` matching tokens (all tokens of a
shorter item); an item's overlap of most matches, then of the smallest start in the document, is reported.

The benchmark is the query set: it is taken in blocks of at most ``BLOCK_TOKENS`` tokens, each block is sent to the
executors (its size is bounded by that), and all documents are read against each block. Nothing else moves; a hot
passage stays where its documents are, and a document's hits are worked through in parts of about ``HITS``, so a seed of many windows and many items takes no more memory.

Defined results: null texts count as empty and overlap nothing. Items with fewer than ``MIN_ITEM`` tokens name no passage
and are not searched; items shorter than a mask's span are searched by their whole sequence. Equal items are each reported.
Repeated documents are each judged; a null doc_id is reported as null. Extra columns are ignored. An item longer than a
block is a block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_row, mix64, odd_constants, pieces

#: 1 is a compared position, 0 an ignored one.
MASKS = ("111111", "1110111", "110110101", "1100101011")
MIN_MATCH, MIN_ITEM, PENALTY, BLOCK_TOKENS, HITS = 13, 5, 3, 2_000_000, 1_000_000
_TOKEN = re.compile(r"[^\W_]+")
_BITS = 20

SCHEMA = "item_id long, matched int, overlap_tokens int, doc_start int, item_start int"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _offsets(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def seeds(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """One hash for each window: a sum of token hashes times constants of their positions."""
    n = len(hashes) - int(offsets[-1])
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for at, c in zip(offsets, odd_constants(len(offsets), 1000 + salt), strict=True):
        out += hashes[at : at + n] * c
    return mix64(out)


@dataclass
class Block:
    """Some items with the seeds that find them."""

    ids: list[int | None]
    items: list[np.ndarray]
    masks: list[np.ndarray]  # the offsets of each mask in use
    seed: list[np.ndarray]  # by mask, ascending
    item: list[np.ndarray]  # the item of each seed
    at: list[np.ndarray]  # its position there
    table: list[np.ndarray]  # by mask: which leading bits some seed has

    @classmethod
    def of(cls, ids: list[int | None], items: list[np.ndarray]) -> Block:
        spans = [_offsets(m) for m in MASKS]
        longest = min(int(o[-1]) + 1 for o in spans)
        short = sorted({len(x) for x in items if len(x) < longest})
        out = cls(ids, items, [*spans, *(np.arange(n) for n in short)], [], [], [], [])
        for k, offsets in enumerate(out.masks):
            own = [i for i, x in enumerate(items) if len(x) > offsets[-1] and (k < len(spans) or len(x) == len(offsets))]
            found = [seeds(items[i], offsets, k) for i in own]
            seed = np.concatenate(found) if found else np.empty(0, np.uint64)
            item = np.repeat(np.array(own, np.int64), [len(f) for f in found])
            at = np.concatenate([np.arange(len(f)) for f in found]) if found else np.empty(0, np.int64)
            order = np.argsort(seed, kind="stable")
            table = np.zeros(1 << _BITS, bool)
            table[(seed >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            out.seed.append(seed[order])
            out.item.append(item[order])
            out.at.append(at[order])
            out.table.append(table)
        return out

    def _hits(self, doc: np.ndarray) -> Iterator[np.ndarray]:
        """(item, diagonal) of the seeds that a document shares with items, in parts of about ``HITS`` hits, each without repeats."""
        found, held = [], 0
        for k, offsets in enumerate(self.masks):
            s = seeds(doc, offsets, k)
            near = np.flatnonzero(self.table[k][(s >> np.uint64(64 - _BITS)).astype(np.int64)])
            low, high = np.searchsorted(self.seed[k], s[near]), np.searchsorted(self.seed[k], s[near], side="right")
            count = high - low
            total = np.cumsum(count)
            at = 0
            while at < len(near):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, side="right")))
                here = count[at:upto]
                which = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here) + np.repeat(low[at:upto], here)
                found.append(np.stack([self.item[k][which], np.repeat(near[at:upto], here) - self.at[k][which]], axis=1))
                held, at = held + len(which), upto
                if held >= HITS:
                    yield np.unique(np.concatenate(found), axis=0)
                    found, held = [], 0
        if held:
            yield np.unique(np.concatenate(found), axis=0)

    def _diagonals(self, doc: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(item, diagonal, its start in the document, which tokens are equal) of every alignment that a seed hits."""
        for part in self._hits(doc):
            for item, diagonal in part.tolist():
                mine = self.items[item]
                start, end = max(0, diagonal), min(len(doc), diagonal + len(mine))
                yield item, diagonal, start, doc[start:end] == mine[start - diagonal : end - diagonal]

    def overlaps(self, doc: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, matching tokens, overlap's tokens, its start in the document, in the item), the best for each item."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for item, diagonal, start, equal in self._diagonals(doc):
            at = np.flatnonzero(equal)
            if len(at) < min(MIN_MATCH, len(self.items[item])):
                continue
            # From the i-th match to the j-th, matches less substitutions times the penalty are level[j] - level[i] + 1.
            level = (1 + PENALTY) * np.arange(len(at)) - PENALTY * at
            first = np.searchsorted(-np.minimum.accumulate(level), -(level + 1))  # the earliest match from which the sum is not below 0
            matches = np.arange(len(at)) - first + 1
            j = int(np.argmax(matches))
            i, matched = int(first[j]), int(matches[j])
            if matched >= min(MIN_MATCH, len(self.items[item])) and (item not in best or (-matched, start + at[i]) < (-best[item][0], best[item][2])):
                best[item] = (matched, int(at[j] - at[i]) + 1, start + int(at[i]), start + int(at[i]) - diagonal)
        return [(self.ids[i], *found) for i, found in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[Block]:
    hashes, ids, items, total = WordHashes(), [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        own = hashes.array(tokens(row.text))
        if len(own) < MIN_ITEM:
            continue
        if items and total + len(own) > block_tokens:
            yield Block.of(ids, items)
            ids, items, total = [], [], 0
        ids.append(row.item_id)
        items.append(own)
        total += len(own)
    yield Block.of(ids, items)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, matched, overlap_tokens, doc_start, item_start."""
    docs = docs.select("doc_id", "text")
    out = None
    for block in _blocks(benchmark, block_tokens):
        found = _against(docs, block)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, block: Block) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, 1):
            ids, found = [], []
            for k, text in enumerate(batch.column(1)):
                own = held.value.overlaps(hashes.array(tokens(text.as_py())))
                ids += [k] * len(own)
                found += own
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate([pa.int64(), *[pa.int32()] * 4])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *columns],
                names=["doc_id", "item_id", "matched", "overlap_tokens", "doc_start", "item_start"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def clean(docs: DataFrame, benchmark: DataFrame, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; each row is judged by its own text."""
    for block in _blocks(benchmark, block_tokens):
        docs = docs.where(_touched(docs, block) == F.lit(False))
    return docs


def _touched(docs: DataFrame, block: Block) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def touched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            yield by_row(texts, lambda t: bool(held.value.overlaps(hashes.array(tokens(t)))), pa.bool_())

    return touched("text")
