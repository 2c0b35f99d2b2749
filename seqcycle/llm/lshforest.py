"""MinHash near-duplicates by an LSH forest.

Texts are lower-cased in A-Z and cut into words at ASCII white space; a document's set holds its distinct 5-word
shingles, or its whole sequence of words if there are fewer. Equal sets are one node of the search. Every node has
``TREES`` labels, each a sequence of ``DEPTH`` minima of permuted shingle hashes. In each tree the nodes stand in the order of their labels, and
candidates are neighbours in that order, so how deep a prefix two neighbours share adapts to how crowded their region
is: alone in a region, a pair that agrees in its first minimum meets; in a crowded one, the pairs with the longest
common prefixes do. Besides its ``NEAR`` neighbours on either side, each node meets the hubs of its regions of one and of two
common minima: the node whose sketch agrees best with the most frequent values there, such as the text from which a family of copies was made.
Candidates are kept by length and a 64-value sketch, down to 2.6 standard deviations below the
threshold, and confirmed on the full sets, read again from the texts. Linked components follow.

The forest's cost is linear: a node takes part in at most ``TREES * (NEAR + 2)`` candidates of its own, whatever the size of its
region. What it misses, mostly in regions of many texts that share a passage, a prefix-filtered join finds: shingles are put
in an order of rising frequency, and two sets at the threshold share one of the first ``n - ceil(0.75 * n) + 1`` of each. Nodes
that meet there under different components, and could still reach the threshold by their sizes and the shingle's places, are
candidates, confirmed as the others are. Any order gives the same links; it is told from the shingles of all documents, by the upper half of their hashes.
Only pairs of shingles' hashes that are equal by chance could make the result differ from that of all pairs.

Defined results: null texts and texts without words have an empty set, are linked with nothing and kept. Repeated rows
have equal sets, hence one component; one row stands for them all in every later step. Different texts under one doc_id are nodes of their own. A row with a null doc_id is never named by others; its component_id is null and
it is kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, in_few, mix64, odd_constants, pieces, remove, written

TREES, DEPTH, NEAR, WORDS = 24, 8, 3, 5
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
_SKETCH = 64  # 4-bit values
_KEY = 1 + 2 * DEPTH + 8 + 4 + _SKETCH // 2
_CHUNK = 1 << 16
#: Sets that are sent with one copy of their hub's.
MEMBERS = 512
_FEATURES = "doc_id long, set_key binary, n_shingles long, signature binary, prefix array<long>"
#: Shingles are ordered by frequency from this number of sets on; of rarer ones, a pair of sets meets under few.
COMMON = 4
#: Of the count of all shingles: documents in a range, about; shingles that a task sorts at once; buckets that are sent to all tasks.
_SHARE, _TALLY, _HELD = 2_000, 1 << 22, 1 << 22
_SEED = 20240607


@lru_cache
def _places(k: int) -> np.ndarray:
    return odd_constants(k, _SEED)


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a whole text, as ascending 64-bit hashes."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not parts:
        return np.empty(0, np.uint64)
    h = hashes.array(parts)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i, c in enumerate(_places(k)):
        out += h[i : len(h) - k + 1 + i] * c
    return np.unique(mix64(out))


_A = odd_constants(TREES * DEPTH, _SEED, np.uint32)
_B = mix64(np.arange(TREES * DEPTH, dtype=np.uint64) + np.uint64(_SEED)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` minima, each mixed down to 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 512):
        block = x[start : start + 512, None] ^ _B
        block *= _A
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(low, block.min(axis=0), out=low)
    return (mix64(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _tallied(bits: int):
    """A task's shingles by bucket, one for each set that has it: sorted, cut into ``2**bits`` ranges, as differences whose bytes of equal weight stand together."""

    def packed(waiting: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate(waiting))
        cuts = np.searchsorted(buckets, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.uint32))
        blocks = [np.diff(part, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for part in np.split(buckets, cuts)]
        return pa.RecordBatch.from_arrays([pa.array(range(1 << bits), pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, waiting, held = WordHashes(), [], 0
        for batch in pieces(batches):
            for text in batch.column(0):
                waiting.append(_buckets(shingle_set(text.as_py(), hashes)))
                held += len(waiting[-1])
            if held >= _TALLY:
                yield packed(waiting)
                waiting, held = [], 0
        if held:
            yield packed(waiting)

    return run


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _counted(table: pa.Table) -> pa.Table:
    """The buckets of one range that ``COMMON`` sets or more share, and how many do."""
    blocks = [np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().cumsum(dtype=np.uint32) for b in table.column("block").to_pylist()]
    buckets, counts = np.unique(np.concatenate(blocks), return_counts=True)
    at = counts >= COMMON
    return pa.table({"bucket": pa.array(buckets[at].astype(np.int64)), "n": pa.array(counts[at].astype(np.int64))})


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of common shingles, ascending, and in how many of all documents' sets each stands; at most ``_HELD`` of them, the most frequent ones."""
    bits = min(16, (docs.count() // _SHARE).bit_length())
    tallies = docs.select("text").mapInArrow(_tallied(bits), "part int, block binary")
    common = written(tallies.groupBy("part").applyInArrow(_counted, "bucket long, n long"), "common")
    sizes = {r.power: r.n for r in common.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # powers of two
    least, total = 1 << 62, 0
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > _HELD:
            break
        least = 1 << power
    found = common.where(F.col("n") >= least).toArrow()
    remove(common)
    buckets, counts = found.column("bucket").to_numpy().astype(np.uint32), found.column("n").to_numpy().astype(np.uint32)
    order = np.argsort(buckets)
    return buckets[order], counts[order]


def prefix(shingles: np.ndarray, frequencies: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles, in order, of which two sets at the threshold share at least one; those that are not common are as rare as each other."""
    own, (common, counts) = _buckets(shingles), frequencies
    rank = np.zeros(len(own), np.uint32)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], rank)
    order = np.lexsort((shingles, rank))
    n = len(shingles)
    return shingles[order[: n - -(-SIMILAR * n // 100) + 1]].view(np.int64) if n else shingles.view(np.int64)


def _featured(docs: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in pieces(batches, 1):
            keys, sizes, signatures, prefixes = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                signatures.append(signature(s).tobytes() if len(s) else b"")
                prefixes.append(prefix(s, held.value))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            rarest = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), rarest],
                names=["doc_id", "set_key", "n_shingles", "signature", "prefix"],
            )

    return docs.mapInArrow(run, _FEATURES)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sortable key for each node and tree: tree, label, node, size, sketch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(n, TREES, DEPTH)
        flat = (sig.reshape(n, -1)[:, :: TREES * DEPTH // _SKETCH] & 15).astype(np.uint8)
        out = np.empty((n, TREES, _KEY), np.uint8)
        out[:, :, 0] = np.arange(TREES, dtype=np.uint8)
        end = 1 + 2 * DEPTH
        out[:, :, 1:end] = sig.astype(">u2").view(np.uint8).reshape(n, TREES, 2 * DEPTH)
        ids = np.asarray(batch.column(0)).astype(np.int64)
        out[:, :, end : end + 8] = ids.view(np.uint8).reshape(n, 1, 8)
        out[:, :, end + 8 : end + 12] = np.asarray(batch.column(1)).astype(np.uint32).view(np.uint8).reshape(n, 1, 4)
        out[:, :, end + 12 :] = (flat[:, ::2] | (flat[:, 1::2] << 4))[:, None, :]
        step = 4096
        for i in range(0, n, step):
            block = out[i : i + step].reshape(-1, _KEY)
            yield pa.RecordBatch.from_arrays([_binary(block)], names=["key"])


def _binary(rows: np.ndarray) -> pa.Array:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return fixed.cast(pa.binary())


class _Rows:
    """Keys of ``_planted`` in sorted order, as columns."""

    def __init__(self, keys: np.ndarray):
        end = 1 + 2 * DEPTH
        self.keys = keys
        self.first = keys[:, :3].astype(np.uint32) @ np.array([1 << 16, 1 << 8, 1], np.uint32)  # tree and first minimum
        self.node = np.ascontiguousarray(keys[:, end : end + 8]).view(np.int64).ravel()
        self.size = np.ascontiguousarray(keys[:, end + 8 : end + 12]).view(np.uint32).ravel().astype(np.int64)
        packed = keys[:, end + 12 :]
        self.sketch = np.empty((len(keys), _SKETCH), np.uint8)
        self.sketch[:, ::2], self.sketch[:, 1::2] = packed & 15, packed >> 4

    def agreement(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), _CHUNK):
            out[k : k + _CHUNK] = (self.sketch[i[k : k + _CHUNK]] == self.sketch[j[k : k + _CHUNK]]).sum(axis=1)
        return out


#: Of 64 four-bit values, a pair at the threshold agrees in 49 on average with a deviation of 3.4; what agrees in fewer than this is left to the join.
_LEAST = 40


def _candidates(keys: np.ndarray) -> np.ndarray:
    """Pairs of nodes, smaller first, among rows that stand next to each other or under a region's hub."""
    rows, n = _Rows(keys), len(keys)
    left, right = [], []
    for gap in range(1, NEAR + 1):
        i = np.flatnonzero(rows.first[: n - gap] == rows.first[gap:]) if n > gap else np.empty(0, np.int64)
        left.append(i)
        right.append(i + gap)
    for depth in (1, 2):
        begins = np.r_[True, (keys[1:, : 1 + 2 * depth] != keys[:-1, : 1 + 2 * depth]).any(axis=1)] if n else np.empty(0, bool)
        starts = np.flatnonzero(begins)
        counts = np.diff(np.r_[starts, n])
        for start, count in zip(starts[counts > NEAR + 1].tolist(), counts[counts > NEAR + 1].tolist(), strict=True):
            left.append(np.arange(start, start + count))
            right.append(np.full(count, start + _hub(rows.sketch[start : start + count])))
    i, j = np.concatenate(left), np.concatenate(right)
    small, large = np.minimum(rows.size[i], rows.size[j]), np.maximum(rows.size[i], rows.size[j])
    fit = (100 * small >= SIMILAR * large) & (rows.node[i] != rows.node[j])
    i, j = i[fit], j[fit]
    close = rows.agreement(i, j) >= _LEAST
    a, b = rows.node[i[close]], rows.node[j[close]]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def _hub(sketches: np.ndarray) -> int:
    """The row that agrees best with the most frequent value of each place."""
    places = np.arange(_SKETCH) * 16
    votes = np.bincount((sketches + places).ravel(), minlength=16 * _SKETCH).reshape(_SKETCH, 16)
    return int((sketches == votes.argmax(axis=1)).sum(axis=1).argmax())


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, _KEY)


def _pairs_batch(pairs: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    nothing = [None] * len(edges)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*pairs[:, 0].tolist(), *nothing], pa.int64()),
            pa.array([*pairs[:, 1].tolist(), *nothing], pa.int64()),
            pa.array([*[None] * len(pairs), *(e.tobytes() for e in edges)], pa.binary()),
        ],
        names=["a", "b", "edge"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition, and its first and last rows for the stitching across partitions."""
    kept, first = np.empty((0, _KEY), np.uint8), None
    waiting: list[np.ndarray] = []
    none = np.empty((0, 2), np.int64)

    def flush():
        nonlocal kept
        rows = np.concatenate([kept, *waiting])
        waiting.clear()
        kept = rows[-NEAR:]
        return _candidates(rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch)
        if first is None:
            first = rows[:NEAR]
        waiting.append(rows)
        if sum(map(len, waiting)) >= _CHUNK:
            yield _pairs_batch(flush(), kept[:0])
    if waiting:
        yield _pairs_batch(flush(), kept[:0])
    if first is not None:
        yield _pairs_batch(none, np.concatenate([first, kept]))


def _stitched(table: pa.Table) -> pa.Table:
    rows = np.unique(np.frombuffer(b"".join(table.column("edge").to_pylist()), np.uint8).reshape(-1, _KEY), axis=0)
    pairs = _candidates(rows)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    hashes = WordHashes()
    for batch in pieces(batches, 2):
        ids, sets = [], []
        for node, key, text in zip(*batch.columns, strict=True):
            s = shingle_set(text.as_py(), hashes)
            if xxhash.xxh3_128_digest(s.tobytes()) == key.as_py():
                ids.append(node.as_py())
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (hub, salt, member, shingles) in that order, in which the hub's own set, without a member, stands before those of its members."""
    hub, held = None, np.empty(0, np.uint64)
    for batch in pieces(batches, 3):
        hubs, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        good = []
        for h, member, value in zip(hubs, members, batch.column(3), strict=True):
            own = np.frombuffer(value.as_py(), np.uint64)
            if member is None:
                hub, held = h, own
            linked = False
            if member is not None and h == hub:
                small, large = (own, held) if len(own) < len(held) else (held, own)
                shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                linked = 100 * shared >= SIMILAR * (len(own) + len(held) - shared)
            good.append(linked)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _crossed(rows: np.ndarray, group: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """Pairs of nodes of different roots, from whole groups of (shingle, root, node, size, place) in the order of roots; ``group`` marks where one begins.

    ``apart`` holds each row's block, and whether the rows of its group are all of one; if they are not, pairs within a block belong to another group.
    """
    n = len(rows)
    own = group | np.r_[True, rows[1:, 1] != rows[:-1, 1]]

    def ends(begins: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.r_[starts, n])
        return np.repeat(starts + lengths, lengths)

    after, stop = ends(own), ends(group)
    count = stop - after
    busy = np.flatnonzero(count)
    total = np.cumsum(count[busy])
    at = 0
    while at < len(busy):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        i, c = busy[at:upto], count[busy[at:upto]]
        at = upto
        j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(after[i], c)
        i = np.repeat(i, c)
        x, y = rows[i, 3], rows[j, 3]
        most = np.minimum(x - rows[i, 4], y - rows[j, 4])  # shared shingles, if this is the first one
        fit = (100 * np.minimum(x, y) >= SIMILAR * np.maximum(x, y)) & ((100 + SIMILAR) * most >= SIMILAR * (x + y))
        if apart is not None:
            fit &= apart[1][i] | (apart[0][i] != apart[0][j])
        a, b = rows[i[fit], 2], rows[j[fit], 2]
        if len(a):
            yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


_RARE = ("shingle", "root", "node", "size", "place")
_MET = f"a long, b long, block long, {', '.join(f'{c} long' for c in _RARE)}"


def _met_batch(pairs: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """Pairs, and the rows of a block, which is named by its first node."""
    blank = [pa.nulls(len(pairs), pa.int64())] * (1 + len(_RARE))
    named = np.column_stack([np.full(len(block), block[0, 2]), block]) if len(block) else np.empty((0, 1 + len(_RARE)), np.int64)
    left = [pa.concat_arrays([pa.array(pairs[:, k]), pa.nulls(len(block), pa.int64())]) for k in range(2)]
    return pa.RecordBatch.from_arrays([*left, *(pa.concat_arrays([x, pa.array(named[:, k])]) for k, x in enumerate(blank))], names=["a", "b", "block", *_RARE])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates under the shingles that one sorted partition holds whole, and the rows of the other shingles in blocks.

    A partition may share its first and its last shingle with others, and a shingle of more than ``_CHUNK`` rows is not held at once: what such shingles have here
    is handed on in blocks of about that many rows.
    """
    waiting, held, handed = [], 0, None
    none, no_pairs = np.empty((0, len(_RARE)), np.int64), np.empty((0, 2), np.int64)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        """Works off what is waiting but for its last shingle, which is handed on if nothing else waits; ``handed`` is the shingle handed on before."""
        nonlocal waiting, held, handed
        rows = np.concatenate(waiting)
        begins = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        if handed is None:
            handed = rows[0, 0]
        first = (int(begins[1]) if len(begins) > 1 else len(rows)) if rows[0, 0] == handed else 0
        cut = int(begins[-1])
        if first == len(rows):
            yield _met_batch(no_pairs, rows)
            waiting, held = [], 0
            return
        if first:
            yield _met_batch(no_pairs, rows[:first])
        whole = rows[first:cut]
        if len(whole):
            for found in _crossed(whole, np.r_[True, whole[1:, 0] != whole[:-1, 0]]):
                yield _met_batch(found, none)
        rest = rows[cut:]
        if last or len(rest) >= _CHUNK:
            yield _met_batch(no_pairs, rest)
            handed, rest = rest[0, 0], rest[:0]
        waiting, held = [rest], len(rest)

    for batch in batches:
        if batch.num_rows:
            waiting.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
            held += batch.num_rows
            if held >= _CHUNK:
                yield from flush(False)
    if held:
        yield from flush(True)


def _met_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among whole cells of (x, y, block, shingle, root, node, size, place), two blocks of a shingle or one, in the order of cells and roots."""
    waiting, held = [], 0
    cell = [3, 0, 1]

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.r_[True, (rows[1:, cell] != rows[:-1, cell]).any(axis=1)]
        for found in _crossed(rows[:, 3:], group, (rows[:, 2], rows[:, 0] == rows[:, 1])):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
        held += batch.num_rows
        if held >= _CHUNK and (waiting[-1][-1, cell] != waiting[0][0, cell]).any():
            rows = np.concatenate(waiting)
            cut = int(np.flatnonzero((rows[:, cell] != rows[-1, cell]).any(axis=1))[-1]) + 1
            yield from pairs(rows[:cut])
            waiting, held = [rows[cut:]], len(rows) - cut
    if held:
        yield from pairs(np.concatenate(waiting))


def _met_anywhere(rare: DataFrame) -> DataFrame:
    """(a, b): nodes of different roots that meet under a shingle of their prefixes and may reach the threshold.

    Rows are dealt by ranges of (shingle, root, node), so a shingle of any number of rows is spread like all others and no task holds it. Where a shingle came
    apart into blocks, every two of its blocks with more than one root between them meet in a cell of their own.
    """
    order = ["shingle", "root", "node"]
    found = written(rare.select(*_RARE).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_met, _MET), "met")
    rows = found.where("block is not null").select("block", *_RARE)
    blocks = rows.groupBy("shingle", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = (blocks.withColumnsRenamed({"block": side, "low": f"low_{side}", "high": f"high_{side}"}) for side in "xy")
    cells = x.join(y, "shingle").where("x <= y and least(low_x, low_y) < greatest(high_x, high_y)")
    # A pair of blocks that are of several roots each also meets within them; that is the cell of a block and itself.
    sides = cells.select("shingle", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    dealt = rows.join(sides, ["shingle", "block"]).select("x", "y", "block", *_RARE).repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "root")
    pairs = found.where("a is not null").select("a", "b").unionByName(dealt.mapInArrow(_met_in_cells, "a long, b long"))
    met = written(pairs.distinct(), "met")
    remove(found)
    return met


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates that can reach the threshold by what their prefixes share: the rest of a set adds no more than its size."""
    for batch in batches:
        good = []
        for x, y, one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
            one, two = one.values.to_numpy(), two.values.to_numpy()
            most = len(np.intersect1d(one, two, assume_unique=True)) + max(x - len(one), y - len(two))
            good.append((100 + SIMILAR) * most >= SIMILAR * (x + y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates that reach the threshold on their full sets.

    Of a pair, the node of more candidates is the hub; its set is sent once for each ``MEMBERS`` of its members, which are dealt by a salt, and theirs
    stream past it.
    """
    degrees = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    both = pairs.join(degrees.withColumnsRenamed({"node": "a", "degree": "of_a"}), "a").join(degrees.withColumnsRenamed({"node": "b", "degree": "of_b"}), "b")
    first = F.col("of_a") >= F.col("of_b")
    ends = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("of_a", "of_b").alias("degree"))
    salt = F.pmod(F.xxhash64("member"), F.ceil(F.col("degree") / MEMBERS))
    spokes = written(in_few(ends.select("hub", salt.alias("salt"), "member"), pairs.count()), "spokes")
    keys = nodes.join(degrees.select("node"), "node").select("node", F.col("doc_id").alias("of"), "set_key")
    again = docs.join(keys, docs.doc_id == keys.of).select("node", "set_key", "text")
    sets = again.mapInArrow(_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    heads = spokes.select("hub", "salt").distinct().join(sets, F.col("hub") == F.col("node")).select("hub", "salt", F.lit(None).cast("long").alias("member"), "shingles")
    tails = spokes.join(sets, F.col("member") == F.col("node")).select("hub", "salt", "member", "shingles")
    in_order = heads.unionByName(tails).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    links = written(in_order.mapInArrow(_confirmed, "a long, b long"), "links")
    remove(spokes)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    rows = written(_featured(docs).withColumn("row", F.monotonically_increasing_id()), "shingles")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    first = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    nodes = written(first.select("set_key", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id")), "nodes")
    keyed = named.withColumnRenamed("row", "node").join(nodes.select("node"), "node")
    planted = keyed.select("node", "n_shingles", "signature").mapInArrow(_planted, "key binary")
    found = written(
        planted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_neighbours, "a long, b long, edge binary"), "neighbours"
    )
    edges = found.where("edge is not null").select("edge", F.substring("edge", 1, 1).alias("tree"))
    stitched = edges.groupBy("tree").applyInArrow(_stitched, "a long, b long")
    pairs = written(in_few(found.where("a is not null").select("a", "b").union(stitched).distinct(), found.count()), "pairs")

    links = _links(docs, nodes, pairs)
    roots = components(links)
    remove(found)
    remove(pairs)
    remove(links)
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    placed = rooted.join(named.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "prefix"), "node")
    rare = placed.select("node", "root", "size", F.posexplode("prefix").alias("place", "shingle"))
    met = _met_anywhere(rare)
    ends = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    fronts = placed.join(ends, "node", "left_semi").select("node", "size", "prefix")
    two = (
        met.join(fronts.withColumnsRenamed({"node": "a", "size": "size_a", "prefix": "one"}), "a")
        .join(fronts.withColumnsRenamed({"node": "b", "size": "size_b", "prefix": "two"}), "b")
        .select("a", "b", "size_a", "size_b", "one", "two")
    )
    more = written(two.mapInArrow(_likely, "a long, b long").distinct(), "pairs")
    remove(met)
    if not more.isEmpty():
        further = _links(docs, nodes, more)
        if not further.isEmpty():
            roots = components(further.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        remove(further)
    remove(more)
    joined = nodes.join(roots, "node", "left").select("set_key", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("smallest"))
    labels = joined.join(smallest, "root").select("set_key", "smallest")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "set_key")
        .join(labels, "set_key", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
