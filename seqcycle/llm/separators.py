"""Token counts by a separator scan over flat token files.

``tokenise`` writes texts as flat files of 16-bit token identifiers, an end-of-document identifier after each text, and
nothing else: no index, no lengths. ``scan`` gets the documents' lengths back from such files alone. It reads blocks of a
fixed size wherever they fall, finds the separators of a block in one vectorised comparison, and notes their number, the first and last position,
and the lengths between them. A prefix scan over the blocks of a file then says how many documents ended before a block
and where the last one did, which stitches documents across any number of blocks. Files are closed at ``FILE_TOKENS``,
so the scan's groups are bounded, and a document is never split between files (one that is longer makes a longer file).

A task writes files under names of its own and reports them with its rows; files of lost or repeated tasks are never read.

Defined results: null and empty texts have 0 tokens and a separator. Repeated rows are separate documents. A null doc_id
passes through. Strings that look like special tokens are plain text. Extra columns are ignored. An empty table makes no file.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, written
from .files import make_folder, open_input, open_output

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts texts before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END, FILE_TOKENS, BLOCK_TOKENS, TASK_TOKENS = 50256, 64_000_000, 1_000_000, 16_000_000


def encoder(vocabulary: bytes):
    """The tokenizer of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_MANIFEST = "file string, ordinal long, file_tokens long"


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY, *, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token files; (doc_id, file, ordinal, file_tokens).

    A row with an ordinal tells which document of which file a row of ``docs`` became; one without tells the size of a file.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    make_folder(folder)
    with open_input(vocabulary) as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary of 16-bit identifiers

    def rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in found], t) for i, t in enumerate([pa.string(), pa.int64(), pa.int64()])]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "file", "ordinal", "file_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value).encode_ordinary
        out, name, ordinal, total, closed, kind = None, None, 0, 0, [], None
        for batch in pieces(batches, 1):
            places, kind = [], batch.column(0).type
            for text in batch.column(1):
                if out is None:
                    name, ordinal, total = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    out = open_output(name)
                ids = np.array(encode(text.as_py() or "") + [end], np.uint16)
                out.write(ids.tobytes())
                places.append((name, ordinal, None))
                ordinal, total = ordinal + 1, total + len(ids)
                if total >= file_tokens:
                    out.close()
                    out = None
                    closed.append((name, None, total))
            yield rows(batch.column(0), places)
        if out is not None:
            out.close()
            closed.append((name, None, total))
        if closed:
            yield rows(pa.nulls(len(closed), kind), closed)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_MANIFEST}"), "manifest")


_BLOCK = "file string, block long, ends long, first long, last long, lengths array<long>"


def _blocks(end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(name) as f:
                    f.seek(2 * size * block)
                    tokens = np.frombuffer(f.read(2 * size), np.uint16)
                at = np.flatnonzero(tokens == end) + size * block
                rows.append((name, block, len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, np.diff(at) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())])],
                names=["file", "block", "ends", "first", "last", "lengths"],
            )

    return run


def blocks(files: DataFrame, block_tokens: int = BLOCK_TOKENS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(file, block) of all blocks, dealt to as many tasks as their tokens ask for; a given number of partitions is not coalesced."""
    total = files.agg(F.coalesce(F.sum("file_tokens"), F.lit(0))).first()[0]
    parts = files.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("file_tokens") - 1) / block_tokens))).alias("block")).where("block >= 0")
    return parts.repartition(max(1, -(-total // task_tokens)))


def scan(files: DataFrame, *, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in flat token files; ``files`` has file and file_tokens."""
    found = blocks(files, block_tokens).mapInArrow(_blocks(end, block_tokens), _BLOCK)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)))
    lengths = F.concat(F.array(F.col("first") - F.col("open") - 1), "lengths")
    return stitched.where("ends > 0").select("file", "base", F.posexplode(lengths).alias("k", "n_tokens")).select(
        "file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens"
    )


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document, by way of token files and their scan."""
    manifest = tokenise(docs, vocabulary)
    counts = scan(manifest.where("ordinal is null").select("file", "file_tokens"))
    named = manifest.where("ordinal is not null").select("doc_id", "file", "ordinal")
    return named.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")  # rows of files compress too well for their size to be told
