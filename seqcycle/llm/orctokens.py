"""Token identifiers of documents in ORC files, in ascending order of doc_id.

Documents are dealt to ranges of doc_id, sorted, encoded in that order and written by the engine's ORC writer: each range
becomes a file (or several of at most ``FILE_ROWS`` rows) with the columns doc_id, part, at, n and tokens. Integers are run-length encoded by the
format; ``at`` and doc_id grow along a file and so become runs; ``n`` is the number of tokens. A stripe has an index with the least and largest values of every
``INDEX_ROWS`` rows and a Bloom filter on doc_id, so that a reader of a few documents opens only the stripes and the groups of rows that may
hold them, and readers of everything share a file by its stripes.

``at`` counts the identifiers before a document in its own part, which is all that a task knows while it writes. Where a document
starts among all follows when reading: the parts' totals come from a scan of three narrow columns, are summed up in order, and are
joined to the rows. There are as many parts as ``spark.sql.shuffle.partitions`` says at most, so their sums are one small table whatever the input.

The order within equal doc_ids is that of a hash of the text; rows that are equal in both are the same whichever comes first.
A lost task writes the same rows again, and the engine's committer leaves one file of each task.

Defined results: null and empty texts have the end identifier alone. A null doc_id comes first, in the order of its texts' hashes. Repeated
rows are documents each. Strings that look like special tokens are encoded as the vocabulary file says (``special_as_text`` makes them ordinary text).
Extra columns are left out, whatever their names. An empty table makes no rows. Very long texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, written
from .files import open_input

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END, STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES, FILE_ROWS = 2, 16 << 20, 1000, 0.01, 1_000_000
#: Texts of about so many bytes are encoded at a time.
PIECE_BYTES = 1_000_000


@lru_cache(maxsize=1)
def tokenizer(vocabulary: bytes, special_as_text: bool = False) -> Encoder:
    """The encoder of a vocabulary file's content, built once by each Python worker; the engine's tasks are its only parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(vocabulary, special_as_text)


#: Words that a worker remembers, in about 100 MB, and their length at most.
KEPT_WORDS, KEPT_LENGTH = 500_000, 64


def _ranges(wanted: Callable[[str], bool]) -> str:
    """The characters of the first plane that ``wanted`` is true of, as the ranges of a pattern's class."""
    found = [i for i in range(0x10000) if not 0xD800 <= i < 0xE000 and wanted(chr(i))]
    starts = [c for c, before in zip(found, [-2, *found], strict=False) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -2], strict=True) if c + 1 != after]
    return "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in zip(starts, ends, strict=True))


def patterns() -> tuple[re.Pattern, re.Pattern]:
    """How byte-level tokenizers cut a text into words before any merge, and the characters that forbid to do so here.

    Fixed values: words are contractions, letters, digits, or other signs, each with a blank before it or not, and white space. Libraries that know different versions of
    Unicode may class characters differently; those that version 3.2 had are classed alike by all.
    """
    letters, digits = (_ranges(lambda c, k=kind: unicodedata.category(c)[0] == k) for kind in "LN")
    blanks = _ranges(lambda c: c.isspace() and not 0x1C <= ord(c) <= 0x1F)
    cut = f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{digits}]+| ?[^{blanks}{letters}{digits}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    known = _ranges(lambda c: unicodedata.ucd_3_2_0.category(c) != "Cn")
    return re.compile(cut), re.compile(f"[^{known}]")


def _alphabet() -> dict[int, str]:
    """The characters in which byte-level models write bytes: printable ones themselves, the others in turn from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class Encoder(dict):
    """The identifiers of texts, by the library's merges of each word; words met before are remembered.

    Merges never reach across words, so a text's identifiers are those of its words. Texts in which the library would find words or special tokens otherwise, and
    all texts of a vocabulary that is not plainly byte-level, are left to its own call.
    """

    def __init__(self, vocabulary: bytes, special_as_text: bool):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_str(vocabulary.decode())
        self.whole.encode_special_tokens = special_as_text
        said = json.loads(vocabulary)
        cut = said.get("pre_tokenizer") or {}
        self.by_words = (
            not said.get("normalizer") and not said.get("post_processor") and not said.get("truncation") and not said.get("padding") and said["model"].get("type") == "BPE" and not said["model"].get("dropout")
            and not said["model"].get("ignore_merges") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        )
        self.special = [] if special_as_text else [t["content"] for t in said.get("added_tokens", [])]
        self.tokenize, self.alphabet = self.whole.model.tokenize, _alphabet()
        self.words, self.newer = patterns()

    def __missing__(self, word: str) -> bytes:
        ids = array("i", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words or any(t in text for t in self.special) or not text.isascii() and self.newer.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, self.words.findall(text))), np.int32)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, *, end: int = END, special_as_text: bool = False) -> DataFrame:
    """(doc_id, part, at, n, tokens) in ranges of doc_id: part numbers the range, at is the number of identifiers before the document in it, n its own."""
    with open_input(vocabulary) as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = tokenizer(content.value, special_as_text).encode, 0
        for batch in pieces(batches, 2, size=PIECE_BYTES):
            found = [encode(text) for text in batch.column(2).to_pylist()]
            ends = np.cumsum([0] + [len(ids) + 1 for ids in found])
            flat = np.full(ends[-1], end, np.int32)
            for start, ids in zip(ends.tolist(), found, strict=False):
                flat[start : start + len(ids)] = ids
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            narrow = [batch.column(0), batch.column(1), pa.array(at + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64())]
            yield pa.RecordBatch.from_arrays([*narrow, tokens], names=["doc_id", "part", "at", "n", "tokens"])
            at += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part int, at long, n long, tokens array<int>")


def write(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, *, end: int = END, special_as_text: bool = False) -> DataFrame:
    """Writes the files into a new folder (one of the shared folder, if none is named) and returns the table that reads them."""
    path = path or new_path(docs.sparkSession, "orc-tokens")
    rows = encoded(docs, vocabulary, end=end, special_as_text=special_as_text)
    options = {
        "compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES,
        "maxRecordsPerFile": FILE_ROWS, "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    }
    rows.write.options(**options).orc(path)
    return read(docs.sparkSession, path, rows.schema)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table of a folder of such files; a condition on doc_id reaches the stripes' indexes and Bloom filters."""
    return (spark.read.schema(schema) if schema else spark.read).orc(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, base): the number of identifiers in all earlier parts, from the narrow columns of the last document of each."""
    ends = files.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(3)
        ends = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        flat = memoryview(tokens.flatten().to_numpy().astype("<u4")).cast("B")
        sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: identifiers before it, its own number, and the CRC-32 of them as little-endian 32-bit integers."""
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", "part", "at", "tokens").mapInArrow(_checksums, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts(files), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
