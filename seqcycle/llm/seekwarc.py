"""Web archives in seekable Zstandard bundles.

Pages become WARC 1.1 records, grouped into frames of about ``FRAME_BYTES`` that are compressed independently; a bundle is the
sequence of its frames and, as its last frame, a skippable one that holds the seek table of the seekable format: the
compressed and decompressed size of every frame, their number, and the magic number by which a reader finds the table from the
end of the file. An index maps each record identifier to bundle, frame, offset in the decompressed frame, and length, so
one record is read by decompressing one frame.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the largest page_id is a response and the
others are revisits of it (profile identical-payload-digest): they hold digest and length of the payload and refer to the
response's identifier, and no payload. Equal payloads are found by grouping digests with a partial maximum in each task,
so a page that a third of all rows share sends one row from each task; payloads join what was found by digest, a join whose hot key adaptive execution splits.

A task writes bundles under names of its own and reports them with its rows; bundles of lost or repeated tasks are never read.

Record identifiers are unique: ``urn:page:`` and the page_id or, where a page_id is null or repeats, that (or ``none``), the bundle and the record's number
there. A revisit refers to its page's identifier, which is that of one record if the page_id does not repeat.

Reading spreads over runs of frames of about ``TASK_BYTES``, one for each task, so no bundle is a task's least share.

Defined results: a null html is an empty payload, a null url an empty target. A row with a null page_id is always
a response and never referred to. Rows that repeat a page_id and its payload are all responses if that page_id is
the largest. A record larger than a frame is a frame of its own. Extra columns are ignored. An empty table makes no bundle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, pieces, written
from .files import make_folder, open_input, open_output

FRAME_BYTES, BUNDLE_BYTES, TASK_BYTES, REVISIT_BYTES, LEVEL = 1 << 18, 1 << 28, 1 << 25, 1000, 3
# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URN = "urn:page:"
#: Records carry no time of capture of their own, so all have one.
_DATE = "1970-01-01T00:00:00Z"


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = _HTTP if refers_to is not None else _HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Refers-To-Payload-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block, and the place after a record that begins at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return headers, data[begin:end], end + 4


class Bundle:
    """Writes records into independent frames, then the seek table."""

    def __init__(self, name: str):
        import zstandard

        self.name, self.out, self.press = name, open_output(name), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.key = name.rpartition("/")[2].partition(".")[0]
        self.waiting, self.size, self.frames, self.written, self.records = [], 0, [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame of a record and its offset there."""
        if self.waiting and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.size
        self.waiting.append(data)
        self.size += len(data)
        self.records += 1
        return place

    def flush(self) -> None:
        if self.waiting:
            frame = self.press.compress(b"".join(self.waiting))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, name: str):
        self.file = open_input(name)
        size = self.file.size()
        self.file.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        width = 12 if descriptor & 0x80 else 8  # entries may have checksums
        self.file.seek(size - 9 - width * count)
        table = self.file.read(width * count)
        self.starts, self.sizes = [0], []
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, width * k)
            self.starts.append(self.starts[-1] + packed)
            self.sizes.append(plain)

    def frame(self, k: int) -> bytes:
        import zstandard

        self.file.seek(self.starts[k])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(self.file.read(self.starts[k + 1] - self.starts[k]))
        if len(data) != self.sizes[k]:
            raise ValueError(f"frame {k} is not as long as the seek table says")
        return data

    def close(self) -> None:
        self.file.close()


_INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def archived(pages: DataFrame) -> DataFrame:
    """Writes the bundles; the index: record_id, page_id, bundle, frame, offset, length of every record."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    make_folder(folder)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.where((F.length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    shared = long.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "newest")
    refers = F.when((F.col("newest") != F.col("page_id")) & (F.length("payload") >= REVISIT_BYTES), F.col("newest"))
    twice = rows.where("page_id is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id", F.lit(False).alias("alone"))
    alone = F.coalesce("alone", F.col("page_id").isNotNull())
    known = rows.join(written(shared, "payloads"), "digest", "left").join(written(twice, "repeated"), "page_id", "left")
    ready = known.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), alone.alias("alone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in pieces(batches, 2):
            out = []
            for row in zip(*batch.columns, strict=True):
                page, url, data, digest, to, alone = (v.as_py() for v in row)
                if bundle is not None and bundle.written + bundle.size > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                name = f"{_URN}{'none' if page is None else page}" + ("" if alone else f":{bundle.key}:{bundle.records}")
                text = record(name, url, data, digest, to)
                frame, offset = bundle.add(text)
                out.append((name, page, bundle.name, frame, offset, len(text)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return written(ready.mapInArrow(run, _INDEX), "index")


_RECORD = "record_id string, page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix(_URN).partition(":")[0]
    return None if name == "none" else int(name)


def _read_back(headers: dict[str, str], block: bytes) -> tuple:
    body = block.partition(b"\r\n\r\n")[2]
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(body).hexdigest() != stated:
        raise ValueError(f"the payload of {headers['warc-record-id']} is not what its digest says")
    return (
        headers["warc-record-id"].strip("<>"), _page(headers["warc-record-id"]), headers["warc-type"], headers.get("warc-target-uri", ""),
        None if revisit else body, int(headers["warc-refers-to-payload-length"]) if revisit else len(body), stated,
        _page(headers["warc-refers-to"]) if revisit else None,
    )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def read(runs: DataFrame) -> DataFrame:
    """All records of the frames ``first`` to ``last`` of the bundles named in the column ``bundle``, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(name)
                for k in range(first, last + 1):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        headers, block, at = parsed(data, at)
                        rows.append(_read_back(headers, block))
                    yield _records(rows)
                reader.close()

    return runs.select("bundle", "first", "last").mapInArrow(run, _RECORD)


def runs(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(bundle, first, last): all frames of an index in runs of about ``task_bytes``, each in a partition of its own."""
    run = F.floor(F.col("frame") / max(1, task_bytes // FRAME_BYTES))
    found = written(index.groupBy("bundle", run.alias("run")).agg(F.min("frame").alias("first"), F.max("frame").alias("last")), "runs")
    return found.repartition(max(1, found.count()))  # a given number of partitions is not coalesced


def lookup(index: DataFrame) -> DataFrame:
    """The records that rows of the index point at, each frame decompressed once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            held, data, rows, reader = (None, None), b"", [], None
            for name, frame, offset in places:
                if held != (name, frame):
                    if held[0] != name:
                        reader = Reader(name)
                    data, held = reader.frame(frame), (name, frame)
                headers, block, _ = parsed(data, offset)
                rows.append(_read_back(headers, block))
            yield _records(rows)

    return index.select("bundle", "frame", "offset").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads the bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(runs(archived(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
