"""Block-compressed files in parts: each record once, whatever the parts, against a reader of the whole."""

import gzip
import random
import struct

import pytest

from seqcycle.sources import blocks, sequences, sinks, streams


def blocked(data: bytes, draw: random.Random, most: int = 3000) -> bytes:
    """The bytes in members of random sizes, an empty one among them, and the empty one that ends a file."""
    out, at = [sinks._bgzf(b"")], 0
    while at < len(data):
        size = draw.randrange(1, most)
        out.append(sinks._bgzf(data[at : at + size]))
        at += size
    return b"".join(out) + sinks._LAST


def records_of(draw, n):
    return [(f"r{i}", "".join(draw.choice("ACGTN") for _ in range(draw.randrange(0, 90))), "".join(draw.choice("@+I!A") for _ in range(90))) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_parts_give_each_record_once(spark, tmp_path, end):
    draw = random.Random(2)
    rows = [(name, seq, qual[: len(seq)]) for name, seq, qual in records_of(draw, 400)]
    text = end.join(f"@{name} d{end}{seq}{end}+{name if i % 3 else ''}{end}{qual}" for i, (name, seq, qual) in enumerate(rows)) + end
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(blocked(text.encode(), draw))
    assert gzip.decompress(path.read_bytes()) == text.encode()
    want = [r for r in rows if r[1]]
    for size in (60, 501, 4000, 10**7):
        parts = streams.ranges([str(path)], size)
        got = [t for p in parts for t in sequences._fastq(p)]
        assert [(t[1], t[3], t[4]) for t in got] == want and [t[2] for t in got] == sorted({t[2] for t in got}), size
    df = sequences.fastq(spark, str(path), split_bytes=2000)
    assert df.rdd.getNumPartitions() > 5 and [r.read_id for r in df.orderBy("file", "ordinal").collect()] == [r[0] for r in want]
    (tmp_path / "plain.fastq.gz").write_bytes(gzip.compress(text.encode()))
    assert streams.ranges([str(tmp_path / "plain.fastq.gz")], 60) == [f"0- {tmp_path}/plain.fastq.gz"]
    assert sequences.fastq(spark, str(tmp_path / "plain.fastq.gz")).count() == len(want)


def bam_bytes(rows, contigs=("c1", "c2")):
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 10**6) for c in contigs)
    return head + b"".join(sinks._packed(name, 4, seq, qual[: len(seq)] if i % 2 else None, [("RG", "Z:g"), ("NM", f"i:{i}")]) for i, (name, seq, qual) in enumerate(rows))


def test_bam_parts_give_each_record_once(spark, tmp_path):
    draw = random.Random(7)
    rows = records_of(draw, 300) + [("long", "ACGT" * 9000, "I" * 36_000)] + records_of(draw, 50)
    path = tmp_path / "a.bam"
    path.write_bytes(blocked(bam_bytes(rows), draw))
    for size in (70, 777, 5000, 10**7):
        got = [t for p in streams.ranges([str(path)], size) for t in sequences._bam(p)]
        assert [(t[1], t[9] or "") for t in got] == [(n, s) for n, s, _ in rows] and [t[11]["NM"] for t in got] == [f"i:{i}" for i in range(len(rows))], size
        assert [t[2] for t in got] == sorted({t[2] for t in got})
    df = sequences.bam(spark, str(path), split_bytes=2000)
    assert df.rdd.getNumPartitions() > 5 and [r.read_id for r in df.orderBy("ordinal").collect()] == [r[0] for r in rows]


def test_broken_and_empty_files(tmp_path):
    draw = random.Random(1)
    whole = blocked(bam_bytes(records_of(draw, 40)), draw)
    path = tmp_path / "cut.bam"
    path.write_bytes(whole[: len(whole) - 200])
    with pytest.raises(Exception, match="cut off|incomplete|malformed"):
        list(sequences._bam(f"0-{len(whole)} {path}"))
    (tmp_path / "none.bam").write_bytes(blocked(bam_bytes([]), draw))
    assert list(sequences._bam(f"0-9999 {tmp_path}/none.bam")) == []
    (tmp_path / "other.bam").write_bytes(blocked(b"something else", draw))
    with pytest.raises(ValueError, match="BAM"):
        list(sequences._bam(f"0-9999 {tmp_path}/other.bam"))
    assert blocks.member_size(b"\x1f\x8b\x08\x00" + b"\0" * 30) is None
