"""Sources of reads: FASTA, FASTQ, SAM and BAM. All give (source, read_id, ordinal, seq, ...) with upper-case sequences.

A record's place in the input is (file, span, ordinal): the rank of its file, in the order of the given paths and by name within a folder; where the part of the file begins in which
it was read (text that the engine splits); and what grows along that. ``counts.input_order`` names those of a table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from .blocks import Blocked
from .shared import qualified
from .streams import opened, ranges, records, seekable

SPLIT_BYTES = 64_000_000
#: More records than a compressed byte can hold: deflate makes at most 1,032 bytes of one, and a record has 8 or more.
DENSE = 256
REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x10, 0x100, 0x200, 0x400, 0x800


def _lines(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    """(source, file, span, ordinal, value) of text records, split by the engine."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    text = reader.text(paths)
    names = text.inputFiles()
    given = [n for p in paths for n in sorted(spark.read.text(p).inputFiles())] if len(names) > 1 else names
    rows = text.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("span"), F.monotonically_increasing_id().alias("ordinal"), "value",
    )
    if len(given) < 2:
        return rows.withColumn("file", F.lit(0))
    slashes = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    ranks = spark.createDataFrame([(n, k) for k, n in enumerate(dict.fromkeys(given))], "name string, file int").withColumn("name", slashes(F.col("name")))
    return rows.join(ranks, slashes(F.col("source")) == F.col("name")).drop("name")


def _ranked(paths: list[str], parse):
    """``parse`` with the rank of its path added to each row."""
    rank = {p: k for k, p in reversed(list(enumerate(paths)))}

    def run(part: str) -> Iterator[tuple]:
        own = rank[part if part in rank else part.partition(" ")[2]]
        for row in parse(part):
            yield (*row, own)

    return run


def fasta(spark: SparkSession, paths: str | list[str], *, allow_headerless: bool = False, keep_empty: bool = False) -> DataFrame:
    """Records of FASTA text, split at their headers by the engine, so one large file is read by many tasks.

    Sequence before the first header is an error, or with ``allow_headerless`` a record without a name. ``ordinal``
    grows along each split of a file.
    """
    paths = [paths] if isinstance(paths, str) else paths
    rows = _lines(spark, paths, "\n>").withColumn("v", F.regexp_replace("value", "\r", ""))
    if not allow_headerless and (bad := _headerless(spark, spark.read.text(paths).inputFiles())):
        raise ValueError(f"{bad} has sequence before its first header")
    headed = F.when(F.ltrim("v").startswith(">"), F.regexp_replace("v", r"^\s*>", "")).otherwise(F.col("v"))
    header = F.split(headed, "\n", 2)
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(header, F.lit(1)), F.lit("")), r"\s", ""))
    out = rows.select("source", "file", "span", "ordinal", F.get(header, F.lit(0)).alias("description"), seq.alias("seq"))
    out = out.select("source", F.split("description", r"\s", 2)[0].alias("read_id"), "ordinal", "seq", "description", "file", "span")
    return out if keep_empty else out.where("seq <> ''")


def _first(path: str) -> Iterator[tuple]:
    """(path, first symbol that is no white space) of a file that has one."""
    with opened(path) as lines:
        while part := lines.read(4096):
            if part.strip():
                yield (path, part.strip()[:1].decode(errors="replace"))
                return


def _headerless(spark: SparkSession, files: list[str]) -> str | None:
    """One of the files whose first symbol begins no header, told from their first bytes."""
    found = records(spark, files, _first, "path string, symbol string").where("symbol <> '>'").limit(1).collect() if files else []
    return found[0].path if found else None


def _aligned(lines, path: str, start: int) -> None:
    """Moves to the first record that begins at ``start`` or later: a line of ``@`` two lines before one of ``+``, which no line of qualities is."""
    lines.seek(start - 1)
    lines.readline()  # the rest of a line, or the line feed before ``start``
    ahead, places = [], []
    while len(ahead) < 8:
        places.append(lines.tell())
        line = lines.readline()
        if not line:
            break
        ahead.append(line.rstrip(b"\r\n"))
    for i in range(len(ahead) - 3):
        if ahead[i].startswith(b"@") and ahead[i + 2].startswith(b"+") and len(ahead[i + 1].strip()) == len(ahead[i + 3].strip()):
            lines.seek(places[i])
            return
    if len(ahead) == 8:
        raise ValueError(f"{path}: no record begins near byte {start}; it is malformed")
    lines.seek(0, 2)  # what is left belongs to the record before


def _fastq_blocks(path: str, start: int, end: int) -> Iterator[tuple]:
    """The records whose first byte is from a block that begins in a part of a block-compressed file."""
    with seekable(path) as stream:
        data = Blocked(stream, start)
        if start:
            if data.before != b"\n":
                data.line()
            at, ahead, places = data.at, [], []
            for _ in range(8):  # the record that begins at the first of these lines that can be one's header
                places.append(data.at)
                line = data.line()
                if not line:
                    break
                ahead.append(line.rstrip(b"\r\n"))
            fine = (i for i in range(len(ahead) - 3) if ahead[i].startswith(b"@") and ahead[i + 2].startswith(b"+") and len(ahead[i + 1].strip()) == len(ahead[i + 3].strip()))
            found = next(fine, None)
            if found is None:
                if len(ahead) == 8:
                    raise ValueError(f"{path}: no record begins near byte {start}; it is malformed")
                return  # what is left belongs to the record before
            data.at = places[found] if places[found] >= at else at
        number = 0
        while (member := data.member()) is not None and member < end:
            head = data.line()
            if not head.strip():
                continue
            row = _record(path, f"in the block at byte {member}", head, *(data.line() for _ in range(3)))
            if row:
                yield (path, row[0], start * DENSE + number, *row[1:])
            number += 1


def _record(path: str, where: str, *lines: bytes) -> tuple | None:
    """(read_id, seq, qual, description) of a record's four lines; None if it has no sequence."""
    head, seq, plus, qual = (x.rstrip(b"\r\n").decode() for x in lines)
    if not head.startswith("@") or not plus.startswith("+") or len(seq.strip()) != len(qual.strip()):
        raise ValueError(f"{path}: the record {where} is cut off or malformed")
    return (head[1:].split(" ", 1)[0], seq.strip().upper(), qual.strip(), head[1:]) if seq.strip() else None


def _fastq(part: str) -> Iterator[tuple]:
    span, _, path = part.partition(" ")
    start, _, end = span.partition("-")
    if end and path.lower().endswith(".gz"):
        yield from _fastq_blocks(path, int(start), int(end))
        return
    with seekable(path) if end else opened(path) as lines:
        if int(start):
            _aligned(lines, path, int(start))
        while not end or lines.tell() < int(end):
            place = lines.tell()
            if not (head := lines.readline()):
                break
            if not head.strip():
                continue
            row = _record(path, f"at byte {place}", head, *(lines.readline() for _ in range(3)))
            if row:
                yield (path, row[0], place, *row[1:])


def fastq(spark: SparkSession, paths: str | list[str], *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of FASTQ text, plain or gzip; ``ordinal`` grows along a file. Plain and block-compressed files are read in parts of ``split_bytes``, each by a task of its own."""
    paths = [qualified(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    return records(spark, ranges(paths, split_bytes), _ranked(paths, _fastq), "source string, read_id string, ordinal long, seq string, qual string, description string, file int")


def paired(spark: SparkSession, one: str | list[str], two: str | list[str], which: str = "r1") -> DataFrame:
    """The reads of paired FASTQ files (one or several of each mate): r1, r2, or both, the first mates before the second in input order."""
    if which not in ("r1", "r2", "both"):
        raise ValueError("which is r1, r2 or both")
    files = [(k, p) for k, given in ((1, one), (2, two)) if which in (f"r{k}", "both") for p in ([given] if isinstance(given, str) else given)]
    firsts = sum(k == 1 for k, _ in files)
    return fastq(spark, [p for _, p in files]).withColumn("mate", F.when(F.col("file") < firsts, 1).otherwise(2))


SAM_COLUMNS = ("read_id", "flag", "contig", "ref_start", "mapq", "cigar", "seq", "qual", "tags")


def sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of SAM text: read_id, flag, mapq, contig, ref_start and ref_end (0-based, half-open), cigar, seq, qual, tags."""
    lines = _lines(spark, [paths] if isinstance(paths, str) else paths).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t", 12)
    checked = F.when(F.size(f) >= 11, f).otherwise(F.raise_error(F.lit("a SAM line has fewer than 11 fields")).cast("array<string>"))
    rows = lines.select("source", "file", "span", "ordinal", checked.alias("f"))
    start = F.col("f")[3].cast("long") - 1
    # a tag TAG:TYPE:VALUE becomes TAG -> TYPE:VALUE
    tags = F.when(F.size("f") > 11, F.str_to_map(F.get("f", F.lit(11)), F.lit("\t"), F.lit(":")))
    star = lambda c: F.when(c != "*", c)
    out = rows.select(
        "source", F.col("f")[0].alias("read_id"), "ordinal", F.col("f")[1].cast("int").alias("flag"), F.col("f")[4].cast("int").alias("mapq"), star(F.col("f")[2]).alias("contig"),
        start.alias("ref_start"), star(F.col("f")[5]).alias("cigar"), F.upper(star(F.col("f")[9])).alias("seq"), star(F.col("f")[10]).alias("qual"), tags.alias("tags"), "file", "span",
    )
    return out.withColumn("ref_end", F.col("ref_start") + reference_length(F.col("cigar")))


def reference_length(cigar):
    """The number of reference places that an alignment covers."""
    steps = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


_BASES, _STEPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _NUMBERS:
            value = struct.unpack_from(_NUMBERS[kind], data, at)[0]
            at += struct.calcsize(_NUMBERS[kind])
            out[name] = f"{'f' if kind == 'f' else 'i'}:{value}"
        elif kind == "A":
            out[name] = f"A:{chr(data[at])}"
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[name] = f"{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, count = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            width = struct.calcsize(_NUMBERS[sub])
            values = [struct.unpack_from(_NUMBERS[sub], data, at + 5 + width * i)[0] for i in range(count)]
            out[name] = f"B:{sub}," + ",".join(map(str, values))
            at += 5 + width * count
        else:
            raise ValueError(f"unknown tag type {kind}")
    return out


def _header(data: Blocked) -> list[str]:
    """The names of the contigs; what follows is the first record."""
    if data.take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    number = lambda: struct.unpack("<i", data.take(4))[0]
    data.take(number())
    names = []
    for _ in range(number()):
        names.append(data.take(number())[:-1].decode())
        data.take(4)
    return names


def _can_be_record(data: Blocked, at: int, contigs: int, follow: int = 4) -> bool:
    """Whether a record can begin at a place, and others after it, as far as ``follow`` or the end of the file."""
    for _ in range(follow):
        if not data.held(at + 36 - data.at):
            return len(data.data) == at
        size, contig, place, name, _, _, steps, _, length, other, beside = struct.unpack_from("<iiiBBHHHiii", data.data, at)
        if size < 32 or not -1 <= contig < contigs or not -1 <= other < contigs or place < -1 or beside < -1 or name < 1 or length < 0 or size < 32 + name + 4 * steps + (length + 1) // 2 + length:
            return False
        if size > 1 << 28 or not data.held(at + 4 + size - data.at):
            return False
        text = data.data[at + 36 : at + 36 + name]
        if text[-1] or any(not 33 <= c <= 126 for c in text[:-1]):
            return False
        at += 4 + size
    return True


def _bam(part: str) -> Iterator[tuple]:
    """The records whose first byte is from a block that begins in a part of a file."""
    span, _, path = part.partition(" ")
    start, end = map(int, span.split("-"))
    with seekable(path) as stream:
        data = Blocked(stream, 0)
        names = _header(data)
        if start:
            data = Blocked(stream, start)
            while (member := data.member()) is not None and member < end and not _can_be_record(data, data.at, len(names)):
                data.at += 1
        number = 0
        while (member := data.member()) is not None and member < end:
            body = data.take(struct.unpack("<i", data.take(4))[0])
            contig, place, name_size, mapq, _, steps, flag, size = struct.unpack_from("<iiBBHHHi", body)
            at = 32 + name_size
            name = body[32 : at - 1].decode()
            pairs = struct.unpack_from(f"<{steps}I", body, at)
            at += 4 * steps
            packed = body[at : at + (size + 1) // 2]
            at += (size + 1) // 2
            seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:size]
            qual = body[at : at + size]
            quality = None if not size or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
            cigar = "".join(f"{p >> 4}{_STEPS[p & 15]}" for p in pairs) or None
            covered = sum(p >> 4 for p in pairs if _STEPS[p & 15] in "MDN=X")
            known = contig >= 0
            yield (path, name, start * DENSE + number, flag, mapq, names[contig] if known else None, place, place + covered, cigar, seq or None, quality, _tags(body[at + size :]))
            number += 1


def bam(spark: SparkSession, paths: str | list[str], *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alignments of BAM files, with the columns of ``sam``. A file is read in parts of ``split_bytes``, each by a task of its own; ``ordinal`` grows along a file."""
    paths = [paths] if isinstance(paths, str) else paths
    for p in paths:
        if p.lower().endswith(".cram"):
            raise ValueError("CRAM is not supported; convert it to BAM or SAM")
    paths = [qualified(spark, p) for p in paths]
    schema = "source string, read_id string, ordinal long, flag int, mapq int, contig string, ref_start long, ref_end long, cigar string, seq string, qual string, tags map<string,string>, file int"
    return records(spark, ranges(paths, split_bytes), _ranked(paths, _bam), schema)


def as_reads(alignments: DataFrame, *, secondary: bool = False, supplementary: bool = False, qc_fail: bool = False, duplicates: bool = True) -> DataFrame:
    """Alignments as reads in sequenced orientation, without records of the kinds not wanted and those without sequence."""
    mask = (0 if secondary else SECONDARY) | (0 if supplementary else SUPPLEMENTARY) | (0 if qc_fail else QC_FAIL) | (0 if duplicates else DUPLICATE)
    rows = alignments.where((F.col("flag").bitwiseAND(mask) == 0) & F.col("seq").isNotNull())
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    return rows.withColumns({"seq": F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(back, F.reverse("qual")).otherwise(F.col("qual"))})
