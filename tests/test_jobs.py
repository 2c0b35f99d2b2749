"""The jobs: queries against SQL, runs over growing input, reruns, runs that were cut off, and the command lines."""

import json
import logging
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import arriving_libraries, frame_normalised_reads, queries
from jobs.common import configured
from tests.test_oracle import SF, canon

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted("|".join(canon(r[c]) for c in columns) for r in df.collect()) == sorted("|".join(canon(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


CONFIG = arriving_libraries.Config({"library": "source", "seq": "upper(text)"}, tile=12, k=2, files_per_batch=1, min_read_count=2, start=1, end=12)
SCHEMA = "doc_id long, text string, source string, extra int"
FIRST = [(1, "ACGTACGTACGTAC", "a", 0), (2, "acgtacgtacgt", "a", 0), (3, None, "a", 0), (4, "", "b", 0), (5, "NCGT", None, 0)]
SECOND = [(6, "ACGGACGGACGG" * 3, "b", 0), (7, "ACGTACGTACGT", "a", 0), (1, "ACGTACGTACGTAC", "a", 0)]


def rows_of(spark, output):
    return sorted(map(repr, queries.flat(arriving_libraries.written(spark, str(output))).collect()))


def arrive(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return folder


@pytest.fixture
def grown(spark, tmp_path):
    """A folder of input, an output and a checkpoint after a first run over a first file."""
    source, output, checkpoint = (tmp_path / n for n in ("in", "out", "check"))
    arrive(spark, FIRST, source, "one")
    arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    return source, output, checkpoint


def at_once(spark, rows, tmp_path):
    source = tmp_path / "whole"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(source))
    arriving_libraries.run(spark, str(source), str(tmp_path / "whole-out"), str(tmp_path / "whole-check"), CONFIG)
    return rows_of(spark, tmp_path / "whole-out")


def test_two_runs_over_growing_input_equal_one_over_all(spark, grown, tmp_path, caplog):
    source, output, checkpoint = grown
    before = rows_of(spark, output)
    deltas = sorted(p.name for p in (output / "deltas").glob("batch=*"))
    with caplog.at_level(logging.INFO, "jobs"):
        arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    assert rows_of(spark, output) == before and "wrote 0 lengths" in caplog.text and "batch" not in caplog.text
    arrive(spark, SECOND, source, "two")
    stamp = (output / "cells/length=4").stat().st_mtime_ns  # no new read of this length
    with caplog.at_level(logging.INFO, "jobs"):
        arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    assert "read 3 rows" in caplog.text
    assert sorted(p.name for p in (output / "deltas").glob("batch=*")) > deltas and (output / "cells/length=4").stat().st_mtime_ns == stamp
    assert rows_of(spark, output) == at_once(spark, FIRST + SECOND, tmp_path)


def test_reads_are_cut_in_one_pass(spark):
    """The given expressions are evaluated once for a row, and no read is sought from the start of its sequence."""
    texts = ["acgt" * 25_000, "a\nb\r\u2028\u00e9\U0001f9ec" * 5, "acgtacgtacgt", "", None]
    rows = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], SCHEMA).repartition(1)
    got = arriving_libraries.reads(rows, CONFIG)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(text") == 1 and "substr" not in plan, plan
    expected = [t.upper()[i : i + 12] for t in texts if t for i in range(0, len(t), 12)]
    assert sorted(r.seq for r in got.collect()) == sorted(expected)


def test_counts_by_hand(spark, grown):
    cells = Counter({(r.library, r.length, r.cycle, r.token): r.n for r in arriving_libraries.written(spark, str(grown[1]))["cells"].collect()})
    assert cells["a", 12, 0, "+"] == 2 and cells["a", 2, 1, "AC"] == 1 and cells["a", 2, 2, "C"] == 1 and cells["", 4, 0, "-"] == 1 and cells["a", 12, 12, "T"] == 2
    assert sum(n for (_, _, cycle, _), n in cells.items() if cycle) == 2 * 12 + 2
    libraries = {r.sample: r for r in arriving_libraries.written(spark, str(grown[1]))["libraries"].collect()}
    assert set(libraries) == {"a", ""} and libraries["a"].best_length == 12 and libraries["a"].n_total == 3 and libraries[""].n_invalid == 1 and libraries[""].best_length is None


def test_a_run_that_was_cut_off_is_finished_by_the_next(spark, grown, tmp_path, monkeypatch):
    source, output, checkpoint = grown
    arrive(spark, SECOND, source, "two")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(arriving_libraries, "bring_up_to_date", lambda *_: (_ for _ in ()).throw(RuntimeError("cut off")))
        arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    real = arriving_libraries._by_partition

    def failing(df, path, *names):
        if path.endswith("/cells"):
            raise RuntimeError("cut off")
        real(df, path, *names)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(arriving_libraries, "_by_partition", failing)
        arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    assert rows_of(spark, output) == at_once(spark, FIRST + SECOND, tmp_path)


def test_a_batch_that_is_run_again_replaces_itself(spark, grown, tmp_path):
    """As after a failure between the output of a batch and the checkpoint's note of it."""
    source, output, checkpoint = grown
    before = rows_of(spark, output)
    for note in (checkpoint / "commits").iterdir():
        note.unlink()
    arriving_libraries.run(spark, str(source), str(output), str(checkpoint), CONFIG)
    assert rows_of(spark, output) == before


def test_no_rows_give_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    arriving_libraries.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), CONFIG)
    assert rows_of(spark, tmp_path / "out") == []


ALIGNED = "read_id string, flag int, mapq int, contig string, ref_start long, ref_end long, cigar string, seq string"
FEATURES = "contig string, start long, end long, strand string, phase int, identifier string"


def test_frames_are_written_by_contig_and_replaced(spark, tmp_path, caplog):
    config = frame_normalised_reads.Config({c.split()[0]: c.split()[0] for c in ALIGNED.split(", ")}, {c.split()[0]: f"`{c.split()[0]}`" for c in FEATURES.split(", ")})
    rows = [("r1", 0, 30, "1", 10, 20, "10M", "ACGTACGTAC"), ("r2", 0, 30, "1", 90, 110, "20M", "A" * 20), ("r3", 4, 0, None, None, None, None, "ACG"), ("r4", 0, 30, "2", 5, 9, "4M", "ACGT")]
    features = spark.createDataFrame([("1", 8, 100, "+", 0, "g")], FEATURES)
    features.write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(rows, ALIGNED).write.parquet(str(tmp_path / "a"))
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "jobs"):
        frame_normalised_reads.run(spark, str(tmp_path / "a"), str(tmp_path / "f"), out, config)
    assert "read 4 alignments" in caplog.text and "wrote 1 rows" in caplog.text
    got = {r.read_id: r for r in frame_normalised_reads.written(spark, out).collect()}
    assert {k: r.reason for k, r in got.items()} == {"r1": "written", "r2": "not_fully_contained_or_antisense", "r3": "unmapped", "r4": "contig_without_cds"}
    assert (got["r1"].corrected, got["r1"].phase, got["r1"].trim5, got["r1"].contig) == ("CGTACGTAC", 2, 1, "1")
    spark.createDataFrame(rows[2:], ALIGNED).write.mode("overwrite").parquet(str(tmp_path / "a"))
    frame_normalised_reads.run(spark, str(tmp_path / "a"), str(tmp_path / "f"), out, config)
    assert sorted(r.read_id for r in frame_normalised_reads.written(spark, out).collect()) == ["r3", "r4"]


def test_a_sequence_is_made_only_of_an_alignment_that_is_tried(spark, tmp_path):
    """Alignments left out by their flag, quality or CIGAR meet no feature, so they are not sent to any, and their sequence is not evaluated."""
    given = {c.split()[0]: c.split()[0] for c in ALIGNED.split(", ")} | {"seq": "if(flag = 4 or mapq < 25, cast(raise_error('made for nothing') as string), seq)"}
    config = frame_normalised_reads.Config(given, {c.split()[0]: f"`{c.split()[0]}`" for c in FEATURES.split(", ")})
    rows = [("r1", 0, 30, "1", 10, 20, "10M", "ACGTACGTAC"), ("r2", 0, 30, None, 10, 20, "10M", "ACGTACGTAC"), ("r3", 4, 0, None, None, None, None, "ACG"), ("r4", 0, 9, "1", 10, 20, "10M", None), ("r5", 0, 30, "1", 10, 20, None, "ACG")]
    spark.createDataFrame([("1", 8, 100, "+", 0, "g"), ("1", 8, 100, "-", 0, "h")], FEATURES).write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(rows, ALIGNED).write.parquet(str(tmp_path / "a"))
    out = str(tmp_path / "out")
    frame_normalised_reads.run(spark, str(tmp_path / "a"), str(tmp_path / "f"), out, config)
    got = {r.read_id: (r.reason, r.corrected) for r in frame_normalised_reads.written(spark, out).collect()}
    none = {"r2": "contig_without_cds", "r3": "unmapped", "r4": "low_mapq", "r5": "complex_cigar_excluded"}
    assert got == {"r1": ("written", "CGTACGTAC")} | {k: (reason, None) for k, reason in none.items()}


def test_configurations_are_checked(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"columns": {}, "tiles": 3}))
    with pytest.raises(ValueError, match="tiles"):
        configured(arriving_libraries.Config, str(tmp_path / "c.json"))
    with pytest.raises(ValueError):
        arriving_libraries.Config(k=4)


def test_command_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"columns": CONFIG.columns, "tile": 12, "k": 2, "min_read_count": 2, "start": 1, "end": 12}))
    arrive(spark, FIRST + SECOND, tmp_path / "in", "one")
    done = subprocess.run(
        [sys.executable, "-m", "jobs.arriving_libraries", tmp_path / "in", tmp_path / "out", tmp_path / "check", "--config", tmp_path / "c.json"], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False
    )
    assert done.returncode == 0 and "read 8 rows" in done.stderr, done.stderr[-2000:]
    assert rows_of(spark, tmp_path / "out") == at_once(spark, FIRST + SECOND, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out/libraries")).agg(F.sum("n_total")).first()[0] == 10
