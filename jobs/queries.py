"""The jobs as queries over the given tables: each runs twice into one new folder, and returns the whole output as it stands then; and their SQL."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcycle.plans import demo, queries_models
from seqcycle.sources.shared import new_folder

from . import arriving_libraries, frame_normalised_reads
from .common import configured


def _config(job):
    return configured(job.Config, str(Path(job.__file__).with_suffix(".json")))


def job1_frame_normalised_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job1")
    for _ in range(2):
        frame_normalised_reads.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet", output, _config(frame_normalised_reads))
    return frame_normalised_reads.written(spark, output)


def job2_arriving_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three tables in one: (dataset, library, length, cycle, name, value)."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        arriving_libraries.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint", _config(arriving_libraries))
    return flat(arriving_libraries.written(spark, f"{folder}/output"))


_FIT = ("reads", "n_cycles", "intercept", "amplitude", "phase_degrees", "r2")
_LIBRARY = (
    "n_total", "n_invalid", "best_length", "best_length_read_count", "max_r2", "best_length_min_base_r2", "best_length_max_base_r2", "n_eligible_lengths", "min_eligible_length", "max_eligible_length",
    "median_mean_r2", "mean_mean_r2_across_lengths",
)


def flat(tables: dict[str, DataFrame]) -> DataFrame:
    def values(names: tuple[str, ...]) -> F.Column:
        return F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (F.round(F.col(n).cast("double"), 5) + 0.0).alias("value")) for n in names]))

    null = F.lit(None).cast("int")
    parts = [
        tables["cells"].select(F.lit("cells").alias("dataset"), "library", "length", "cycle", F.col("token").alias("name"), F.col("n").cast("double").alias("value")),
        tables["fits"].select(F.lit("fits").alias("dataset"), "library", "length", null.alias("cycle"), "base", "status", values(_FIT))
        .withColumn("name", F.concat_ws(":", "base", "status", "name")).drop("base", "status"),
        tables["libraries"].select(F.concat(F.lit("libraries:"), "category").alias("dataset"), F.col("sample").alias("library"), null.alias("length"), null.alias("cycle"), values(_LIBRARY)),
    ]
    return reduce(DataFrame.unionByName, parts).select("dataset", "library", F.col("length").cast("long").alias("length"), F.col("cycle").cast("long").alias("cycle"), "name", "value")


QUERIES = {"job1_frame_normalised_reads": job1_frame_normalised_reads, "job2_arriving_libraries": job2_arriving_libraries}

# ---- the same in SQL

_FEATURES = """SELECT 'c' || (p_partkey % 5) AS contig, p_partkey * 100 AS start, p_partkey * 100 + p_size * 15 AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    (p_partkey % 3)::INTEGER AS phase, 'cds' || p_partkey AS identifier FROM part"""
_FUNNEL = queries_models._FUNNEL.replace(demo.FEATURES, _FEATURES)
_ONLY = "CASE WHEN reason = 'written' THEN {} END AS {}"
_C = _config(arriving_libraries)
_SHARES = "s{0} / n{0}::DOUBLE / reads"
_FITTED = "CASE WHEN n0 > 0 AND n1 > 0 AND n2 > 0 THEN {} END"

ORACLE_SQL = {
    "job1_frame_normalised_reads": f"""WITH {_FUNNEL} SELECT read_id, flag, ref_start, ref_end, {_ONLY.format('identifier', 'cds_identifier')}, {_ONLY.format('strand', 'cds_strand')},
  {_ONLY.format('ph::INTEGER', 'phase')}, {_ONLY.format('t5::INTEGER', 'trim5')}, {_ONLY.format('t3::INTEGER', 'trim3')}, {_ONLY.format('corrected', 'corrected')}, reason, contig FROM final""",
    "job2_arriving_libraries": f"""
WITH d AS (SELECT coalesce({_C.columns['library']}, '') AS library, {_C.columns['seq'].replace("'')", "'', 'g')", 1)} AS s FROM documents),
r AS MATERIALIZED (SELECT library, substring(s, i, {_C.tile}) AS seq FROM (SELECT *, unnest(range(1, length(s) + 1, {_C.tile})) AS i FROM d WHERE length(s) > 0)),
v AS MATERIALIZED (SELECT library, seq, length(seq)::BIGINT AS length, regexp_full_match(seq, '[ACGT]+') AS fine FROM r),
cells AS MATERIALIZED (
  SELECT library, length, 0::BIGINT AS cycle, CASE WHEN fine THEN '+' ELSE '-' END AS token, count(*) AS n FROM v GROUP BY ALL
  UNION ALL SELECT library, length, i, substring(seq, i, {_C.k}), count(*) FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM v WHERE fine) GROUP BY ALL
), lengths AS (SELECT library, length, n AS reads FROM cells WHERE cycle = 0 AND token = '+' AND n >= {_C.min_read_count}),
dense AS (
  SELECT l.library, l.length, reads, i AS cycle, base, coalesce(sum(n), 0) AS n
  FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM lengths) l CROSS JOIN (VALUES ('A'), ('T'), ('G'), ('C')) AS b(base)
  LEFT JOIN cells c ON c.library = l.library AND c.length = l.length AND c.cycle = i AND c.token[1] = base WHERE i BETWEEN {_C.start} AND {_C.end} GROUP BY ALL
), sums AS (
  SELECT library, length, base, max(reads) AS reads, count(*) AS n_cycles, coalesce(sum(n) FILTER (cycle % 3 = 0), 0) AS s0, coalesce(sum(n) FILTER (cycle % 3 = 1), 0) AS s1, coalesce(sum(n) FILTER (cycle % 3 = 2), 0) AS s2,
    count(*) FILTER (cycle % 3 = 0) AS n0, count(*) FILTER (cycle % 3 = 1) AS n1, count(*) FILTER (cycle % 3 = 2) AS n2, (count(*) * sum(n * n) - sum(n) * sum(n))::DOUBLE AS spread, sum(n)::DOUBLE AS total
  FROM dense GROUP BY ALL HAVING count(*) >= 3
), waves AS (
  SELECT *, {_SHARES.format(0)} AS m0, {_SHARES.format(1)} AS m1, {_SHARES.format(2)} AS m2 FROM sums
), fits AS (
  SELECT library, length, base, reads, n_cycles, CASE WHEN n0 * n1 * n2 = 0 THEN 'degenerate' WHEN n_cycles < 9 THEN 'skipped' ELSE 'ok' END AS status,
    (m0 + m1 + m2) / 3 AS intercept, 2.0 / 3 * (m0 + m1 * cos(2 * pi() / 3) + m2 * cos(4 * pi() / 3)) AS c, 2.0 / 3 * (m1 * sin(2 * pi() / 3) + m2 * sin(4 * pi() / 3)) AS s,
    CASE WHEN spread <= 0 THEN 0 ELSE least(greatest((n_cycles * (s0::DOUBLE * s0 / n0 + s1::DOUBLE * s1 / n1 + s2::DOUBLE * s2 / n2) - total * total) / spread, 0), 1) END AS r2 FROM waves
), best AS (
  SELECT library, length, max(reads) AS reads, avg(r2) AS m, min(r2) AS low, max(r2) AS high FROM fits WHERE status = 'ok' GROUP BY ALL HAVING count(*) = 4
), top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY library ORDER BY m DESC, reads DESC, length) = 1),
per AS (SELECT library, count(*) AS k, min(length) AS lo, max(length) AS hi, median(m) AS med, avg(m) AS mean FROM best GROUP BY ALL),
qc AS (SELECT library, sum(n) AS total, coalesce(sum(n) FILTER (token = '-'), 0) AS bad FROM cells WHERE cycle = 0 GROUP BY ALL),
out AS (
  SELECT 'cells' AS dataset, library, length, cycle, token AS name, n::DOUBLE AS value FROM cells
  UNION ALL SELECT 'fits', library, length, NULL, base || ':' || status || ':' || u.name, round(u.value, 5) + 0.0 FROM fits, unnest([
    {{'name': 'reads', 'value': reads::DOUBLE}}, {{'name': 'n_cycles', 'value': n_cycles::DOUBLE}}, {{'name': 'intercept', 'value': intercept}}, {{'name': 'amplitude', 'value': sqrt(c * c + s * s)}},
    {{'name': 'phase_degrees', 'value': degrees(atan2(s, c)) - 360 * floor(degrees(atan2(s, c)) / 360)}}, {{'name': 'r2', 'value': r2}}]) AS t(u)
  UNION ALL SELECT 'libraries:' || CASE WHEN regexp_matches(qc.library, '(?i)^(SRR|ERR|DRR|PRJ)') THEN 'external_ancient' ELSE 'internal_ancient' END, qc.library, NULL, NULL, u.name, round(u.value, 5) + 0.0
  FROM qc LEFT JOIN top USING (library) LEFT JOIN per USING (library), unnest([
    {{'name': 'n_total', 'value': total::DOUBLE}}, {{'name': 'n_invalid', 'value': bad::DOUBLE}}, {{'name': 'best_length', 'value': length::DOUBLE}}, {{'name': 'best_length_read_count', 'value': reads::DOUBLE}},
    {{'name': 'max_r2', 'value': m}}, {{'name': 'best_length_min_base_r2', 'value': low}}, {{'name': 'best_length_max_base_r2', 'value': high}}, {{'name': 'n_eligible_lengths', 'value': k::DOUBLE}},
    {{'name': 'min_eligible_length', 'value': lo::DOUBLE}}, {{'name': 'max_eligible_length', 'value': hi::DOUBLE}}, {{'name': 'median_mean_r2', 'value': med}}, {{'name': 'mean_mean_r2_across_lengths', 'value': mean}}]) AS t(u)
) SELECT * FROM out""",
}
