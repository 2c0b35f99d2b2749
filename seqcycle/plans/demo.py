"""Deterministic tables of reads, alignments, features, libraries and simulations made from the test tables.

Every adapter exists twice: as a DataFrame, and as the body of a common table expression that says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, ordinal, seq): sequences of 58 to 61 symbols with a planted period of 3, some with an ambiguous symbol."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digits = F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("x"))))
    raw = F.substring(F.translate(digits, "0123456789abcdef", "ACGTACGTACGTAAGG"), 1, 64)
    base = docs.select("doc_id", F.substr(raw, F.lit(1), (58 + F.col("doc_id") % 4).cast("int")).alias("s"))
    seq = (
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("N"), F.substring("s", 2, 64)))
        .when(F.col("doc_id") % 3 == 0, F.regexp_replace("s", "(..).", "$1A"))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.substring("s", 1, 1), F.regexp_replace(F.substring("s", 2, 64), "(..).", "$1A")))
        .otherwise(F.col("s"))
    )
    return base.select(F.concat(F.lit("r"), F.col("doc_id")).alias("read_id"), F.col("doc_id").alias("ordinal"), seq.alias("seq"))


READS = """
  SELECT 'r' || doc_id AS read_id, doc_id AS ordinal,
    CASE WHEN doc_id % 17 = 0 THEN 'N' || substring(s, 2, 64)
         WHEN doc_id % 3 = 0 THEN regexp_replace(s, '(..).', '\\1A', 'g')
         WHEN doc_id % 3 = 1 THEN substring(s, 1, 1) || regexp_replace(substring(s, 2, 64), '(..).', '\\1A', 'g')
         ELSE s END AS seq
  FROM (SELECT doc_id, substring(translate(md5(text) || md5(text || 'x'), '0123456789abcdef', 'ACGTACGTACGTAAGG'), 1, (58 + doc_id % 4)::INTEGER) AS s FROM documents)
"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, flag, mapq, contig, ref_start, ref_end, cigar, seq) from order lines; 0-based half-open places. The first two lines of an order are mates of one name."""
    r = table(spark, sf_dir, "lineitem")
    start = (F.col("l_orderkey") * F.col("l_linenumber") * 7919) % 200000
    length = F.col("l_quantity").cast("long")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 29
    flag = (
        F.when(F.col("l_linestatus") == "F", 16).otherwise(0) + F.when(F.col("l_returnflag") == "A", 1024).otherwise(0)
        + F.when(kind == 0, 4).when(kind == 1, 256).when(kind == 2, 512).when(kind == 3, 2048).otherwise(0)
        + F.when(F.col("l_linenumber") == 1, 65).when(F.col("l_linenumber") == 2, 129).otherwise(0)
    )
    name = F.when(F.col("l_linenumber") <= 2, F.concat(F.col("l_orderkey"), F.lit(":mates"))).otherwise(F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber")))
    cigar = F.when(kind == 4, F.concat(length, F.lit("M1I2M"))).otherwise(F.concat(length, F.lit("M")))
    digits = F.md5(F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber")))
    letters = F.substr(F.translate(F.concat(digits, digits), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), length.cast("int"))
    seq = F.when(kind == 5, F.lit(None)).when(kind == 6, F.concat(F.lit("N"), F.substr(letters, F.lit(2)))).otherwise(letters)
    return r.select(
        name.alias("read_id"), flag.cast("int").alias("flag"), F.round(F.col("l_discount") * 1000).cast("int").alias("mapq"),
        F.concat(F.lit("c"), F.col("l_orderkey") % 6).alias("contig"), start.alias("ref_start"), (start + length).alias("ref_end"), cigar.alias("cigar"), seq.alias("seq"),
    )


ALIGNMENTS = """
  SELECT CASE WHEN l_linenumber <= 2 THEN l_orderkey || ':mates' ELSE l_orderkey || ':' || l_linenumber END AS read_id,
    ((CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END) + (CASE WHEN l_returnflag = 'A' THEN 1024 ELSE 0 END)
     + (CASE kind WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 512 WHEN 3 THEN 2048 ELSE 0 END) + (CASE l_linenumber WHEN 1 THEN 65 WHEN 2 THEN 129 ELSE 0 END))::INTEGER AS flag,
    round(l_discount * 1000)::INTEGER AS mapq, 'c' || (l_orderkey % 6) AS contig, start AS ref_start, start + len AS ref_end,
    CASE WHEN kind = 4 THEN len || 'M1I2M' ELSE len || 'M' END AS cigar,
    CASE WHEN kind = 5 THEN NULL WHEN kind = 6 THEN 'N' || substring(letters, 2) ELSE letters END AS seq
  FROM (SELECT *, substring(translate(md5(l_orderkey || ':' || l_linenumber) || md5(l_orderkey || ':' || l_linenumber), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, len) AS letters
        FROM (SELECT *, (l_orderkey * l_linenumber * 7919) % 200000 AS start, l_quantity::BIGINT AS len, (l_orderkey + l_linenumber) % 29 AS kind FROM lineitem))
"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, start, end, strand, phase, identifier) from parts; every fourth one twice, 30 apart. The last contig has none."""
    p = table(spark, sf_dir, "part")
    copies = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(0), F.lit(30))).otherwise(F.array(F.lit(0)))
    rows = p.select("p_partkey", "p_size", F.explode(copies).alias("shift"))
    start = F.col("p_partkey") * 100 + F.col("shift")
    return rows.select(
        F.concat(F.lit("c"), F.col("p_partkey") % 5).alias("contig"), start.alias("start"), (start + F.col("p_size") * 9).alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("p_partkey") % 3).cast("int").alias("phase"),
        F.concat(F.lit("cds"), F.col("p_partkey"), F.when(F.col("shift") > 0, "b").otherwise("")).alias("identifier"),
    )


FEATURES = """
  SELECT 'c' || (p_partkey % 5) AS contig, p_partkey * 100 + shift AS start, p_partkey * 100 + shift + p_size * 9 AS "end",
    CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, (p_partkey % 3)::INTEGER AS phase,
    'cds' || p_partkey || CASE WHEN shift > 0 THEN 'b' ELSE '' END AS identifier
  FROM part, (VALUES (0), (30)) AS v(shift) WHERE shift = 0 OR p_partkey % 4 = 0
"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, read_length, read_count, observed_read_count, mean_r2, min_base_r2, max_base_r2): one result for each sample and length, from orders."""
    o = table(spark, sf_dir, "orders")
    keyed = o.select(F.concat(F.when(F.col("o_custkey") % 2 == 0, "ERR").otherwise("LIB"), F.col("o_custkey")).alias("sample"), (F.col("o_orderkey") % 40 + 30).cast("int").alias("read_length"), "o_orderkey", "o_totalprice")
    first = keyed.groupBy("sample", "read_length").agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("r")).select("sample", "read_length", "r.*")
    mean = F.floor(F.col("o_totalprice")) % 101 / 100.0
    return first.select(
        "sample", "read_length", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 1000).alias("read_count"), (F.col("o_orderkey") % 1000 + 5).alias("observed_read_count"),
        mean.alias("mean_r2"), (mean * 0.5).alias("min_base_r2"), F.least(mean * 1.25, F.lit(1.0)).alias("max_base_r2"),
    )


LENGTHS = """
  SELECT sample, read_length, CASE WHEN k % 7 <> 0 THEN k % 1000 END AS read_count, k % 1000 + 5 AS observed_read_count,
    m AS mean_r2, m * 0.5::DOUBLE AS min_base_r2, least(m * 1.25::DOUBLE, 1.0::DOUBLE) AS max_base_r2
  FROM (SELECT sample, read_length, min(o_orderkey) AS k, floor(arg_min(o_totalprice, o_orderkey))::BIGINT % 101 / 100.0::DOUBLE AS m
        FROM (SELECT *, (CASE WHEN o_custkey % 2 = 0 THEN 'ERR' ELSE 'LIB' END) || o_custkey AS sample, (o_orderkey % 40 + 30)::INTEGER AS read_length FROM orders)
        GROUP BY sample, read_length)
"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive_data_accession, library_name, project_name, material, region): customers as libraries, every tenth left out."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = c.where(F.col("c_custkey") % 10 != 0).join(n, c.c_nationkey == n.n_nationkey, "left")
    name = F.col("c_custkey").cast("string")
    return rows.select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ERR"), name)).alias("archive_data_accession"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("LIB"), name)).alias("library_name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("project_name"),
        F.when(F.col("c_custkey") % 11 == 0, " N/A ").otherwise(F.col("c_mktsegment")).alias("material"), F.col("n_name").alias("region"),
    )


METADATA = """
  SELECT CASE WHEN c_custkey % 2 = 0 THEN 'ERR' || c_custkey END AS archive_data_accession, CASE WHEN c_custkey % 2 = 1 THEN 'LIB' || c_custkey END AS library_name,
    CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS project_name, CASE WHEN c_custkey % 11 = 0 THEN ' N/A ' ELSE c_mktsegment END AS material, n_name AS region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0
"""


def simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome, bias_5prime, bias_3prime, replicate, base, r2): mean scaled event values, every cell with four bases."""
    e = table(spark, sf_dir, "events")
    bias = F.when(F.col("user_id") % 2 == 0, 0.5).otherwise(0.75)
    cell = e.select(F.col("event_type").alias("genome"), bias.alias("bias_5prime"), F.lit(0.5).alias("bias_3prime"), (F.col("user_id") % 12 / 2).cast("int").alias("replicate"), (F.floor(F.abs(F.col("value")) * 100) % 101).alias("v"))
    cells = cell.groupBy("genome", "bias_5prime", "bias_3prime", "replicate").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    bases = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(i).alias("i")) for i, b in enumerate("ATGC")])).alias("b")
    return cells.select("genome", "bias_5prime", "bias_3prime", "replicate", bases, "s", "n").select(
        "genome", "bias_5prime", "bias_3prime", "replicate", "b.base", ((F.col("s") / F.col("n") + F.col("b.i")) / 110.0).alias("r2")
    )


SIMULATIONS = """
  SELECT genome, bias_5prime, bias_3prime, replicate, base, (s / n::DOUBLE + i) / 110.0::DOUBLE AS r2
  FROM (SELECT genome, bias_5prime, bias_3prime, replicate, sum(v)::DOUBLE AS s, count(*) AS n
        FROM (SELECT event_type AS genome, CASE WHEN user_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS bias_5prime, 0.5::DOUBLE AS bias_3prime,
                floor(user_id % 12 / 2.0::DOUBLE)::INTEGER AS replicate, floor(abs(value) * 100)::BIGINT % 101 AS v FROM events)
        GROUP BY ALL), (VALUES ('A', 0), ('T', 1), ('G', 2), ('C', 3)) AS b(base, i)
"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, ordinal, seq): sequences to sample from, one for each nation."""
    n = table(spark, sf_dir, "nation")
    unit = F.translate(F.md5("n_name"), "0123456789abcdef", "ACGTACGTACGTAAGG")
    return n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ordinal"), F.repeat(unit, (2 + F.col("n_nationkey") % 5).cast("int")).alias("seq"))


CONTIGS = """
  SELECT n_name AS name, n_nationkey AS ordinal, repeat(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTAAGG'), (2 + n_nationkey % 5)::INTEGER) AS seq FROM nation
"""

#: The uniform number of ``functions.sequences.uniform`` in SQL, for one joined text.
UNIFORM = "(('0x' || substr(md5({0}), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0::DOUBLE"
