"""The filter audit and the ORC token files, against plain versions of both."""

import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcycle.llm import filteraudit, orctokens, queries

SF = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, source string, mask int, part string, n long, at long", "doc_id long, quality int, toxic int, good int"


def documents():
    """Nulls, copies across parts, ties, repeated rows, long and empty texts, and columns named as the operators' own."""
    prose = " ".join(f"w{i}" for i in range(250))
    texts = [
        (1, prose, "a"), (2, prose, "a"), (3, prose, "b"), (3, prose, "b"), (4, None, "b"), (5, "", "a"), (6, "  \t\n ", None), (7, "A B C", None), (8, prose + " $", ""), (9, "x " * 300, "b"),
        (10, prose.upper(), "c"), (None, prose, "c"), (None, None, "c"), (11, "AA" + "b" * 98, "c"), (12, "AA" + "b" * 97, "c"), (13, "one\x0btwo\x0cthree one one", "a"), (14, "y1 y2 " * 50_000, "a"),
        (15, prose, "a"), (0, "late first", "d"), (16, "late first", "d"), (16, "other text", "d"), (17, "Größe ÄÖÜ Ä \xa0 #", "d"),
    ]
    return [(i, t, s, 7, "p", 8, 9) for i, t, s in texts]


LABELLED = [(1, 1, 0, 5), (2, 0, 1, 5), (3, 1, 1, 5), (3, 0, 0, 5), (9, None, 1, 5), (14, 1, None, 5), (None, 1, 1, 5), (99, 1, 1, 5), (8, 1, 0, 5)]


def plain_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(set("#$%&*|") & set(text))}
        failed["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)
        rows.append((source or "", "".join(k for k, v in failed.items() if v), i in good, i in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        shapley, own = Counter(), [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in own if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                found[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def test_audit_equals_plain_version(spark):
    docs, labels = documents(), LABELLED
    got = filteraudit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(docs, labels) and len(got) == 600 * 5


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.audit(docs, labels).count() == 0
    one = filteraudit.audit(spark.createDataFrame(documents()[:1], DOCS), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.shapley) for r in one] == [("a", 1, 0, 0)] * 5


def test_audit_of_other_filters(spark):
    """The general interface takes any conditions, whatever their number."""
    rows = spark.createDataFrame([(1, "ab", "s"), (2, "b", "s"), (3, "ab", "s"), (4, "", "s")], "doc_id long, text string, source string")
    given = {"X": lambda text, words: text.contains("a"), "Y": lambda text, words: F.size(words) == 0}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filteraudit.audit(rows, spark.createDataFrame([], LABELS), given).collect()}
    assert len(got) == 18 and got["XYE", 1] == (2, 2, 0, 9) and got["XYE", 3] == (1, 0, 1, 3) and got["EXY", 1] == (3, 1, 0, 3) and got["EXY", 2] == (2, 1, 1, 9)


def test_audit_reads_texts_once_and_without_python(spark):
    rows = filteraudit.audit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString() + filteraudit.masked(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- token files

def plain_tokens(docs, special_as_text=False):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(orctokens.VOCABULARY)
    made.encode_special_tokens = special_as_text
    out = []
    for i, text in docs:
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_token_files_equal_plain_encoding(spark):
    docs = [(r[0], r[1]) for r in documents()] + [(18, "<|endoftext|> in a text"), (-5, "negative"), (19, "中文 \U0001f600 á " * 30)]
    table = spark.createDataFrame([(*r, 7, 8, 9, 10) for r in docs], "doc_id long, text string, part int, at long, tokens long, tie long").repartition(5)
    for special in (False, True):
        got = orctokens.digests(orctokens.write(table, special_as_text=special)).orderBy("start").collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(plain_tokens(docs, special))
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
        assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in docs if i is not None) and [r.doc_id for r in got[:2]] == [None, None]


def test_no_documents_make_no_tokens(spark):
    assert orctokens.digests(orctokens.write(spark.createDataFrame([], DOCS))).collect() == []


def test_query_covers_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op12_orc_token_ids(spark, SF).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == plain_tokens(docs)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def scanned(df):
    """Rows that the scan of an executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_files_have_stripes_indexes_and_filters(spark, tmp_path, monkeypatch):
    """A reader of few documents is given few rows by the scan: by the ranges of the index, and by Bloom filters for absent identifiers within them."""
    monkeypatch.setattr(orctokens, "STRIPE_BYTES", 64 << 10)
    rows = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(k))) for k in "abc"]).alias("text")).repartition(3)
    path = f"{tmp_path}/tokens"
    files = orctokens.write(rows, path)
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    names = [f.rpartition("/")[2] for f in files.inputFiles()]
    stripes = sum(reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), reader.readerOptions(conf)).getStripes().size() for n in names)
    assert stripes >= 2 * len(names)
    assert files.count() == 20_000 and scanned(files.where("doc_id = 3000").select("doc_id")) <= orctokens.INDEX_ROWS
    absent = [scanned(files.where(f"doc_id = {k}").select("doc_id")) for k in range(2001, 2101, 10)]
    assert sorted(absent)[5] == 0, absent  # within the range of a group, so only the filter can tell
    assert sorted(r.doc_id for r in orctokens.read(spark, path).where("doc_id between 100 and 110").collect()) == [100, 102, 104, 106, 108, 110]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        orctokens.write(rows, path)
