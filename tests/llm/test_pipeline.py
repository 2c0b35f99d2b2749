"""The pipeline's stages, each held against a plain version on its own input."""

import re
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from seqcycle.llm import nbsvm, poissonmix, queries, spacedseeds
from tests.llm.test_pairs import plain_set, roots
from tests.llm.test_texts import plain_spans, poisson_count

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents").withColumn("score", F.lit("mine")).withColumn("base", F.lit(7)).cache()
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "mixing sources to target weights"]
    (_, quality), (_, dedup), (_, clean), (_, pii), (_, mix) = corpus_pipeline.STAGES

    one = quality(spark, docs, SF).cache()
    assert one.columns == columns and one.where("score <> 'mine' or base <> 7").count() == 0
    accepted = {r.doc_id for r in nbsvm.quality(docs.drop("score"), queries.table(spark, SF, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in one.collect()} == accepted
    good = {r.doc_id for r in queries.table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(good - accepted) <= 0.02 * len(good)

    rows = sorted(one.collect(), key=lambda r: r.doc_id)
    sets = [plain_set(r.text) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = {rows[r].doc_id for r in roots(len(rows), links)}
    two = dedup(spark, one, SF).cache()
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(want)

    items = [spacedseeds.tokens(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    runs = {tuple(i[p : p + 13]) for i in items for p in range(len(i) - 12)}
    leaks = lambda t: any(tuple(t[p : p + 13]) in runs for p in range(len(t) - 12))
    three = clean(spark, two, SF).cache()
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not leaks(spacedseeds.tokens(r.text))}

    before = {r.doc_id: r.text for r in three.collect()}
    four = pii(spark, three, SF).cache()
    assert four.columns == columns
    for r in four.collect():
        text = before[r.doc_id]
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in plain_spans(text))
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        assert re.sub(r"\[term\]", "", r.text) == "".join([*out, text[at:]]) and r.n_chars == len(r.text)

    sources = [r.source for r in four.collect()]
    ids = {r.doc_id: r.source for r in four.collect()}
    five = mix(spark, four, SF).collect()
    n = {s: sources.count(s) for s in set(sources)}
    for d, s in ids.items():
        rate = 1.0 / len(n) * len(sources) / n[s]
        assert sum(r.doc_id == d for r in five) == poisson_count(str(d), rate, poissonmix.SEED)


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert set(queries.table(spark, SF, "documents").columns) <= set(rows.columns) and rows.count() > 0


def test_empty_documents(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_dedup_keeps_texts_not_ids(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(1, a), (7, a), (7, b), (7, b), (None, c), (None, c), (None, a), (None, None), (None, None), (9, "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, dedup_key int")
    got = corpus_pipeline.minhash_near_dedup(spark, df, SF)
    assert got.columns == df.columns
    assert sorted(map(repr, got.collect())) == sorted(repr(type(df.first())(doc_id=d, text=t, dedup_key=3)) for d, t in [(1, a), (7, b), (None, c), (None, None), (9, "")])


def test_nulls_repeated_rows_and_long_texts(spark):
    docs = queries.table(spark, SF, "documents")
    good = docs.where("doc_id = 1").first().text
    rows = [(None, good, "en", None, None), (None, None, None, None, None), (7001, good + " more words", None, "s", 5), (7001, good + " more words", None, "s", 5), (7002, "", "en", "s", 0), (7003, "word " * 60000, "en", "s", 1), (7004, None, None, "s", None)]
    mixed = docs.where("doc_id < 40").unionByName(spark.createDataFrame(rows, docs.schema))
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        mixed = stage(spark, mixed, SF).cache()
        seen.append(mixed.count())
        assert set(docs.columns) <= set(mixed.columns)
        if len(seen) == 4:
            cleaned = {(r.doc_id, r.text, r.n_chars) for r in mixed.collect()}
    assert seen[0] >= seen[1] >= seen[2] == seen[3] > 0
    odd = {(d, t, n) for d, t, n in cleaned if d is None or d > 7000}
    assert {d for d, *_ in odd} <= {None, 7001, 7002, 7003, 7004} and all(n == (None if t is None else len(t)) for _, t, n in odd)
    kept = [t for d, t, _ in cleaned if t and good[:40] in t]
    assert len(kept) == 1  # of the text, its longer copies and the row without doc_id, one stays
    assert all(t is None or t == "" or t.startswith("word") or good[:40] in t for _, t, _ in odd)
    weights = {r.source for r in mixed.collect()}
    assert weights <= {None, "s", *(r.source for r in docs.collect())}
