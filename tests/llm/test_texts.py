"""Operators on texts: decontamination, personal data, mixing, quality, token counts."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seqcycle.llm import disclosure, nbsvm, poissonmix, queries, separators, spacedseeds
from seqcycle.llm.common import WordHashes

SF = "/root/testdata/sf0.01"


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


# ---- decontamination

def best_overlap(doc, item, least=13, penalty=3):
    """Every alignment and every segment, the slow way: the most matches of a segment whose sum is not below 0."""
    found = 0
    for d in range(-len(item) + 1, len(doc)):
        pairs = [(doc[i] == item[i - d]) for i in range(max(0, d), min(len(doc), d + len(item)))]
        for a in range(len(pairs)):
            score = matched = 0
            for ok in pairs[a:]:
                score += 1 if ok else -penalty
                matched += ok
                if score >= 0:
                    found = max(found, matched)
    return found if found >= min(least, len(item)) else 0


def test_overlaps_equal_brute_force():
    items = [words(n, 100 + n) for n in (5, 7, 11, 12, 20, 40)]
    draw = random.Random(3)
    docs = []
    for k in range(60):
        text = words(30, k)
        item = draw.choice(items)
        part = list(item[draw.randrange(0, 6) :]) if k % 2 else list(item)
        if k % 3:
            for _ in range(draw.randrange(0, 4)):
                part[draw.randrange(len(part))] = "changed"
        docs.append(text[:15] + part + text[15:] if k % 5 else text)
    hashes = WordHashes()
    block = spacedseeds.Block.of(list(range(len(items))), [hashes.array(i) for i in items])
    missed = 0
    for doc in docs:
        counts = {f[0]: f[1] for f in block.overlaps(hashes.array(doc))}
        got = set(counts)
        want = {i for i, item in enumerate(items) if best_overlap(doc, item)}
        assert got <= want and all(n == best_overlap(doc, items[i]) for i, n in counts.items())
        missed += len(want - got)
        for i in want:  # an untouched run of 8 tokens is always found
            if any(" ".join(items[i][s : s + 13]) in " ".join(doc) for s in range(max(1, len(items[i]) - 12))):
                assert i in got
    assert missed == 0


def test_masks_bear_substitutions():
    item = words(30, 1)
    hashes = WordHashes()
    block = spacedseeds.Block.of([7], [hashes.array(item)])
    for step in (5, 6, 7, 8):
        doc = words(10, 2) + [w if i % step else "other" for i, w in enumerate(item)] + words(10, 3)
        assert block.overlaps(hashes.array(doc)), step


@pytest.mark.parametrize(("n", "changed"), [(15, [2]), (15, [11]), (15, [12]), (16, [12]), (18, [2, 15]), (40, [2, 15, *range(18, 28)])])
def test_every_span_is_judged(n, changed):
    item = words(n, 1)
    hashes = WordHashes()
    block = spacedseeds.Block.of([7], [hashes.array(item)])
    doc = words(10, 2) + [w if i not in changed else "other" for i, w in enumerate(item)] + words(10, 3)
    assert block.overlaps(hashes.array(doc))
    few = words(10, 2) + item[:12] + words(10, 3)
    assert not block.overlaps(hashes.array(few))


def test_hot_seeds_are_worked_through_in_parts(monkeypatch):
    same = ["again"] * 40
    items = [same, words(20, 1) + same, words(20, 2)]
    doc = same * 5 + words(20, 2) + same
    hashes = WordHashes()
    block = spacedseeds.Block.of([0, 1, 2], [hashes.array(i) for i in items])
    whole = block.overlaps(hashes.array(doc))
    monkeypatch.setattr(spacedseeds, "HITS", 50)
    assert len(list(block._hits(hashes.array(doc)))) > 20
    assert block.overlaps(hashes.array(doc)) == whole and [f[:2] for f in whole] == [(0, 40), (1, 40), (2, 20)]


def test_contaminated_edge_cases(spark):
    item = " ".join(words(20, 5))
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}, after!", "x"), (None, item, "y"), (2, None, "z"), (3, "", "z"), (4, "nothing here", "z"), (1, f"Before. {item.upper()}, after!", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.matched) for r in spacedseeds.contaminated(docs, bench, block_tokens=20).collect())
    assert got == sorted((d, i, 20) for d in ("1", "1", "None") for i in (10, 13))
    assert sorted(r.doc_id for r in spacedseeds.clean(docs, bench, block_tokens=20).collect()) == [2, 3, 4]
    assert spacedseeds.contaminated(docs.limit(0), bench).count() == 0 and spacedseeds.contaminated(docs, bench.limit(0)).count() == 0


def test_whole_table_of_documents(spark):
    """All 8-token runs of the benchmark, looked up plainly, name the same documents."""
    docs = {r.doc_id: spacedseeds.tokens(r.text) for r in queries.table(spark, SF, "documents").collect()}
    items = [spacedseeds.tokens(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    runs = {tuple(i[p : p + 13]) for i in items for p in range(len(i) - 12)}
    want = {d for d, t in docs.items() if any(tuple(t[p : p + 13]) in runs for p in range(len(t) - 12))}
    assert {r.doc_id for r in queries.op3_spaced_seed_decontamination(spark, SF).collect()} == want and want


# ---- personal data

def plain_spans(t):
    t = t or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(c if k % 2 == 0 else c * 2 - 9 * (c > 4) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


TEXTS = [
    "a@b.c_d@e.f x@y..z foo@bar.com. q@w a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 999999999999999999999.1.1.1 .1.2.3.4.", "4111 1111 1111 1111 and 4111-1111-1111-1112, 1 2 3 4 5 6 4111-1111-1111-1111-000",
    "+1 (555) 123-4567 +12 +99 1234567 8 9 ++49 30 1234567890", None, "", "\u00e9\U0001f600 a@b.co " + "1 " * 5000 + "x" * 5000 + "." * 100, "\ue000 4111 1111 1111 1111", "1" * 30000, "a.b@c.d-e.f@g.h@i.j +1234567890 4111111111111111",
    "5.5.5.5@x.y 4000000000000002 6.6.6", "@ @a.b a@ a@b", "+1234567-" + "5" * 9 + " ... +1 ........ 2", "a" * 20000 + "@" + "b" * 20000 + ".c",
]


def test_base_spans_equal_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(queries.table(spark, SF, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = disclosure.found(df).select("doc_id", F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("b")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.b == plain_spans(texts[r.doc_id]), texts[r.doc_id]


def test_query_carries_base_spans(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op4_disclosure_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in disclosure.KINDS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == want


def test_disclosing_terms(spark):
    fill = words(400, 8)
    rows = [(i, f"{fill[i]} {fill[i + 100]} said Zebulon to zeb@corp.example about {fill[i + 200]} the end") for i in range(6)]
    rows += [(100 + i, f"the end said {fill[i]} about {fill[(i * 7) % 400]}") for i in range(300)]
    rows += [(500 + i, "copy of Quentin at q@corp.example here") for i in range(50)]  # one context, copied
    rows += [(600, None), (600, None), (None, "Zebulon zeb@corp.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in disclosure.sanitised(df).collect()}
    for i in range(6):
        assert "[term] to [email]" in got[i].sanitised and "Zebulon" not in got[i].sanitised and "said" in got[i].sanitised and fill[i] in got[i].sanitised
    assert got[500].sanitised == "copy of Quentin at [email] here" and got[600].sanitised is None and got[None].sanitised == "[term] [email]" and got[150].sanitised == rows[56][1]
    assert got[0].lang == "en" and len(got[0].terms) == 1
    gone = {r.doc_id: r for r in disclosure.sanitised(df, remove_terms=True).collect()}
    assert "said  to [email]" in gone[1].sanitised
    assert disclosure.sanitised(df.limit(0)).count() == 0


def test_linear_spans_of_a_long_text(spark):
    import time

    lines = [f"u{i}@h{i % 97}.example wrote from 10.{i % 250}.3.{i % 11} on day {i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    row = disclosure.sanitised(df).collect()[0]
    assert time.time() - began < 60
    assert [f"{s.kind}:{s.start}:{s.end}" for s in row.base] == plain_spans("\n".join(lines))
    got = row.sanitised.split("\n")
    assert len(got) == 20_000 and all(x.startswith("[email] ") and x.endswith(f"day {i}") and "[ip]" in x for i, x in enumerate(got))


def test_overlapping_spans_join(spark):
    df = spark.createDataFrame([(1, "\u00e9\U0001f600 x a@1.2.3.4 y +1 234 5678 1.2.3.4 " + "z" * 2500 + " b@c.d")], "doc_id long, text string")
    assert disclosure.sanitised(df).first().sanitised == "\u00e9\U0001f600 x [email] y [phone] " + "z" * 2500 + " [email]"


# ---- mixing

def poisson_count(key, rate, seed=poissonmix.SEED):
    parts = max(math.ceil(rate / poissonmix.CHUNK), 1)
    total, mean = 0, rate / parts
    for p in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:draw:{key}:{p}".encode()).hexdigest()[:12], 16) / 2**48
        term = cumulative = math.exp(-mean)
        n = 0
        while cumulative <= u:
            n += 1
            term *= mean / n
            cumulative += term
        total += n
    return total


def test_copies_follow_the_inverted_distribution(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else "small", 9) for i in range(3000)] + [(5000, None, None, 9), (5000, None, None, 9), (None, "", "big", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = poissonmix.mixed(df, {"big": 1.0, "small": 3.0, "": 1.0, "none": 2.0})
    got = {}
    for r in out.collect():
        assert 1 <= r.copy <= r.copies
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    n = {"big": 2701, "small": 300, "": 2}
    rate = {k: w / 5.0 * len(rows) / n[k] for k, w in (("big", 1.0), ("small", 3.0), ("", 1.0))}
    for i in range(3000):
        want = poisson_count(str(i), rate[rows[i][2]])
        assert got.get((i, rows[i][2]), 0) == want
    assert got.get((5000, None), 0) == 2 * poisson_count("5000", rate[""])
    small = sum(v for (_, s), v in got.items() if s == "small")
    assert abs(small / sum(got.values()) - 0.6) < 0.08
    assert poissonmix.mixed(df.limit(0)).count() == 0 and poissonmix.mixed(df, {"none": 1.0}).count() == 0


def test_mixing_repeats_very_long_texts_whole(spark):
    df = spark.createDataFrame([(i, "x" * 2_000_000 if i == 3 else "y", "s" if i else "t") for i in range(40)], "doc_id long, text string, source string")
    out = poissonmix.mixed(df).select("doc_id", F.length("text").alias("n"), "shuffle_key").collect()
    assert {r.n for r in out if r.doc_id == 3} <= {2_000_000} and {r.n for r in out if r.doc_id != 3} <= {1}
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)  # ranges of the key, each in order


# ---- quality

def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    rows = queries.op10_nbsvm_quality(spark, SF).collect()
    assert len(rows) == queries.table(spark, SF, "documents").count()
    hidden = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(p == y for _, p, y in hidden) >= 0.97 * len(hidden)
    assert sum(p for _, p, y in hidden if y == 1) >= 0.98 * sum(y for *_, y in hidden)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, "good plain words here" if i % 2 else "### %%% $$$ !!", 0.0) for i in range(60)] + [(100, None, 0.0), (101, "", 0.0), (None, "good", 0.0), (102, "x " * 50000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, None), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in nbsvm.quality(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60)) and got[100].score == got[101].score and len(got) == 64
    assert {r.score for r in nbsvm.quality(docs, labels.where("quality = 1")).collect()}.pop() > 0.99
    assert {r.score for r in nbsvm.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.quality(docs.limit(0), labels).count() == 0


def test_a_giant_text_does_not_shut_out_the_rest(spark):
    ids = [r.id for r in spark.range(20).orderBy(F.xxhash64("id")).collect()]
    docs = spark.createDataFrame([(i, "x " * 5000 if i == ids[0] else f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    found, marks = nbsvm.training_rows(docs, labels, held_out="false", text_bytes=1000)
    assert found == [f"text {i}" for i in ids[1:]] and marks == [i % 2 for i in ids[1:]]
    with pytest.raises(ValueError):
        nbsvm.training_rows(docs, labels, held_out="false", text_bytes=1)


# ---- token counts

@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scan_equals_lengths(spark, block):
    texts = ["", None, "a", "Some words, 123.", "<|endoftext|>", "x" * 5000, "caf\u00e9 \U0001f600", "a"]
    df = spark.createDataFrame([(i if i else None, t, "f", 1) for i, t in enumerate(texts)], "doc_id long, text string, file string, ordinal int")
    encode = separators.encoder(open(separators.VOCABULARY, "rb").read()).encode_ordinary
    manifest = separators.tokenise(df.repartition(2), file_tokens=100)
    files = manifest.where("ordinal is null").select("file", "file_tokens")
    assert files.count() > 2
    got = manifest.where("ordinal is not null").drop("file_tokens").join(separators.scan(files, block_tokens=block), ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i if i else None), len(encode(t or ""))) for i, t in enumerate(texts))
    assert separators.token_counts(df.limit(0)).count() == 0


def test_scan_is_dealt_to_several_tasks(spark):
    files = spark.createDataFrame([(f"f{i}", 3_000_000) for i in range(20)], "file string, file_tokens long")
    dealt = separators.blocks(files)
    assert dealt.rdd.getNumPartitions() == 4 and dealt.count() == 60 and min(dealt.rdd.glom().map(len).collect()) > 5
    assert separators.blocks(files.limit(0)).count() == 0


def test_query_counts_tokens_as_plainly_tokenised(spark):
    encode = separators.encoder(open(separators.VOCABULARY, "rb").read()).encode_ordinary
    docs = queries.table(spark, SF, "documents").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op5_separator_scan(spark, SF).collect()}
    assert got == {r.doc_id: len(encode(r.text or "")) for r in docs}


def test_dual_descent_reaches_the_optimum():
    """The duality gap closes, the solution is that of a plain projected gradient on the dual, and the ratios are the plain ones."""
    import numpy as np

    draw = np.random.default_rng(3)
    size = 12
    rows = [np.sort(draw.choice(size, draw.integers(2, 6), replace=False)) for _ in range(40)]
    y = np.where(draw.random(40) < 0.4, 1, -1)
    weights, ratio, bias = nbsvm._train(rows, y, size, 1.0, 3000, 7)
    for j in range(size):
        p, q = (1 + sum(j in r for r, t in zip(rows, y, strict=True) if t == side) for side in (1, -1))
        all_p, all_q = (size + sum(len(r) for r, t in zip(rows, y, strict=True) if t == side) for side in (1, -1))
        assert math.isclose(ratio[j], math.log(p / all_p) - math.log(q / all_q), abs_tol=1e-12)
    x = np.zeros((40, size + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, size] = 1
    cost = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == -1).mean())
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha = np.zeros(40)
    for _ in range(100_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    plain = (alpha * y) @ x
    w = np.append(np.where(ratio != 0, weights / np.where(ratio != 0, ratio, 1), 0), bias)
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert abs(primal(plain) - dual) < 1e-4 and abs(primal(w) - dual) < 1e-2 * max(1, dual)


def test_labels_outside_the_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad ### text") for i in range(1000, 1020)] + [(1000, "bad ### text")], "doc_id long, text string").withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(1001, 1), (1002, 0), (1002, 1)], "doc_id long, quality int")
    found, marks = nbsvm.training_rows(docs, labels, held_out="false", rows=15)
    assert 8 <= len(found) <= 15 and set(marks) == {0, 1}
    rows = nbsvm.quality(docs, labels).collect()
    assert len(rows) == 21 and {r.predicted for r in rows} <= {0, 1} and len({r.score for r in rows if r.doc_id == 1000}) == 1
