"""Near-duplicate operators against brute force, with edge cases."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqcycle.llm import hnsw, lshforest
from seqcycle.llm.common import WordHashes, components, shared_dir, written


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(300, links)
    assert got == {n: want[n] for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_table_reads_back(spark):
    assert written(spark.range(3), "t").count() == 3 and "/" in shared_dir(spark)


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def documents():
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = []
    passage = " ".join(word() for _ in range(60))
    for _ in range(25):
        base = [word() for _ in range(draw.randrange(30, 160))]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(0, 6)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(copy) // 25)):
                copy[draw.randrange(len(copy))] = word()
            texts.append((" ".join(copy)).upper() if draw.random() < 0.3 else "  \n".join(copy))
    texts += [passage + " " + " ".join(word() for _ in range(draw.randrange(5, 90))) for _ in range(60)]
    hub = [word() for _ in range(120)]
    for k in range(40):  # star: siblings are like the hub and less like each other
        copy = list(hub)
        for j in range(3):
            copy[(k * 3 + j * 41) % 120] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(hub), "", None, "one", "one two", "One two", "ein\u00a0wort", "\u00c4 b c d e f", "\u00e4 b c d e f", "x " * 30000, "x " * 29999]
    return texts


def test_forest_equals_all_pairs(spark):
    texts = documents()
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, set_key string, node int")
    got = {r.doc_id: r for r in lshforest.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_no_link_is_lost_among_texts_that_share_a_passage(spark):
    draw = random.Random(31)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    passage, texts, pairs = [word() for _ in range(84)], [], []
    for k in range(2400):
        own = [word() for _ in range(15)]
        if k % 6 == 1:  # 82 of 108 shingles are those of the text before
            own[:2] = texts[-1][84:86]
            pairs.append(k)
        texts.append(passage + own)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in lshforest.near_duplicates(df).collect()}
    assert sorted(k for k in got if got[k] != k) == pairs and all(got[k] == k - 1 for k in pairs)


def test_forest_edge_cases(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (None, None), (8, " \t\n")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in lshforest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("8", 8, True), ("None", None, True), ("None", None, True)]
    assert lshforest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours_do_not_depend_on_partitions():
    hashes = WordHashes()
    sets = [s for s in (lshforest.shingle_set(t, hashes) for t in documents()) if len(s)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([len(s) for s in sets]), pa.array([lshforest.signature(s).tobytes() for s in sets], pa.binary())], names=["node", "n", "s"])
    keys = sorted(k for b in lshforest._planted(iter([batch])) for k in b.column(0).to_pylist())
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    whole = set(map(tuple, lshforest._candidates(rows).tolist()))
    parts, edges = set(), []
    for at in range(0, len(keys), 100):
        for out in lshforest._neighbours(iter([pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100], pa.binary())], names=["key"])])):
            parts |= {(a, b) for a, b, e in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True) if e is None}
            edges += [e for e in out.column(2).to_pylist() if e]
    for tree in range(lshforest.TREES):
        own = pa.table({"edge": pa.array([e for e in edges if e[0] == tree], pa.binary())})
        t = lshforest._stitched(own)
        parts |= set(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
    near = {p for p in whole}
    linked = {(a, b) for a, b in near if len(np.intersect1d(sets[a], sets[b])) * 100 >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert roots(len(sets), linked & parts) == roots(len(sets), linked)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(8)
    base = draw.normal(size=(900, 16))
    near = base[:200] + 0.16 * draw.normal(size=(200, 16))
    clump = base[300] + 0.1 * draw.normal(size=(150, 16))
    return np.concatenate([base, near, clump, base[:30], 3 * base[30:40]]).astype("float32")


def test_graphs_equal_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARDS", 2)
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    want = roots(len(vectors), list(zip(*np.nonzero(close), strict=True)))
    df = spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, node int, links int")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    counts = np.array([got[i].n_links for i in range(len(vectors))])
    assert counts.sum() >= 0.99 * close.sum() and (counts <= close.sum(axis=1)).all()
    assert np.mean([got[i].component_id == want[i] for i in range(len(vectors))]) > 0.99


def planted(n=9000, d=64, seed=5):
    """Unit vectors: n at random, pairs just above and just below the threshold, and a crowd around one of them."""
    draw = np.random.default_rng(seed)

    def near(x, cos):
        z = draw.normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        return cos[:, None] * x + np.sqrt(1 - cos[:, None] ** 2) * z

    base = draw.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    k = n // 20
    pairs = [near(base[:k], draw.uniform(0.951, 0.999, k)), near(base[k : 2 * k], draw.uniform(0.9, 0.949, k))]
    crowd = near(np.repeat(base[-1:], n // 10, axis=0), draw.uniform(0.96, 0.99, n // 10))
    v = np.concatenate([base, *pairs, crowd])
    return v[draw.permutation(len(v))].astype("float32")


def test_planted_links_past_ten_thousand_vectors(spark):
    """Against brute force: every link outside the crowd, no component wrong, and hardly a query of the crowd short."""
    vectors = planted()
    assert len(vectors) > 10_000
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    want = close.sum(axis=1)
    rows = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()}
    got = np.array([rows[i].n_links for i in range(len(vectors))])
    linked = want > 0
    recall = got[linked] / want[linked]
    print(f"recall by query: mean {recall.mean():.6f}, least {recall.min():.4f}, short {(recall < 1).sum()} of {linked.sum()}")
    assert (got <= want).all() and (got == want)[want < 50].all() and recall.mean() > 0.9995 and (recall < 1).mean() < 0.02
    component = roots(len(vectors), list(zip(*np.nonzero(np.triu(close)), strict=True)))
    assert [rows[i].component_id for i in range(len(vectors))] == [component[i] for i in range(len(vectors))]


def test_the_given_tables_are_searched_by_graphs(spark):
    """Every shard of the query's table has neighbour lists below the layer that is searched whole."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("vector"))
    shards = table.groupBy(F.pmod(F.xxhash64("vector"), F.lit(hnsw.SHARDS)).alias("shard")).agg(F.collect_list("vector").alias("vectors")).collect()
    assert len(shards) == hnsw.SHARDS
    for s in shards:
        graph = hnsw.Graph(hnsw._unit(np.array(s.vectors)))
        assert len(graph.layers) >= 1 and graph.top < len(graph.layers[0]) == len(s.vectors)


def test_beam_widens_until_the_audit_passes(vectors):
    unit = vectors.astype(float) / np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(unit.astype("float32"))
    assert graph.layers and all((links < len(links)).all() for links in graph.layers)
    beam = hnsw.audited_beam(graph, unit.astype("float32"), 0.95)
    q, x = graph.links(unit.astype("float32"), beam, 0.95)
    assert len(set(zip(q.tolist(), x.tolist(), strict=True))) == len(q) and len(q) >= 0.99 * (unit @ unit.T >= 0.95).sum()
    for links in graph.layers:
        links[:] = -1  # a graph without ways needs the whole shard
    assert hnsw.audited_beam(graph, unit.astype("float32"), 0.95) == len(unit)


def test_audit_gives_each_query_one_vote():
    draw = np.random.default_rng(5)
    unit = np.concatenate([draw.normal(size=(1200, 16)), draw.normal(size=16) + 0.02 * draw.normal(size=(900, 16))])
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype("float32")
    unit = unit[draw.permutation(len(unit))]
    hot = (unit @ unit.T >= 0.95).sum(axis=1) > 100
    graph = hnsw.Graph(unit)

    class Partial(hnsw.Graph):  # finds the hot group's links, and no other below a whole search
        def links(self, queries, beam, least):
            q, x = np.nonzero(queries @ self.v.T >= least)
            keep = hot[x] if beam < len(self.v) else np.ones(len(x), bool)
            return q[keep], x[keep]

    graph.__class__ = Partial
    assert hnsw.audited_beam(graph, unit, 0.95) == len(unit)


def test_last_resort_compares_all(vectors):
    unit = vectors.astype(float) / np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(unit.astype("float32"))
    for links in graph.layers:
        links[:] = -1
    assert len(graph.links(graph.v, len(graph.v), 0.95)[0]) == (graph.v @ graph.v.T >= 0.95).sum()


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (8, []), (9, [float("inf"), 0.0])]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    alone = [(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), *alone, ("None", 0, None, True)]
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_rows_are_one_candidate(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50", "x")
    df = spark.createDataFrame([(1, base)] * 300 + [(2, near)] * 300 + [(3, near + " more"), (3, "another text of this number")], "doc_id long, text string")
    seen = []
    real = lshforest._links
    monkeypatch.setattr(lshforest, "_links", lambda docs, nodes, pairs: seen.append((nodes.count(), pairs.count())) or real(docs, nodes, pairs))
    got = lshforest.near_duplicates(df).collect()
    assert len(got) == 602 and seen[0][0] == 4 and seen[0][1] <= 3
    assert sorted({(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}) == [(1, 96, 1, True), (2, 96, 1, False), (3, 1, 3, True), (3, 97, 1, False)]


def test_hub_of_many_members_is_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "MEMBERS", 3)
    rows, want = documents()[:40], None
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [plain_set(t) for t in rows]
    want = roots(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    assert {r.doc_id: r.component_id for r in lshforest.near_duplicates(df).collect()} == dict(enumerate(want))


def rare_rows(seed=3):
    """(shingle, root, node, size, place): a shingle of one root, one of a root and an outsider, one of many roots, and small ones."""
    draw = random.Random(seed)
    rows = [(5, 1, n, 40, 0) for n in range(70)]
    rows += [(6, 2, n, 40, 0) for n in range(100, 190)] + [(6, 3, 999, 41, 0)]
    rows += [(7, draw.randrange(30), n, draw.randrange(20, 60), draw.randrange(12)) for n in range(200, 330)]
    return rows + [(-s, draw.randrange(6), n, 30, draw.randrange(4)) for s in range(1, 25) for n in draw.sample(range(400, 440), draw.randrange(1, 9))]


def plain_met(rows):
    out = set()
    for (s, r, a, x, p), (t, q, b, y, o) in combinations(rows, 2):
        if s == t and r != q and 100 * min(x, y) >= 75 * max(x, y) and 175 * min(x - p, y - o) >= 75 * (x + y):
            out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("chunk,step", [(16, 5), (64, 64), (1 << 16, 7)])
def test_blocks_of_a_shingle_and_whole_groups_hold_each_row_once(monkeypatch, chunk, step):
    monkeypatch.setattr(lshforest, "_CHUNK", chunk)
    rows = sorted(rare_rows())
    pairs, blocks = set(), []
    for part in (rows[:100], rows[100:101], rows[101:260], rows[260:]):  # as ranges deal them, shingles cut in two
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part[k : k + step])], names=list(lshforest._RARE)) for k in range(0, len(part), step)]
        for out in lshforest._met(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=list(lshforest._RARE)), *batches])):
            found = out.to_pylist()
            pairs |= {(r["a"], r["b"]) for r in found if r["a"] is not None}
            own = [r for r in found if r["block"] is not None]
            assert len({(r["block"], r["shingle"]) for r in own}) <= 1 and len(own) < chunk + step
            blocks += own
    handed = [tuple(r[c] for c in lshforest._RARE) for r in blocks]
    assert len(set(handed)) == len(handed) and {5, 6, 7} & {r[0] for r in handed}
    assert pairs | plain_met(handed) == plain_met(rows) and plain_met([r for r in rows if r not in set(handed)]) <= pairs


def test_a_shingle_spread_over_partitions_loses_no_pair(spark):
    rows = rare_rows()
    conf, name = spark.conf, "spark.sql.adaptive.coalescePartitions.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        found = [tuple(r) for r in lshforest._met_anywhere(spark.createDataFrame(rows, "shingle long, root long, node long, size long, place int")).collect()]
    finally:
        conf.set(name, before)
    assert len(found) == len(set(found)) and set(found) == plain_met(rows)
    assert lshforest._met_anywhere(spark.createDataFrame([], "shingle long, root long, node long, size long, place int")).count() == 0


def test_shingles_of_other_words_or_order_differ():
    hashes = WordHashes()
    texts = ["a b c d e", "b a c d e", "e d c b a", "a a a a b", "a a a b a", "a b c d", "a b c", "a"]
    assert len({lshforest.shingle_set(t, hashes).tobytes() for t in texts}) == len(texts)
    assert len(lshforest.shingle_set("x x x x x x x", hashes)) == 1


def test_order_of_shingles_counts_every_document(spark, monkeypatch):
    """As many documents as no sample of 5,000 would hold, in which a passage stands in few."""
    monkeypatch.setattr(lshforest, "_TALLY", 3_000)
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}" + (" one passage of six words here" if i % 4000 == 0 else "")) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    buckets, counts = lshforest._frequencies(docs)
    passage = lshforest._buckets(lshforest.shingle_set("one passage of six words here", WordHashes()))
    assert dict(zip(buckets.tolist(), counts.tolist())) == {int(b): 6 for b in passage}
    own = lshforest.shingle_set(rows[0][1], WordHashes())
    first = lshforest.prefix(own, (buckets, counts)).view("uint64")
    assert not set(lshforest._buckets(first).tolist()) & set(passage.tolist())
    monkeypatch.setattr(lshforest, "_HELD", 1)
    assert [len(x) for x in lshforest._frequencies(docs)] == [0, 0]
    assert [len(x) for x in lshforest._frequencies(docs.limit(0))] == [0, 0]
