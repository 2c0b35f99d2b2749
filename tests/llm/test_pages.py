"""Operators on pages: archives, extraction, URL filter."""

import hashlib
import html.parser
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqcycle.llm import queries, seekwarc, textdensity, urltrees
from seqcycle.llm.files import open_input

SF = "/root/testdata/sf0.001"


def pages(spark):
    big, other = "<p>" + "\u00e9" * 600 + "</p>", "z" * 999
    rows = [(1, "http://a/\r\nx y", big), (2, "u", big), (3, None, big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "q" * 600_000), (3, "u", big)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, frame int"), big


def test_round_trip(spark):
    df, big = pages(spark)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in seekwarc.round_trip(df).collect())
    n = len(big.encode())
    assert got == sorted([("1", n, "revisit", 3), ("2", n, "revisit", 3), ("3", n, "response", None), ("3", n, "response", None), ("4", 999, "response", None), ("5", 999, "response", None),
                          ("6", 0, "response", None), ("7", 0, "response", None), ("None", n, "response", None), ("8", 600_000, "response", None)])
    digests = {r.page_id: r.payload_digest for r in seekwarc.round_trip(df).collect()}
    assert digests[1] == digests[3] == hashlib.sha1(big.encode()).hexdigest() and digests[6] == hashlib.sha1(b"").hexdigest()
    assert seekwarc.round_trip(df.limit(0)).count() == 0
    index = seekwarc.archived(df).collect()
    names = [r.record_id for r in index]
    assert len(set(names)) == len(names) == 10 and {n for n in names if n.count(":") == 2} == {f"urn:page:{i}" for i in (1, 2, 4, 5, 6, 7, 8)}
    assert sum(n.startswith("urn:page:3:") for n in names) == 2 and sum(n.startswith("urn:page:none:") for n in names) == 1


def test_one_bundle_is_read_by_many_tasks(spark):
    import random

    draw = random.Random(1)
    df = spark.createDataFrame([(i, "u", draw.randbytes(150_000).hex()) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    index = seekwarc.archived(df)
    runs = seekwarc.runs(index, 2 * seekwarc.FRAME_BYTES)
    assert index.select("bundle").distinct().count() == 1 and runs.rdd.getNumPartitions() == 6
    read = seekwarc.read(runs)
    assert read.rdd.getNumPartitions() == 6 and {r.page_id for r in read.collect()} == set(range(12))


def test_index_reads_single_records_from_seekable_bundles(spark):
    import zstandard

    df = queries.table(spark, SF, "pages")
    html = {r.page_id: r.html for r in df.collect()}
    index = seekwarc.archived(df)
    some = seekwarc.lookup(index.where("page_id % 7 = 0")).collect()
    assert len(some) == len([i for i in html if i % 7 == 0]) and all(r.payload.decode() == html[r.page_id] for r in some)
    assert all(r.record_id == f"urn:page:{r.page_id}" for r in some)
    name = index.first().bundle
    with open_input(name) as f:
        raw = f.read()
    assert raw[-4:] == b"\xb1\xea\x92\x8f"
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(1 << 20) for _ in range(1))
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    reader = seekwarc.Reader(name)
    assert len(reader.sizes) >= 1 and b"".join(reader.frame(k) for k in range(len(reader.sizes)))[: len(plain)] == plain[: sum(reader.sizes)]
    broken = bytearray(seekwarc.record("urn:page:1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None))
    broken[-5:-4] = b"X"
    with pytest.raises(ValueError):
        seekwarc._read_back(*seekwarc.parsed(bytes(broken))[:2])


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies on this site, which is a long notice.</div>
    <div id="page-wrap"><article><header class="entry-header"><h1>Title &amp; more</h1></header><p><b>First &lt;p&gt; part.<br><p>Second   part,
    with <a href="x">a link</a> inside.</p><div class="share-bar"><a>x</a></div><ul><li>one<li>two</ul><p>Be.</p></article>
    <aside>Related things that are long enough to look like text of an article, really.</aside></div>
    <section id="comments"><article class="comment"><p>I think this comment is very long and has much to say about the article itself.</p></article></section>
    <form><p>Name <input name=q></p></form><footer>&copy; all</footer></body></html>"""
    assert textdensity.main_text(page) == "Title & more\nFirst <p> part.\nSecond part, with a link inside.\none\ntwo\nBe."


def test_article_by_density_alone():
    links = "".join(f'<div class="x{i}"><a href="{i}">Some link text number {i}</a></div>' for i in range(12))
    text = "".join(f"<p>Paragraph {i} of the story goes on for a while, with commas, clauses and such things.</p>" for i in range(5))
    page = f'<html><body><div class="c1">{links}</div><div class="c2"><div class="c3"><h2>Head</h2>{text}</div></div><div class="c4">{links}</div></body></html>'
    got = textdensity.main_text(page).split("\n")
    assert got[0] == "Head" and len(got) == 6 and got[5].startswith("Paragraph 4")


def test_sources_and_link_tables_stay_in_the_article():
    links = "".join(f"<li><a href={i}>Source number {i}</a></li>" for i in range(4))
    table = "".join(f"<tr><td><a href={i}>Row {i}</a></td></tr>" for i in range(3))
    page = f"<body><article><h1>T</h1><p>Some text of the story.</p><ul>{links}</ul><table>{table}</table><nav><a href=x>Menu</a></nav></article></body>"
    assert textdensity.main_text(page).split("\n") == ["T", "Some text of the story.", *(f"Source number {i}" for i in range(4)), *(f"Row {i}" for i in range(3))]


@pytest.mark.parametrize("name", ["layout sidebar-right", "comments-open", "widget", "side", "notice", "promo"])
def test_names_of_wrappers_do_not_empty_the_page(name):
    text = [f"Paragraph {i} of the story goes on for a while, with commas, clauses and such things." for i in range(4)]
    page = f"<html><body><div class='{name}'>{''.join(f'<p>{x}</p>' for x in text)}<div class='sidebar'><p>Aside.</p></div></div><div class='footer'><p>Imprint.</p></div></body></html>"
    assert textdensity.main_text(page).split("\n") == text
    comments = f"<body><div>{''.join(f'<p>{x}</p>' for x in text)}</div><div id='comments'>{'<p>I say so, and I say it again, and so on, at some length.</p>' * 9}</div></body>"
    assert textdensity.main_text(comments).split("\n") == text


STORY = [f"Paragraph {i} of the story goes on for a while, with commas, clauses and such things." for i in range(4)]
INNER = "".join(f"<p>{x}</p>" for x in STORY)


@pytest.mark.parametrize("page", [
    f"<body><div class='widget Blog'><h2>Blog</h2>{INNER}</div><div class='widget'><p>Other box.</p></div></body>",
    f"<body><form id='aspnetForm'><div><h2>Blog</h2>{INNER}</div><div class='footer'>Imprint.</div></form></body>",
    f"<body><article><h2>Blog</h2><div class='notice-board'>{INNER}</div><div class='cookie-notice'><p>We use cookies.</p></div></article></body>",
    f"<body><div class='c'><h2>Blog</h2>{INNER}</div><div>Some words of an advert without any paragraph, which stand in a box of their own.</div></body>",
])
def test_names_and_forms_never_cut_the_core(page):
    assert textdensity.main_text(page).split("\n") == ["Blog", *STORY]


@pytest.mark.parametrize("tag", [
    "article title='The hidden costs'", 'article aria-label="a hidden gem"', "article onclick=\"this.style='display:none'\"", "article data-x='class=comments'", "article title=\"a > b, hidden\"", "article data-hidden=no",
    "article alt='x'class='story'", "article =hidden", "article title=hidden", "article / class = 'story'",
])
def test_values_of_attributes_are_not_searched_for_names(tag):
    page = f"<body><nav><a href=x>M</a></nav><{tag}><h2>Blog</h2>{INNER}<p title='some hidden thing'>Last, with <a title='Read the hidden story' href=x>a link</a>.</p></article></body>"
    assert textdensity.main_text(page).split("\n") == ["Blog", *STORY, "Last, with a link."]


@pytest.mark.parametrize("tag", ["p hidden", "p title='a' hidden", "p HIDDEN=''", 'p style="color:red;display: none"', "p aria-hidden=true", "div role=navigation", "p style=display:none title='x'"])
def test_hidden_parts_are_left_out(tag):
    page = f"<body><article><h2>Blog</h2><{tag}>Never seen by any reader.</{tag.split()[0]}>{INNER}</article></body>"
    assert textdensity.main_text(page).split("\n") == ["Blog", *STORY]


@given(st.lists(st.tuples(
    st.from_regex(r"[a-zA-Z][a-zA-Z0-9:_-]{0,8}", fullmatch=True), st.text(st.characters(codec="utf-8", exclude_characters="\0\r", exclude_categories=["Cs"]), max_size=12), st.sampled_from(["'", '"', "", None]), st.sampled_from(["", " ", "\n"]),
), max_size=6))
def test_attributes_equal_those_of_another_parser(given_attributes):
    """Names and values in any quotes, against the parser of the standard library."""
    written, texts = [], {}
    for name, value, quote, space in given_attributes:
        if quote is None:
            written.append(name)
            texts.setdefault(name.lower(), "")
        else:
            plain = re.sub(r"[\s\"'<>=`/&]", "", value) or "v" if quote == "" else value.replace(quote, "").replace("&", "")
            written.append(f"{name}{space}={space}{quote}{plain}{quote}")
            texts.setdefault(name.lower(), plain)
    seen = []

    class Other(html.parser.HTMLParser):
        def handle_starttag(self, tag, attrs):
            seen.append(attrs)

    rest = " " + " ".join(written)
    Other().feed(f"<p{rest}>")
    other: dict = {}
    for name, value in seen[0]:
        other.setdefault(name, value or "")
    assert textdensity._attributes(rest) == texts == other


def test_parts_of_articles_with_names_of_other_things():
    related = "<section id='related'><h2>Related work</h2><p>Others have told this story in other words, and at length.</p></section>"
    quote = "<blockquote><p>So it goes.</p><footer>An author</footer></blockquote><figure><figcaption>A picture.</figcaption><footer>Its painter</footer></figure>"
    page = f"<body><article><h2>Blog</h2>{INNER}<p class='comment'>A remark of the author.</p>{related}{quote}<footer>Filed under stories</footer></article></body>"
    want = ["Blog", *STORY, "A remark of the author.", "Related work", "Others have told this story in other words, and at length.", "So it goes.", "An author", "A picture.", "Its painter"]
    assert textdensity.main_text(page).split("\n") == want
    links = "".join(f"<li><a href={i}>Another story, number {i}</a></li>" for i in range(5))
    readers = "<div class='comments'><h3>Comments</h3><p class='comment'>I read this, and I did not like it.</p></div><ol><li class='comment'>Nor did I.</li></ol>"
    page = f"<body><article><h2>Blog</h2>{INNER}<div class='related'><h3>Related</h3><ul>{links}</ul></div>{readers}</article></body>"
    assert textdensity.main_text(page).split("\n") == ["Blog", *STORY]


def test_density_finds_articles_without_names():
    """Of the pages of the test table, with classes and sectioning tags taken away, nearly all give their articles."""
    import re

    import pyarrow.parquet as pq

    same = total = 0
    for source in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        plain = re.sub(r"<(/?)(article|nav|header|footer|aside|main|section)\b", r"<\1div", re.sub(r"\s(class|id)=\"[^\"]*\"", "", source))
        same += textdensity.main_text(plain) == textdensity.main_text(source)
        total += 1
    assert total >= 250 and same >= 0.98 * total


def test_extraction_of_an_empty_table_and_of_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", f"<body>{INNER}</body>", "old", 7), (1, "u", f"<body>{INNER}</body>", "old", 7)], "page_id long, url string, html string, text string, n_chars int")
    got = textdensity.extracted(rows).collect()
    assert [tuple(r) for r in got] == [(1, "u", "\n".join(STORY), len("\n".join(STORY)))] * 2
    assert textdensity.extracted(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain < 5 & more &amp; &eacute;&#x41;", "plain < 5 & more & \u00e9A"), ("<p>", ""), ("<script>x", ""), ("<p>a</p></div></p><p>b", "a\nb"), ("<!-- x", ""),
    ("<p title='a>b' class=\"c\">x<!-- y -->z</p>", "xz"), ("<p>a&nbsp;\n b</p>", "a b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p a='unclosed>x</p>", "x"),
])
def test_malformed_pages(page, want):
    assert textdensity.main_text(page) == want


def test_long_and_deep_pages():
    assert textdensity.main_text("<div>" * 3000 + "word " * 50000 + "</div>" * 3000).count("word") == 50000
    assert textdensity.main_text("<" * 20000) == "<" * 20000
    assert textdensity.main_text("<p '" * 3000) is not None


def test_extraction_over_the_table(spark):
    import html
    import re

    rows = queries.op8_text_density_extraction(spark, SF).collect()
    source = {r.page_id: r.html for r in queries.table(spark, SF, "pages").collect()}
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    empty = spark.createDataFrame([(None, None, None), (1, "u", None)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in textdensity.extracted(empty).collect()] == [("", 0)] * 2


URLS = [
    (1, None, "", "", None), (2, "no scheme", "", "", None), (3, "HTTP://A.NET?x/y", "a.net", "", None), (4, "http://Net/a", "net", "/a", "net/"), (5, "x://a.EXAMPLE.com/de/1?#", "a.example.com", "/de/1", "example.com/de/"),
    (6, "http://xexample.com/de/", "xexample.com", "/de/", None), (7, "http://https://b.org/fr/", "https:", "//b.org/fr/", None), (8, "http://b.example.net/en/x", "b.example.net", "/en/x", "example.net/en/"),
    (9, "http://b.example.net/en", "b.example.net", "/en", "net/"), (10, "http://\u00c4.org/fr/#a/b", "\u00c4.org", "/fr/", "org/fr/"), (11, "http://a.net:80/x", "a.net:80", "/x", None), (12, "", "", "", None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u, *_ in URLS], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://h{i}.com/{'bad' if i % 2 else 'ok'}/{i}", i % 2) for i in range(400)], "url string, label int")
    judge = urltrees.train(labelled)
    got = {r.page_id: r for r in urltrees.judged(df, judge).collect()}
    says = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for i, _, host, path, rule in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == says[rule] if rule else got[i].verdict in ("allow", "block")
    new = spark.createDataFrame([(i, f"http://n{i}.com/{'bad' if i % 2 else 'ok'}/{i}") for i in range(100)], "page_id long, url string")
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in urltrees.judged(new, judge).collect()]) > 0.95
    assert urltrees.judged(df.limit(0), judge).count() == 0
    nothing = urltrees.train(labelled.limit(0))
    assert {r.verdict for r in urltrees.judged(new, nothing).collect()} == {"allow"}


def test_trees_learn_lexical_features():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = urltrees.grow(x[:1000], y[:1000])
    assert ((model.margin(x[1000:]) > 0) == y[1000:]).mean() > 0.93
    assert urltrees.lexical("http://a1b.c/p/q.html?x=1&y=2#z", "a1b.c", "/p/q.html")[5:8] == [2, 2, 2]


def plain_trees(x, y, w, trees):
    """Margins of boosted trees, every split of every node tried by sums over its rows."""
    share = np.dot(w, y) / w.sum()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [np.arange(len(y))]
        for _ in range(urltrees.LEVELS):
            after = []
            for rows in leaves:
                best, parts = 1e-9, (rows, rows[:0])
                for j in range(x.shape[1]):
                    gain_here, parts_here = 0.0, None
                    for c in urltrees._cuts(x[:, j]) if len(set(x[:, j])) > 1 else []:
                        left = rows[x[rows, j] <= c]
                        right = rows[x[rows, j] > c]
                        hl, hr = h[left].sum(), h[right].sum()
                        if hl < 1 or hr < 1:
                            continue
                        gain = g[left].sum() ** 2 / (hl + 1) + g[right].sum() ** 2 / (hr + 1) - g[rows].sum() ** 2 / (hl + hr + 1)
                        if gain > gain_here + 1e-12:
                            gain_here, parts_here = gain, (left, right)
                    if gain_here > best + 1e-9:
                        best, parts = gain_here, parts_here
                after += parts
            leaves = after
        for rows in leaves:
            if len(rows):
                margin[rows] -= urltrees.RATE * g[rows].sum() / (h[rows].sum() + 1)
    return margin


def test_trees_equal_plain_ones():
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(300, 4)), 1)
    x[:, 3] = 2.0
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) ^ (draw.random(300) < 0.1)).astype(float)
    y[:20] = 0.5
    w = draw.integers(1, 4, 300).astype(float)
    assert np.allclose(urltrees.grow(x, y, w, trees=6).margin(x), plain_trees(x, y, w, 6), atol=1e-8)


def plain_url(url):
    rest = url.partition("://")[2] if "://" in (url or "") else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[len(host) :].split("?")[0].split("#")[0]


def plain_suffixes(url):
    host, path = plain_url(url)
    labels, first, name = host.split("."), (path.split("/") + ["", ""])[1], path.split("/")[-1]
    return [labels[-1], "2:" + ".".join(labels[-2:]), "p:" + first, f"q:{labels[-1]}/{first}", "x:" + (name.split(".")[-1] if "." in name else "")]


def test_statistics_equal_plain_counts(spark):
    """Shares of blocked rows by suffix, over all labelled rows of the whole table, repeats included."""
    pages = queries.table(spark, SF, "pages").select("url").unionByName(spark.createDataFrame([("http://a.com/x/y.html",)] * 30 + [("http://b.com/" + "z" * 40_000,), (None,), ("none",)], "url string"))
    labelled = pages.withColumn("label", F.when(F.length("url") % 3 == 0, 1).otherwise(0))
    judge = urltrees.train(labelled)
    rows = [(r.url, r.label) for r in labelled.collect() if r.url is not None]
    share = sum(b for _, b in rows) / len(rows)
    count = {}
    for url, b in rows:
        for k, s in enumerate(plain_suffixes(url)):
            n = count.setdefault((urltrees.bucket(s), k), [0, 0])
            n[0], n[1] = n[0] + b, n[1] + 1
    whole = {}
    for (bucket, _), (b, n) in count.items():
        whole[bucket] = [whole.get(bucket, [0, 0])[0] + b, whole.get(bucket, [0, 0])[1] + n]
    urls = [u for u, _ in rows]
    got = judge.rows(urls, *zip(*map(plain_url, urls), strict=True))[:, urltrees.FEATURES :]
    want = [[(whole[urltrees.bucket(s)][0] + urltrees.SMOOTH * share) / (whole[urltrees.bucket(s)][1] + urltrees.SMOOTH) for s in plain_suffixes(u)] for u in urls]
    assert np.allclose(got, want)
    masked = urltrees.train(labelled, masked={"last", "pair"}).rows(urls[:3], *zip(*map(plain_url, urls[:3]), strict=True))[:, urltrees.FEATURES :]
    assert np.allclose(masked[:, [0, 3]], share) and np.allclose(masked[:, [1, 2, 4]], got[:3][:, [1, 2, 4]])


def test_sample_is_of_distinct_urls_and_bounded_bytes(spark, monkeypatch):
    rows = [("http://same.com/a", 1)] * 500 + [(f"http://n{i}.com/{'bad' if i % 2 else 'ok'}", i % 2) for i in range(60)] + [("http://long.com/" + "x" * 5000, 0)]
    seen = []
    real = urltrees.Judge.rows
    monkeypatch.setattr(urltrees.Judge, "rows", lambda self, urls, *rest: seen.append(list(urls)) or real(self, urls, *rest))
    labelled = spark.createDataFrame(rows, "url string, label int")
    urltrees.train(labelled, sample_bytes=4000)
    assert len(seen[0]) == len(set(seen[0])) == 61 and max(map(len, seen[0])) < 100
    urltrees.train(labelled, sample=20)
    assert 10 <= len(seen[1]) <= 20


def test_verdicts_of_the_whole_table_come_from_the_trees(spark):
    """URLs without a rule: plain features and trees trained on ruled URLs alone give the same scores and verdicts, and they differ among URLs."""
    big = "/root/testdata/sf0.1"
    rows = queries.op9_url_boosted_trees(spark, big).collect()
    url = {r.page_id: r.url for r in queries.table(spark, big, "pages").collect()}
    says = {"net/": 1, "example.com/de/": 1, "example.net/en/": 0, "org/fr/": 0}
    labels = {}
    for r in rows:
        if r.rule:
            labels.setdefault(url[r.page_id], []).append(says[r.rule])
    known = sorted(labels)
    assert 0 < len(known) <= urltrees.SAMPLE
    split = lambda urls: (urls, *zip(*map(plain_url, urls), strict=True))
    share = sum(map(sum, labels.values())) / sum(map(len, labels.values()))
    ends = {}
    for u in known:
        n = ends.setdefault(urltrees.bucket(plain_suffixes(u)[4]), [0, 0])
        n[0], n[1] = n[0] + sum(labels[u]), n[1] + len(labels[u])
    free = [r for r in rows if r.rule is None]
    judge = urltrees.train(spark.createDataFrame([(u, b) for u in known for b in labels[u]], "url string, label int"), masked=urltrees.named_by())
    x = judge.rows(*split([url[r.page_id] for r in free]))
    assert np.allclose(x[:, urltrees.FEATURES : urltrees.FEATURES + 4], share)
    found = [ends.get(urltrees.bucket(plain_suffixes(url[r.page_id])[4]), [0, 0]) for r in free]
    assert np.allclose(x[:, -1], [(b + urltrees.SMOOTH * share) / (n + urltrees.SMOOTH) for b, n in found])
    score = 1 / (1 + np.exp(-judge.trees.margin(x)))
    assert np.allclose(score, [r.score for r in free], atol=1e-9)
    assert [r.verdict for r in free] == ["block" if s > judge.limit else "allow" for s in score]
    assert len(set(np.round(score, 6))) > 100 and len({r.verdict for r in free}) == 2


def test_whole_table_follows_the_rules(spark):
    rows = queries.op9_url_boosted_trees(spark, SF)
    assert rows.count() == queries.table(spark, SF, "pages").count()
    assert rows.where(F.col("rule").isin("net/", "example.com/de/") != (F.col("verdict") == "block")).where("rule is not null").count() == 0
