"""Information-theoretic sanitisation of personal data, by DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers, found by patterns. Each distinct value
of a base span is a protected entity. The words of three letters or more that stand within ``WINDOW`` characters of a mention are its context.
Over the whole corpus, co-occurrence tells how strongly a word discloses an entity: with ``both`` the occurrences of the word
in the entity's contexts and ``word`` its occurrences in all texts, p(entity | word) = both / word, and the
disclosure is PMI(entity, word) / IC(entity) = 1 + log p(entity | word) / IC(entity), where IC(entity) = -log p(entity)
and p(entity) is the share of all words that stand in its contexts. It is 1 for a word that is known to stand only there. What few contexts
show is not taken for certain: p(entity | word) is a lower bound of 95 % confidence (Wilson) over the different contexts that hold the
word (copies of one context count once), so the rarer an entity, and the larger the corpus, the fewer contexts are enough.
Words whose disclosure reaches ``THRESHOLD`` are terms: in the entity's contexts they become spans of their own and are generalised to their
class, as base spans are, or removed.

Skew: contexts, words and pairs are pre-aggregated before each shuffle, and no group is ever gathered: joins with
contexts split on their keys, and only the spans of one document meet. Only words of some context are counted over the corpus.

Defined results: null texts count as empty and have no spans. Rows are told apart by doc_id and text, so repeated rows
have equal spans, as have rows with a null doc_id and equal text. Extra columns are kept by ``sanitised``; those named as its results give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_few, written

WINDOW, THRESHOLD, CONFIDENCE = 60, 0.9, 1.645  # the last in standard deviations: 95 % on one side
#: Up to so many context words, the corpus count keeps to them before it is grouped; beyond, all words are grouped first.
FEW_WORDS = 200_000
#: Elements of a block of a prefix scan; code points of a piece of a cut text.
_BLOCK, _PIECE = 64, 1000

#: The kinds in the order of their spans, and their patterns. Where a match can start inside what an
#: earlier attempt has scanned without success, look-behinds and possessive loops keep the scan linear; they match the same spans.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_JOINT, _OTHER = "\ue000", "\ue001"
_CARD = f"[0-9][0-9{_JOINT}]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"\p{L}{3,}"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, add) -> Column:
    """What ``add`` makes, from 0, of all values before each one: by blocks, so that time and memory are all but linear in a long array's size."""
    fold = lambda part: F.aggregate(part, F.lit(0), add)
    cut = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda k: F.slice(found, k * _BLOCK + 1, F.lit(_BLOCK)))
    nothing = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def scanned(parts: Column) -> Column:
        step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        heads = F.aggregate(F.transform(parts, fold), start, step, lambda s: s["out"])
        return F.flatten(F.zip_with(parts, heads, lambda part, head: F.transform(part, lambda _, i: add(head, fold(F.slice(part, F.lit(1), i))))))

    return _let(values, lambda found: F.when(F.size(found) > 0, _let(cut(found), scanned)).otherwise(nothing))


def _placed(text: Column, pattern: str, good) -> Column:
    """array<struct<start,end,value>>: the matches of ``pattern`` for which ``good`` holds, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    one = lambda v, g: F.struct(v.alias("value"), g.alias("gap"))
    matches = F.filter(F.zip_with(found, gaps, one), lambda m: m["value"].isNotNull())  # there is one more gap than matches

    def places(found: Column) -> Column:
        before = _before(F.transform(found, lambda m: m["gap"] + F.length(m["value"])), lambda a, b: a + b)

        def span(m: Column, at: Column) -> Column:
            return F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + F.length(m["value"])).alias("end"), m["value"].alias("value"))

        return F.filter(F.zip_with(found, before, span), lambda s: good(s["value"]))

    return _let(matches, places)


def _cut_up(text: Column) -> Column:
    """The text in pieces of ``_PIECE`` code points, for ``_part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a cut text, found without a scan from its beginning."""
    first = F.floor(start / _PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1), "")
    return F.substr(near, start - first * _PIECE + 1, end - start)


def _rewritten(text: Column, spans: Column, instead) -> Column:
    """The text with ``instead(span, reach)`` for each of its spans, which come by start; what earlier spans reach (``reach``) is left out."""

    def whole(pieces: Column, spans: Column, reach: Column) -> Column:
        one = lambda s, r: F.concat(F.when(s["start"] > r, _part(pieces, r, s["start"])).otherwise(""), instead(s, r))
        last = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.zip_with(spans, reach, one), ""), _part(pieces, last, F.greatest(F.length(text), last)))

    reach = lambda found: _before(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    changed = _let(_cut_up(text), lambda pieces: _let(spans, lambda found: _let(reach(found), lambda r: whole(pieces, found, r))))
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<rank,kind,start,end,value>> of a whole text, by kind as listed, then start."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), _placed(text, _IP, lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(none)
    email = F.when(text.contains("@"), _placed(text, _EMAIL, lambda v: F.lit(True))).otherwise(none)
    # A separator between two digits becomes one private character, so that a run of any length is one character class.
    joined = F.regexp_replace(F.translate(text, _JOINT, _OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)
    size = lambda v: F.length(_digits(v))
    card = F.when(
        joined.rlike(f"[0-9{_JOINT}]{{16}}"),
        _placed(joined, _CARD, lambda v: F.when(size(v).between(16, 19), _luhn(_digits(v))).otherwise(False)),
    ).otherwise(none)
    phone = F.when(text.rlike(r"\+[0-9]"), _placed(text, _PHONE, lambda v: size(v).between(8, 15))).otherwise(none)
    def tagged(rank: int, name: str, spans: Column) -> Column:
        def one(s: Column) -> Column:
            value = _digits(s["value"]) if name in ("card", "phone") else F.lower(s["value"])
            return F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"))

        return F.transform(spans, one)

    by_kind = [tagged(k, name, spans) for k, (name, spans) in enumerate(zip(KINDS, (email, ip, card, phone), strict=True))]
    return F.concat(*by_kind)


def _context(masked: Column, size: Column, start: Column, end: Column) -> Column:
    """The words near a mention in the cut text ``masked`` of ``size`` code points, with their places; words cut by the window's ends are left out."""
    low = F.greatest(start - WINDOW, F.lit(0))

    def words(near: Column) -> Column:
        whole = F.filter(_placed(near, _WORD, lambda v: F.lit(True)), lambda w: ((w["start"] > 0) | (low == 0)) & (w["end"] < F.length(near)))
        return F.transform(whole, lambda w: F.struct(F.lower(w["value"]).alias("word"), (w["start"] + low).alias("start"), (w["end"] + low).alias("end")))

    return _let(_part(masked, low, F.least(end + WINDOW, size)), words)


def _masked(text: Column, spans: Column) -> Column:
    """The text with every base span overwritten by as many digits, which are no words."""
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return _rewritten(text, by_start, lambda s, reach: F.repeat(F.lit("0"), F.greatest(s["end"] - F.greatest(s["start"], reach), F.lit(0))))


def found(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with text_key, base, contexts and n_words: the base spans of each row, written once for the steps that follow."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("text_key", F.md5(text)).withColumn("base", base_spans(text))

    def contexts(masked: Column) -> Column:
        one = lambda s, size: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), _context(masked, size, s["start"], s["end"]).alias("words"))
        return _let(F.length(text), lambda size: F.transform("base", lambda s: one(s, size)))

    none = F.array().cast("array<struct<kind:string,value:string,words:array<struct<word:string,start:int,end:int>>>>")
    near = F.when(F.size("base") > 0, _let(_cut_up(_masked(text, F.col("base"))), contexts)).otherwise(none)
    return rows.withColumn("contexts", near).withColumn("n_words", F.regexp_count(text, F.lit(_WORD)))


_NOWHERE = "array<struct<start:int,end:int>>"


def _assured(share: Column, contexts: Column) -> Column:
    """The lower end of Wilson's interval for a share seen in so many contexts."""
    z2 = CONFIDENCE**2
    return (share + z2 / (2 * contexts) - CONFIDENCE * F.sqrt((share * (1 - share) + z2 / (4 * contexts)) / contexts)) / (1 + z2 / contexts)


def terms(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, terms): where words that disclose an entity stand in its contexts, from the rows of ``found``."""
    mentions = rows.where(F.size("contexts") > 0).select("doc_id", "text_key", F.explode("contexts").alias("c")).select("doc_id", "text_key", "c.kind", "c.value", "c.words")
    distinct = mentions.select("kind", "value", F.col("words.word").alias("words")).distinct()
    pairs = distinct.select("kind", "value", F.explode("words").alias("word")).groupBy("kind", "value", "word").agg(F.count(F.lit(1)).alias("contexts"))
    near = mentions.select("doc_id", "text_key", "kind", "value", F.explode("words").alias("w")).select("doc_id", "text_key", "kind", "value", "w.word", "w.start", "w.end")
    both = near.groupBy("kind", "value", "word").agg(F.count(F.lit(1)).alias("both"))
    entities = both.groupBy("kind", "value").agg(F.sum("both").alias("size"))
    everything = rows.agg(F.coalesce(F.sum("n_words"), F.lit(1))).first()[0]
    ic = -F.log(F.least(F.col("size") / F.lit(float(max(everything, 1))), F.lit(0.5)))
    disclosure = lambda share: 1 + F.log(_assured(share, F.col("contexts"))) / ic
    # Words that would not reach the threshold even if they stood nowhere else need not be counted.
    possible = written(pairs.join(both, ["kind", "value", "word"]).join(entities, ["kind", "value"]).where(disclosure(F.lit(1.0)) >= THRESHOLD), "pairs")
    n = possible.count()
    wanted = written(in_few(possible.select("word").distinct(), n), "wanted")
    texts = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(_WORD), F.lit(0))).alias("word"))
    if wanted.count() <= FEW_WORDS:
        totals = texts.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        # The whole vocabulary is counted in a stage of its own, in as many tasks as the session deals it to; only the table after it is small.
        totals = written(texts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(wanted, "word", "left_semi"), "totals")
    share = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    disclosing = written(in_few(possible.join(totals, "word").where(disclosure(share) >= THRESHOLD).select("kind", "value", "word"), n), "terms")
    hits = near.join(disclosing, ["kind", "value", "word"])
    return written(hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms")), "hits")


def _with_terms(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` (which have doc_id and text_key) with the array ``terms`` in place of text_key."""
    r, h = rows.alias("r"), hits.alias("h")
    same = F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.text_key") == F.col("h.text_key"))
    kept = [F.col(f"r.`{c}`") for c in rows.columns if c != "text_key"]
    return r.join(h, same, "left").select(*kept, F.coalesce("h.terms", F.array().cast(_NOWHERE)).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, terms) of each row of ``docs``: the spans of personal data and of disclosing terms."""
    rows = written(found(docs.select("doc_id", "text")).drop("text"), "personal")
    return _with_terms(rows.select("doc_id", "text_key", "base"), terms(docs, rows))


def sanitised(docs: DataFrame, *, remove_terms: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``base`` and ``terms`` (arrays of spans) and ``sanitised`` (the text without them).

    Spans become their kind in brackets; terms become ``[term]``, or nothing with ``remove_terms``.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("base", "terms", "sanitised", "text_key", "contexts", "n_words")])
    rows = written(found(docs), "personal")
    out = _with_terms(rows.drop("contexts", "n_words"), terms(docs, rows))
    return out.withColumn("sanitised", _cut(F.col("text"), F.col("base"), F.col("terms"), "" if remove_terms else "[term]"))


def _cut(text: Column, base: Column, found_terms: Column, instead: str) -> Column:
    """The text with its spans replaced from left to right; a span that begins inside an earlier one joins it."""
    marks = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("mark"))),
        F.transform(found_terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(instead).alias("mark"))),
    )
    return _rewritten(text, F.sort_array(marks), lambda s, reach: F.when(s["start"] >= reach, s["mark"]).otherwise(""))
