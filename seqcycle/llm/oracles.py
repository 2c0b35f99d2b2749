"""What the queries of this subpackage return, in SQL, where SQL can say it: by definition, without the method's shortcuts."""

from __future__ import annotations

from . import disclosure, filteraudit, hnsw, lshforest, poissonmix, seekwarc, spacedseeds

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), newest AS (
  SELECT payload, max(page_id) AS newest FROM p WHERE n >= {seekwarc.REVISIT_BYTES} GROUP BY payload
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM p LEFT JOIN newest USING (payload)
"""

#: Smallest nodes reachable over (a, b) links, for a common table expression ``links`` of both directions.
_REACHED = """
reached(node, root) AS (
  SELECT a, a FROM links
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node WHERE r.root < l.b
), roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {lshforest.WORDS - 1}], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {lshforest.WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {lshforest.SIMILAR} * (x.n + y.n - c)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), {_REACHED}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN roots ON roots.node = w.doc_id
"""

# On one alignment, from the i-th match to the j-th, matches less substitutions times the penalty are
# (1 + penalty) * (j - i) - penalty * (place_j - place_i) + 1.
_P = spacedseeds.PENALTY
OP3 = rf"""
WITH d AS (
  SELECT doc_id, u.t, (u.i - 1)::INTEGER AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents), unnest(w) WITH ORDINALITY AS u(t, i)
), b0 AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark
), b AS (
  SELECT item_id, u.t, (u.i - 1)::INTEGER AS i, len(w) AS n FROM b0, unnest(w) WITH ORDINALITY AS u(t, i) WHERE len(w) >= {spacedseeds.MIN_ITEM}
), m AS (
  SELECT doc_id, item_id, n, d.i - b.i AS diagonal, b.i AS place FROM d JOIN b USING (t)
), enough AS (SELECT doc_id, item_id, diagonal FROM m GROUP BY ALL HAVING count(*) >= min(least({spacedseeds.MIN_MATCH}, n))),
k AS (
  SELECT m.*, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY place) AS k FROM m JOIN enough USING (doc_id, item_id, diagonal)
), g AS (
  SELECT *, {1 + _P} * k - {_P} * place AS f FROM k
), spans AS (
  SELECT y.doc_id, y.item_id, y.diagonal, min(y.n) AS n, y.k AS last_k, min(y.place) AS last_place, min(x.k) AS first_k, min(x.place) AS first_place
  FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.diagonal = y.diagonal AND x.k <= y.k AND x.f <= y.f + 1
  GROUP BY y.doc_id, y.item_id, y.diagonal, y.k
), segments AS (
  SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY last_k - first_k DESC, last_k) = 1
), found AS (
  SELECT doc_id, item_id, (last_k - first_k + 1)::INTEGER AS matched, last_place - first_place + 1 AS overlap_tokens, first_place + diagonal AS doc_start, first_place AS item_start, n
  FROM segments
)
SELECT doc_id, item_id, matched, overlap_tokens, doc_start, item_start FROM found WHERE matched >= least({spacedseeds.MIN_MATCH}, n)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_start) = 1
"""

OP6 = f"""
WITH keyed AS (
  SELECT *, coalesce(source, '') AS source_key, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), counts AS (
  SELECT source_key, count(*) AS n FROM keyed GROUP BY source_key
), rates AS (
  SELECT source_key, 1.0::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / n::DOUBLE AS rate FROM counts
), parts AS (
  SELECT source_key, greatest(ceil(rate / {poissonmix.CHUNK}::DOUBLE), 1)::BIGINT AS parts, rate / greatest(ceil(rate / {poissonmix.CHUNK}::DOUBLE), 1)::DOUBLE AS mean FROM rates
), terms AS (
  SELECT source_key, parts, j, sum(exp(-mean + j * ln(mean) - lgamma(j + 1))) OVER (PARTITION BY source_key ORDER BY j ROWS UNBOUNDED PRECEDING) AS cumulative
  FROM parts, range(0, 60) AS t(j)
), draws AS (
  SELECT k, doc_id, p, source_key, (('0x' || substr(md5('{poissonmix.SEED}:draw:' || k || ':' || p), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM (SELECT k, doc_id, source_key, unnest(range(1, parts + 1)) AS p FROM (SELECT DISTINCT k, doc_id, source_key FROM keyed) JOIN parts USING (source_key))
), copies AS (
  SELECT k, source_key, count(*) AS copies FROM draws JOIN terms USING (source_key) WHERE cumulative <= u GROUP BY k, source_key
)
SELECT doc_id, text, lang, source, n_chars, copies::INTEGER AS copies, c::INTEGER AS copy, md5('{poissonmix.SEED}:shuffle:' || k || ':' || c) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS c FROM keyed JOIN copies USING (k, source_key))
"""

OP7 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), good AS MATERIALIZED (SELECT DISTINCT vec_id, e, norm FROM u WHERE norm > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= {hnsw.LEAST}
), {_REACHED}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(coalesce(root, vec_id) = vec_id, true) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN roots ON node = vec_id
"""


def _base(kind: str, rank: int, text: str, pattern: str, good: str) -> str:
    """Rows (key, rank, kind, s, e, value) of one kind: places from the lengths of what stands between matches."""
    return f"""SELECT key, {rank} AS rank, '{kind}' AS kind, s, s + length(v) AS e, v AS value FROM (
  SELECT key, i, v, (sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER w, 0) - length(v))::BIGINT AS s
  FROM (SELECT key, generate_subscripts(m, 1) AS i, unnest(m) AS v, unnest(gaps[1:len(m)]) AS gap
        FROM (SELECT key, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS gaps FROM docs))
  WINDOW w AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {good}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INTEGER) % 10
  + (2 * substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INTEGER) // 10 ELSE substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INTEGER END)) % 10 = 0"""
_OCTETS = "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INTEGER), 0) > 255)) = 0"

_KINDS = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in disclosure.KINDS)
_W, _Z2 = disclosure.WINDOW, disclosure.CONFIDENCE**2
OP4 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS key FROM documents), base AS MATERIALIZED (
{_base("email", 0, "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
UNION ALL {_base("ip", 1, "t", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", _OCTETS)}
UNION ALL {_base("card", 2, "t", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
UNION ALL {_base("phone", 3, "t", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")}
), masked AS (
  SELECT key, list_reduce(list_prepend(t, list(s || ':' || e ORDER BY rank, s)), lambda a, x:
    left(a, split_part(x, ':', 1)::INTEGER) || repeat('0', split_part(x, ':', 2)::INTEGER - split_part(x, ':', 1)::INTEGER) || substr(a, split_part(x, ':', 2)::INTEGER + 1)) AS t
  FROM base JOIN docs USING (key) GROUP BY key, t
), near AS (
  SELECT key, kind, s, CASE WHEN kind IN ('card', 'phone') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(value) END AS value, greatest(s - {_W}, 0) AS low,
    substr(t, greatest(s - {_W}, 0) + 1, e + {_W} - greatest(s - {_W}, 0)) AS n FROM base JOIN masked USING (key)
), words AS MATERIALIZED (
  SELECT key, kind, value, ms, word, low + b AS b, low + b + length(v) AS e, i FROM (
    SELECT key, kind, value, ms, low, n, i, v, lower(v) AS word, (sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER w, 0) - length(v))::BIGINT AS b
    FROM (SELECT key, kind, value, s AS ms, low, n, generate_subscripts(m, 1) AS i, unnest(m) AS v, unnest(gaps[1:len(m)]) AS gap
          FROM (SELECT *, regexp_extract_all(n, '\p{{L}}{{3,}}') AS m, string_split_regex(n, '\p{{L}}{{3,}}') AS gaps FROM near))
    WINDOW w AS (PARTITION BY key, kind, ms ORDER BY i ROWS UNBOUNDED PRECEDING))
  WHERE (b > 0 OR low = 0) AND b + length(v) < length(n)
), contexts AS (
  SELECT DISTINCT kind, value, list(word ORDER BY i) AS words FROM words GROUP BY key, kind, value, ms
), seen AS (
  SELECT kind, value, word, count(*) AS m FROM (SELECT kind, value, unnest(words) AS word FROM contexts) GROUP BY ALL
), co AS (SELECT kind, value, word, count(*) AS together FROM words GROUP BY ALL),
entities AS (SELECT kind, value, sum(together) AS size FROM co GROUP BY ALL),
corpus AS MATERIALIZED (SELECT unnest(regexp_extract_all(lower(t), '\p{{L}}{{3,}}')) AS word FROM docs),
totals AS (SELECT word, count(*) AS n FROM corpus GROUP BY word),
shares AS (
  SELECT kind, value, word, m, least(together / n::DOUBLE, 1) AS p, -ln(least(size / (SELECT sum(n) FROM totals)::DOUBLE, 0.5)) AS ic
  FROM seen JOIN co USING (kind, value, word) JOIN totals USING (word) JOIN entities USING (kind, value)
), terms AS (
  SELECT kind, value, word FROM shares
  WHERE 1 + ln((p + {_Z2} / (2 * m) - {disclosure.CONFIDENCE} * sqrt((p * (1 - p) + {_Z2} / (4 * m)) / m)) / (1 + {_Z2} / m)) / ic >= {disclosure.THRESHOLD}
), found AS (
  SELECT key, rank, kind, s, e FROM base
  UNION ALL SELECT DISTINCT key, 4, 'term', b, e FROM words JOIN terms USING (kind, value, word)
)
SELECT doc_id, {_KINDS}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s, e) FILTER (rank IS NOT NULL), '') AS spans
FROM docs LEFT JOIN found USING (key) GROUP BY key, doc_id
"""

_A = filteraudit
OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_A.WORD}') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT row_number() OVER () AS row, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN len(w) < {_A.MIN_WORDS} THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < {_A.MIN_DISTINCT} * len(w) THEN 'B' END,
      CASE WHEN 100 * len(regexp_extract_all(text, '{_A.CAPITAL}')) > {_A.MAX_CAPITALS} * length(text) THEN 'C' END,
      CASE WHEN regexp_matches(text, '{_A.SYMBOL}') THEN 'D' END, CASE WHEN d.doc_id > f.first THEN 'E' END) AS failed
  FROM d JOIN f USING (text) LEFT JOIN l ON l.doc_id = d.doc_id
), x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
k AS (SELECT *, unnest(range(1, 6))::INTEGER AS step FROM o),
e AS (
  SELECT part, filter_order, step, filter_order[step] AS own, good, toxic, failed = filter_order[step] AS alone,
    contains(failed, filter_order[step]) AS fails, translate(filter_order[1:step - 1], failed, '') <> filter_order[1:step - 1] AS gone FROM m, k
), t AS (
  SELECT part, filter_order, step, own, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
    count(*) FILTER (alone) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""
