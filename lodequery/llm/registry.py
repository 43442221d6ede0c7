"""What the driver contract adds for this package."""
from __future__ import annotations

from lodequery.llm import queries as q

QUERIES = {f.__name__: f for f in (q.op1_warc_merge, q.op2_byte_bpe, q.op3_best_fit, q.op4_simhash, q.op5_bradley_terry, q.op6_isolation_forest, q.op7_minimum_cut, q.op8_surrogates, q.op9_weighted_sampling, q.op10_simple8b, q.op11_source_divergence, q.op12_lexical_search, q.op13_exact_top_k)}

#: SQL for the queries that it can express.
ORACLE: dict[str, str] = {}

ORACLE["op1_warc_merge"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE strlen(html) >= 100 GROUP BY 1 HAVING count(*) > 1),
u AS (SELECT *, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www[0-9]*[.])?([^/?#:]*)(?::([0-9]+))?([^?#]*)([?][^#]*)?', ['host', 'port', 'path', 'query']) AS parts FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, u.payload_digest,
    CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to,
    array_to_string(list_reverse(string_split(parts.host, '.')), ',') || CASE WHEN parts.port IN ('', '80', '443') THEN '' ELSE ':' || parts.port END
        || ')' || CASE WHEN parts.path = '' THEN '/' ELSE parts.path END || parts.query AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS timestamp
FROM u LEFT JOIN g USING (payload_digest)
"""

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op11_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, lang_n, v, lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n::HUGEINT + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (lang_n::HUGEINT + 5)) // (lang_total + 5 * v) AS q FROM filled),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM found)
SELECT lang, source, part, item, value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 50
"""

ORACLE["op12_lexical_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
has AS (SELECT id, doc_id, len(words) AS n, words FROM d WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM has),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM has) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
m AS (SELECT id, doc_id, 25 + (75 * n * docs) // terms AS m FROM has, total),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

ORACLE["op13_exact_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS query_id, a.id, b.vec_id, coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]), 0)::BIGINT AS score
    FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
