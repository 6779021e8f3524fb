"""SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components(links: str, nodes: str) -> str:
    """CTEs reach and comp: each node's smallest reachable node. links: (x, y) both ways; nodes: (id)."""
    return f"reach AS (SELECT id AS x, id AS y FROM {nodes} UNION SELECT reach.x, l.y FROM reach JOIN {links} l ON reach.y = l.x), comp AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)"


_digit = " + ".join(f"{1 << (4 - k)} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, CAST(CAST(unhex(sha1(b)) AS BIT) AS VARCHAR) AS bits FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{UPPER}234567', 1 + {_digit}, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS main FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN main = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN main <> page_id THEN main END AS refers_to FROM m
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS x, b.id AS y FROM g a JOIN g b ON a.label = b.label AND a.id <> b.id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
{components("links", "v")}
SELECT v.id AS vec_id, (SELECT count(*) FROM links WHERE links.x = v.id) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN comp USING (id)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
{components("pairs", "s")}
SELECT id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM s JOIN comp USING (id)
"""


#: Kinds as the contract and README name them, for an engine without look-behind: kind, pattern, the group that is the span (0: all), the one whose length counts, characters at least.
SECRET_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
    ("pem", r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY-----", 0, 0, 27),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 0, 40),
    ("gitlab", r"glpat-[A-Za-z0-9_-]+", 0, 0, 26),
    ("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 0, 20),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 0, 32),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 0, 39),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 1, 40),
    ("address", r"://[A-Za-z0-9._%+-]+:([^\x00-\x20/@:]+)@", 0, 1, 3),
)
BASE_KINDS = 3


def _found(order: int) -> str:
    kind, pattern, span, counted, least = SECRET_KINDS[order]
    pattern = pattern.replace("'", "''")
    at = "list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0)"
    lead = " + len(hits[i]) - len(parts[i])" if span else ""
    return f"""(SELECT doc_id, {order} AS k, '{kind}' AS kind, CAST({at}{lead} AS BIGINT) AS a, CAST({at} + len(hits[i]) AS BIGINT) AS b FROM
(SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {counted}) AS parts, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)) WHERE len(parts[i]) >= {least})"""


_kinds = [k for k, *_ in SECRET_KINDS[:BASE_KINDS]]
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(f"SELECT * FROM {_found(k)}" for k in range(len(SECRET_KINDS)))}),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(_kinds))}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {BASE_KINDS}) AS base FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, m AS size, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(m)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= 30),
i AS (SELECT lang, sub, max(a) AS whole FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda s: list_transform(range(1, size - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS sub FROM c WHERE size > 2) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.sub = c.phrase WHERE whole IS NULL OR 100 * CAST(whole AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
u AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM k),
s AS (SELECT u.lang, u.phrase, u.k, a, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM u JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.k], ' ') JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""

_crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(octet_length(b) AS BIGINT)), lambda i: 16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))"
SPELLING = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
e AS (SELECT run, n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b, hex(b) AS x FROM o),
h AS (SELECT run, n, xor({_crc}, 4294967295) AS h FROM e, t),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
g AS (SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS g FROM v),
c AS (SELECT DISTINCT a.word AS a, a.n AS n, b.word AS b, b.n AS m FROM g a JOIN g b ON a.g = b.g AND a.word <> b.word),
q AS (SELECT * FROM c WHERE CASE WHEN length(a) = length(b) THEN len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
 WHEN length(a) > length(b) THEN len(list_filter(range(1, length(a) + 1), lambda i: substr(a, 1, i - 1) || substr(a, i + 1) = b)) > 0 ELSE len(list_filter(range(1, length(b) + 1), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = a)) > 0 END),
f AS (SELECT a, count(*) AS n_near, first(b ORDER BY m DESC, b) AS b, max(m) AS m FROM q GROUP BY a),
w AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN f ON a = word),
r AS (SELECT word, word AS at FROM w UNION ALL SELECT r.word, w.form FROM r JOIN w ON r.at = w.word WHERE w.form IS NOT NULL),
z AS (SELECT r.word, r.at AS root FROM r JOIN w ON r.at = w.word WHERE w.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM w JOIN z USING (word)
"""

#: The pages of the data have one article element each, of headings and paragraphs; what is around it is boilerplate.
MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS t FROM a)
SELECT page_id, url, array_to_string(list_filter(t, lambda x: x <> ''), chr(10) || chr(10)) AS text, CAST(length(array_to_string(list_filter(t, lambda x: x <> ''), chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b
"""

WARC_COPIES = WARC.replace("FROM pages)", "FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id + 10000000 * k, html FROM pages, (VALUES (1), (2)) v(k) WHERE page_id % 2 = 0))", 1)
VECTOR_LINKS = VECTORS.replace("FROM embeddings)", """FROM (SELECT vec_id, embedding, label FROM embeddings UNION ALL SELECT vec_id + 10000000, list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)), label FROM embeddings
UNION ALL SELECT vec_id + 20000000, list_transform(embedding, lambda x, i: CASE WHEN i = 1 THEN CAST(0 AS FLOAT) ELSE x END), label FROM embeddings UNION ALL SELECT vec_id + 30000000, list_transform(embedding, lambda x: -x), label FROM embeddings WHERE vec_id % 3 = 0))""", 1)
