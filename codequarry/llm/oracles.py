"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^ \t-\r]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.doc_id WHERE r.c < e.b
), least AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN least ON least.doc_id = w.doc_id
"""

OP3 = r"""
WITH p AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919 % 365) * 86400 + page_id % 86400 AS fetched_at,
         coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '') AS path FROM pages
), pattern AS (
  SELECT DISTINCT 'domain' AS kind, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern FROM p
  UNION ALL SELECT DISTINCT 'host', host FROM p
  UNION ALL SELECT DISTINCT 'prefix', host || regexp_extract(path, '^(/[^/]*/)', 1) FROM p WHERE host || regexp_extract(path, '^(/[^/]*/)', 1) LIKE '%/'
), hashed AS (
  SELECT kind, pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS h FROM pattern WHERE pattern <> '' AND pattern NOT LIKE '/%'
), entries AS (
  SELECT 'domains' AS list, 'block' AS verdict, kind, pattern, h % 300 AS d, CASE WHEN h % 6 = 0 THEN h % 300 + 60 END AS e FROM hashed WHERE kind = 'domain' AND h % 3 = 0
  UNION ALL SELECT 'hosts', 'block', kind, pattern, h % 200, CASE WHEN h % 8 = 0 THEN h % 200 + 90 END FROM hashed WHERE kind = 'host' AND h % 4 = 0
  UNION ALL SELECT 'hosts', 'block', kind, pattern, h % 200 + 150, NULL FROM hashed WHERE kind = 'host' AND h % 16 = 0
  UNION ALL SELECT 'sections', 'allow', kind, pattern, h % 100, NULL FROM hashed WHERE kind = 'prefix' AND h % 5 = 0
), active AS (
  SELECT p.page_id, p.url, e.*,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY CASE e.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(e.pattern) DESC) AS place,
         count(*) OVER (PARTITION BY p.page_id, p.url) AS n
  FROM p JOIN entries e ON CASE e.kind WHEN 'host' THEN p.host = e.pattern
                                       WHEN 'domain' THEN p.host = e.pattern OR ends_with(p.host, '.' || e.pattern)
                                       ELSE starts_with(p.host || p.path, e.pattern) END
  WHERE 1704067200 + e.d * 86400 <= p.fetched_at AND (e.e IS NULL OR p.fetched_at < 1704067200 + e.e * 86400)
)
SELECT p.page_id, p.url, p.host, p.fetched_at, coalesce(a.verdict, 'none') AS status, a.list, a.kind, a.pattern, coalesce(a.n, 0) AS n_active
FROM p LEFT JOIN active a ON a.page_id = p.page_id AND a.url = p.url AND a.place = 1
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7 = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages
), block AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS bs
  FROM article
), joined AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(bs, lambda b: b <> ''), chr(10)), '') AS text FROM block
)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

_WORDS8 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '{_WORDS8}') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_TEXT}, '{_WORDS8}') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k,
         unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS g
  FROM b WHERE len(ws) > 0
), place AS (
  SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k
), grams AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM place
), found AS (
  SELECT g.doc_id, g.i, g.k, w.item_id FROM grams g JOIN win w ON w.k = g.k AND w.g = g.g
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _mixing(steps: int, rounds_per_step: int = 4, tolerance: float = 1e-6) -> str:
    """Raking that ends after the first step which leaves every margin within the tolerance, of at most ``steps``."""
    names = ("source", "lang", "topic")
    parts = [r"""WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shout' WHEN contains(text, '%%% ') THEN 'symbols'
              WHEN length(coalesce(text, '')) < 500 THEN 'short' WHEN length(coalesce(text, '')) < 4000 THEN 'medium' ELSE 'long' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT + 1 AS tokens FROM documents
), cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS weight FROM d GROUP BY ALL)"""]
    for name in names:
        parts.append(f"""goal_{name} AS (SELECT {name}, sqrt(w) / sum(sqrt(w)) OVER () * sum(w) OVER () AS goal
  FROM (SELECT {name}, sum(weight)::DOUBLE AS w FROM cells GROUP BY {name}))""")
    parts.append("f0 AS (SELECT source, lang, topic, weight, weight::DOUBLE AS fitted FROM cells)")
    last, ends, going = "f0", [], "true"
    for step in range(1, steps + 1):
        for turn in range(rounds_per_step):
            for name in names:
                now = f"f{step}_{turn}_{name}"
                parts.append(f"{now} AS MATERIALIZED (SELECT f.source, f.lang, f.topic, weight, fitted * goal / sum(fitted) OVER (PARTITION BY f.{name}) AS fitted "
                             f"FROM {last} f JOIN goal_{name} g ON g.{name} = f.{name})")
                last = now
        off = " UNION ALL ".join(f"SELECT max(abs(m / goal - 1)) AS r FROM (SELECT {n}, sum(fitted) AS m FROM {last} GROUP BY {n}) JOIN goal_{n} USING ({n})" for n in names)
        parts.append(f"r{step} AS MATERIALIZED (SELECT max(r) <= {tolerance} AS met FROM ({off}))")
        ends.append(f"SELECT * FROM {last} WHERE {going} AND " + (f"(SELECT met FROM r{step})" if step < steps else "true"))
        going += f" AND NOT (SELECT met FROM r{step})"
    parts.append(f"""fit AS MATERIALIZED ({' UNION ALL '.join(ends)}),
scaled AS (SELECT fitted / weight AS factor,
  (0.5::DOUBLE * sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(fitted) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM fit WINDOW o AS (ORDER BY fitted / weight DESC, source, lang, topic)),
chance AS (SELECT source, lang, topic, round(least((SELECT max_by(scale, factor) FROM scaled WHERE scale * factor <= 1) * fitted / weight, 1.0) * 1000000000)::BIGINT
  AS per_billion FROM fit)""")
    return ", ".join(parts) + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, c.per_billion,
       ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < c.per_billion / 1000000000.0 AS kept
FROM d JOIN chance c USING (source, lang, topic)"""


def _clusters(k: int, rounds: int) -> str:
    parts = ["""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, q AS m FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k})
)"""]
    for step in range(rounds + 1):
        parts.append(f"""a{step} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, arg_min(c, d * 1000 + c) AS c, min(d)::BIGINT AS d, any_value(q) AS q
  FROM (SELECT r, vec_id, q, c, list_inner_product(q, q) - 2 * list_inner_product(q, m) + list_inner_product(m, m) AS d FROM v, c{step}) GROUP BY r
)""")
        if step < rounds:
            parts.append(f"""s{step} AS (
  SELECT c, list(x ORDER BY i) AS m FROM (
    SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{step}) GROUP BY c, i) GROUP BY c
), c{step + 1} AS MATERIALIZED (SELECT c, coalesce(s{step}.m, c{step}.m) AS m FROM c{step} LEFT JOIN s{step} USING (c))""")
    return ", ".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


_CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|\|endoftext\|>)"
OP13 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{_CONTROL}', '\1\\\2\3', 'g'))
            + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op1_minhash": OP1, "op3_url_filters": OP3, "op4_topk": OP4, "op7_main_text": OP7,
    "op8_decontamination": OP8, "op10_mixing": _mixing(16),
    "op12_centroids": _clusters(40, 5), "op13_chat": OP13,
}
