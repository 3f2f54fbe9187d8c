"""Oracle SQL: what each registered query must return, as plain SQL.

The statements run on the raw test tables and share only the corpus
projections, the fixed patterns and the query parameters with the library.
"""

from __future__ import annotations

from codequarry.functions import imports as im
from codequarry.functions import symbols as sy
from codequarry.functions.text import TRIM_CHARS
from codequarry.functions.tokens import SEPARATORS
from codequarry.plans import catalog as cat
from codequarry.plans.corpora import CODE, CONFIG, WINDOWS, corpus_sql


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(values: list[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


WS = quote(TRIM_CHARS)


def trimmed(sql: str) -> str:
    return f"trim({sql}, {WS})"


def shortened(sql: str, n: int) -> str:
    return f"CASE WHEN length({sql}) > {n} THEN substr({sql}, 1, {n}) || '...' ELSE {sql} END"


def split_sql(text: str = "text") -> str:
    return f"string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10))"


def lines_cte(corpus: str, name: str = "lines") -> str:
    return (f"{corpus}_files AS ({corpus_sql(corpus)}), {name} AS (SELECT repo, path, unnest({split_sql()}) AS raw, "
            f"generate_subscripts({split_sql()}, 1) AS line_no FROM {corpus}_files)")


EXT = r"lower(regexp_extract(path, '[^/](\.[^./]*)$', 1))"
SHOWN = shortened(trimmed("raw"), 200)


def search(corpus: str, test: str, tail: str = "") -> str:
    return (f"WITH {lines_cte(corpus)} SELECT repo, path, cast(line_no AS int) AS line_no, {SHOWN} AS line "
            f"FROM lines WHERE {test} {tail}")


def regex_test(pattern: str, column: str = "raw") -> str:
    return f"regexp_matches({column}, {quote('(?i)' + pattern)})"


def search_multi() -> str:
    parts = []
    for q in cat.MULTI:
        test = regex_test(q.query) if q.use_regex else f"contains(lower(raw), {quote(q.query.strip().lower())})"
        if q.path_pattern:
            test += f" AND contains(lower(path), {quote(q.path_pattern.lower())})"
        if q.exts:
            names = q.exts.split(",") if isinstance(q.exts, str) else q.exts
            test += f" AND {EXT} IN {among(['.' + n.strip().lstrip('.').lower() for n in names])}"
        parts.append(
            f"SELECT * FROM (SELECT {quote(q.query_id)} AS query_id, cast(row_number() OVER (ORDER BY repo, path, line_no) AS int) "
            f"AS rank, repo, path, cast(line_no AS int) AS line_no, {SHOWN} AS line FROM lines WHERE {test}) "
            f"WHERE rank <= {q.max_results}")
    return f"WITH {lines_cte('docs')} " + " UNION ALL ".join(parts)


def search_requests() -> str:
    parts = []
    for query_id, query, use_regex, exts, inside, limit in cat.REQUESTS:
        if query_id in ("refused", "blank"):
            continue
        query = query.strip()  # requests are trimmed before anything else looks at them
        tests = [regex_test(query) if use_regex else f"contains(lower(raw), {quote(query.lower())})"]
        if (inside or "").strip():
            tests.append(f"contains(lower(path), {quote(inside.strip().lower())})")
        if exts:
            tests.append(f"{EXT} IN {among(['.' + n.strip().lstrip('.').lower() for n in exts.split(',')])}")
        rank = "cast(row_number() OVER (ORDER BY repo, path, line_no) AS int)" if limit else "cast(NULL AS int)"
        parts.append(f"SELECT * FROM (SELECT {quote(query_id)} AS query_id, {rank} AS rank, repo, path, cast(line_no AS int) AS line_no, {SHOWN} AS line "
                     f"FROM lines WHERE {' AND '.join(tests)}) WHERE rank IS NULL OR rank <= {limit or 0}")
    return f"WITH {lines_cte('docs')} " + " UNION ALL ".join(parts)


SEARCH_FILTERED = f"""
WITH {lines_cte('docs')},
asked AS (SELECT item_id, unnest({split_sql()}) AS q, generate_subscripts({split_sql()}, 1) AS n FROM benchmark),
wanted AS (SELECT item_id, item_id || ':' || n AS query_id, {trimmed('q')} AS q, nullif(item_id % 7, 0) AS most FROM asked WHERE {trimmed('q')} <> ''),
met AS (SELECT query_id, most, repo, path, line_no, raw FROM lines JOIN wanted
  ON CASE WHEN item_id % 3 = 0 THEN regexp_matches(raw, '(?i)' || q) ELSE contains(lower(raw), lower(q)) END
  AND (item_id % 4 > 1 OR (item_id % 4 = 0 AND {EXT} IN ('.txt', '.md'))) AND (item_id % 5 <> 0 OR contains(lower(path), 'en/'))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY repo, path, line_no) AS place FROM met)
SELECT query_id, cast(CASE WHEN most IS NOT NULL THEN place END AS int) AS rank, repo, path, cast(line_no AS int) AS line_no, {SHOWN} AS line
FROM ranked WHERE most IS NULL OR place <= most"""

SEARCH_TABLE = f"""
WITH {lines_cte('docs')},
asked AS (SELECT item_id, unnest({split_sql()}) AS q, generate_subscripts({split_sql()}, 1) AS n FROM benchmark),
wanted AS (SELECT cast(item_id AS string) || ':' || cast(n AS string) AS query_id, lower({trimmed('q')}) AS q
           FROM asked WHERE {trimmed('q')} <> '')
SELECT query_id, repo, path, cast(line_no AS int) AS line_no, {SHOWN} AS line
FROM lines JOIN wanted ON contains(lower(raw), q)"""

# --- file filters -------------------------------------------------------------------------

_DEFAULT_IGNORED = (
    r"(?i)(^|/)(node_modules|\.git|dist|build|\.env|\.env\.[^/]*|[^/]*\.pem|[^/]*\.key|[^/]*\.id_rsa|"
    r"[^/]*\.id_ed25519|[^/]*\.p12|[^/]*\.pfx|[^/]*\.kdbx|[^/]*\.keystore|\.DS_Store|coverage|\.npmrc|\.pypirc)(/|$)"
)
_NO_DIST = _DEFAULT_IGNORED.replace("dist|", "")
IGNORED = f"""
CASE cast(replace(repo, 'nation_', '') AS int) % 3
  WHEN 0 THEN regexp_matches(path, {quote(_DEFAULT_IGNORED)})
       OR (path LIKE '%.log' AND path NOT LIKE '%/keep.log') OR path LIKE 'tmp/%'
  WHEN 1 THEN regexp_matches(path, {quote(_NO_DIST)}) OR (path LIKE 'services/%' AND path LIKE '%/run.log')
  ELSE regexp_matches(path, {quote(_DEFAULT_IGNORED)}) OR path LIKE 'assets/%' END"""

_BASE = "lower(regexp_extract(path, '[^/]*$'))"
SENSITIVE = rf"""({_BASE} = '.env' OR starts_with({_BASE}, '.env.')
  OR regexp_matches({_BASE}, '\.(pem|key|id_rsa|id_ed25519|p12|pfx|kdbx|keystore|jks)$')
  OR {_BASE} IN ('id_rsa', 'id_ed25519', 'id_dsa', 'id_ecdsa', 'credentials.json', 'secrets.json',
    'service-account.json', 'service_account.json', '.htpasswd', '.npmrc', '.pypirc', 'oauth_credentials.json')
  OR contains(path, '.kube/config') OR contains(path, '.aws/credentials'))"""

REASONS = f"""
SELECT repo, path, CASE WHEN {IGNORED} THEN 'ignored'
  WHEN len(string_split(path, '/')) > {cat.MAX_DEPTH} + 1 THEN 'depth'
  WHEN {SENSITIVE} THEN 'sensitive'
  WHEN strlen(text) > {cat.MAX_SIZE} THEN 'size'
  WHEN instr(text, chr(0)) > 0 THEN 'binary' ELSE 'ok' END AS reason, strlen(text) AS size
FROM ({corpus_sql('config')})"""


def ancestors_cte(corpus: str) -> str:
    return (f"files AS ({corpus_sql(corpus)}), parts AS (SELECT repo, path, strlen(text) AS size, string_split(path, '/') AS p "
            "FROM files), dirs AS (SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS path FROM "
            "(SELECT repo, p, unnest(range(1, len(p))) AS i FROM parts))")


def tree_sql(corpus: str, max_depth: int, ignored: str, sub: str = "") -> str:
    kept = f"starts_with(path, '{sub}/')" if sub else "true"
    inner = f"substr(path, {len(sub) + 2})" if sub else "path"
    return f"""WITH {ancestors_cte(corpus)},
entries AS (SELECT repo, path, false AS is_dir, size FROM parts UNION ALL SELECT repo, path, true, NULL FROM dirs),
named AS (SELECT *, cast(len(string_split({inner}, '/')) - 1 AS int) AS depth FROM entries WHERE {kept}),
slashed AS (SELECT repo, path AS plain, CASE WHEN is_dir THEN path || '/' ELSE path END AS path, is_dir, size, depth
            FROM named WHERE depth <= {max_depth})
SELECT repo, plain AS path, is_dir, depth, regexp_extract(plain, '[^/]*$') AS name,
  floor(size / 1024 * 10 + 0.5) / 10 AS size_kb
FROM slashed WHERE NOT ({ignored})"""


PATHS = rf"""
SELECT repo, path, regexp_extract(path, '[^/](\.[^./]*)$', 1) AS ext, regexp_extract(path, '[^/]*$') AS base,
  regexp_replace(path, '/[^/]*$', '') AS dir, cast(len(string_split(path, '/')) - 1 AS int) AS depth,
  'x/' || regexp_replace(path, '/[^/]*/[^/]*$', '') || '/up/' || regexp_extract(path, '[^/]*$') AS folded,
  floor(strlen(text) / 1024 * 10 + 0.5) / 10 AS size_kb,
  regexp_replace(path, '\.(ts|tsx|js|jsx|mjs|cjs|py)$', '') AS module
FROM ({corpus_sql('code')})"""

# --- symbols and imports -------------------------------------------------------------------


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quote(pattern)})"


def _group(column: str, pattern: str, n: int) -> str:
    return f"regexp_extract({column}, {quote(pattern)}, {n})"


KIND = f"""CASE
  WHEN t = '' OR starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') THEN NULL
  WHEN starts_with(t, '#') AND ext NOT IN ('.md', '.markdown') THEN NULL
  WHEN ext IN {among(sy.SCRIPT)} THEN CASE
    WHEN {_has('t', sy.SCRIPT_TYPE)} THEN {_group('t', sy.SCRIPT_TYPE, 4)}
    WHEN {_has('t', sy.SCRIPT_FUNCTION)} OR {_has('t', sy.SCRIPT_ARROW)} THEN 'function'
    WHEN {_has('t', sy.SCRIPT_METHOD)} AND NOT {_has('t', sy.SCRIPT_CONTROL)} THEN 'method' END
  WHEN ext = '.py' THEN CASE WHEN {_has('raw', sy.PYTHON_CLASS)} THEN 'class'
    WHEN {_has('raw', sy.PYTHON_DEF)} THEN CASE WHEN regexp_matches(raw, '^\\s') THEN 'method' ELSE 'function' END END
  WHEN ext IN ('.md', '.markdown') AND {_has('raw', sy.HEADING)} THEN 'h' || length({_group('raw', sy.HEADING, 1)})
  WHEN ext = '.go' THEN CASE WHEN {_has('t', sy.GO_FUNC)} THEN CASE WHEN {_group('t', sy.GO_FUNC, 1)} <> '' THEN 'method' ELSE 'function' END
    WHEN {_has('t', sy.GO_TYPE)} THEN {_group('t', sy.GO_TYPE, 2)} END
  WHEN ext = '.rs' AND {_has('t', sy.RUST_ITEM)} THEN {_group('t', sy.RUST_ITEM, 4)}
  WHEN ext IN {among(sy.BRACED)} THEN CASE WHEN {_has('t', sy.BRACED_CLASS)} THEN {_group('t', sy.BRACED_CLASS, 3)}
    WHEN {_has('t', sy.BRACED_FUNCTION)} AND NOT {_has('t', sy.BRACED_CONTROL)} THEN 'function' END
END"""

SIGNATURE = f"""CASE WHEN ext = '.py' THEN {trimmed("regexp_replace(t, ':$', '')")}
  WHEN ext IN ('.md', '.markdown') THEN {_group('raw', sy.HEADING, 1)} || ' ' || {trimmed(_group('raw', sy.HEADING, 2))}
  ELSE {trimmed("split_part(t, '{', 1)")} END"""

SYMBOLS_CTE = f"""{lines_cte('code')},
typed AS (SELECT *, {EXT} AS ext, {trimmed('raw')} AS t FROM lines),
kinds AS (SELECT *, {KIND} AS kind FROM typed),
symbols AS (SELECT repo, path, cast(line_no AS int) AS line_no, kind, {SIGNATURE} AS signature FROM kinds WHERE kind IS NOT NULL)"""

LAST_DIR = "regexp_replace(path, '/[^/]*$', '')"


def _first(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif({_group('t', p, 1)}, '')" for p in patterns) + ")"


IMPORTS_CTE = f"""{lines_cte('code')},
typed AS (SELECT *, {EXT} AS ext, {trimmed('raw')} AS t FROM lines),
found AS (SELECT repo, path, line_no, CASE WHEN t = '' OR regexp_matches(t, '^(//|#|/\\*|\\*)') THEN NULL
    WHEN ext IN {among(sy.SCRIPT)} THEN {_first(im.SCRIPT_IMPORTS)}
    WHEN ext = '.py' THEN {_first(im.PYTHON_IMPORTS)} END AS specifier FROM typed),
firsts AS (SELECT repo, path, specifier, cast(min(line_no) AS int) AS line_no FROM found
           WHERE specifier IS NOT NULL GROUP BY ALL),
imports AS (SELECT repo, path, line_no, specifier, CASE
    WHEN starts_with(specifier, '../../') THEN regexp_replace({LAST_DIR}, '/[^/]*/[^/]*$', '') || substr(specifier, 6)
    WHEN starts_with(specifier, './') THEN {LAST_DIR} || substr(specifier, 2)
    WHEN starts_with(specifier, '.') THEN {LAST_DIR} || '/' || substr(specifier, 2) END AS resolved FROM firsts)"""

# Import edges straight from the rows the files were made of.
EDGES_CTE = f"""sources AS (SELECT *, p_size % 8 AS lang FROM part WHERE p_size % 8 IN (0, 1, 6)),
named AS (SELECT p_partkey AS k, 'repo_' || p_partkey % 16 AS repo, 'src/parts/p_' || p_partkey ||
  CASE lang WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.js' END AS path FROM sources),
edges AS (SELECT n.repo, 'src/orders/o_' || l_orderkey || '/l' || l_linenumber || '_p' || l_partkey || '_s' ||
    l_suppkey || '_q' || cast(l_quantity AS int) || '.ts' AS src, n.path AS dst FROM lineitem JOIN named n ON l_partkey = k
  UNION ALL SELECT a.repo, a.path, b.path FROM named a JOIN named b ON b.k = a.k - 16)"""

FILE_REQUESTS = f"""asked AS (SELECT cast(p_partkey AS string) AS request_id, {CODE[1].repo} AS repo, {cat.REQUESTED} AS path,
    CASE p_partkey % 9 WHEN 3 THEN 'missing' WHEN 4 THEN 'denied' WHEN 5 THEN 'sensitive' WHEN 6 THEN 'ignored' WHEN 7 THEN 'directory' ELSE 'ok' END AS status,
    {CODE[1].path} AS target FROM part)"""

OUTLINE_STATUS = f"""WITH {SYMBOLS_CTE}, {FILE_REQUESTS}, texts AS ({corpus_sql('code')}),
n AS (SELECT repo, path, count(*) AS n FROM symbols GROUP BY ALL)
SELECT request_id, a.repo, a.path, status, cast(CASE WHEN status = 'ok' THEN len({split_sql('t.text')}) END AS int) AS line_count,
  cast(CASE WHEN status = 'ok' THEN coalesce(n, 0) END AS int) AS symbols
FROM asked a JOIN texts t ON t.repo = a.repo AND t.path = a.target LEFT JOIN n ON n.repo = a.repo AND n.path = a.target"""

DEPENDENCY_STATUS = f"""WITH {IMPORTS_CTE}, {EDGES_CTE}, {FILE_REQUESTS},
i AS (SELECT repo, path, count(*) FILTER (resolved IS NOT NULL) AS internal, count(*) FILTER (resolved IS NULL) AS external FROM imports GROUP BY ALL),
d AS (SELECT repo, dst, count(DISTINCT src) AS n FROM edges GROUP BY ALL)
SELECT request_id, a.repo, a.path, status, cast(CASE WHEN status = 'ok' THEN coalesce(internal, 0) END AS int) AS internal,
  cast(CASE WHEN status = 'ok' THEN coalesce(external, 0) END AS int) AS external, CASE WHEN status = 'ok' THEN coalesce(n, 0) END AS dependents
FROM asked a LEFT JOIN i ON i.repo = a.repo AND i.path = a.target LEFT JOIN d ON d.repo = a.repo AND d.dst = a.target"""

# --- ranking --------------------------------------------------------------------------------

SEP = quote(SEPARATORS)
# the letters outside ASCII in the documents, mapped to capitals that no
# lower-cased term contains: levenshtein() here counts bytes
ACCENTS, CAPITALS = "ßèéçíöóüêäñ", "ABCDEFGHIJK"


def by_chars(column: str) -> str:
    return f"translate({column}, '{ACCENTS}', '{CAPITALS}')"


def index_cte(corpus: str = "docs", scope: str = "'*'", where: str = "true", symbols: bool = False,
              files: str | None = None) -> str:
    texts = f"SELECT repo, path, text, '' AS symbols FROM ({files or corpus_sql(corpus)}) WHERE {where}"
    if symbols:
        texts = ("SELECT f.repo, f.path, f.text, coalesce(s.symbols, '') AS symbols FROM code_files f LEFT JOIN "
                 "(SELECT repo, path, string_agg(signature, ' ' ORDER BY line_no) AS symbols FROM symbols GROUP BY ALL) s "
                 "ON f.repo = s.repo AND f.path = s.path")
    return f"""texts AS ({texts}),
fields AS (SELECT {scope} AS scope, repo, path, 'symbols' AS field, symbols AS text FROM texts UNION ALL
  SELECT {scope}, repo, path, 'file', path FROM texts UNION ALL SELECT {scope}, repo, path, 'content', text FROM texts),
split AS (SELECT scope, repo, path, field, regexp_split_to_array(text, {SEP}) AS raw FROM fields),
lens AS (SELECT scope, repo, path, field, len(list_distinct(raw)) AS fl FROM split),
stats AS (SELECT scope, field, avg(fl) AS avg_fl, count(*) AS n FROM lens GROUP BY ALL),
words AS (SELECT scope, repo, path, field, lower(unnest(raw)) AS term FROM split),
tf AS (SELECT scope, repo, path, field, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL),
df AS (SELECT scope, field, term, count(*) AS df FROM tf GROUP BY ALL)"""


def score_cte(queries: str, prefix: bool = True, fuzzy: bool = True) -> str:
    kinds = ["SELECT qt, qt AS term, 1.0::double AS w FROM asked WHERE qt IN (SELECT term FROM df)"]
    if prefix:
        kinds.append("SELECT qt, term, 0.7 * length(term) / (length(term) + 0.3 * (length(term) - length(qt))) "
                     "FROM asked JOIN terms ON starts_with(term, qt) AND term <> qt")
    if fuzzy:
        distance = f"levenshtein({by_chars('term')}, {by_chars('qt')})"
        kinds.append(f"SELECT qt, term, 0.3 * length(term) / (length(term) + d) FROM (SELECT qt, term, {distance} AS d, "
                     "CASE WHEN length(qt) > 3 THEN least(6, floor(0.2 * length(qt) + 0.5)) ELSE 0 END AS lim "
                     "FROM asked JOIN terms ON abs(length(term) - length(qt)) <= 6 AND NOT starts_with(term, qt)) "
                     "WHERE d BETWEEN 1 AND lim")
    return f"""queries AS ({queries}),
qtok AS (SELECT query_id, lower(unnest(regexp_split_to_array({trimmed('query')}, {SEP}))) AS qt FROM queries),
qts AS (SELECT query_id, qt, count(*) AS times FROM qtok WHERE qt <> '' GROUP BY ALL),
asked AS (SELECT DISTINCT qt FROM qts), terms AS (SELECT DISTINCT term FROM df),
exp AS ({' UNION ALL '.join(kinds)}),
parts AS (SELECT query_id, scope, repo, path, qt, times * w * CASE field WHEN 'symbols' THEN 3.0 WHEN 'file' THEN 2.0 ELSE 1.0 END
    * ln(1 + (n - df + 0.5) / (df + 0.5))
    * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * fl / avg_fl))) AS part
  FROM tf JOIN exp USING (term) JOIN qts USING (qt) JOIN df USING (scope, field, term) JOIN stats USING (scope, field)
  JOIN lens USING (scope, repo, path, field)),
scores AS (SELECT query_id, scope, repo, path, floor(sum(part) * count(DISTINCT qt) * 1e6 + 0.5) / 1e6 AS score
  FROM parts GROUP BY ALL)"""


def top_sql(limit: str, prefix: str = "") -> str:
    return f"""SELECT {prefix} query_id, scope, cast(rank AS int) AS rank, repo, path, score,
  cast(least(100, floor(score * 100 / max(score) OVER (PARTITION BY query_id, scope) + 0.5)) AS int) AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, repo, path) AS rank FROM scores)
WHERE rank <= {limit}"""


def query_rows(rows: list[tuple[str, str]]) -> str:
    values = ", ".join(f"({quote(i)}, {quote(q)})" for i, q in rows)
    return f"SELECT * FROM (VALUES {values}) v(query_id, query)"


RANKED = query_rows(cat.RANK_QUERIES)
SCORES = "SELECT query_id, repo, path, score FROM scores"


def filtered_sql() -> str:
    parts = []
    for q in cat.FILTERED:
        where = f"contains(lower(path), {quote((q.path_pattern or '').lower())})"
        body = f"WITH {index_cte(where=where)}, {score_cte(query_rows([(q.query_id, q.query)]))} {top_sql(str(q.max_results))}"
        parts.append(f"SELECT query_id, rank, repo, path, score, pct FROM ({body})")
    return " UNION ALL ".join(parts)


KEY_LINES = f"""
WITH {index_cte()}, {score_cte(RANKED)}, hits AS ({top_sql(str(cat.TOP))}),
asked_words AS (SELECT query_id, list_filter(regexp_split_to_array(lower({trimmed('query')}), '\\s+'), lambda w: length(w) > 1) AS words
                FROM queries),
lines AS (SELECT repo, path, unnest({split_sql()}) AS raw, generate_subscripts({split_sql()}, 1) AS line_no,
          len({split_sql()}) AS line_count FROM texts),
matched AS (SELECT query_id, repo, path, line_no, raw, row_number() OVER (PARTITION BY query_id, repo, path ORDER BY line_no) AS n
  FROM hits JOIN asked_words USING (query_id) JOIN lines USING (repo, path)
  WHERE len(list_filter(words, lambda w: contains(lower(raw), w))) > 0),
counted AS (SELECT DISTINCT repo, path, line_count FROM lines)
SELECT h.query_id, h.rank, h.repo, h.path, cast(c.line_count AS int) AS line_count, '' AS symbol_preview,
  cast(m.line_no AS int) AS line, {shortened(trimmed('m.raw'), 120)} AS text
FROM hits h JOIN counted c USING (repo, path) LEFT JOIN matched m ON m.query_id = h.query_id AND m.repo = h.repo
  AND m.path = h.path AND m.n <= 3"""

CODE_KEY_LINES = f"""
WITH {SYMBOLS_CTE}, {index_cte(symbols=True)}, {score_cte(query_rows(cat.CODE_QUERIES))}, hits AS ({top_sql(str(cat.TOP))}),
asked_words AS (SELECT query_id, list_filter(regexp_split_to_array(lower({trimmed('query')}), '\\s+'), lambda w: length(w) > 1) AS words
                FROM queries),
cut AS (SELECT t.repo, t.path, symbols, unnest({split_sql()}) AS raw, generate_subscripts({split_sql()}, 1) AS line_no,
        len({split_sql()}) AS line_count FROM texts t SEMI JOIN hits h ON t.repo = h.repo AND t.path = h.path),
matched AS (SELECT query_id, repo, path, line_no, raw, row_number() OVER (PARTITION BY query_id, repo, path ORDER BY line_no) AS n
  FROM hits JOIN asked_words USING (query_id) JOIN cut USING (repo, path)
  WHERE len(list_filter(words, lambda w: contains(lower(raw), w))) > 0),
counted AS (SELECT DISTINCT repo, path, line_count, array_to_string(string_split(symbols, ' ')[1:8], ' ') AS preview FROM cut)
SELECT h.query_id, h.rank, h.repo, h.path, cast(c.line_count AS int) AS line_count, c.preview AS symbol_preview,
  cast(m.line_no AS int) AS line, {shortened(trimmed('m.raw'), 120)} AS text
FROM hits h JOIN counted c USING (repo, path) LEFT JOIN matched m ON m.query_id = h.query_id AND m.repo = h.repo
  AND m.path = h.path AND m.n <= 3"""

# The links straight from the numbers: whoever is in a module's group imports it.
DEPENDENTS_SUFFIX = """
WITH m AS (SELECT c_custkey AS k, c_custkey - c_custkey % 5 AS t, c_custkey % 5 AS kind FROM customer)
SELECT 'group_' || (a.t % 16) AS repo, CASE a.kind WHEN 1 THEN 'use_' || a.k || '.js' WHEN 2 THEN 'deep/pkg/src/app/use_' || a.k || '.cjs'
  ELSE 'pkg/src/app/use_' || a.k || '.tsx' END AS src, 'pkg/src/lib/mod_' || b.t || '.ts' AS dst,
  CASE a.kind WHEN 3 THEN 'exact' ELSE 'suffix' END AS match_type
FROM m a JOIN m b ON a.t = b.t AND b.kind = 0 WHERE a.kind IN (1, 2, 3)"""

REQUESTED_CONFIG = f"""asked AS (SELECT c_custkey AS k, {CONFIG[0].repo} AS repo, {CONFIG[0].path} AS path, {CONFIG[0].text} AS text FROM customer),
judged AS (SELECT *, CASE WHEN {SENSITIVE} THEN 'sensitive' WHEN {IGNORED} THEN 'ignored' WHEN instr(text, chr(0)) > 0 THEN 'binary' END AS refused
  FROM asked)"""

SLICE_STATUS_IGNORED = f"""WITH {REQUESTED_CONFIG}
SELECT cast(k AS string) AS slice_id, repo, CASE WHEN k % 2 = 1 THEN replace(path, '/', chr(92)) ELSE path END AS path,
  coalesce(refused, 'ok') AS status, cast(CASE WHEN refused IS NULL THEN 2 END AS int) AS first_line,
  cast(CASE WHEN refused IS NULL THEN 3 END AS int) AS last_line, cast(CASE WHEN refused IS NULL THEN 3 END AS int) AS total_lines FROM judged"""

PATCH_RESULTS_IGNORED = f"""WITH {REQUESTED_CONFIG}, counted AS (SELECT *,
  CASE WHEN refused IS NULL THEN cast((length(text) - length(replace(text, 'segment', ''))) / 7 AS int) ELSE 0 END AS n FROM judged)
SELECT cast(k AS string) AS patch_id, repo, CASE WHEN refused IS NOT NULL THEN refused WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous'
  ELSE 'applied' END AS status, n AS occurrences, cast(CASE WHEN refused IS NULL THEN 3 END AS int) AS old_lines FROM counted"""

PATCH_LINE_ENDS = f"""WITH w AS (SELECT p_partkey AS k, {WINDOWS[0].repo} AS repo, {WINDOWS[0].path} AS path,
  'name: ' || p_name || chr(10) || 'size: 0' || chr(10) || 'more' || chr(10) || 'end: size: ' || p_size || chr(10) || 'last' AS one FROM part),
two AS (SELECT k, repo, path, CASE WHEN k % 3 = 0 THEN replace(one, 'size', 'weight') ELSE one END AS t FROM w),
ended AS (SELECT repo, path, CASE WHEN k % 2 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS text FROM two)
SELECT repo, path, strlen(text) AS size, text FROM ended"""

TREE_ORDER = f"""WITH {ancestors_cte('code')}, entries AS (SELECT repo, path FROM parts UNION ALL SELECT repo, path FROM dirs),
slashed AS (SELECT repo, path FROM entries WHERE NOT regexp_matches(path, {quote(_DEFAULT_IGNORED)}))
SELECT repo, path, cast(row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS int) AS place FROM slashed"""

REFRESHED = f"""SELECT source AS repo, lang || '/doc_' || cast(doc_id AS string) || '.txt' AS path,
  CASE WHEN doc_id % 10 = 0 THEN 'edited anew ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1"""

# --- slices, patches, changes ---------------------------------------------------------------

SLICES_CTE = f"""asked AS (SELECT cast(doc_id AS string) AS slice_id, source AS repo, doc_id % 11 AS p,
  CASE WHEN doc_id % 11 = 3 THEN 'gone.txt' WHEN doc_id % 11 = 4 THEN '../up.txt' WHEN doc_id % 11 = 5 THEN 'a/.env'
    WHEN doc_id % 11 = 6 THEN 'dist/a.txt' ELSE './' || lang || '/doc_' || doc_id || '.txt' END AS path,
  CASE WHEN doc_id % 9 = 0 THEN -1 WHEN doc_id % 9 = 1 THEN 1 WHEN doc_id % 9 = 2 THEN 1 ELSE doc_id % 9 - 2 END AS s,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 + 1 END AS e, {split_sql()} AS arr FROM documents),
judged AS (SELECT *, len(arr) AS total, coalesce(least(e, len(arr)), len(arr)) AS last,
  CASE p WHEN 3 THEN 'missing' WHEN 4 THEN 'denied' WHEN 5 THEN 'sensitive' WHEN 6 THEN 'ignored'
    ELSE CASE WHEN s < 0 THEN 'bad_range' WHEN s > len(arr) THEN 'start_past_end' ELSE 'ok' END END AS status FROM asked)"""

SLICE_STATUS = f"""WITH {SLICES_CTE} SELECT slice_id, repo, path, status,
  cast(CASE WHEN status = 'ok' THEN s END AS int) AS first_line, cast(CASE WHEN status = 'ok' THEN last END AS int) AS last_line,
  cast(CASE WHEN p NOT IN (3, 4, 5, 6) THEN total END AS int) AS total_lines FROM judged"""

SLICE_LINES = f"""WITH {SLICES_CTE},
lines AS (SELECT slice_id, unnest(arr) AS text, generate_subscripts(arr, 1) AS n FROM asked)
SELECT j.slice_id, j.repo, j.path, j.status, cast(l.n AS int) AS line_no, l.text FROM judged j
LEFT JOIN lines l ON l.slice_id = j.slice_id AND j.status = 'ok' AND l.n BETWEEN j.s AND j.last"""


def _count(text: str, target: str) -> str:
    return f"cast((length({text}) - length(replace({text}, {target}, ''))) / length({target}) AS int)"


def _n_lines(text: str) -> str:
    return f"cast(len(string_split({text}, chr(10))) AS int)"


PATCH_CTE = f"""working AS ({corpus_sql('working')}),
asked AS (SELECT p_partkey AS k, p_size, 'shop_' || p_partkey % 7 AS repo,
  CASE WHEN p_partkey % 11 = 3 THEN 'lib/gone_' || p_partkey WHEN p_partkey % 13 = 4 THEN '../p_' || p_partkey
    WHEN p_partkey % 17 = 5 THEN 'lib/' || p_partkey || '.pem' ELSE 'lib/p_' || p_partkey || '.yml' END AS path FROM part),
base AS (SELECT a.*, w.text AS t0, CASE WHEN starts_with(a.path, '../') THEN 'denied' WHEN a.path LIKE '%.pem' THEN 'sensitive'
  WHEN w.text IS NULL THEN 'missing' END AS refused FROM asked a LEFT JOIN working w USING (repo, path)),
one AS (SELECT *, {_count('t0', "'size: '")} AS n1,
  CASE WHEN {_count('t0', "'size: '")} = 0 THEN 'not_found' WHEN {_count('t0', "'size: '")} > 1 THEN 'ambiguous' ELSE 'applied' END AS s1
  FROM base),
mid AS (SELECT *, CASE WHEN s1 = 'applied' THEN replace(t0, 'size: ', 'size: $&' || k) ELSE t0 END AS t1 FROM one),
two AS (SELECT *, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN {_count('t1', "'e: '")} ELSE {_count('t1', "'absent'")} END AS n2 FROM mid),
judged AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'empty_target' WHEN n2 = 0 THEN 'not_found'
  WHEN n2 > 1 AND k % 2 <> 0 THEN 'ambiguous' ELSE 'applied' END AS s2 FROM two),
done AS (SELECT *, CASE WHEN s2 = 'applied' THEN replace(t1, 'e: ', 'e = ' || chr(10)) ELSE t1 END AS t2 FROM judged)"""

PATCH_RESULTS = f"""WITH {PATCH_CTE}, results AS (
SELECT repo, path, k || '#1' AS patch_id, 1 AS seq, coalesce(refused, s1) AS status, CASE WHEN refused IS NULL THEN n1 ELSE 0 END AS occurrences,
  CASE WHEN refused IS NULL THEN {_n_lines('t0')} END AS old_lines, CASE WHEN refused IS NULL THEN {_n_lines('t1')} END AS new_lines FROM done
UNION ALL SELECT repo, path, k || '#2', 2, coalesce(refused, s2), CASE WHEN refused IS NULL THEN n2 ELSE 0 END,
  CASE WHEN refused IS NULL THEN {_n_lines('t1')} END, CASE WHEN refused IS NULL THEN {_n_lines('t2')} END FROM done)
"""

PATCH_SNAPSHOT = f"""WITH {PATCH_CTE}
SELECT w.repo, w.path, strlen(coalesce(d.t2, w.text)) AS size, coalesce(d.t2, w.text) AS text
FROM working w LEFT JOIN (SELECT repo, path, t2 FROM done WHERE refused IS NULL) d USING (repo, path)"""

VERSIONS_CTE = f"""{PATCH_CTE}, versions AS (
SELECT 1 AS version, repo, path, text FROM ({corpus_sql('base')}) UNION ALL SELECT 2, repo, path, text FROM ({corpus_sql('staged')})
UNION ALL SELECT 3, repo, path, text FROM working
UNION ALL SELECT 4, w.repo, w.path, coalesce(d.t2, w.text) FROM working w LEFT JOIN (SELECT repo, path, t2 FROM done WHERE refused IS NULL) d USING (repo, path)
UNION ALL SELECT 5, repo, path, text FROM ({corpus_sql('base')}))"""


def _version_step(old: int, new: int) -> str:
    return (f"SELECT '{old}-{new}' AS step, repo, path, CASE WHEN o.text IS NULL THEN 'A' WHEN n.text IS NULL THEN 'D' ELSE 'M' END AS status "
            f"FROM (SELECT * FROM versions WHERE version = {old}) o FULL JOIN (SELECT * FROM versions WHERE version = {new}) n USING (repo, path) "
            "WHERE o.text IS DISTINCT FROM n.text")


SIDES_CTE = f"""b AS ({corpus_sql('base')}), s AS ({corpus_sql('staged')}), w AS ({corpus_sql('working')}),
sides AS (SELECT repo, path, b.text AS bt, s.text AS st, w.text AS wt
  FROM b FULL JOIN s USING (repo, path) FULL JOIN w USING (repo, path)),
changes AS (SELECT repo, path, 'staged' AS bucket, CASE WHEN bt IS NULL THEN 'A' WHEN st IS NULL THEN 'D' ELSE 'M' END AS status
    FROM sides WHERE bt IS DISTINCT FROM st
  UNION ALL SELECT repo, path, 'modified', CASE WHEN wt IS NULL THEN 'D' ELSE 'M' END
    FROM sides WHERE st IS NOT NULL AND st IS DISTINCT FROM wt
  UNION ALL SELECT repo, path, 'untracked', '?' FROM sides WHERE st IS NULL AND wt IS NOT NULL)"""


def _diff_lines(column: str, sign: int) -> str:
    return (f"SELECT repo, path, unnest(string_split(regexp_replace({column}, '\\n$', ''), chr(10))) AS line, {sign} AS sign "
            f"FROM differing WHERE {column} IS NOT NULL")


DIFF_CTE = f"""{SIDES_CTE}, differing AS (SELECT * FROM sides WHERE bt IS DISTINCT FROM wt AND <tracked>),
balance AS (SELECT repo, path, line, sum(sign) AS n FROM ({_diff_lines('bt', -1)} UNION ALL {_diff_lines('wt', 1)}) GROUP BY ALL),
stat AS (SELECT repo, path, cast(sum(greatest(n, 0)) AS bigint) AS added, cast(sum(greatest(-n, 0)) AS bigint) AS removed
  FROM balance GROUP BY ALL)"""

# --- manifests ------------------------------------------------------------------------------

STACK = f"""SELECT DISTINCT repo, CASE WHEN path = 'package.json' THEN 'Node.js'
  WHEN path IN ('requirements.txt', 'pyproject.toml') THEN 'Python' WHEN path = 'go.mod' THEN 'Go'
  WHEN path = 'Cargo.toml' THEN 'Rust' WHEN path IN ('pom.xml', 'build.gradle', 'build.gradle.kts') THEN 'Java/Kotlin'
  WHEN path = 'composer.json' THEN 'PHP' WHEN path = 'Gemfile' THEN 'Ruby'
  WHEN path IN ('Dockerfile', 'docker-compose.yml', 'docker-compose.yaml') THEN 'Docker' END AS technology
FROM ({corpus_sql('manifest')}) WHERE technology IS NOT NULL"""

MANIFEST = f"""
WITH raw AS (SELECT repo, text, json_valid(text) AS ok FROM ({corpus_sql('manifest')}) WHERE path = 'package.json'),
read AS (SELECT repo, ok, CASE WHEN ok THEN text ELSE '{{}}' END AS j FROM raw),
keyed AS (SELECT repo, ok, j, coalesce(json_keys(j, '$.dependencies'), []) AS d, coalesce(json_keys(j, '$.devDependencies'), []) AS v,
  coalesce(json_keys(j, '$.scripts'), []) AS s FROM read)
SELECT repo, CASE WHEN ok THEN 'ok' ELSE 'corrupt' END AS status,
  CASE WHEN ok THEN coalesce(j ->> '$.name', 'unnamed') END AS name,
  CASE WHEN ok THEN coalesce(j ->> '$.version', '0.0.0') END AS version, j ->> '$.description' AS description,
  CASE WHEN ok THEN array_to_string(d[1:10], ',') END AS dependencies, CASE WHEN ok THEN cast(len(d) AS int) END AS n_dependencies,
  CASE WHEN ok THEN len(d) > 10 END AS more_dependencies,
  CASE WHEN ok THEN array_to_string(v[1:10], ',') END AS dev_dependencies, CASE WHEN ok THEN cast(len(v) AS int) END AS n_dev_dependencies,
  CASE WHEN ok THEN len(v) > 10 END AS more_dev_dependencies, CASE WHEN ok THEN array_to_string(s, ',') END AS scripts
FROM keyed"""

ORACLES: dict[str, str] = {
    "lines_per_file": f"SELECT repo, path, cast(len({split_sql()}) AS int) AS lines FROM ({corpus_sql('docs')})",
    "search_literal": search("docs", f"contains(lower(raw), '{cat.LITERAL}')", "ORDER BY repo, path, line_no LIMIT 30"),
    "search_regex": search("docs", regex_test(cat.REGEX)),
    "search_multi_query": search_multi(),
    "search_path_filter": search("pages", f"contains(lower(raw), '<h1>') AND {EXT} = '.htm' AND contains(lower(path), '/en/')"),
    "search_literal_table": SEARCH_TABLE,
    "search_indexed": search_requests(),
    "search_table": search_requests(),
    "search_table_filtered": SEARCH_FILTERED,
    "search_statuses": f"""SELECT cast(doc_id AS string) AS query_id, CASE WHEN doc_id % 5 = 2 THEN 'invalid_regex'
        WHEN doc_id % 5 < 2 OR coalesce({trimmed('text')}, '') = '' THEN 'empty' ELSE 'ok' END AS status FROM documents""",
    "match_counts": f"WITH {lines_cte('docs')} SELECT repo, count(*) AS matches FROM lines WHERE {regex_test(cat.REGEX)} GROUP BY repo",
    "path_parts": PATHS,
    "eligible_reasons": f"SELECT repo, path, reason FROM ({REASONS})",
    "eligible_counts": f"SELECT reason, count(*) AS files FROM ({REASONS}) GROUP BY reason",
    "eligible_files": f"SELECT repo, path, size FROM ({REASONS}) WHERE reason = 'ok'",
    "ignored_files": f"SELECT repo, path FROM ({corpus_sql('config')}) WHERE {IGNORED}",
    "ignored_inherited": f"SELECT DISTINCT repo, path FROM ({corpus_sql('config')}) WHERE {IGNORED}",
    "ignore_report": rf"""
WITH listed AS (SELECT repo, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM ({corpus_sql('config')}) WHERE path = '.gitignore')
SELECT repo, cast(line_no AS int) AS line_no, line, CASE WHEN line = '' THEN 'blank' WHEN line LIKE '#%' THEN 'comment'
  WHEN line LIKE '!%' THEN 'negated' ELSE 'pattern' END AS kind,
  CASE WHEN regexp_extract(line, '\[(.)-(.)\]', 1) > regexp_extract(line, '\[(.)-(.)\]', 2) THEN 'backward range' END AS problem FROM listed""",
    "tree_rows": tree_sql("config", 4, IGNORED),
    "tree_subtree": tree_sql("code", 1, "false", "src/orders"),
    "tree_dirs": f"WITH {ancestors_cte('code')} SELECT repo, path FROM dirs",
    "outline_symbols": f"WITH {SYMBOLS_CTE} SELECT repo, path, line_no, kind, {shortened('signature', 120)} AS signature FROM symbols",
    "outline_kind_counts": f"WITH {SYMBOLS_CTE} SELECT repo, kind, count(*) AS symbols FROM symbols GROUP BY ALL",
    "outline_summary": f"""WITH {SYMBOLS_CTE}, per AS (SELECT repo, path, count(*) AS n FROM symbols GROUP BY ALL)
SELECT f.repo, f.path, cast(len({split_sql('f.text')}) AS int) AS line_count, cast(coalesce(per.n, 0) AS int) AS symbols
FROM code_files f LEFT JOIN per USING (repo, path)""",
    "outline_status": OUTLINE_STATUS,
    "dependency_status": DEPENDENCY_STATUS,
    "imports_extracted": f"WITH {IMPORTS_CTE} SELECT *, resolved IS NOT NULL AS is_internal FROM imports",
    "imports_internal_external": f"""WITH {IMPORTS_CTE} SELECT repo, path, count(*) FILTER (resolved IS NOT NULL) AS internal,
count(*) FILTER (resolved IS NULL) AS external FROM imports GROUP BY ALL""",
    "dependents": f"WITH {EDGES_CTE} SELECT DISTINCT repo, src, dst, 'exact' AS match_type FROM edges",
    "dependent_lines": f"""WITH {EDGES_CTE}, files AS ({corpus_sql('code')}) SELECT DISTINCT e.repo, src, dst, 'exact' AS match_type,
cast(len({split_sql()}) AS int) AS line_count FROM edges e JOIN files f ON f.repo = e.repo AND f.path = e.src""",
    "impact_counts": f"""WITH {EDGES_CTE}, files AS ({corpus_sql('code')}), n AS (SELECT repo, dst, count(DISTINCT src) AS n FROM edges GROUP BY ALL)
SELECT f.repo, f.path, coalesce(n.n, 0) AS dependents FROM files f LEFT JOIN n ON n.repo = f.repo AND n.dst = f.path""",
    "term_frequencies": f"""WITH {index_cte()} SELECT repo, path, field, term, cast(tf AS int) AS tf, cast(fl AS int) AS fl
FROM tf JOIN lens USING (scope, repo, path, field)""",
    "term_stats": f"WITH {index_cte()} SELECT field, term, df FROM df",
    "field_lengths": f"""WITH {index_cte(scope='repo')} SELECT scope, field, n AS n_docs, floor(avg_fl * 1e4 + 0.5) / 1e4 AS avg_fl FROM stats""",
    "rank_exact": f"""WITH {index_cte()}, {score_cte("SELECT cast(item_id AS string) AS query_id, text AS query FROM benchmark", False, False)} {SCORES}""",
    "rank_query_status": f"""SELECT cast(doc_id AS string) AS query_id,
CASE WHEN doc_id % 4 < 2 OR {trimmed('text')} = '' OR text IS NULL THEN 'empty' ELSE 'ok' END AS status FROM documents""",
    "rank_prefix": f"WITH {index_cte()}, {score_cte(RANKED, True, False)} {SCORES}",
    "rank_fuzzy": f"WITH {index_cte()}, {score_cte(RANKED)} {SCORES}",
    "rank_topk_pct": f"SELECT query_id, rank, repo, path, score, pct FROM (WITH {index_cte()}, {score_cte(RANKED)} {top_sql(str(cat.TOP))})",
    "rank_repo_scope": f"WITH {index_cte(scope='repo')}, {score_cte(RANKED)} {top_sql('3')}",
    "rank_topk_blocks": f"SELECT query_id, rank, repo, path, score, pct FROM (WITH {index_cte()}, {score_cte(RANKED)} {top_sql(str(cat.TOP))})",
    "rank_repo_blocks": f"WITH {index_cte(scope='repo')}, {score_cte(RANKED)} {top_sql('3')}",
    "rank_filtered": filtered_sql(),
    "rank_code": f"""SELECT query_id, rank, repo, path, score, pct FROM (WITH {SYMBOLS_CTE}, {index_cte(symbols=True)},
{score_cte(query_rows(cat.CODE_QUERIES))} {top_sql(str(cat.TOP))})""",
    "rank_key_lines": KEY_LINES,
    "index_refresh": f"WITH {index_cte(files=REFRESHED)} SELECT field, term, df FROM df",
    "index_refresh_repo": f"WITH {index_cte(scope='repo', files=REFRESHED)} SELECT scope, field, term, df FROM df",
    "segments_vocab": f"WITH {index_cte(files=REFRESHED)} SELECT field, term, df FROM df",
    "segments_postings": f"""WITH {index_cte(files=REFRESHED)} SELECT repo, path, field, term, cast(tf AS int) AS tf, cast(fl AS int) AS fl
        FROM tf JOIN lens USING (scope, repo, path, field)""",
    "segments_stats": f"""WITH {index_cte(scope='repo', files=REFRESHED)} SELECT scope, field, n AS n_docs, floor(avg_fl * 1e4 + 0.5) / 1e4 AS avg_fl FROM stats""",
    "slice_lines": SLICE_LINES,
    "slice_status": SLICE_STATUS,
    "patch_results": f"{PATCH_RESULTS} SELECT * FROM results",
    "patch_snapshot": PATCH_SNAPSHOT,
    "patch_status_counts": f"{PATCH_RESULTS} SELECT status, count(*) AS patches FROM results GROUP BY status",
    "version_files": f"WITH {VERSIONS_CTE} SELECT version, repo, path, strlen(text) AS size, text FROM versions",
    "version_changes": f"WITH {VERSIONS_CTE} " + " UNION ALL ".join(_version_step(o, n) for o, n in ((1, 2), (1, 3), (5, 1))),
    "version_log": f"""WITH {VERSIONS_CTE} SELECT cast(version AS bigint) AS version, cast(nullif(version - 1, 0) AS bigint) AS parent,
['create', 'commit', 'commit', 'commit', 'roll back to 1'][version] AS action, count(*) AS files, cast(sum(strlen(text)) AS bigint) AS bytes
FROM versions GROUP BY version""",
    "changes_classified": f"WITH {SIDES_CTE} SELECT * FROM changes",
    "change_counts": f"WITH {SIDES_CTE} SELECT repo, bucket, count(*) AS files FROM changes GROUP BY ALL",
    "untracked_preview": f"""WITH {SIDES_CTE}, u AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rank,
count(*) OVER (PARTITION BY repo) AS n FROM changes WHERE bucket = 'untracked')
SELECT repo, cast(rank AS int) AS rank, path, greatest(n - 10, 0) AS more FROM u WHERE rank <= 10""",
    "diff_stat": f"WITH {DIFF_CTE.replace('<tracked>', '(bt IS NOT NULL OR st IS NOT NULL)')} SELECT * FROM stat",
    "diff_total": f"""WITH {DIFF_CTE.replace('<tracked>', 'true')} SELECT repo, count(*) AS files, cast(sum(added) AS bigint) AS added,
cast(sum(removed) AS bigint) AS removed FROM stat GROUP BY repo""",
    "tech_stack": STACK,
    "manifest_keys": MANIFEST,
    "readme_preview": f"""SELECT repo, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS preview
FROM ({corpus_sql('manifest')}) WHERE path = 'README.md'""",
    "trees_round_trip": f"SELECT repo, path, strlen(text) AS size, false AS is_binary, text FROM ({corpus_sql('config')}) WHERE instr(text, chr(0)) = 0",
    "decoded_content": f"""WITH d AS (SELECT repo, path, coalesce(text, '') AS own FROM ({corpus_sql('docs')})),
t AS (SELECT repo, path, own, own || chr(65533) || chr(65533) || chr(13) || chr(10) || path AS text FROM d)
SELECT repo, path, cast(strlen(own) + 4 + strlen(path) AS bigint) AS size, instr(own, chr(0)) > 0 AS is_binary, text,
cast(len({split_sql()}) AS int) AS lines FROM t""",
    "tree_order": TREE_ORDER,
    "dependents_suffix": DEPENDENTS_SUFFIX,
    "rank_code_key_lines": CODE_KEY_LINES,
    "index_stored": f"SELECT query_id, rank, repo, path, score, pct FROM (WITH {index_cte()}, {score_cte(RANKED)} {top_sql(str(cat.TOP))})",
    "slice_status_ignored": SLICE_STATUS_IGNORED,
    "patch_results_ignored": PATCH_RESULTS_IGNORED,
    "patch_line_ends": PATCH_LINE_ENDS,
}
