"""The same queries as SQL, for comparison by an independent engine."""

from __future__ import annotations

from skerry.functions import text as T
from skerry.operators import extract
from skerry.sources import workspace


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(pairs: dict, on: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({on}, {_q(p)}) THEN {_q(k)}" for k, p in pairs.items()) + f" ELSE {other} END"


B = "(SELECT DISTINCT block_id, name, kind, file_path, start_line, end_line, content, org_id, dept_id, repo_id FROM blocks)"
FILES = "(SELECT DISTINCT file_id, repo_id, file_path, hash, mtime, lang, text FROM source_files)"
CUR = f"(SELECT * FROM {FILES} QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY file_id DESC) = 1)"
E = "(SELECT DISTINCT * FROM edges)"
R = "(SELECT DISTINCT request_id AS query_id, query, top_k, expand_depth, max_chunk_chars, repo_id FROM context_requests)"
H = "(SELECT DISTINCT request_id AS query_id, hit_rank AS pos, block_id, file_path, start_line, end_line, match_type, relevance_score AS score FROM chunks)"
EXT = "lower(regexp_extract(file_path, '(\\.[^./]+)$', 1))"
LANG = "CASE " + EXT + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EXTENSIONS.items()) + " END"
BASE = "regexp_extract({0}, '([^/]*)$', 1)"


def toks(text: str) -> str:
    """Tokens of a text, with repeats; without look-ahead, which this dialect lacks."""
    camel = r"regexp_extract_all(regexp_replace(regexp_replace(t, '[A-Z]+_', '_', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    one = f"list_concat([lower(t)], list_concat(CASE WHEN contains(t, '_') THEN list_filter(string_split(lower(t), '_'), lambda p: p <> '') ELSE [] END, CASE WHEN len({camel}) > 1 THEN list_transform({camel}, lambda p: lower(p)) ELSE [] END))"
    return f"flatten(list_transform(regexp_extract_all({text}, '[a-zA-Z0-9_]+'), lambda t: {one}))"


def words(query: str) -> str:
    stop = ", ".join(_q(w) for w in T.STOP_WORDS)
    found = f"list_filter(list_concat([trim({query})], list_filter(regexp_extract_all({query}, '[a-zA-Z0-9_]{{3,}}'), lambda w: lower(w) NOT IN ({stop}))), lambda w: w <> '')"
    return f"list_filter({found}, lambda w, i: list_position({found}, w) = i)"


BODY = "coalesce(name, '') || ' ' || coalesce(file_path, '') || ' ' || coalesce(content, '')"


def bm25(docs: str, id_col: str, body: str, k: str, where: str = "TRUE") -> str:
    """BM25 of all requests over ``docs``; ``where`` restricts hits (h) by the request (r)."""
    return f"""
        WITH d AS (SELECT * FROM {docs}),
        p AS (SELECT id, term, count(*) AS tf FROM (SELECT {id_col} AS id, unnest({toks(body)}) AS term FROM d) GROUP BY ALL),
        dl AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id),
        c AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT sum(tf) FROM p) * 1.0::DOUBLE / (SELECT count(*) FROM d) AS avgdl),
        ts AS (SELECT term, ln(1 + ((SELECT n FROM c) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
        w AS (SELECT query_id, repo_id, {k} AS k, term, count(*) AS w FROM (SELECT query_id, repo_id, top_k, unnest({toks('query')}) AS term FROM {R}) GROUP BY ALL),
        s AS (SELECT w.query_id, w.k, p.id, round(sum(w.w * ts.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / (SELECT avgdl FROM c)))), 6) AS score
              FROM w JOIN p USING (term) JOIN ts USING (term) JOIN dl ON dl.id = p.id JOIN d ON d.{id_col} = p.id WHERE {where} GROUP BY ALL),
        r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, k FROM s WHERE score > 0)
    """


def dense(where: str, k: int, threshold: float, drop_self: bool) -> str:
    return f"""
        WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
        s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE {where} {'AND query_id <> vec_id' if drop_self else ''})
        SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= {threshold}) WHERE rank <= {k}
    """


CONCERN = _case(T.CONCERNS, "lower(coalesce(file_path, '') || ' ' || coalesce(name, ''))", "'general'")
REQUESTED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(query, '')), {_q(p)}) THEN {_q(k)} END" for k, p in T.CONCERNS.items()) + "], lambda x: x IS NOT NULL)"


def label(s: str, t: str) -> str:
    s, t = f"lower(coalesce({s}, ''))", f"lower(coalesce({t}, ''))"
    return f"""CASE WHEN contains({s}, 'controller') AND contains({t}, 'service') THEN 'exposes_endpoint_to_service'
        WHEN contains({s}, 'consumer') AND contains({t}, 'service') THEN 'consumes_event_triggers_service'
        WHEN contains({s}, 'service') AND regexp_matches({t}, 'repository|entity|model') THEN 'manages_persistence'
        WHEN regexp_matches({s}, 'test|spec') THEN 'tests_implementation' WHEN regexp_matches({t}, 'test|spec') THEN 'tested_by' ELSE 'imports' END"""


LINES = "string_split(regexp_replace(regexp_replace(text, '(\\r\\n|\\r|\\n)\\z', ''), '\\r\\n|\\r', chr(10), 'g'), chr(10))"
OPENS = _q(extract.OPENS)
SCAN = f"""
    (SELECT file_id, CASE WHEN regexp_matches(line, 'class|struct|interface') THEN 'class' ELSE 'function' END AS kind, regexp_extract(line, {OPENS}, 1) AS name, i AS start_line,
            least(len(ls), i + 40) AS end_line, array_to_string(list_slice(ls, i, i + 40), chr(10)) AS content
     FROM (SELECT file_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT file_id, {LINES} AS ls FROM {FILES} WHERE length(text) > 0))
     WHERE regexp_matches(line, {OPENS}))
"""
IMPORTS = " UNION ALL ".join(f"SELECT file_id, file_path, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS t FROM {FILES} WHERE length(text) > 0" for p in extract.IMPORTS)
NOT_CALLS = ", ".join(_q(x) for x in extract.NOT_CALLS)
CALLS = f"(SELECT DISTINCT source_file, source_symbol, target_file, target_symbol FROM edges WHERE relation = 'calls')"

# the last part of an import and the file it means
RESOLVED = f"""
    f AS (SELECT repo_id, found, module, regexp_extract(module, '([^.:]+)$', 1) AS tail FROM (SELECT DISTINCT repo_id, file_path AS found, replace(regexp_replace(file_path, '\\.[^./]*$', ''), '/', '.') AS module FROM source_files)),
    i AS (SELECT *, regexp_extract(want, '([^.:]+)$', 1) AS tail FROM (SELECT DISTINCT repo_id, target_symbol, regexp_replace(regexp_replace(replace(target_symbol, '::', '.'), '^\\.+', ''), '\\.(h|hpp|hh|dart|js|ts)$', '') AS want FROM edges WHERE relation = 'imports')),
    bi AS (SELECT repo_id, target_symbol, 'imports' AS relation, arg_min(found, (length(module), found)) AS hit FROM i JOIN f USING (repo_id, tail) WHERE tail <> '' AND (module = want OR suffix(module, '.' || want)) GROUP BY ALL),
    bc AS (SELECT repo_id, name AS target_symbol, 'calls' AS relation, min(file_path) AS hit FROM (SELECT DISTINCT repo_id, name, file_path FROM blocks WHERE name <> '') GROUP BY ALL HAVING count(*) = 1),
    res AS (SELECT e.repo_id, e.source_file, e.source_symbol, e.target_symbol, e.relation, coalesce(nullif(e.target_file, ''), k.hit) AS target_file
            FROM {E} e LEFT JOIN (SELECT * FROM bi UNION ALL SELECT * FROM bc) k ON k.repo_id = e.repo_id AND k.target_symbol = e.target_symbol AND k.relation = e.relation)
"""
RULES_SQL = None
SEEDS = f"(SELECT DISTINCT name AS symbol FROM {H} h JOIN {B} b USING (block_id) WHERE h.pos = 1 AND name <> '')"
NAMES = "(SELECT DISTINCT name AS symbol FROM blocks WHERE name <> '')"


def blast(seeds: str, fan: int) -> str:
    return f"""
        c AS (SELECT target_symbol, source_symbol, source_file FROM (SELECT DISTINCT target_symbol, source_symbol, source_file FROM edges WHERE relation = 'calls' AND source_symbol <> '')
              QUALIFY row_number() OVER (PARTITION BY target_symbol ORDER BY source_symbol, source_file) <= {fan}),
        l1 AS (SELECT DISTINCT s.symbol, c.source_symbol, c.source_file FROM {seeds} s JOIN c ON c.target_symbol = s.symbol),
        l2 AS (SELECT DISTINCT a.symbol, c.source_symbol, c.source_file FROM (SELECT DISTINCT symbol, source_symbol AS at FROM l1) a JOIN c ON c.target_symbol = a.at),
        radius AS (SELECT symbol, source_symbol, source_file, min(level) AS level FROM (SELECT *, 1 AS level FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY ALL)
    """


def exact_hits() -> str:
    return f"""
        w AS (SELECT query_id, repo_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS word_no FROM (SELECT query_id, repo_id, {words('query')} AS ws FROM {R} WHERE query IS NOT NULL)),
        x AS (SELECT query_id, block_id, file_path, start_line, min(word_no) AS word_no FROM w JOIN {B} b ON b.repo_id = w.repo_id AND lower(b.name) = lower(w.word) WHERE b.name <> '' GROUP BY ALL)
    """


def ignored(rules: list[tuple]) -> str:
    values = ", ".join(f"({i}, {_q(b)}, {n}, {dr}, {a}, {_q(x)})" for i, b, n, dr, a, x in rules)
    return f"""
        WITH r(rule_idx, base_dir, negation, dir_only, anchored, regex) AS (VALUES {values}),
        p AS (SELECT DISTINCT file_path FROM source_files),
        st AS (SELECT file_path, array_to_string(list_slice(string_split(file_path, '/'), 1, n), '/') AS p, n < len(string_split(file_path, '/')) AS d
               FROM (SELECT file_path, unnest(range(1, len(string_split(file_path, '/')) + 1)) AS n FROM p)),
        x AS (SELECT st.p, st.d, r.*, CASE WHEN base_dir = '' THEN st.p WHEN st.p = base_dir THEN '' WHEN starts_with(st.p, base_dir || '/') THEN substr(st.p, length(base_dir) + 2) END AS x
              FROM (SELECT DISTINCT p, d FROM st) st, r WHERE st.d OR NOT dir_only),
        v AS (SELECT p, d, arg_max(negation, rule_idx) AS neg FROM x WHERE x IS NOT NULL AND (regexp_matches(x, regex) OR (NOT anchored AND len(list_filter(string_split(x, '/'), lambda s: regexp_matches(s, regex))) > 0)) GROUP BY ALL)
        SELECT q.file_path, EXISTS (SELECT 1 FROM st JOIN v ON v.p = st.p AND v.d = st.d AND NOT v.neg WHERE st.file_path = q.file_path) AS ignored FROM p q
    """


CHANGES = "(SELECT DISTINCT repo_id || '/' || file_path AS path, CASE WHEN text = '' THEN 'removed' ELSE 'modified' END AS op, synced_at AS ts, text FROM source_files)"
LAST = f"(SELECT * FROM {CHANGES} QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, CASE WHEN op = 'removed' THEN 0 ELSE 1 END DESC, coalesce(md5(text), '') DESC) = 1)"

SQL: dict[str, str] = {
    "src3_accepted": f"SELECT file_id, {EXT} AS ext, {LANG} AS language FROM (SELECT DISTINCT file_id, file_path FROM source_files) WHERE {LANG} IS NOT NULL",
    "src4_language": f"SELECT {LANG} AS by_suffix, CASE lower(trim(lang)) WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp' WHEN 'cs' THEN 'csharp' ELSE lower(trim(lang)) END AS by_name, count(*) AS n_files FROM (SELECT DISTINCT file_id, file_path, lang FROM source_files) GROUP BY ALL",
    "src6_tolerant_text": f"SELECT file_id, md5(text) AS hash FROM {FILES} WHERE text IS NOT NULL",
    "src7_read_lines": f"""
        WITH f AS (SELECT file_path, arg_max(text, file_id) AS text FROM source_files GROUP BY file_path),
        a AS (SELECT query_id, h.file_path, greatest(1, start_line - 5) AS lo, end_line + 5 AS hi, text FROM {H} h LEFT JOIN f USING (file_path))
        SELECT query_id, file_path, CASE WHEN text IS NULL THEN '[ERROR] File not found: ' || file_path ELSE '--- ' || file_path || ' (Lines ' || lo || '-' || hi || ') ---' || chr(10)
            || array_to_string(list_transform(list_slice({LINES}, lo, hi), lambda x, i: lpad((i + lo - 1)::VARCHAR, greatest(4, length((i + lo - 1)::VARCHAR))::INT, ' ') || ' | ' || x), chr(10)) END AS excerpt FROM a
    """,
    "src8_resolve_path": f"""
        WITH f AS (SELECT DISTINCT file_path FROM source_files), a AS (SELECT DISTINCT {BASE.format('file_path')} AS b FROM f),
        c AS (SELECT a.b, 2 AS pr, f.file_path FROM a JOIN f ON f.file_path = a.b UNION ALL SELECT a.b, 3, f.file_path FROM a JOIN f ON FALSE)
        SELECT 'workspace/' || a.b AS asked, arg_min(c.file_path, (c.pr, c.file_path)) AS file_path FROM a LEFT JOIN c USING (b) GROUP BY ALL
    """,
    "src10_repo_parse": """
        SELECT repo_id, CASE WHEN ok THEN regexp_replace(lower(regexp_extract(u, p, 1)), '[^a-zA-Z0-9_]', '_', 'g') ELSE 'external_org' END AS url_org,
               CASE WHEN ok THEN regexp_replace(lower(regexp_extract(u, p, 2)), '[^a-zA-Z0-9_]', '_', 'g') ELSE 'git_repo' END AS url_repo
        FROM (SELECT repo_id, u, p, regexp_matches(u, p) AS ok FROM (SELECT repo_id, regexp_replace(trim(coalesce(repo_url, '')), '\\.git$', '') AS u, '[:/]([a-zA-Z0-9_\\-\\.]+)/([a-zA-Z0-9_\\-\\.]+)$' AS p FROM repos))
    """,
    "src14_new_points": "SELECT DISTINCT point_id FROM vectors WHERE point_id NOT IN (SELECT point_id FROM probe_points)",
    "src12_snapshot": f"SELECT block_id, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms FROM (SELECT block_id, term, count(*) AS tf FROM (SELECT block_id, unnest({toks(BODY)}) AS term FROM {B}) GROUP BY ALL) GROUP BY ALL",
    "prj2_scan_blocks": f"SELECT file_id, kind, name, start_line, end_line, md5(content) AS content_hash FROM {SCAN}",
    "prj3_import_edges": f"SELECT file_id, {BASE.format('file_path')} AS source_symbol, regexp_replace(t, '[/\\\\]', '.', 'g') AS target_symbol, 'imports' AS relation, 1.0::DOUBLE AS confidence FROM ({IMPORTS})",
    "prj4_call_edges": f"""
        SELECT block_id, t AS target_symbol, count(*) AS n_calls FROM (SELECT block_id, coalesce(name, '') AS name, unnest(regexp_extract_all(content, '(?:^|[^a-zA-Z0-9_])([a-zA-Z0-9_]{{3,}})\\s*\\(', 1)) AS t FROM (SELECT block_id, name, regexp_replace(content, '\\(', '( ', 'g') AS content FROM {B}))
        WHERE t <> name AND t NOT IN ({NOT_CALLS}) GROUP BY ALL
    """,
    "prj5_module_blocks": f"SELECT file_id, 'module' AS kind, 1 AS start_line, len({LINES}) AS end_line, md5(substr(text, 1, 4000)) AS content_hash FROM {FILES} WHERE regexp_replace(text, '[\\s\\x0B]', '', 'g') <> '' AND file_id NOT IN (SELECT file_id FROM {SCAN})",
    "prj8_concern": f"SELECT block_id, {CONCERN} AS concern FROM {B}",
    "prj9_relationship": f"SELECT DISTINCT source_file, target_symbol, {label('source_file', 'target_symbol')} AS label FROM edges",
    "prj11_point_id": f"SELECT block_id, sha256(coalesce(org_id, '') || ':' || coalesce(dept_id, '') || ':' || coalesce(repo_id, '') || ':' || coalesce(file_path, '') || ':' || coalesce(start_line::VARCHAR, '') || ':' || coalesce(end_line::VARCHAR, '') || ':' || coalesce(name, '') || ':' || sha256(coalesce(content, ''))) AS point_id FROM {B}",
    "prj12_hash": f"SELECT file_id, md5(text) AS text_hash, length(text) AS n_chars FROM {FILES}",
    "prj13_render": "SELECT source_file AS file_path, '[INFO] Dependencies of ' || source_file || ':' || chr(10) || ' - ' || string_agg(t, chr(10) || ' - ' ORDER BY t) AS shown FROM (SELECT DISTINCT source_file, coalesce(nullif(target_file, ''), target_symbol) AS t FROM edges) GROUP BY source_file",
    "prj15_collection": "SELECT repo_id, regexp_replace(lower(trim(coalesce(org_id, 'default_org') || ' ' || coalesce(dept_id, 'default_dept') || ' ' || repo_id)), '[^a-zA-Z0-9_-]', '_', 'g') AS collection FROM repos",
    "prj6_summary": f"""
        SELECT block_id, coalesce(list_filter(list_transform(string_split(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')), lambda x: x <> '')[1], '') AS signature,
               nullif(CASE WHEN contains(content, '\"\"\"') THEN CASE WHEN len(string_split(content, '\"\"\"')) >= 3 THEN substr(regexp_replace(string_split(content, '\"\"\"')[2], '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), 1, 200) END
                    WHEN contains(content, '''''''') THEN CASE WHEN len(string_split(content, '''''''')) >= 3 THEN substr(regexp_replace(string_split(content, '''''''')[2], '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), 1, 200) END END, '') AS docstring,
               file_path || ':' || start_line || '-' || end_line AS line_range FROM {B}
    """,
    "prj7_truncate": f"""
        SELECT DISTINCT query_id, block_id, md5(CASE WHEN m > 0 AND length(content) > m THEN substr(content, 1, m) || chr(10) || '... [truncated]' ELSE content END) AS snippet_hash, coalesce(m > 0 AND length(content) > m, FALSE) AS was_cut
        FROM (SELECT h.query_id, h.block_id, r.max_chunk_chars AS m, b.content FROM {H} h JOIN {R} r USING (query_id) JOIN {B} b USING (block_id))
    """,
    "prj10_explain": f"""
        SELECT DISTINCT query_id, block_id, kind, CASE WHEN kind = 'exact_symbol' THEN 'very_high' WHEN score > 0.03 THEN 'high' ELSE 'medium' END AS confidence FROM (
        SELECT h.query_id, h.block_id, h.score, CASE WHEN coalesce(b.name, '') <> '' AND contains(lower(coalesce(r.query, '')), lower(b.name)) THEN 'exact_symbol'
            WHEN len(list_filter(regexp_split_to_array(lower(coalesce(r.query, '')), '[\\s\\x0B]+'), lambda w: length(w) > 3 AND contains(lower(h.file_path), w))) > 0 THEN 'path_keyword' ELSE 'hybrid_rrf' END AS kind
        FROM {H} h JOIN {R} r USING (query_id) JOIN {B} b USING (block_id))
    """,
    "sco1_tokens": f"SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({toks('query')}) AS term FROM {R}) GROUP BY ALL",
    "sco2_bm25": bm25(B, "block_id", BODY, "coalesce(top_k, 5)") + "SELECT query_id, id AS block_id, score, rank FROM r WHERE rank <= k",
    "sco2_bm25_documents": bm25("documents", "doc_id", "coalesce(title, '') || ' ' || coalesce(text, '')", "coalesce(top_k, 5)") + "SELECT query_id, id AS doc_id, score, rank FROM r WHERE rank <= k",
    "flt5_bm25_own_repo": bm25(B, "block_id", BODY, "coalesce(top_k, 5)", "d.repo_id = w.repo_id") + "SELECT query_id, id AS block_id, score, rank FROM r WHERE rank <= k",
    "agg1_term_freq": f"SELECT block_id, term, count(*) AS tf FROM (SELECT block_id, unnest({toks(BODY)}) AS term FROM {B}) GROUP BY ALL",
    "agg2_doc_freq": bm25(B, "block_id", BODY, "5") + "SELECT term, count(*) AS df, round(ln(1 + ((SELECT n FROM c) - count(*) + 0.5) / (count(*) + 0.5)), 8) AS idf FROM p GROUP BY term",
    "agg3_corpus": bm25(B, "block_id", BODY, "5") + "SELECT n, round(avgdl, 6) AS avgdl FROM c",
    "sco4_dense": dense("TRUE", 10, -1, True),
    "flt4_dense_label": dense("label IN (0, 1, 2)", 5, -1, False),
    "flt7_threshold": dense("TRUE", 50, 0.2, True),
    "sco6_rrf": bm25(B, "block_id", BODY, "15") + f""",
        v AS (SELECT payload.block_id AS block_id, arg_min(vector::DOUBLE[], point_id) AS v FROM vectors WHERE point_id IS NOT NULL AND len(vector) = 384 AND payload.block_id IS NOT NULL GROUP BY 1),
        ok AS (SELECT * FROM v WHERE isfinite(list_dot_product(v, v)) AND list_dot_product(v, v) > 0),
        sd AS (SELECT h.query_id, arg_min(v.v, v.block_id) AS v FROM {H} h JOIN v USING (block_id) WHERE h.pos = 1 AND h.query_id % 100 = 0 GROUP BY 1),
        dn AS (SELECT * FROM (SELECT sd.query_id, ok.block_id AS id, row_number() OVER (PARTITION BY sd.query_id ORDER BY round(list_cosine_similarity(sd.v, ok.v), 6) DESC, ok.block_id) AS rank FROM sd, ok WHERE isfinite(list_dot_product(sd.v, sd.v)) AND list_dot_product(sd.v, sd.v) > 0) WHERE rank <= 15),
        fu AS (SELECT query_id, id, min(d) AS dense_rank, min(s) AS bm25_rank FROM (SELECT query_id, id, rank AS d, NULL AS s FROM dn UNION ALL SELECT query_id, id, NULL, rank FROM r WHERE rank <= 15 AND query_id % 100 = 0) GROUP BY ALL),
        fs AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS raw FROM fu)
        SELECT query_id, id AS block_id, rank, round(raw, 4) AS score, dense_rank, bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM fs) WHERE rank <= 10
    """,
    "sco10_diversify": f"""
        WITH h AS (SELECT h.query_id, h.block_id, min(h.pos) AS pos, any_value(least(r.top_k, 3)) AS k, {CONCERN.replace('file_path', 'h.file_path').replace('coalesce(name', 'coalesce(b.name')} AS concern,
                   list_concat({REQUESTED.replace('coalesce(query', 'coalesce(r.query')}, ['events_messaging', 'frontend_ui']) AS rq FROM {H} h JOIN {B} b USING (block_id) JOIN {R} r USING (query_id) GROUP BY ALL),
        g AS (SELECT query_id, block_id, concern, k, min(pos) AS pos, any_value(list_filter(rq, lambda x, i: list_position(rq, x) = i)) AS rq FROM h GROUP BY ALL),
        l AS (SELECT *, coalesce(len(rq) > 1 AND list_position(rq, concern) > 0 AND row_number() OVER (PARTITION BY query_id, concern ORDER BY pos) = 1, FALSE) AS lead FROM g),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, CASE WHEN lead THEN list_position(rq, concern) END NULLS FIRST, pos) AS slot FROM l)
        SELECT query_id, block_id, concern, slot FROM o WHERE lead OR slot <= k
    """,
    "sco11_confidence": f"SELECT query_id, CASE WHEN bool_or(match_type = 'exact_symbol') THEN 0.96 WHEN bool_or(score >= 0.8) THEN 0.88 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN bool_or(match_type = 'exact_symbol') THEN 'VERY_HIGH' WHEN bool_or(score >= 0.8) THEN 'HIGH' ELSE 'MEDIUM' END AS rating FROM {H} GROUP BY query_id",
    "flt9_query_symbols": f"SELECT query_id, i - 1 AS word_no, word FROM (SELECT query_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT query_id, {words(chr(99) + 'oalesce(query, ' + chr(39) * 2 + ')')} AS ws FROM {R}))",
    "gdb1_current_files": f"SELECT repo_id, file_path, file_id, hash FROM {CUR}",
    "gdb4_clear": f"SELECT block_id FROM {B} b WHERE NOT EXISTS (SELECT 1 FROM source_files f WHERE f.text = '' AND f.repo_id = b.repo_id AND f.file_path = b.file_path)",
    "gdb5_file_symbols": f"SELECT repo_id, file_path, count(*) AS symbols, array_to_string(list_sort(list_distinct(list(coalesce(name, '')))), ',') AS names FROM {B} GROUP BY ALL",
    "gdb6_find_exact": f"""
        WITH w AS (SELECT DISTINCT query_id, unnest({words('query')}) AS symbol FROM {R} WHERE query IS NOT NULL)
        SELECT query_id, symbol, block_id, rank FROM (SELECT query_id, symbol, block_id, row_number() OVER (PARTITION BY query_id, symbol ORDER BY name, file_path, start_line, block_id) AS rank FROM w JOIN {B} b ON lower(b.name) = lower(w.symbol) WHERE b.name <> '') WHERE rank <= 5
    """,
    "flt10_find_fuzzy": f"""
        WITH w AS (SELECT DISTINCT query_id, unnest({words('query')}) AS symbol FROM {R} WHERE query IS NOT NULL)
        SELECT query_id, symbol, block_id, rank FROM (SELECT query_id, symbol, block_id, row_number() OVER (PARTITION BY query_id, symbol ORDER BY lower(name) <> lower(symbol), name, file_path, start_line, block_id) AS rank FROM w JOIN {B} b ON contains(lower(b.name), lower(w.symbol)) WHERE b.name <> '') WHERE rank <= 20
    """,
    **{
        name: f"""
        WITH q AS (SELECT DISTINCT request_id AS query_id, coalesce(query, '') AS query, coalesce(dept_id, 'unknown') || '/' || coalesce(repo_id, 'unknown') AS scope FROM context_requests),
        h AS (SELECT h.query_id, h.pos, h.score, b.* FROM {H} h JOIN {B} b USING (block_id) WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, b.file_path, b.start_line) <= 3),
        t AS (SELECT query_id, string_agg(chr(10) || {head} || chr(10) || 'File: ' || coalesce(file_path, 'unknown') || ' (Lines ' || coalesce(start_line::VARCHAR, '0') || '-' || coalesce(end_line::VARCHAR, '0') || ')' || chr(10)
                 || 'Block Name: ''' || coalesce(name, 'anonymous') || ''' (' || coalesce(kind, 'unknown') || ')' || chr(10) || 'Content:' || chr(10) || content || chr(10), '' ORDER BY pos, file_path, start_line) AS body FROM h GROUP BY query_id)
        SELECT query_id, CASE WHEN body IS NULL THEN '[INFO] No relevant code found for query: ''' || query || ''' in ' || scope ELSE '--- {title} Results for ''' || query || ''' [' || scope || '] ---' || chr(10) || body END AS shown FROM q LEFT JOIN t USING (query_id)
        """
        for name, title, head in (
            ("sco7_hybrid_text", "Hybrid Search", "printf('[Match (RRF Score: %.4f)]', score)"),
            ("sco5_vector_text", "Vector Search", "printf('[Candidate Match (Score: %.2f) | Repo: %s]', score, coalesce(repo_id, 'unknown'))"),
        )
    },
    "sco9_fallback": f"""
        WITH w AS (SELECT DISTINCT query_id, unnest({words('query')}) AS symbol FROM {R} WHERE query IS NOT NULL),
        f AS (SELECT * FROM (SELECT query_id, symbol, block_id, file_path, start_line, row_number() OVER (PARTITION BY query_id, symbol ORDER BY name, file_path, start_line, block_id) AS rank FROM w JOIN {B} b ON lower(b.name) = lower(w.symbol) WHERE b.name <> '') WHERE rank <= 20),
        sp AS (SELECT query_id, block_id, min((file_path, start_line, block_id)) AS o FROM f GROUP BY ALL),
        h AS (SELECT DISTINCT query_id, block_id FROM {H}),
        op AS (SELECT sp.query_id, sp.block_id, row_number() OVER (PARTITION BY sp.query_id ORDER BY o) AS r FROM sp ANTI JOIN h ON h.query_id = sp.query_id AND h.block_id = sp.block_id)
        SELECT op.query_id, op.block_id, 0.85::DOUBLE AS score FROM op JOIN {R} q USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS have FROM h GROUP BY 1) n USING (query_id) WHERE op.r + coalesce(n.have, 0) <= q.top_k
    """,
    "gdb8_callers": f"SELECT * FROM (SELECT target_symbol AS symbol, source_symbol, source_file, row_number() OVER (PARTITION BY target_symbol ORDER BY source_symbol, source_file) AS rank FROM (SELECT DISTINCT target_symbol, source_symbol, source_file FROM {CALLS} WHERE source_symbol <> '') WHERE target_symbol IN (SELECT symbol FROM {NAMES})) WHERE rank <= 10",
    "gdb9_callees": f"SELECT DISTINCT source_file AS file_path, source_symbol AS symbol, target_symbol FROM {CALLS} e WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.file_path = e.source_file AND b.name = e.source_symbol)",
    "gdb10_references": f"SELECT DISTINCT * FROM (SELECT name AS symbol, 'definition' AS role, file_path, kind AS name FROM {B} UNION ALL SELECT target_symbol, 'reference', source_file, source_symbol FROM edges) WHERE symbol IN (SELECT symbol FROM {NAMES})",
    "gdb11_dependencies": "SELECT DISTINCT source_file AS file_path, coalesce(nullif(target_file, ''), target_symbol) AS target, relation FROM edges",
    "joi5_resolve": f"WITH {RESOLVED} SELECT DISTINCT repo_id, source_file, source_symbol, target_symbol, relation, target_file FROM res",
    "gdb12_dependents": f"WITH {RESOLVED} SELECT DISTINCT repo_id, target_file AS file_path, source_file AS dependent FROM res WHERE target_file IS NOT NULL AND target_file <> source_file",
    "gdb13_induced": f"WITH {RESOLVED}, pk AS (SELECT DISTINCT f.repo_id, f.file_path FROM source_files f WHERE f.file_path IN (SELECT file_path FROM chunks)) SELECT DISTINCT repo_id, source_file, target_file, relation, {label('source_file', 'target_file')} AS label FROM res WHERE (repo_id, source_file) IN (SELECT repo_id, file_path FROM pk) AND (repo_id, target_file) IN (SELECT repo_id, file_path FROM pk)",
    "gdb18_stats": f"SELECT (SELECT count(DISTINCT file_id) FROM source_files) AS total_files, (SELECT count(DISTINCT block_id) FROM blocks) AS total_symbols, (SELECT count(*) FROM {E}) AS total_edges",
    "gdb19_listing": f"SELECT block_id, name, file_path, start_line FROM {B} WHERE name <> '' ORDER BY name, file_path, start_line, block_id LIMIT 100",
    "joi1_exact": f"WITH {exact_hits()} SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY word_no, file_path, start_line, block_id) AS pos FROM x",
    "joi4_companions": f"""
        WITH f AS (SELECT DISTINCT file_path, {BASE.format('file_path')} AS base FROM source_files), t AS (SELECT file_path AS test_path, base FROM f UNION SELECT regexp_replace(file_path, '([^/]*)(\\.[^./]*)$', 'test_\\1\\2'), regexp_replace(base, '([^/]*)(\\.[^./]*)$', 'test_\\1\\2') FROM f),
        c AS (SELECT file_path, unnest(['test_' || st || e, st || '_test' || e, st || '.test' || e, st || '.spec' || e, st || 'Test' || e, 'Test' || st || e]) AS base
              FROM (SELECT file_path, CASE WHEN contains(base, '.') AND base NOT LIKE '.%' THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS st, CASE WHEN contains(base, '.') AND base NOT LIKE '.%' THEN regexp_extract(base, '(\\.[^./]*)$', 1) ELSE '' END AS e FROM f))
        SELECT DISTINCT c.file_path, t.test_path FROM c JOIN t USING (base) WHERE contains(t.test_path, '/')
    """,
    "joi6_unresolved": "SELECT DISTINCT target_symbol FROM edges e WHERE relation = 'calls' AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.name = e.target_symbol)",
    "joi10_cross_repo": f"SELECT * FROM (SELECT repo_id, block_id, row_number() OVER (PARTITION BY repo_id ORDER BY name NULLS FIRST, file_path, start_line, block_id) AS rank FROM {B} WHERE name ILIKE '%ledger%') WHERE rank <= 5",
    "joi11_contract": f"SELECT * FROM (SELECT repo_id, block_id, row_number() OVER (PARTITION BY repo_id ORDER BY name NULLS FIRST, file_path, start_line, block_id) AS rank FROM {B} WHERE content ILIKE '%authorization%') WHERE rank <= 5",
    "joi12_roots": "SELECT DISTINCT source_symbol AS symbol FROM edges WHERE relation = 'calls' AND source_symbol <> '' AND source_symbol NOT IN (SELECT target_symbol FROM edges WHERE relation = 'calls')",
    "flt1_ignored": "",
    "flt11_test_files": "SELECT DISTINCT file_path FROM source_files WHERE regexp_matches(lower(file_path), 'test|spec|mock')",
    "flt12_entry_points": f"SELECT block_id FROM {B} WHERE regexp_matches(lower(coalesce(file_path, '') || ' ' || coalesce(name, '')), {_q(T.ENTRY_POINT)})",
    "set1_ordered_union": f"""
        WITH u AS (SELECT query_id, file_path, start_line, 0 AS part, min((pos, block_id)) AS x FROM {H} WHERE match_type = 'exact_symbol' GROUP BY ALL UNION ALL SELECT query_id, file_path, start_line, 1, min((pos, block_id)) FROM {H} GROUP BY ALL),
        k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, file_path, start_line ORDER BY part) = 1)
        SELECT query_id, x[2] AS block_id, row_number() OVER (PARTITION BY query_id ORDER BY part, x[1]) AS pos FROM k
    """,
    "set3_containment": f"SELECT query_id, pos, block_id FROM {H} h WHERE NOT EXISTS (SELECT 1 FROM {H} o WHERE o.query_id = h.query_id AND o.file_path = h.file_path AND o.pos < h.pos AND o.start_line <= h.start_line AND o.end_line >= h.end_line)",
    "set5_edge_dedup": f"SELECT repo_id, relation, count(*) AS n_edges FROM {E} GROUP BY ALL",
    "gra1_blast": f"WITH {blast(SEEDS, 50)} SELECT * FROM radius",
    "agg9_blast_summary": f"""WITH {blast(SEEDS, 50)} SELECT symbol, count(DISTINCT source_symbol) AS callers, count(DISTINCT source_file) AS files, array_to_string(list_slice(list_sort(list_distinct(list(source_symbol))), 1, 20), ',') AS caller_list,
        array_to_string(list_slice(list_sort(list_distinct(list(source_file))), 1, 20), ',') AS file_list, count(DISTINCT CASE WHEN regexp_matches(lower(source_file), 'test|spec|mock') THEN source_file END) AS n_tests FROM radius GROUP BY symbol""",
    "gdb15_impact": f"WITH {blast(NAMES, 1000000)} SELECT symbol, count(DISTINCT source_symbol) AS affected_symbols, count(DISTINCT source_file) AS affected_files FROM radius GROUP BY symbol",
    "prj14_flow": f"""
        WITH t AS (SELECT DISTINCT file_path, name AS symbol FROM blocks WHERE name <> '' AND name <> 'anonymous'),
        up AS (SELECT t.file_path, t.symbol, 'up' AS side, source_file || ':' || source_symbol AS step, CASE WHEN regexp_matches(lower(source_file || ' ' || source_symbol), {_q(T.ENTRY_POINT)}) OR source_symbol NOT IN (SELECT target_symbol FROM {CALLS} WHERE source_symbol <> '') THEN 'entry' ELSE 'caller' END AS role
               FROM t JOIN (SELECT DISTINCT target_symbol, source_symbol, source_file FROM {CALLS} WHERE source_symbol <> '' QUALIFY dense_rank() OVER (PARTITION BY target_symbol ORDER BY source_symbol, source_file) <= 5) c ON c.target_symbol = t.symbol),
        fd AS (SELECT name, arg_min(file_path, (file_path, start_line)) AS def_file FROM blocks WHERE name <> '' GROUP BY name),
        dn AS (SELECT DISTINCT t.file_path, t.symbol, 'down' AS side, c.target_symbol AS step, CASE WHEN fd.def_file IS NULL THEN 'unresolved' WHEN NOT EXISTS (SELECT 1 FROM {CALLS} n WHERE n.source_file = fd.def_file AND n.source_symbol = c.target_symbol) THEN 'leaf' ELSE 'callee' END AS role
               FROM t JOIN {CALLS} c ON c.source_file = t.file_path AND c.source_symbol = t.symbol LEFT JOIN fd ON fd.name = c.target_symbol),
        tr AS (SELECT * FROM up UNION ALL SELECT * FROM dn),
        g AS (SELECT file_path, symbol, list_slice(list_sort(list(DISTINCT step) FILTER (role = 'entry')), 1, 2) AS a, list_slice(list_sort(list(DISTINCT step) FILTER (role IN ('leaf', 'unresolved'))), 1, 3) AS z, bool_or(role = 'unresolved') AS open FROM tr GROUP BY ALL)
        SELECT file_path, symbol, 'Entry: [' || coalesce(nullif(array_to_string(a, ', '), ''), 'Direct / API / Test') || '] --> Target: [' || symbol || '] --> Leaves: [' || coalesce(nullif(array_to_string(z, ', '), ''), 'Local Return') || ']' AS flow, NOT open AS fully_traced FROM g
    """,
    "gra4_affected_tests": f"""
        WITH {RESOLVED}, dep AS (SELECT DISTINCT repo_id, target_file AS file_path, source_file AS dependent FROM res WHERE target_file IS NOT NULL AND target_file <> source_file),
        f0 AS (SELECT DISTINCT repo_id, file_path AS origin, file_path FROM source_files),
        f1 AS (SELECT DISTINCT f0.repo_id, origin, dependent AS file_path FROM f0 JOIN dep USING (repo_id, file_path)),
        f2 AS (SELECT DISTINCT f1.repo_id, origin, dependent AS file_path FROM f1 JOIN dep USING (repo_id, file_path)),
        b AS (SELECT DISTINCT file_path, {BASE.format('file_path')} AS base FROM source_files),
        c AS (SELECT file_path, unnest(['test_' || st || e, st || '_test' || e, st || '.test' || e, st || '.spec' || e, st || 'Test' || e, 'Test' || st || e]) AS base
              FROM (SELECT file_path, CASE WHEN contains(base, '.') AND base NOT LIKE '.%' THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS st, CASE WHEN contains(base, '.') AND base NOT LIKE '.%' THEN regexp_extract(base, '(\\.[^./]*)$', 1) ELSE '' END AS e FROM b))
        SELECT origin AS file_path, file_path AS test_path FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) WHERE regexp_matches(file_path, '(?i)test|spec|mock')
        UNION SELECT c.file_path, b.file_path FROM c JOIN b USING (base) WHERE contains(b.file_path, '/')
    """,
    "gra2_trace": f"""
        WITH t AS (SELECT DISTINCT file_path, name AS symbol FROM blocks WHERE name <> '' AND name <> 'anonymous'),
        up AS (SELECT t.file_path, t.symbol, 'up' AS side, source_file || ':' || source_symbol AS step, CASE WHEN regexp_matches(lower(source_file || ' ' || source_symbol), {_q(T.ENTRY_POINT)}) OR source_symbol NOT IN (SELECT target_symbol FROM {CALLS} WHERE source_symbol <> '') THEN 'entry' ELSE 'caller' END AS role
               FROM t JOIN (SELECT DISTINCT target_symbol, source_symbol, source_file FROM {CALLS} WHERE source_symbol <> '' QUALIFY dense_rank() OVER (PARTITION BY target_symbol ORDER BY source_symbol, source_file) <= 5) c ON c.target_symbol = t.symbol),
        fd AS (SELECT name, arg_min(file_path, (file_path, start_line)) AS def_file FROM blocks WHERE name <> '' GROUP BY name),
        dn AS (SELECT DISTINCT t.file_path, t.symbol, 'down' AS side, c.target_symbol AS step, CASE WHEN fd.def_file IS NULL THEN 'unresolved' WHEN NOT EXISTS (SELECT 1 FROM {CALLS} n WHERE n.source_file = fd.def_file AND n.source_symbol = c.target_symbol) THEN 'leaf' ELSE 'callee' END AS role
               FROM t JOIN {CALLS} c ON c.source_file = t.file_path AND c.source_symbol = t.symbol LEFT JOIN fd ON fd.name = c.target_symbol)
        SELECT * FROM up UNION ALL SELECT * FROM dn
    """,
    "gra3_call_paths": f"""
        WITH RECURSIVE {blast(SEEDS, 50)},
        e AS (SELECT DISTINCT source_symbol AS a, target_symbol AS b FROM edges WHERE relation = 'calls' AND source_symbol <> '' AND source_symbol <> target_symbol),
        pr AS (SELECT DISTINCT source_symbol AS origin, symbol AS goal FROM radius),
        wk(origin, goal, path, cur, n) AS (SELECT origin, goal, [origin], origin, 0 FROM pr UNION ALL SELECT origin, goal, list_append(path, e.b), e.b, n + 1 FROM wk JOIN e ON e.a = wk.cur WHERE n < 3 AND (n = 0 OR cur <> goal) AND NOT list_contains(path, e.b))
        SELECT DISTINCT origin, goal, array_to_string(path, '>') AS path, n AS edges FROM wk WHERE cur = goal AND n > 0
    """,
    "gra5_expand": f"""
        WITH {RESOLVED}, ed AS (SELECT DISTINCT repo_id, source_file, target_file FROM res WHERE target_file IS NOT NULL),
        s AS (SELECT DISTINCT h.query_id, r.repo_id, h.file_path FROM {H} h JOIN {R} r USING (query_id) WHERE h.pos <= 3),
        h1 AS (SELECT DISTINCT s.query_id, s.repo_id, ed.source_file, ed.target_file FROM s JOIN ed ON ed.repo_id = s.repo_id AND ed.source_file = s.file_path),
        n1 AS (SELECT DISTINCT query_id, repo_id, target_file AS file_path FROM h1 EXCEPT SELECT * FROM s),
        h2 AS (SELECT DISTINCT n1.query_id, n1.repo_id, ed.source_file, ed.target_file FROM n1 JOIN ed ON ed.repo_id = n1.repo_id AND ed.source_file = n1.file_path)
        SELECT query_id, repo_id, source_file, target_file, min(hop) AS hop, {label('source_file', 'target_file')} AS label FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL
    """,
    "agg6_token_metrics": f"""
        WITH h AS (SELECT DISTINCT h.query_id, h.block_id, h.file_path, b.content, b.repo_id FROM {H} h JOIN {B} b USING (block_id)),
        m AS (SELECT query_id, greatest(1, sum(length(content)) // 4)::BIGINT AS rt FROM h GROUP BY query_id),
        f AS (SELECT q.query_id, coalesce(sum(strlen(c.text)), 0) AS bytes FROM (SELECT DISTINCT query_id, repo_id, file_path FROM h) q LEFT JOIN {CUR} c USING (repo_id, file_path) GROUP BY 1),
        x AS (SELECT query_id, rt, greatest(rt, (bytes // 4)::BIGINT) AS wt FROM m JOIN f USING (query_id))
        SELECT query_id, rt AS retrieved_tokens, wt AS whole_files_tokens, wt - rt AS tokens_saved, round((wt - rt)::DOUBLE / wt * 100, 1) AS savings_percent FROM x
    """,
    "agg7_progress": f"""
        WITH b AS (SELECT DISTINCT block_id, repo_id, file_path FROM blocks), v AS (SELECT DISTINCT payload.block_id AS block_id FROM vectors WHERE payload.block_id IS NOT NULL)
        SELECT b.repo_id, count(DISTINCT file_path) AS total_files, count(*) AS total_blocks, count(v.block_id) AS indexed_blocks, least(greatest(round(count(v.block_id)::DOUBLE / count(*) * 100, 1), 0), 100)::DOUBLE AS percent,
               CASE WHEN count(*) = 0 THEN 'idle' WHEN count(v.block_id) < count(*) THEN 'indexing' ELSE 'ready' END AS state FROM b LEFT JOIN v USING (block_id) GROUP BY b.repo_id
    """,
    "agg11_usage": f"""
        WITH o AS (SELECT query_id, sum(length(content)) AS oc FROM {H} h JOIN {B} b USING (block_id) GROUP BY 1),
        u AS (SELECT repo_id, greatest(1, coalesce(length(query), 0) // 4)::BIGINT AS tin, greatest(1, coalesce(oc, 0) // 4)::BIGINT AS tout FROM {R} r LEFT JOIN o USING (query_id))
        SELECT repo_id, sum(tin)::BIGINT AS input_tokens, sum(tout)::BIGINT AS output_tokens, sum(tin + tout)::BIGINT AS total_tokens, count(*) AS calls FROM u GROUP BY repo_id
    """,
    "str2_sync": f"SELECT path, md5(text) AS hash FROM {LAST} WHERE op <> 'removed'",
    "str3_delta": f"SELECT count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'modified') AS modified, count(*) FILTER (op = 'removed') AS removed FROM {LAST}",
    "str1_listing_diff": "SELECT path, 'modified' AS op FROM (SELECT repo_id || '/' || file_path AS path, arg_min(md5(text), file_id) AS a, arg_max(md5(text), file_id) AS b FROM source_files GROUP BY 1) WHERE a <> b",
    "str7_needs_reindex": "WITH n AS (SELECT repo_id, count(DISTINCT block_id) AS c FROM blocks GROUP BY 1) SELECT r.repo_id FROM repos r LEFT JOIN n USING (repo_id) WHERE coalesce(n.c, 0) <= 20 OR r.repo_url IS NULL",
}

MODULES = f"(SELECT file_id, 'module' AS kind FROM {FILES} WHERE regexp_replace(text, '[\\s\\x0B]', '', 'g') <> '' AND file_id NOT IN (SELECT file_id FROM {SCAN}))"
SQL |= {
    "src2_tenant_blocks": f"""
        SELECT r.org_id, r.dept_id, f.repo_id, b.kind, count(*) AS n_blocks FROM (SELECT file_id, kind FROM {SCAN} UNION ALL SELECT file_id, kind FROM {MODULES}) b JOIN {FILES} f USING (file_id)
        LEFT JOIN (SELECT repo_id, coalesce(org_id, 'default_org') AS org_id, coalesce(dept_id, 'default_dept') AS dept_id FROM repos) r ON r.repo_id = f.repo_id GROUP BY ALL
    """,
    "joi3_hit_neighbours": f"""
        WITH h AS (SELECT DISTINCT b.block_id, b.file_path, b.name AS symbol FROM {B} b WHERE b.block_id IN (SELECT block_id FROM chunks) AND name <> '' AND name <> 'anonymous'),
        c AS (SELECT target_symbol AS symbol, source_symbol || ' (' || {BASE.format('source_file')} || ')' AS x FROM (SELECT DISTINCT target_symbol, source_symbol, source_file FROM {CALLS} WHERE source_symbol <> '') QUALIFY row_number() OVER (PARTITION BY target_symbol ORDER BY source_symbol, source_file) <= 5),
        i AS (SELECT symbol, array_to_string(list_sort(list(x)), ',') AS callers, count(*) AS callers_count FROM c GROUP BY symbol),
        o AS (SELECT source_file AS file_path, source_symbol AS symbol, count(DISTINCT target_symbol) AS callees_count FROM {CALLS} GROUP BY ALL)
        SELECT block_id, coalesce(callers, '') AS callers, coalesce(callers_count, 0) AS callers_count, coalesce(callees_count, 0) AS callees_count FROM h LEFT JOIN i USING (symbol) LEFT JOIN o USING (file_path, symbol)
    """,
    "sco8_exact_first": f"""
        WITH {exact_hits()}, e AS (SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY word_no, file_path, start_line, block_id) AS pos FROM x),
        u AS (SELECT *, 0 AS part FROM e UNION ALL SELECT query_id, block_id, min(pos), 1 FROM {H} GROUP BY ALL), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, block_id ORDER BY part, pos) = 1)
        SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY part, pos) AS pos FROM k
    """,
    "set2_changed_paths": f"SELECT path FROM {LAST} WHERE op = 'modified' UNION SELECT repo_id || '/' || file_path FROM source_files GROUP BY 1 HAVING count(DISTINCT file_id) = 1",
    "set6_federated_dense": """
        WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
        s AS (SELECT query_id, vec_id AS id, label, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
        t AS (SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) <= 5)
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t QUALIFY rank <= 10
    """,
    "win2_repo_top5": f"SELECT repo_id, block_id, score, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, block_id) AS rank FROM (SELECT b.repo_id, h.block_id, max(h.score) AS score FROM {H} h JOIN {B} b USING (block_id) GROUP BY ALL) QUALIFY rank <= 5",
    "win4_concern_first": f"SELECT query_id, concern, x[1] AS pos, x[2] AS block_id FROM (SELECT h.query_id, {CONCERN.replace('file_path', 'h.file_path').replace('coalesce(name', 'coalesce(b.name')} AS concern, min((h.pos, h.block_id)) AS x FROM {H} h JOIN {B} b USING (block_id) GROUP BY ALL)",
    "agg8_ordered_distinct": f"SELECT query_id, string_agg(file_path, ',' ORDER BY pos, file_path) AS file_list FROM (SELECT query_id, file_path, min(pos) AS pos FROM {H} GROUP BY ALL) GROUP BY query_id",
    "top5_cap": f"SELECT query_id, least(count(*), 5) AS shown, count(*) > 5 AS truncated FROM {H} GROUP BY query_id",
    "flt6_repo_scope": f"""
        WITH w AS (SELECT DISTINCT r.query_id, coalesce(r.repo_id, 'default_repo') AS scope, b.name AS symbol FROM {R} r JOIN {H} h USING (query_id) JOIN {B} b USING (block_id) WHERE h.pos = 1 AND b.name <> ''),
        e AS (SELECT DISTINCT repo_id, target_symbol AS symbol, source_symbol, source_file FROM edges WHERE relation = 'calls')
        SELECT query_id, symbol, count(*) AS n_callers FROM w JOIN e USING (symbol) WHERE scope = 'default_repo' OR scope = repo_id GROUP BY ALL
    """,
    "str6_empty_index": "SELECT repo_id FROM repos WHERE repo_id NOT IN (SELECT repo_id FROM blocks WHERE name IS NOT NULL)",
}


def _ignore_rules() -> list[tuple]:
    lines = [("", "*_pb2.py"), ("", "*.min.js"), ("", "/tools/"), ("src", "generated_reports/"), ("", "vendor/**"), ("", "!vendor/pandoline/**"), ("app", "[!a-m]*.go"), ("", "quer?_*")]
    return workspace.compile_rules(lines)


SQL["flt1_ignored"] = ignored(_ignore_rules())
