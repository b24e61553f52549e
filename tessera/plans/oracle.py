"""DuckDB SQL equivalent of every bound query (same column names)."""

ORACLE = {}

ORACLE["sparse_topk"] = r"""
WITH lines AS (
  SELECT doc_id, l.line_no - 1 AS line_no, l.line
  FROM (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS line,
               generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), 1) AS line_no
        FROM documents) l
),
qtok AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '\p{L}[\p{L}\p{N}]*')) AS token FROM lines),
qtf AS (SELECT doc_id, line_no, token, count(*)::DOUBLE AS n FROM qtok GROUP BY ALL),
qn AS (SELECT doc_id, line_no, sum(n*n) AS qss FROM qtf GROUP BY ALL),
ctok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}]*')) AS token FROM benchmark),
ctf AS (SELECT item_id, token, count(*)::DOUBLE AS m FROM ctok GROUP BY ALL),
cn AS (SELECT item_id, sum(m*m) AS css FROM ctf GROUP BY ALL),
dots AS (SELECT q.doc_id, q.line_no, c.item_id, sum(q.n*c.m) AS dot FROM qtf q JOIN ctf c USING (token) GROUP BY ALL),
frag AS (SELECT d.doc_id, d.item_id, d.dot / sqrt(qn.qss * cn.css) AS s
         FROM dots d JOIN qn USING (doc_id, line_no) JOIN cn USING (item_id)),
best AS (SELECT doc_id, item_id, max(s) AS similarity FROM frag WHERE s >= 1 - 0.5 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id DESC) AS rank FROM best)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM ranked WHERE rank <= 10
"""


def _prune_sql(x: str) -> str:
    """Chained prefix/suffix removal, written without regular expressions."""
    e = x
    for p in ("DELIMITER_CODE_START@", "DELIMITER_CODE_START"):
        e = f"(CASE WHEN starts_with({e}, '{p}') THEN substr({e}, {len(p) + 1}) ELSE {e} END)"
    for s in ("@DELIMITER_CODE_END", "DELIMITER_CODE_END"):
        e = f"(CASE WHEN ends_with({e}, '{s}') THEN left({e}, length({e}) - {len(s)}) ELSE {e} END)"
    return e


# one source file per order; the reason of each kind is stated, not computed
_SOURCES = r"""
kinds AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, (o_custkey % 25)::VARCHAR AS area, o_orderkey % 9 AS v FROM orders),
src AS (SELECT id, k, c, area, v,
  CASE v WHEN 1 THEN 'src/dao/Order' ELSE 'src/app/Order' END || k || CASE v WHEN 0 THEN '.xml' ELSE '.java' END AS path,
  'package app;' || chr(10) || '/* public class OrderDao' || k || ' { Hidden h; } */ // calls getConnection' || chr(10) ||
  CASE v WHEN 2 THEN 'public class OrderRepository' || k WHEN 3 THEN 'public class Order' || k || ' extends BaseMapper' ELSE 'public class Order' || k END || ' { ' ||
  CASE v WHEN 4 THEN 'void f() { org.hibernate.Session.open(); }' WHEN 5 THEN 'Object f() { return preparedStatement; }'
         WHEN 6 THEN 'void f() throws IOException, SQLException { }' WHEN 7 THEN 'String s = "class FooDao throws SQLException";' ELSE '' END ||
  ' private Map<Cust' || c || ', List<Line>> items; void g(Cust' || c || ' x, final Area' || area || ' y) { Gone[] a; try { } catch (Lost e) { } Part' || k || ' z = null; }' ||
  CASE WHEN id % 2 = 1 THEN ' public interface Port' || k || ' { }' ELSE '' END || ' }' || chr(10) AS content,
  CASE v WHEN 0 THEN 'not_source' WHEN 1 THEN 'path' WHEN 2 THEN 'class_name' WHEN 3 THEN 'superclass' WHEN 4 THEN 'library_call'
         WHEN 5 THEN 'jdbc_member' WHEN 6 THEN 'throws_sql' ELSE 'none' END AS reason FROM kinds)
"""


_LINES = """
  SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS line,
         generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')), 1) - 1 AS line_no
  FROM documents"""

_RELPATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"

ORACLE["corpus_scan"] = f"""
WITH p AS (SELECT page_id, {_RELPATH} AS path FROM pages),
s AS (SELECT page_id, path, string_split(path, '/') AS segs FROM p)
SELECT page_id, path, len(segs)::INTEGER AS depth, segs[-1] AS name FROM s
WHERE ends_with(path, '.html')
  AND NOT list_bool_or(list_transform(list_slice(segs, 1, len(segs) - 1),
        lambda d: starts_with(d, '.') OR starts_with(d, 'test') OR starts_with(d, 'target')
               OR starts_with(d, 'build') OR starts_with(d, 'ads-') OR starts_with(d, 'm.')))
"""

ORACLE["line_count"] = """
SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::INTEGER AS line_count FROM documents
"""

ORACLE["rule_classify"] = "WITH " + _SOURCES + "SELECT id, reason, reason NOT IN ('none', 'not_source') AS is_dao FROM src"

ORACLE["java_symbols"] = "WITH " + _SOURCES + """
SELECT id, CASE v WHEN 2 THEN 'OrderRepository' ELSE 'Order' END || k || CASE WHEN id % 2 = 1 THEN ',Port' || k ELSE '' END AS declared,
  CASE v WHEN 7 THEN 'String;' ELSE '' END || 'Map<Cust' || c || ', List<Line>>;Cust' || c || ';Area' || area || ';Part' || k AS used,
  array_to_string(list_sort(list_concat(CASE v WHEN 7 THEN ['String'] ELSE [] END,
    ['Map<Cust' || c || ', List<Line>>', 'Cust' || c, 'Area' || area, 'Part' || k, 'Map', 'List', 'Line'])), ';') AS used_args FROM src
"""

ORACLE["code_normalise"] = r"""
WITH t AS (
  SELECT page_id,
    regexp_replace(
      regexp_replace(
        replace(replace(replace(replace(replace(html, '\"', '"'), '\n', chr(10)), ';', ';' || chr(10)),
                '{', '{' || chr(10)), '}', chr(10) || '}' || chr(10)),
        '\n\s*\n', chr(10), 'g'),
      '^\s+|\s+$', '', 'g') AS s
  FROM pages),
l AS (SELECT page_id, unnest(string_split(s, chr(10))) AS raw, (generate_subscripts(string_split(s, chr(10)), 1) - 1)::INTEGER AS pos FROM t),
f AS (SELECT page_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM l),
g AS (SELECT *, (CASE WHEN ends_with(s, '{') THEN 1 ELSE 0 END) AS o,
             (CASE WHEN starts_with(s, '}') THEN 1 ELSE 0 END) AS c FROM f),
h AS (SELECT page_id, pos, s, (sum(o - c) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - o)::INTEGER AS level FROM g)
SELECT page_id, pos, level, repeat('    ', greatest(level, 0)) || s AS line FROM h
"""

ORACLE["fragments"] = f"SELECT doc_id, line_no::INTEGER AS pos, line AS fragment FROM ({_LINES})"

_VARIANT = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 2 THEN '[' || props || ']' WHEN 3 THEN '  ' || chr(10) || ' ' WHEN 4 THEN '```json' || chr(10) || chr(10) || '```'
  ELSE props || '}' END"""

ORACLE["row_json"] = """
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS json FROM customer
"""

ORACLE["json_status"] = rf"""
WITH a AS (SELECT event_id, regexp_replace({_VARIANT}, '^\s+|\s+$', '', 'g') AS s FROM events),
b AS (SELECT event_id, s, CASE WHEN starts_with(s, '```json' || chr(10)) AND ends_with(s, chr(10) || '```')
        THEN (CASE WHEN length(s) >= 12 THEN substr(s, 9, length(s) - 12) ELSE '' END) ELSE s END AS body FROM a),
c AS (SELECT event_id, body, CASE WHEN s = '' THEN 'empty' WHEN body = '' THEN 'empty'
        WHEN NOT json_valid(body) THEN 'invalid' WHEN json_type(body::JSON) = 'OBJECT' THEN 'ok' ELSE 'not_object' END AS status FROM b)
SELECT event_id, status, CASE WHEN status = 'ok' THEN body END AS body,
       CASE WHEN status = 'ok' THEN json_extract_string(body, '$.k')::BIGINT END AS k FROM c
"""

_MARKED = """CASE turn % 4 WHEN 0 THEN 'DELIMITER_CODE_START@' || text || '@DELIMITER_CODE_END'
  WHEN 1 THEN 'DELIMITER_CODE_START' || text || 'DELIMITER_CODE_END'
  WHEN 2 THEN 'DELIMITER_CODE_START@DELIMITER_CODE_START' || text ELSE text END"""

ORACLE["prune_delims"] = f"""
WITH c AS (SELECT conv_id, turn, {_MARKED} AS m FROM conversations)
SELECT conv_id, turn, {_prune_sql('m')} AS pruned,
       array_to_string(list_transform(string_split(m, chr(10)), lambda x: {_prune_sql('x')}), '|') AS pruned_lines
FROM c
"""

_LINE_ANSWER = """CASE event_id % 4 WHEN 0 THEN '{"start_line": "' || json_extract_string(props, '$.k') || '"}'
  WHEN 1 THEN '{"start_line": ' || json_extract_string(props, '$.k') || '}'
  WHEN 2 THEN '{}' ELSE '{"start_line": "' || json_extract_string(props, '$.k') || 'a"}' END"""

ORACLE["default_cast"] = f"""
WITH a AS (SELECT event_id, json_extract_string({_LINE_ANSWER}, '$.start_line') AS raw FROM events)
SELECT event_id, CASE WHEN raw IS NULL THEN -1 ELSE TRY_CAST(raw AS INTEGER) END AS start_line,
       CASE WHEN raw IS NOT NULL AND TRY_CAST(raw AS INTEGER) IS NULL THEN raw END AS bad_start_line
FROM a
"""

ORACLE["basename"] = "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages"

ORACLE["dense_id_batches"] = """
SELECT o_orderkey, o_custkey, idx, (idx // 100) AS batch FROM (
  SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS idx FROM orders)
"""


_GRAPH = r"""
decl AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\n)([A-Z][a-z]{3,})', 1)) AS cls FROM documents),
owner AS (SELECT cls, max(doc_id) AS doc_id FROM decl GROUP BY cls),
uses AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS cls FROM documents),
e AS (SELECT DISTINCT u.doc_id AS src, o.doc_id AS dst FROM uses u JOIN owner o USING (cls) WHERE u.doc_id <> o.doc_id)
"""

_DAG = r"""
tc(s, t) AS (SELECT src, dst FROM e UNION SELECT tc.s, e.dst FROM tc JOIN e ON tc.t = e.src),
dag AS (SELECT src, dst FROM e WHERE NOT (src < dst AND EXISTS (SELECT 1 FROM tc WHERE tc.s = e.dst AND tc.t = e.src)))
"""

_LEVELS = r"""
l(n, d) AS (SELECT doc_id, 0 FROM documents UNION SELECT dag.src, l.d + 1 FROM l JOIN dag ON dag.dst = l.n),
lv AS (SELECT n AS id, max(d) AS level FROM l GROUP BY n)
"""

ORACLE["declares"] = r"""
WITH decl AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|\n)([A-Z][a-z]{3,})', 1)) AS cls FROM documents)
SELECT d.doc_id, coalesce(string_agg(cls, ',' ORDER BY cls), '') AS symbols, count(cls)::INTEGER AS n_symbols
FROM documents d LEFT JOIN decl USING (doc_id) GROUP BY d.doc_id
"""

ORACLE["uses"] = r"""
SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS symbol FROM documents
"""

ORACLE["symbol_owner"] = "WITH " + _GRAPH.split("uses AS")[0].rstrip().rstrip(",") + \
    "\nSELECT cls AS symbol, doc_id FROM owner"

ORACLE["reference_edges"] = "WITH " + _GRAPH + "SELECT src, dst FROM e"

ORACLE["relaxed_edges"] = "WITH RECURSIVE " + _GRAPH + "," + _DAG + "SELECT src, dst FROM dag"

ORACLE["dep_levels"] = "WITH RECURSIVE " + _GRAPH + "," + _DAG + "," + _LEVELS + \
    "SELECT id, level::INTEGER AS level FROM lv"

ORACLE["level_sizes"] = "WITH RECURSIVE " + _GRAPH + "," + _DAG + "," + _LEVELS + \
    "SELECT level::INTEGER AS level, count(*) AS n_nodes FROM lv GROUP BY level"

ORACLE["components"] = "WITH RECURSIVE " + _GRAPH + r""",
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.m)
SELECT n AS id, min(m) AS component FROM r GROUP BY n
"""

ORACLE["successor_changes"] = "WITH RECURSIVE " + _GRAPH + "," + _DAG + r""",
ch AS (SELECT doc_id AS dst, 1 AS c FROM labels WHERE quality = 1)
SELECT src AS id, count(*) AS n_successors, count(c) AS n_changed,
       min(dst) FILTER (WHERE c = 1) AS first_changed, max(dst) FILTER (WHERE c = 1) AS last_changed
FROM dag LEFT JOIN ch USING (dst) GROUP BY src
"""


def _letter_cols(t: str, prefix: str) -> str:
    from ..functions.vectors import LETTERS
    return ", ".join(f"(length({t}) - length(regexp_replace({t}, '[{ch}{ch.upper()}]', '', 'g')))::DOUBLE AS {prefix}{i}"
                     for i, ch in enumerate(LETTERS))


def _letter_checksum(prefix: str) -> str:
    """round(sum((i+1) * float32(c_i / norm)), 6) with the same summation order as Spark."""
    n = 26
    norm = "sqrt(" + " + ".join(f"{prefix}{i} * {prefix}{i}" for i in range(n)) + ")"
    terms = [f"(CASE WHEN {norm} > 0 THEN {prefix}{i} / {norm} ELSE 0.0 END)::FLOAT::DOUBLE * {i + 1}.0"
             for i in range(n)]
    return "round(" + " + ".join(terms) + ", 6)"


ORACLE["unembedded"] = """
WITH s AS (SELECT text FROM benchmark UNION SELECT text FROM documents),
st AS (SELECT DISTINCT sha256(d.text) AS key FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id)
SELECT sha256(text) AS text_sha, length(text)::INTEGER AS n_chars FROM s WHERE sha256(text) NOT IN (SELECT key FROM st)
"""

ORACLE["corpus_upsert"] = f"""
WITH nw AS (SELECT item_id AS id, text AS example, text || chr(10) || '-- rewritten' AS rewrite FROM benchmark),
od AS (SELECT doc_id AS id, text AS example, text || chr(10) || '-- rewritten' AS rewrite FROM documents),
m AS (SELECT coalesce(nw.id, od.id) AS id, coalesce(nw.example, od.example) AS example,
             coalesce(nw.rewrite, od.rewrite) AS rewrite FROM nw FULL OUTER JOIN od ON nw.id = od.id),
c AS (SELECT id, example, rewrite, {_letter_cols('example', 'e')}, {_letter_cols('rewrite', 'r')} FROM m)
SELECT id, sha256(example) AS example_sha, length(rewrite)::INTEGER AS rewrite_chars,
       {_letter_checksum('e')} AS example_checksum, {_letter_checksum('r')} AS rewrite_checksum
FROM c
"""

ORACLE["id_integrity"] = """
SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL
"""

_PAIRS = """
cases AS (SELECT vec_id AS k, embedding::DOUBLE[] AS a FROM embeddings),
answers AS (SELECT vec_id - 1 AS k, embedding::DOUBLE[] AS b FROM embeddings)
"""

ORACLE["pair_cosine"] = "WITH " + _PAIRS + """
SELECT k AS pair_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM cases JOIN answers USING (k)
"""

ORACLE["accuracy"] = "WITH " + _PAIRS + """,
j AS (SELECT c.k, c.a, x.b FROM cases c LEFT JOIN answers x ON c.k = x.k),
s AS (SELECT CASE WHEN b IS NOT NULL
          AND list_cosine_similarity(list_transform(a, lambda v: abs(v)), list_transform(b, lambda v: abs(v))) >= 0.65
          AND list_cosine_similarity(a, b) >= 0.0 THEN 1 ELSE 0 END AS ok FROM j)
SELECT count(*) AS n_cases, sum(ok)::BIGINT AS n_correct, round(coalesce(avg(ok), 0.0) * 100.0, 6) AS accuracy_pct FROM s
"""

ORACLE["dense_topk"] = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS val, generate_subscripts(v, 1) AS d FROM e),
c AS (SELECT label, list(m ORDER BY d) AS cv FROM (SELECT label, d, avg(val) AS m FROM x GROUP BY ALL) GROUP BY label),
q AS (SELECT label, cv FROM c UNION ALL SELECT label, arg_min(v, vec_id) AS cv FROM e GROUP BY label),
s AS (SELECT q.label, e.vec_id, max(list_cosine_similarity(q.cv, e.v)) AS similarity FROM q, e GROUP BY ALL),
f AS (SELECT * FROM s WHERE similarity >= 1 - 0.75),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id DESC) AS rank FROM f)
SELECT label, vec_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10
"""

ORACLE["truncate_pool"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')[1:64]) AS tok FROM documents),
j AS (SELECT t.doc_id, e.embedding::DOUBLE[] AS v FROM t JOIN embeddings e ON e.vec_id = length(t.tok)),
x AS (SELECT doc_id, unnest(v) AS val, generate_subscripts(v, 1) - 1 AS dim FROM j)
SELECT doc_id, dim::INTEGER AS dim, round(avg(val), 6) AS value FROM x GROUP BY doc_id, dim
"""

_PART_HITS = r"""
rec AS (SELECT min(p_partkey) AS id, 'part ' || p_name || ' ' || p_type AS example FROM part GROUP BY p_name, p_type),
asked AS (SELECT DISTINCT 'part ' || p_name || ' ' || p_type AS q FROM part),
qtf AS (SELECT q, token, count(*)::DOUBLE AS n FROM (SELECT q, unnest(regexp_extract_all(lower(q), '\p{L}[\p{L}\p{N}]*')) AS token FROM asked) GROUP BY ALL),
ctf AS (SELECT id, token, count(*)::DOUBLE AS m FROM (SELECT id, unnest(regexp_extract_all(lower(example), '\p{L}[\p{L}\p{N}]*')) AS token FROM rec) GROUP BY ALL),
s AS (SELECT q, id, sum(n * m) / sqrt(any_value(qss) * any_value(css)) AS sim FROM qtf JOIN ctf USING (token)
      JOIN (SELECT q, sum(n * n) AS qss FROM qtf GROUP BY q) USING (q) JOIN (SELECT id, sum(m * m) AS css FROM ctf GROUP BY id) USING (id) GROUP BY q, id),
rk AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id DESC) AS rank FROM s WHERE sim >= 0.75),
hit AS (SELECT q, string_agg('use part ' || id, '|' ORDER BY rank) FILTER (WHERE rank <= 10) AS ten, count(*) FILTER (WHERE rank <= 10) AS n_ten,
               string_agg('use part ' || id, '|' ORDER BY rank) FILTER (WHERE rank <= 2) AS two, count(*) FILTER (WHERE rank <= 2) AS n_two FROM rk GROUP BY q)
"""

ORACLE["notes_enrich"] = "WITH " + _PART_HITS + """
SELECT p_partkey, 0::INTEGER AS pos, q AS description, p_size::INTEGER AS start_line, coalesce(ten, '') AS notes, coalesce(n_ten, 0)::INTEGER AS n_notes
FROM part LEFT JOIN hit ON hit.q = 'part ' || p_name || ' ' || p_type
UNION ALL SELECT p_partkey, 1, 'nothing known of it', -1, '', 0 FROM part
UNION ALL SELECT p_partkey, 2, NULL, -1, '', 0 FROM part
"""

ORACLE["question_answers"] = "WITH " + _PART_HITS + """
SELECT p_partkey, 0::INTEGER AS pos, coalesce(two, '') AS answers, coalesce(n_two, 0)::INTEGER AS n_answers
FROM part LEFT JOIN hit ON hit.q = 'part ' || p_name || ' ' || p_type
UNION ALL SELECT p_partkey, 1, '', 0 FROM part
"""


def _answer_sql(src: str) -> str:
    """status/body columns of COL-5 for a relation ``src`` with column ``t``."""
    return rf"""
(SELECT *, CASE WHEN s = '' THEN 'empty' WHEN body = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'invalid'
              WHEN json_type(body::JSON) = 'OBJECT' THEN 'ok' ELSE 'not_object' END AS status
 FROM (SELECT *, CASE WHEN starts_with(s, '```json' || chr(10)) AND ends_with(s, chr(10) || '```')
                   THEN (CASE WHEN length(s) >= 12 THEN substr(s, 9, length(s) - 12) ELSE '' END) ELSE s END AS body
       FROM (SELECT *, regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g') AS s FROM {src})))"""


_HEADER = ("Use the following questions and their answers which are required for the code "
           "conversions**Questions and Search Results:**' || chr(10) || chr(10) || '")

ORACLE["context_block"] = rf"""
WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS q_no
           FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls
      FROM conversations WHERE role = 'assistant'),
al AS (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS r_no FROM a),
h AS (SELECT u.conv_id, u.q_no, al.r_no, al.line AS result FROM u JOIN al ON al.conv_id = u.conv_id AND al.turn = u.turn + 1),
pq AS (SELECT conv_id, q_no, string_agg('    * **Search Result ' || r_no || ':** ' || result || chr(10) || chr(10), '' ORDER BY r_no) AS res
       FROM h GROUP BY conv_id, q_no),
q AS (SELECT u.conv_id, u.q_no, u.text AS question, pq.res FROM u LEFT JOIN pq ON pq.conv_id = u.conv_id AND pq.q_no = u.q_no),
g AS (SELECT conv_id, count(*) AS n_questions, count(res) AS n_answered,
             coalesce(string_agg('* **Question ' || q_no || ':** ' || question || chr(10) || res, '' ORDER BY q_no)
                      FILTER (WHERE res IS NOT NULL), '') AS body FROM q GROUP BY conv_id)
SELECT conv_id, n_questions, n_answered,
       CASE WHEN n_answered > 0 THEN 'Conversation ' || conv_id || chr(10) || '{_HEADER}' || body
            ELSE 'Conversation ' || conv_id END AS prompt
FROM g
"""

ORACLE["prompt_replay"] = "WITH " + _SOURCES + """,
r AS (SELECT id, CASE WHEN reason NOT IN ('none', 'not_source') THEN 'full' ELSE 'short' END AS route, 'File ' || path || ':' || chr(10) || content AS code FROM src),
p AS (SELECT id, route, CASE route WHEN 'full' THEN 'Old schema:' || chr(10) || 'CREATE TABLE orders (id INT AUTO_INCREMENT)' || chr(10) || 'New schema:' || chr(10) ||
             'CREATE TABLE orders (id INT64)' || chr(10) || 'Change this data-access file.' || chr(10) ELSE 'Check this file.' || chr(10) END || code AS prompt FROM r),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT p.id AS prompt_key, p.route, max(length(p.prompt))::INTEGER AS prompt_chars, max(sha256(p.prompt)) AS prompt_sha, count(a.text) AS n_responses, min(a.turn) AS first_attempt
FROM p LEFT JOIN a ON a.conv_id = p.id GROUP BY p.id, p.route
"""

ORACLE["attempt_resolution"] = f"""
WITH a AS (SELECT conv_id, turn AS attempt,
             CASE length(text) % 4 WHEN 0 THEN '' WHEN 1 THEN '```json' || chr(10) || '{{"turn": ' || turn || '}}' || chr(10) || '```'
               WHEN 2 THEN '[' || turn || ']' ELSE text END AS t FROM conversations),
s AS {_answer_sql('a')},
g AS (SELECT conv_id, min(attempt) FILTER (WHERE status IN ('ok', 'empty') AND attempt < 3) AS w FROM s GROUP BY conv_id)
SELECT g.conv_id, g.w AS winning_attempt, coalesce(s.status, 'failed') AS status,
       CASE WHEN s.status = 'ok' THEN s.body ELSE '{{}}' END AS value
FROM g LEFT JOIN s ON s.conv_id = g.conv_id AND s.attempt = g.w
"""

_CPLX = "CASE l_returnflag WHEN 'A' THEN 'SIMPLE' WHEN 'N' THEN 'MODERATE' ELSE 'COMPLEX' END"

_ANSWERS = f"""
obj AS (SELECT l_orderkey, l_linenumber,
   '{{"code_sample": "L' || l_linenumber || '", ' ||
   (CASE WHEN l_returnflag = 'N' THEN '' WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN '"start_line": "x1", '
         ELSE '"start_line": "' || (l_linenumber * 10) || '", ' END) ||
   '"end_line": ' || (CASE WHEN l_linenumber = 3 THEN '"9z"' ELSE (l_linenumber * 10 + CAST(l_quantity AS INTEGER))::VARCHAR END) ||
   ', "suggested_change": "use part ' || l_partkey || '", "description": "supplier ' || l_suppkey ||
   '", "complexity": "' || {_CPLX} || '", "warnings": [' || (CASE WHEN l_discount >= 0.05 THEN '"discount"' ELSE '' END) || ']}}' AS o,
   CASE WHEN l_linestatus = 'F' THEN '{{"original_signature": "f' || l_linenumber || '(int)", "new_signature": "f' || l_linenumber ||
        '(long)", "explanation": "supplier ' || l_suppkey || '"}}' END AS sg,
   CASE WHEN l_discount >= 0.05 THEN '"part ' || l_partkey || '?"' END AS q
   FROM lineitem),
ans AS (SELECT l_orderkey,
   '{{"file_modifications": [' || string_agg(o, ', ' ORDER BY l_linenumber, o) || '], "method_signature_changes": [' ||
   coalesce(string_agg(sg, ', ' ORDER BY l_linenumber, sg) FILTER (WHERE sg IS NOT NULL), '') || ']}}' AS value,
   coalesce('{{"questions": [' || string_agg(q, ', ' ORDER BY l_linenumber, q) FILTER (WHERE q IS NOT NULL) || ']}}', '{{}}') AS questions
   FROM obj GROUP BY l_orderkey)
"""

ORACLE["explode_changes"] = "WITH " + _ANSWERS + """,
m AS (SELECT l_orderkey, unnest(json_extract(value, '$.file_modifications[*]')) AS j,
             generate_subscripts(json_extract(value, '$.file_modifications[*]'), 1) - 1 AS pos FROM ans),
f AS (SELECT l_orderkey, pos::INTEGER AS pos, json_extract_string(j, '$.code_sample') AS code_sample,
             json_extract_string(j, '$.start_line') AS sl, json_extract_string(j, '$.end_line') AS el,
             json_extract_string(j, '$.suggested_change') AS suggested_change,
             json_extract_string(j, '$.description') AS description, json_extract_string(j, '$.complexity') AS complexity,
             array_to_string(coalesce(json_extract_string(j, '$.warnings[*]'), []), ',') AS warnings FROM m)
SELECT l_orderkey, pos, code_sample,
       CASE WHEN sl IS NULL THEN -1 ELSE TRY_CAST(sl AS INTEGER) END AS start_line,
       CASE WHEN el IS NULL THEN -1 ELSE TRY_CAST(el AS INTEGER) END AS end_line,
       suggested_change, description, complexity, warnings,
       CASE WHEN sl IS NOT NULL AND TRY_CAST(sl AS INTEGER) IS NULL THEN sl END AS bad_start_line,
       CASE WHEN el IS NOT NULL AND TRY_CAST(el AS INTEGER) IS NULL THEN el END AS bad_end_line
FROM f
"""

ORACLE["explode_signatures"] = "WITH " + _ANSWERS + """,
m AS (SELECT l_orderkey, unnest(json_extract(value, '$.method_signature_changes[*]')) AS j,
             generate_subscripts(json_extract(value, '$.method_signature_changes[*]'), 1) - 1 AS pos FROM ans)
SELECT l_orderkey, pos::INTEGER AS pos, json_extract_string(j, '$.original_signature') AS original_signature,
       json_extract_string(j, '$.new_signature') AS new_signature, json_extract_string(j, '$.explanation') AS explanation
FROM m
"""

ORACLE["explode_questions"] = "WITH " + _ANSWERS + """,
qs AS (SELECT l_orderkey, json_extract_string(questions, '$.questions[*]') AS ql FROM ans)
SELECT l_orderkey, (generate_subscripts(ql, 1) - 1)::INTEGER AS pos, unnest(ql) AS question FROM qs WHERE len(ql) > 0
UNION ALL
SELECT l_orderkey, NULL::INTEGER AS pos, NULL::VARCHAR AS question FROM qs WHERE ql IS NULL OR len(ql) = 0
"""

ORACLE["complexity_matrix"] = f"""
SELECT l_orderkey AS filename, count(*) FILTER (WHERE c = 'SIMPLE') AS n_simple,
       count(*) FILTER (WHERE c = 'MODERATE') AS n_moderate, count(*) FILTER (WHERE c = 'COMPLEX') AS n_complex,
       count(*) AS n_total
FROM (SELECT l_orderkey, {_CPLX} AS c FROM lineitem) GROUP BY l_orderkey
"""

ORACLE["complexity_values"] = f"SELECT DISTINCT {_CPLX} AS complexity FROM lineitem"

ORACLE["lines_by_complexity"] = f"""
SELECT {_CPLX} AS complexity, sum(CAST(l_quantity AS INTEGER))::BIGINT AS lines FROM lineitem GROUP BY 1
"""

ORACLE["tasks_by_effort"] = """
WITH t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Major' WHEN '2-HIGH' THEN 'Moderate'
             WHEN '3-MEDIUM' THEN 'Minor' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS effort FROM orders),
r AS (SELECT *, (CASE effort WHEN 'Major' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 3 ELSE 4 END)::INTEGER AS effort_rank FROM t)
SELECT effort, o_orderkey, effort_rank,
       row_number() OVER (PARTITION BY effort ORDER BY o_orderkey) - 1 AS group_pos,
       row_number() OVER (ORDER BY effort_rank, o_orderkey) - 1 AS sorted_pos
FROM r
"""

_FILES = """
f AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lc FROM documents),
j AS (SELECT f.*, l.doc_id IS NOT NULL AS imp FROM f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
"""

ORACLE["app_totals"] = "WITH " + _FILES + """
SELECT sum(lc)::BIGINT AS lines_of_code, count(*) AS n_files, count(*) FILTER (WHERE imp) AS n_impacted FROM j
"""

ORACLE["impact_split"] = "WITH " + _FILES + """
SELECT count(*) FILTER (WHERE imp) AS modified_files, count(*) FILTER (WHERE NOT imp) AS unchanged_files,
       coalesce(sum(lc) FILTER (WHERE imp), 0)::BIGINT AS modified_lines,
       coalesce(sum(lc) FILTER (WHERE NOT imp), 0)::BIGINT AS unchanged_lines FROM j
"""

ORACLE["task_changes"] = """
SELECT o.o_orderkey AS task, count(l.l_orderkey) AS n_changes,
       coalesce(string_agg(l.l_linenumber::VARCHAR, ',' ORDER BY l.l_linenumber), '') AS line_numbers,
       round(coalesce(sum(l.l_quantity), 0), 6) AS total_qty
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber BETWEEN 1 AND 7 GROUP BY o.o_orderkey
"""

ORACLE["affected_changes"] = f"""
SELECT l_orderkey AS filename, {_CPLX} AS complexity, count(*) AS n FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL
"""

ORACLE["example_block"] = r"""
WITH q AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS ftext,
             generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), 1) AS frag
      FROM documents),
qtok AS (SELECT doc_id, frag, unnest(regexp_extract_all(lower(ftext), '\p{L}[\p{L}\p{N}]*')) AS token FROM q),
qtf AS (SELECT doc_id, frag, token, count(*)::DOUBLE AS n FROM qtok GROUP BY ALL),
qn AS (SELECT doc_id, frag, sum(n*n) AS qss FROM qtf GROUP BY ALL),
ctok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}]*')) AS token FROM benchmark),
ctf AS (SELECT item_id, token, count(*)::DOUBLE AS m FROM ctok GROUP BY ALL),
cn AS (SELECT item_id, sum(m*m) AS css FROM ctf GROUP BY ALL),
dots AS (SELECT q.doc_id, q.frag, c.item_id, sum(q.n*c.m) AS dot FROM qtf q JOIN ctf c USING (token) GROUP BY ALL),
fr AS (SELECT d.doc_id, d.item_id, d.dot / sqrt(qn.qss * cn.css) AS s
       FROM dots d JOIN qn USING (doc_id, frag) JOIN cn USING (item_id)),
best AS (SELECT doc_id, item_id, max(s) AS sim FROM fr WHERE s >= 1 - 0.5 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, item_id DESC) AS rank FROM best),
top AS (SELECT rk.doc_id, rk.rank, b.text AS example, 'item ' || b.item_id AS rewrite
        FROM rk JOIN benchmark b ON b.item_id = rk.item_id WHERE rank <= 10),
blk AS (SELECT doc_id, count(*) AS n,
          string_agg('Code like the following' || chr(10) || '```' || chr(10) || example || chr(10) || '```' || chr(10) || chr(10) ||
                     'can be rewritten as follows:' || chr(10) || chr(10) || '```' || chr(10) || rewrite || chr(10) || '```' || chr(10),
                     chr(10) ORDER BY rank) AS b
        FROM top GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN blk.b IS NULL THEN '' ELSE 'The following are examples of how to rewrite code.' || chr(10) || chr(10) || blk.b END AS examples,
       coalesce(blk.n, 0)::INTEGER AS n_examples
FROM documents d LEFT JOIN blk ON blk.doc_id = d.doc_id
"""

ORACLE["level_propagation"] = "WITH RECURSIVE " + _GRAPH + "," + _DAG + "," + _LEVELS + r""",
anc(n) AS (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT dag.src FROM anc JOIN dag ON dag.dst = anc.n)
SELECT lv.id, lv.level::INTEGER AS level, lv.id IN (SELECT n FROM anc) AS changed FROM lv
"""

# hashed term vectors: bucket and sign of a word from its MD5, L2-normalised, stored as float
ORACLE["embed_batch"] = """
WITH words AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
hashed AS (
    SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS d,
           CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM words),
counts AS (SELECT item_id, d, sum(s)::DOUBLE AS c FROM hashed GROUP BY ALL HAVING sum(s) <> 0),
norms AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM counts GROUP BY item_id)
SELECT b.item_id, 256 AS n_dims, count(c.d)::INTEGER AS n_nonzero,
       round(coalesce(sum(((c.c / n.n)::FLOAT)::DOUBLE * (c.d + 1)), 0.0), 6) AS embedding_checksum
FROM benchmark b LEFT JOIN counts c USING (item_id) LEFT JOIN norms n USING (item_id)
GROUP BY b.item_id
"""
