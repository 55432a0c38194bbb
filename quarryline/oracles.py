"""DuckDB SQL for the catalogue. Chains of table expressions are put together from named parts."""

from __future__ import annotations

from quarryline import config
from quarryline.catalogue import CANDIDATES, SAMPLE_QUERIES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _tokens(text: str) -> str:
    pieces = "list_concat([x], list_filter(string_split(x, '_'), lambda p: p <> ''))"
    return f"flatten(list_transform(regexp_extract_all(lower({text}), '[a-z_][a-z0-9_]*'), lambda x: CASE WHEN contains(x, '_') THEN {pieces} ELSE [x] END))"


def _query_tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z_][a-z0-9_]*'))"


def _name_tokens(name: str) -> str:
    return f"list_distinct(flatten(list_transform(string_split(lower({name}), '.'), lambda x: list_concat([x], list_filter(string_split(x, '_'), lambda p: p <> '')))))"


def _identifiers(text: str) -> str:
    """Without duplicates, in order of their first places."""
    found = rf"list_filter(regexp_extract_all({text}, '\b[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*\b'), lambda x: contains(x, '_') OR contains(x, '.'))"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def _expand(query: str) -> str:
    low = rf"regexp_replace(trim(lower({query})), '\s+', ' ', 'g')"
    every = "list_concat(" + ", ".join(f"CASE WHEN contains({low}, {_text(p)}) THEN {_list(t)} ELSE [] END" for p, t in config.EXPANSIONS) + ")"
    once = f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"
    return f"CASE WHEN len({every}) > 0 THEN {query} || ' ' || array_to_string({once}, ' ') ELSE {query} END"


def _identifier_score(found: str, name: str) -> str:
    one = f"lambda x: CASE WHEN lower(x) = lower({name}) OR list_contains(string_split(lower({name}), '.'), lower(x)) THEN 1.0::DOUBLE WHEN contains(lower({name}), lower(x)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    return f"coalesce(list_max(list_transform({found}, {one})), 0.0::DOUBLE)"


def _name_score(tokens: str, name: str) -> str:
    wanted = f"list_filter({tokens}, lambda x: NOT list_contains({_list(config.STOP_WORDS)}, x))"
    return f"CASE WHEN len({wanted}) > 0 THEN len(list_intersect({wanted}, {_name_tokens(name)}))::DOUBLE / len({wanted}) ELSE 0.0::DOUBLE END"


def _entity_score(tokens: str, name: str) -> str:
    return f"CASE WHEN list_contains({tokens}, lower(split_part({name}, '.', 1))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _weight(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.EDGE_WEIGHTS.items()) + f" ELSE {config.OTHER_EDGE_WEIGHT} END"


LEXICAL = "concat_ws(' ', qualified_name, name, file, type, text)"
DOCS = "docs AS (SELECT doc_id AS id, lang || '_doc_' || doc_id AS name, source || '.' || lang || '_doc_' || doc_id AS qualified_name, lang AS type, source || '/' || lang AS file, 1 AS line, text FROM documents)"
ASKED = "asked AS (SELECT item_id AS qid, text || ' src' || (item_id % 20) || '.en_doc_' || item_id AS query FROM benchmark)"
SAMPLES = "samples AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_text(q)})" for i, q in SAMPLE_QUERIES) + ") v(qid, query))"
MORE_SAMPLES = f"{SAMPLES}, {ASKED}, every AS (SELECT * FROM samples UNION ALL SELECT qid + 100, query FROM asked)"

STAR = """
raw_edges AS (
    SELECT 'R' || n_regionkey AS source, 'N' || n_nationkey AS target, 'DEFINES' AS type, n_nationkey::BIGINT AS line FROM nation
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'INHERITS', c_custkey FROM customer
    UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'INHERITS', s_suppkey FROM supplier
    UNION ALL SELECT 'S' || s_suppkey, 'EXT', 'INHERITS', s_suppkey FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'N' || n_nationkey, 'N' || ((n_nationkey + 1) % 25), 'INHERITS_METHOD', n_nationkey FROM nation
    UNION ALL SELECT 'R' || r_regionkey, 'R' || ((r_regionkey + 1) % 5), 'IMPORTS', r_regionkey FROM region
    UNION ALL SELECT 'C' || o_custkey, 'S' || l_suppkey, 'CALLS', l_orderkey * 10 + l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT *, row_number() OVER (ORDER BY type, source, target, line) AS ord FROM raw_edges),
nodes AS (
    SELECT 'R' || r_regionkey AS qualified_name, 'R' AS type FROM region UNION ALL SELECT 'N' || n_nationkey, 'N' FROM nation
    UNION ALL SELECT 'S' || s_suppkey, 'S' FROM supplier UNION ALL SELECT 'C' || c_custkey, 'C' FROM customer)"""

GRAPH = """
size AS (SELECT max(id) + 1 AS n FROM docs),
raw_edges AS (
    SELECT qualified_name AS source, 'EXT' AS target, 'INHERITS' AS type, id AS line FROM docs WHERE type = 'de'
    UNION ALL SELECT a.qualified_name, b.qualified_name, 'CALLS', a.id FROM docs a, size, docs b WHERE b.id = (a.id * 7 + 1) % n
    UNION ALL SELECT a.qualified_name, b.qualified_name, 'CALLS', a.id FROM docs a, size, docs b WHERE b.id = (a.id + 2) % n
    UNION ALL SELECT a.qualified_name, b.qualified_name, 'INHERITS_METHOD', a.id FROM docs a, size, docs b WHERE b.id = (a.id + 20) % n
    UNION ALL SELECT a.qualified_name, b.qualified_name, 'IMPORTS', a.id FROM docs a, size, docs b WHERE b.id = (a.id + 1) % n),
edges AS (SELECT *, row_number() OVER (ORDER BY type, source, target, line) AS ord FROM raw_edges)"""

CLASSES = """
syms AS (
    SELECT 'R' || r_regionkey AS name, 'class' AS type, r_regionkey AS line, []::VARCHAR[] AS bases FROM region
    UNION ALL SELECT 'R' || n_regionkey || '.' || lower(n_name), 'method', n_nationkey, [] FROM nation
    UNION ALL SELECT 'X' || s_suppkey || '.m', 'method', s_suppkey, [] FROM supplier
    UNION ALL SELECT 'C' || c_custkey, 'class', c_custkey, ['N' || c_nationkey, 'seg.' || c_mktsegment] FROM customer)"""

LOOKUP = """
names AS (
    SELECT 'R' || r_regionkey || '.m' || j AS name FROM region, range(5) t(j) WHERE (r_regionkey + j) % 2 = 0
    UNION ALL SELECT 'N' || n_nationkey || '.m' || j FROM nation, range(5) t(j) WHERE (n_nationkey + j) % 3 = 0
    UNION ALL SELECT 'C' || c_custkey || '.m' || j FROM customer, range(5) t(j) WHERE (c_custkey + j) % 7 = 0),
reached AS (
    SELECT 'C' || c_custkey AS class, 'C' || c_custkey AS owner, 0 AS spot FROM customer
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 100 FROM customer
    UNION ALL SELECT 'C' || c_custkey, 'N' || ((c_nationkey + 1) % 25), 101 FROM customer
    UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, 200 FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, 210 FROM customer JOIN nation ON n_nationkey = (c_nationkey + 1) % 25
    UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 0 FROM region),
found AS (
    SELECT class, split_part(name, '.', 2) AS method, arg_min(name, spot) AS target
    FROM reached JOIN names ON split_part(name, '.', 1) = owner GROUP BY ALL)"""


def _bm25(queries: str, k: int) -> str:
    """Parts up to ``bm25``: (qid, id, score, rank)."""
    return f"""
toks AS (SELECT id, unnest({_tokens(LEXICAL)}) AS term FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT docs.id, coalesce(sum(tf), 0) AS length FROM docs LEFT JOIN tf USING (id) GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, avg(length) AS avgdl FROM lens),
raw AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, corpus GROUP BY term, n_docs),
idf AS (SELECT term, CASE WHEN raw < 0 THEN {config.BM25_EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qterms AS (SELECT qid, unnest({_tokens('query')}) AS term FROM {queries}),
hits AS (
    SELECT qid, id, sum(idf * tf * {config.BM25_K1 + 1} / (tf + {config.BM25_K1} * (1 - {config.BM25_B} + {config.BM25_B} * length / avgdl))) AS score
    FROM qterms JOIN idf USING (term) JOIN tf USING (term) JOIN lens USING (id), corpus GROUP BY ALL),
allscores AS (SELECT q.qid, docs.id, coalesce(score, 0) AS score FROM (SELECT DISTINCT qid FROM {queries}) q CROSS JOIN docs LEFT JOIN hits ON hits.qid = q.qid AND hits.id = docs.id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM allscores) WHERE rank <= {k})"""


HYBRID = f"""
{DOCS}, {ASKED},
qf AS (SELECT qid, query, {_expand('query')} AS expanded, {_query_tokens('query')} AS tokens FROM asked),
qi AS (SELECT *, {_identifiers('expanded')} AS ids FROM qf),
expanded AS (SELECT qid, expanded AS query FROM qi),
{_bm25('expanded', CANDIDATES)},
vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT id FROM docs)),
dots AS (SELECT q.id AS qid, v.id, round(list_dot_product(q.e, v.e), 9) AS score FROM vecs q JOIN asked ON asked.qid = q.id CROSS JOIN vecs v),
semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dots) WHERE rank <= {CANDIDATES}),
{GRAPH},
half AS (SELECT source, target, {_weight('type')} AS w FROM edges WHERE type <> 'DEFINES' AND source <> target UNION ALL SELECT target, source, {_weight('type')} FROM edges WHERE type <> 'DEFINES' AND source <> target),
front0 AS (SELECT DISTINCT qid, qualified_name AS name FROM (SELECT qid, id FROM bm25 UNION ALL SELECT qid, id FROM semantic) JOIN docs USING (id)),
step0 AS (SELECT qid, target AS name, w FROM front0 JOIN half ON name = source),
front1 AS (SELECT DISTINCT qid, name FROM step0 EXCEPT SELECT * FROM front0),
step1 AS (SELECT qid, target AS name, w / 2 AS w FROM front1 JOIN half ON name = source),
near AS (SELECT qid, name, sum(w) AS score FROM (SELECT * FROM step0 UNION ALL SELECT * FROM step1) GROUP BY ALL),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name) AS place FROM near) WHERE place <= {CANDIDATES}),
graph AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM nearest JOIN docs ON nearest.name = qualified_name),
lists AS (
    SELECT qid, id, 'bm25' AS src, rank, 1.0::DOUBLE / ({config.RRF_K} + rank) AS gain FROM bm25
    UNION ALL SELECT qid, id, 'semantic', rank, 1.0::DOUBLE / ({config.RRF_K} + rank) FROM semantic
    UNION ALL SELECT qid, id, 'graph', rank, {config.GRAPH_SHARE}::DOUBLE / ({config.RRF_K} + rank) FROM graph),
fused AS (
    SELECT qid, id, sum(gain) AS rrf, string_agg(src, ',' ORDER BY src) AS sources, max(rank) FILTER (src = 'bm25') AS bm25_rank,
           max(rank) FILTER (src = 'semantic') AS semantic_rank, max(rank) FILTER (src = 'graph') AS graph_rank FROM lists GROUP BY ALL)"""

RANKED = f"""
{HYBRID},
scored AS (
    SELECT fused.*, qualified_name, {_identifier_score('ids', 'qualified_name')} AS ident, {_name_score('tokens', 'qualified_name')} AS nm, {_entity_score('tokens', 'qualified_name')} AS ent
    FROM fused JOIN docs USING (id) JOIN qi USING (qid)),
finals AS (SELECT *, rrf + {config.IDENTIFIER_WEIGHT} * ident + {config.NAME_WEIGHT} * nm + {config.ENTITY_WEIGHT} * ent AS final FROM scored),
results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, round(rrf, 9) DESC, id) AS rank FROM finals) WHERE rank <= 5)"""

RETRIEVED = f"""
{DOCS}, {GRAPH},
picked AS (
    SELECT id AS qid, unnest([1, 2, 3, 4, 5, 6]) AS rank, unnest([id % n, (id * 7 + 1) % n, (((id * 7 + 1) % n) * 7 + 1) % n, (((((id * 7 + 1) % n) * 7 + 1) % n) * 7 + 1) % n, (id + 20) % n, (id + 3) % n]) AS doc
    FROM docs, size),
retrieved AS (SELECT qid, rank, docs.* FROM picked JOIN docs ON docs.id = picked.doc)"""

#: From ``retrieved`` and ``edges`` to ``paths`` and the first edge of each pair.
WALK = """
starts AS (SELECT qid, qualified_name AS name, min(rank) AS rank FROM retrieved GROUP BY ALL),
allowed AS (SELECT qid, list(name) AS names FROM starts GROUP BY qid),
calls AS (SELECT source, list(target ORDER BY ord) AS targets FROM edges WHERE type = 'CALLS' GROUP BY source),
grown AS (
    WITH RECURSIVE walk AS (
        SELECT qid, rank, [name] AS path, 1 AS size, true AS alive FROM starts
        UNION ALL
        SELECT w.qid, w.rank, CASE WHEN len(nxt) > 0 THEN list_append(path, nxt[1]) ELSE path END, size + 1, len(nxt) > 0
        FROM (SELECT w.*, coalesce(list_filter(c.targets, lambda x: NOT list_contains(w.path, x) AND list_contains(a.names, x)), []) AS nxt
              FROM walk w JOIN allowed a USING (qid) LEFT JOIN calls c ON c.source = w.path[-1] WHERE w.alive AND w.size < 8) w)
    SELECT qid, rank, arg_max(path, size) AS path FROM walk GROUP BY ALL),
distinctpaths AS (SELECT qid, path, min(rank) AS start, 15 * len(path) AS score FROM grown GROUP BY ALL),
paths AS (SELECT * FROM (SELECT qid, path, score::BIGINT AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, start) AS rank FROM distinctpaths) WHERE rank <= 5),
firsts AS (SELECT source, target, arg_min(type, ord) AS type, min(ord) AS ord, arg_min(line, ord) AS line FROM edges GROUP BY ALL)"""

PATHS = f"{RETRIEVED},{WALK}"
#: The same after a search.
SEARCHED = f"{RANKED}, retrieved AS (SELECT qid, rank, docs.* FROM results JOIN docs USING (id)),{WALK}"


def _line(kind: str, source: str, target: str) -> str:
    said = f"CASE {kind} WHEN 'CALLS' THEN ' calls ' WHEN 'INHERITS' THEN ' inherits from ' WHEN 'INHERITS_METHOD' THEN ' inherits the method ' WHEN 'IMPORTS' THEN ' imports ' END"
    return f"CASE WHEN {kind} = 'DEFINES' THEN '' ELSE '`' || {source} || '`' || {said} || '`' || {target} || '`' END"


_OPERATION = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, {_text(t)}) THEN {_text(p)} END" for t, p in config.OPERATIONS) + "], lambda x: x IS NOT NULL), ' and ')"
_LAST = "string_split({0}, '.')[-1]"
EVAL = f"""
{DOCS}, {ASKED}, {_bm25('asked', 10)},
cases AS (SELECT id AS qid, qualified_name AS expected FROM docs WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) AND id IN (SELECT qid FROM asked)),
ranked AS (SELECT qid, rank, qualified_name AS name FROM bm25 JOIN docs USING (id))"""

ENRICHED = f"""
{RETRIEVED},
rich AS (SELECT *, contains(text, 'tion') AND id % 3 = 0 AS abstract FROM retrieved),
tops AS (SELECT qid, qualified_name AS top, abstract AS top_abstract FROM rich WHERE rank = 1),
aims AS (SELECT top AS source, target, min(ord) AS ord FROM (SELECT DISTINCT top FROM tops) JOIN edges ON source = top WHERE type = 'INHERITS_METHOD' GROUP BY ALL)"""

ORACLES = {
    "q01_scan_project": f"WITH {DOCS} SELECT id, type, md5({LEXICAL}) AS digest FROM docs",
    "q02_defines": f"WITH {CLASSES} SELECT split_part(m.name, '.', 1) AS source, m.name AS target, 'DEFINES' AS type, m.line::INTEGER AS line FROM syms m WHERE m.type = 'method' AND split_part(m.name, '.', 1) IN (SELECT name FROM syms WHERE type = 'class')",
    "q03_inherits": f"WITH {CLASSES} SELECT name AS source, unnest(bases) AS target, 'INHERITS' AS type, line::INTEGER AS line FROM syms WHERE type = 'class'",
    "q04_inherits_method": """
        WITH known AS (SELECT DISTINCT 'N' || c_nationkey || '.' || lower(c_mktsegment) AS name FROM customer WHERE c_acctbal > 9500)
        SELECT 'C' || c_custkey || '.' || lower(c_mktsegment) AS source, name AS target, 'INHERITS_METHOD' AS type, c_custkey::INTEGER AS line
        FROM customer JOIN known ON name = 'N' || c_nationkey || '.' || lower(c_mktsegment)""",
    "q05_resolve_imports": """
        WITH files AS (SELECT DISTINCT source || '/' || lang || '/m' || (doc_id % 50) || '.py' AS file FROM documents UNION SELECT source || '/' || lang || '/__init__.py' FROM documents),
        found AS (
            SELECT source || '/' || lang || '/m' || (doc_id % 50) || '.py' AS file, doc_id % 4 AS level, doc_id::INTEGER AS line,
                   CASE doc_id % 3 WHEN 0 THEN 'm' || (doc_id % 70) WHEN 1 THEN lang ELSE 'm' || (doc_id % 60) END AS below FROM documents),
        stems AS (SELECT *, string_split(file, '/') AS parts FROM found WHERE level > 0 AND level <= 3),
        paths AS (SELECT *, array_to_string(list_append(parts[1:len(parts) - level], below), '/') AS stem FROM stems)
        SELECT p.file AS source, coalesce(a.file, b.file) AS target, 'IMPORTS' AS type, line
        FROM paths p LEFT JOIN files a ON a.file = stem || '.py' LEFT JOIN files b ON b.file = stem || '/__init__.py' WHERE coalesce(a.file, b.file) IS NOT NULL""",
    "q06_calls": f"""
        WITH {LOOKUP},
        seen AS (SELECT o_custkey, o_orderkey, 'm' || (o_orderkey % 5) AS method, o_orderkey % 4 AS form FROM orders WHERE o_orderkey % 4 <> 1),
        placed AS (
            SELECT s.*, CASE WHEN form = 0 THEN CASE WHEN c_acctbal > 0 THEN 'R' || (o_custkey % 5) END ELSE 'C' || o_custkey END AS class FROM seen s LEFT JOIN customer ON c_custkey = o_custkey)
        SELECT 'C' || o_custkey || '.run' AS source, target, 'CALLS' AS type, o_orderkey::INTEGER AS line FROM placed JOIN found USING (class, method)""",
    "q07_inherited_lookup": f"WITH {LOOKUP} SELECT class, method, target FROM found WHERE class LIKE 'C%'",
    "q08_graph_assembly": f"WITH {STAR} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'edges:' || type, count(*) FROM edges GROUP BY type",
    "q09_adjacency": f"WITH {STAR} SELECT source AS node, count(*) AS n, string_agg(target, ',' ORDER BY ord) AS targets FROM edges WHERE type = 'CALLS' GROUP BY source",
    "q10_undirected": f"WITH {STAR}, both_ways AS (SELECT source, target, type FROM edges UNION ALL SELECT target, source, type FROM edges) SELECT source, type, count(*) AS n, count(DISTINCT target) AS n_other FROM both_ways GROUP BY ALL",
    "q11_relationships": f"""
        WITH {STAR}, both_ways AS (SELECT target AS node, 'incoming' AS direction, * FROM edges UNION ALL SELECT source, 'outgoing', * FROM edges)
        SELECT node, row_number() OVER (PARTITION BY node ORDER BY direction, ord) AS place, direction, {_line('type', 'source', 'target')} AS said
        FROM both_ways WHERE node[1] IN ('N', 'R')""",
    "q12_tokenize": f"WITH {DOCS}, t AS (SELECT id, {_tokens(LEXICAL)} AS t FROM docs) SELECT id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM t",
    "q13_token_sets": f"""
        WITH {DOCS}, {ASKED}
        SELECT qualified_name AS key, array_to_string(list_sort({_name_tokens('qualified_name')}), ' ') AS tokens FROM docs
        UNION ALL SELECT 'q' || qid, array_to_string(list_sort({_query_tokens('query')}), ' ') FROM asked""",
    "q14_identifiers": f"WITH {MORE_SAMPLES} SELECT qid, array_to_string({_identifiers('query')}, '|') AS identifiers FROM every",
    "q15_identifier_score": f"WITH {DOCS}, {MORE_SAMPLES}, q AS (SELECT *, {_expand('query')} AS e FROM every), f AS (SELECT qid, {_identifiers('e')} AS ids FROM q) SELECT * FROM (SELECT qid, id, {_identifier_score('ids', 'qualified_name')} AS score FROM docs, f) WHERE score > 0",
    "q16_name_match": f"WITH {DOCS}, {MORE_SAMPLES}, f AS (SELECT qid, {_query_tokens('query')} AS tokens FROM every) SELECT * FROM (SELECT qid, id, round({_name_score('tokens', 'qualified_name')}, 6) AS score FROM docs, f) WHERE score > 0",
    "q17_entity": f"WITH {DOCS}, {MORE_SAMPLES}, f AS (SELECT qid, {_query_tokens('query')} AS tokens FROM every) SELECT * FROM (SELECT qid, id, {_entity_score('tokens', 'qualified_name')} AS score FROM docs, f) WHERE score > 0",
    "q18_expand": f"WITH {MORE_SAMPLES} SELECT qid, {_expand('query')} AS expanded FROM every",
    "q19_action": f"WITH {DOCS} SELECT id, array_to_string(list_filter(string_split({_LAST.format('qualified_name')}, '_'), lambda p: p <> ''), ' ') AS action, {_LAST.format('qualified_name')} AS last, split_part(qualified_name, '.', 1) AS first FROM docs",
    "q20_vector_topk": """
        WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
        dots AS (SELECT q.id AS qid, v.id, round(list_dot_product(q.e, v.e), 9) AS score FROM v q CROSS JOIN v WHERE q.id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dots)
        SELECT qid, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "q69_vector_cells": """
        WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
        dots AS (SELECT q.id AS qid, v.id, round(list_dot_product(q.e, v.e), 9) AS score FROM v q JOIN v ON q.id <> v.id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dots)
        SELECT qid, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 3""",
    "q21_bm25_topk": f"WITH {DOCS}, {ASKED}, more AS (SELECT * FROM asked UNION ALL SELECT -1, 'zzzqqq nothing' UNION ALL SELECT -2, 'the the src1'), {_bm25('more', 5)} SELECT qid, id, rank, round(score, 6) AS score FROM bm25",
    "q24_rrf": f"WITH {HYBRID} SELECT qid, id, round(rrf, 6) AS rrf_score, sources FROM fused",
    "q25_final": f"WITH {RANKED} SELECT qid, rank, id AS document_id, qualified_name, round(rrf, 6) AS rrf_score, round(ident, 6) AS identifier_score, round(nm, 6) AS name_match_score, round(ent, 6) AS entity_match_score, round(final, 6) AS final_score FROM results",
    "q26_explain": f"""
        WITH {RANKED}
        SELECT qid, rank, array_to_string(list_filter(['BM25 retrieved this result at rank ' || bm25_rank, 'Semantic retrieval found this result at rank ' || semantic_rank,
               'Code graph retrieved this result at rank ' || graph_rank, CASE WHEN ident = 1 THEN 'Exact identifier match detected' WHEN ident > 0 THEN 'Partial identifier match detected' END],
               lambda x: x IS NOT NULL), '; ') AS explanation FROM results""",
    "q27_paths": f"WITH {PATHS} SELECT qid, rank, score, array_to_string(path, '>') AS path FROM paths",
    "q28_steps": f"""
        WITH {PATHS}, hops AS (SELECT qid, rank, unnest(range(1, len(path))) AS step, unnest(path[1:len(path) - 1]) AS source, unnest(path[2:]) AS target FROM paths)
        SELECT qid, rank, step, source, target, coalesce(type, 'UNKNOWN') AS type, line FROM hops LEFT JOIN firsts USING (source, target)""",
    "q29_context": f"""
        WITH {PATHS}, five AS (SELECT * FROM retrieved WHERE rank <= 5),
        once AS (SELECT qid, qualified_name, min(rank) AS rank, any_value(text) AS text FROM five GROUP BY ALL),
        d AS (SELECT qid, count(*) AS n_documents, md5(string_agg(text, '|' ORDER BY rank)) AS texts FROM once GROUP BY qid),
        p AS (SELECT qid, count(*) AS n_paths FROM paths GROUP BY qid),
        r AS (SELECT qid, string_agg(qualified_name, ',' ORDER BY rank) AS results FROM five GROUP BY qid)
        SELECT qid, n_documents, n_paths, results, texts FROM d JOIN p USING (qid) JOIN r USING (qid)""",
    "q30_narrate": f"""
        WITH {PATHS}, spots AS (SELECT qid, rank, path[1] AS start, unnest(range(len(path))) AS pos, unnest(path) AS name, unnest(list_append(path[2:], NULL)) AS nxt FROM paths),
        told AS (
            SELECT s.qid, s.rank, start, pos,
                   CASE WHEN nxt IS NULL THEN CASE WHEN {_OPERATION} <> '' THEN s.name || ' ' || {_OPERATION} || '.' ELSE s.name || ' is the final implementation component in ' || file || ' at line ' || d.line || '.' END
                        WHEN f.type = 'CALLS' THEN s.name || ' directly calls ' || nxt || '.' END AS step
            FROM spots s JOIN docs d ON d.qualified_name = s.name LEFT JOIN firsts f ON f.source = s.name AND f.target = s.nxt),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY pos) AS i FROM told WHERE step IS NOT NULL)
        SELECT qid, rank, 'The repository evidence shows the implementation starting at ' || start || ':' || chr(10) || chr(10) || string_agg(i || '. ' || step, chr(10) ORDER BY i) AS text
        FROM numbered GROUP BY qid, rank, start""",
    "q31_choose": f"""
        WITH {ENRICHED}, tried AS (
            SELECT r.qid, r.rank, r.qualified_name, CASE WHEN top_abstract AND NOT abstract AND a.ord IS NOT NULL THEN 0
                   WHEN top_abstract AND NOT abstract AND rank > 1 AND {_LAST.format('r.qualified_name')} = {_LAST.format('top')} THEN 1 WHEN rank = 1 THEN 2 END AS level, a.ord
            FROM rich r JOIN tops USING (qid) LEFT JOIN aims a ON a.source = top AND a.target = r.qualified_name),
        best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY level, CASE WHEN level = 0 THEN ord END, rank) AS place FROM tried WHERE level IS NOT NULL)
        SELECT qid, rank::BIGINT AS rank, qualified_name FROM best WHERE place = 1""",
    "q32_related": f"""
        WITH {ENRICHED}, tried AS (
            SELECT r.qid, r.rank, r.qualified_name, a.ord, row_number() OVER (PARTITION BY r.qid, r.qualified_name ORDER BY rank) = 1 AND a.ord IS NOT NULL AS lead,
                   r.qualified_name <> top AND {_LAST.format('r.qualified_name')} = {_LAST.format('top')} AS alike
            FROM rich r JOIN tops USING (qid) LEFT JOIN aims a ON a.source = top AND a.target = r.qualified_name),
        placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lead DESC, CASE WHEN lead THEN ord ELSE 0 END, rank) AS place FROM tried WHERE lead OR alike),
        told AS (
            SELECT top, 0 AS k, ord, '`' || top || '` inherits its method implementation from `' || target || '`.' AS said FROM (SELECT DISTINCT top FROM tops) JOIN aims ON source = top
            UNION ALL SELECT top, 1, ord, '`' || top || '` inherits from `' || target || '`.' FROM (SELECT DISTINCT top FROM tops) JOIN edges ON source = top WHERE type = 'INHERITS'),
        said AS (SELECT qid, string_agg(said, ' ' ORDER BY k, ord) AS structure FROM tops LEFT JOIN told USING (top) GROUP BY qid),
        peers AS (SELECT r.qid, string_agg(r.qualified_name, ', ' ORDER BY rank) AS names FROM rich r JOIN tops USING (qid) WHERE r.qualified_name <> top AND {_LAST.format('r.qualified_name')} = {_LAST.format('top')} GROUP BY r.qid)
        SELECT qid, place, qualified_name, concat_ws(' ', structure, 'Related implementations of `' || {_LAST.format('top')} || '` were retrieved: ' || top || ', ' || names || '.') AS structure
        FROM placed JOIN tops USING (qid) JOIN said USING (qid) LEFT JOIN peers USING (qid) WHERE place <= 5""",
    "q33_listing": f"WITH {RETRIEVED}, wanted AS (SELECT DISTINCT qualified_name AS node FROM retrieved) SELECT DISTINCT source, type, target FROM edges WHERE source IN (SELECT node FROM wanted) OR target IN (SELECT node FROM wanted)",
    "q34_histogram": "SELECT source AS folder, count(*) AS n FROM documents GROUP BY source",
    "q35_eval": f"""
        WITH {EVAL}, firsthit AS (SELECT qid, min(rank) AS rank FROM ranked JOIN cases USING (qid) WHERE name = expected AND rank <= 5 GROUP BY qid)
        SELECT count(*) AS n_cases, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM cases LEFT JOIN firsthit USING (qid)""",
    "q36_diagnose": f"WITH {EVAL} SELECT qid, rank, name, name = expected AS is_expected FROM ranked JOIN cases USING (qid)",
}

_SEEDS = f"""
{STAR},
seeds AS (
    SELECT n_nationkey::BIGINT AS qid, 'N' || n_nationkey AS name FROM nation UNION ALL SELECT n_nationkey, 'S' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'nowhere' FROM nation),
half AS (SELECT source, target, {_weight('type')} AS w FROM edges WHERE type <> 'DEFINES' AND source <> target UNION ALL SELECT target, source, {_weight('type')} FROM edges WHERE type <> 'DEFINES' AND source <> target),
front0 AS (SELECT DISTINCT qid, name FROM seeds WHERE name IN (SELECT qualified_name FROM nodes)),
step0 AS (SELECT qid, target AS name, w FROM front0 JOIN half ON name = source),
front1 AS (SELECT DISTINCT qid, name FROM step0 EXCEPT SELECT * FROM front0),
step1 AS (SELECT qid, target AS name, w / 2 AS w FROM front1 JOIN half ON name = source),
near AS (SELECT qid, name, sum(w) AS score FROM (SELECT * FROM step0 UNION ALL SELECT * FROM step1) GROUP BY ALL)"""
ORACLES["q22_graph_scores"] = f"WITH {_SEEDS} SELECT qid, name, round(score, 6) AS score FROM near"
ORACLES["q23_graph_topk"] = f"""
    WITH {_SEEDS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name) AS place FROM near) WHERE place <= {CANDIDATES})
    SELECT qid, qualified_name, type, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM best JOIN nodes ON name = qualified_name"""
