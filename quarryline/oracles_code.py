"""DuckDB SQL for the queries on source code. The files are templates, so every line and name is known."""

from __future__ import annotations

from quarryline import config
from quarryline.operators.answers import NO_RESULT
from quarryline.operators.providers import BLANK_QUESTION, MockProvider
from quarryline.operators.reports import RULE
from quarryline.oracles import ASKED, DOCS, PATHS, SEARCHED, _text

#: The files: key, nation, segment, blank lines before the class, and whether the file parses.
SRC = """
src AS (SELECT 'src/c' || c_custkey || '.py' AS file, c_custkey AS k, c_nationkey AS n, lower(c_mktsegment) AS s, (c_custkey % 4)::INTEGER AS o, c_custkey % 2 = 0 AS even, c_custkey % 10 = 3 AS broken FROM customer),
good AS (SELECT *, CASE WHEN even THEN 'errors.Missing' ELSE 'NotImplementedError' END AS err FROM src WHERE NOT broken)"""


def _lines(*lines: str) -> str:
    """SQL for a text of lines; @k, @n, @s and @error stand for columns."""
    marks = {"@k": "k", "@n": "n", "@s": "s", "@error": "CASE WHEN even THEN 'errors.Missing(\"' || k || '\")' ELSE 'NotImplementedError' END"}
    out = _text("\n".join(lines))
    for mark, value in marks.items():
        out = f"replace({out}, {_text(mark)}, ({value})::VARCHAR)"
    return out


_GO = ("    def go(self, x=@k):", "        total = self.step(x)", "        self.ctx.total = helper(total)", "        return self.step(total).finish()")
_STEP = ("    async def step(self):", "        raise @error")
_CLASS = ("class C@k(Base@n, ext.Mixin):", '    """Class C@k of @s.', "", "    Second paragraph.", '    """', '    @deco("@s")', *_GO, "", *_STEP)
_MAKE = ("def make_@s(n):", "    def inner():", "        return C@k()", "    return inner().go(n)")
_HEAD = ("import os, sys as system", "from . import util", "from ..pkg@n import Base@n as B, helper")
_TAIL = ("if True:", "    def hidden():", "        pass", "make_@s(@k)")
_WHOLE = f"{_lines(*_HEAD, '')} || repeat(chr(10), o) || chr(10) || {_lines(*_CLASS, '', *_MAKE, '', *_TAIL, '')} || CASE WHEN broken THEN 'def (' || chr(10) ELSE '' END"

SYMS = f"""
{SRC},
syms AS (
    SELECT file, k, n, s, o, even, err, 'class' AS type, 'C' || k AS name, 'C' || k AS qualified_name, 5 + o AS line, 17 + o AS end_line, {_lines(*_CLASS)} AS text FROM good
    UNION ALL SELECT file, k, n, s, o, even, err, 'method', 'go', 'C' || k || '.go', 11 + o, 14 + o, {_lines(*_GO)} FROM good
    UNION ALL SELECT file, k, n, s, o, even, err, 'method', 'step', 'C' || k || '.step', 16 + o, 17 + o, {_lines(*_STEP)} FROM good
    UNION ALL SELECT file, k, n, s, o, even, err, 'function', 'make_' || s, 'make_' || s, 19 + o, 22 + o, {_lines(*_MAKE)} FROM good)"""

CALLS = f"""
{SRC},
raw AS (
    SELECT file, 'C' || k || '.go' AS caller, unnest(['deco', 'self.step', 'helper', 'finish', 'self.step']) AS callee, unnest([10, 12, 13, 14, 14]) + o AS line FROM good
    UNION ALL SELECT file, 'C' || k || '.step', err, 17 + o FROM good WHERE even
    UNION ALL SELECT file, 'make_' || s, unnest(['C' || k, 'inner', 'go']), unnest([21, 22, 22]) + o FROM good
    UNION ALL SELECT file, '<module>', 'make_' || s, 27 + o FROM good)"""


def _said(start: str) -> str:
    """The one sentence of the rules that begins like this."""
    (found,) = [_text(r[5]) for r in config.RULES if r[5].startswith(start)]
    return found


def _bit(i: int) -> str:
    return f"(id & {1 << i}) > 0"


#: Sentences on a part's code, in the order of the rules.
SAID = f"""
parts AS (SELECT p_partkey AS id FROM part),
fired AS (
    SELECT id, list_filter([
        CASE WHEN {_bit(3)} AND {_bit(4)} THEN {_said('It determines the endpoint and')} WHEN {_bit(3)} THEN {_said('It determines the endpoint used')} WHEN {_bit(4)} THEN {_said('It determines the allowed')} END,
        CASE WHEN {_bit(0)} THEN {_said('It creates a URL rule and')} WHEN {_bit(1)} THEN {_said('It creates a URL rule for')} END,
        CASE WHEN {_bit(2)} THEN {_said('It associates')} END, CASE WHEN {_bit(6)} THEN {_said('It looks up')} END, CASE WHEN {_bit(5)} THEN {_said('It logs')} END], lambda x: x IS NOT NULL) AS own FROM parts),
said AS (
    SELECT id, list_concat(CASE WHEN len(own) > 0 THEN own WHEN id % 16 <> 0 THEN ['It returns `self.done`.'] ELSE [] END, CASE WHEN id % 16 = 0 THEN [{_text(config.ABSTRACT_SENTENCE)}] ELSE [] END) AS said FROM fired)"""

def _contexts(paths: str, questions: str) -> str:
    """Whole contexts as text, and their paths; ``questions`` selects (qid, query)."""
    return f"""
{paths},
five AS (SELECT * FROM retrieved WHERE rank <= 5),
wondered AS ({questions}),
once AS (SELECT qid, qualified_name, any_value(file) AS file, any_value(text) AS text, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS i FROM five GROUP BY qid, qualified_name),
shown AS (SELECT qid, string_agg(chr(10) || '[' || i || '] ' || qualified_name || chr(10) || 'File: ' || file || chr(10) || chr(10) || text, chr(10) ORDER BY i) AS code FROM once GROUP BY qid),
hops AS (SELECT qid, rank, unnest(range(1, len(path))) AS step, unnest(path[1:len(path) - 1]) AS source, unnest(path[2:]) AS target FROM paths),
told AS (SELECT qid, rank, string_agg(chr(10) || '- ' || source || ' --' || coalesce(type, 'UNKNOWN') || '--> ' || target, '' ORDER BY step) AS steps FROM hops LEFT JOIN firsts USING (source, target) GROUP BY ALL),
walked AS (
    SELECT qid, string_agg(chr(10) || 'Path ' || rank || ':' || chr(10) || array_to_string(path, ' -> ') || coalesce(steps, ''), chr(10) ORDER BY rank) AS walks, string_agg(array_to_string(path, ' -> '), chr(10) ORDER BY rank) AS lines,
           string_agg(rank || '. ' || array_to_string(path, ' -> '), chr(10) ORDER BY rank) AS numbered FROM paths LEFT JOIN told USING (qid, rank) GROUP BY qid),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM five),
listed AS (SELECT qid, string_agg(i || '. ' || qualified_name, chr(10) ORDER BY i) AS found FROM placed GROUP BY qid),
contexts AS (
    SELECT qid, query, lines, numbered, found, concat_ws(chr(10), CASE WHEN query <> '' THEN 'USER QUERY:' || chr(10) || query END, chr(10) || 'RETRIEVED CODE:', code, chr(10) || 'IMPLEMENTATION PATHS:', walks, chr(10) || 'RETRIEVAL EVIDENCE:', found) AS text
    FROM wondered JOIN shown USING (qid) JOIN walked USING (qid) JOIN listed USING (qid))"""


CONTEXTS = _contexts(PATHS, "SELECT id AS qid, CASE WHEN id % 9 > 0 THEN 'question ' || id ELSE '' END AS query FROM docs")
FOUND_CONTEXTS = _contexts(SEARCHED, "SELECT qid, query FROM asked")

_COUNTS = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS c{i}" for i, c in enumerate("etao"))
ENCODED = f"counted AS (SELECT doc_id AS id, text, {_COUNTS} FROM documents), encoded AS (SELECT *, greatest(sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3 + 1), 1e-12) AS size FROM counted)"


def _some(n: int, value: str) -> str:
    return f"CASE c_custkey % {n} WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE {value} END"

#: The documents as files of a tree.
TREE = """
    SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') || '/' || CASE WHEN doc_id % 7 = 6 THEN '.git' ELSE coalesce(lang, 'none') END || '/'
           || CASE WHEN doc_id % 7 = 0 THEN 'd' || doc_id || '/__init__.py' WHEN doc_id % 7 = 5 THEN 'm' || doc_id || '.txt' ELSE 'm' || doc_id || '.py' END AS file FROM documents"""

ORACLES = {
    "q37_symbols": f"WITH {SYMS} SELECT file, name, qualified_name, type, line, end_line FROM syms",
    "q38_imports": f"WITH {SRC} SELECT file, unnest(['os', 'sys', '', 'pkg' || n, 'pkg' || n]) AS module, unnest([NULL, NULL, 'util', 'Base' || n, 'helper']) AS name, unnest([0, 0, 1, 2, 2]) AS level, unnest([1, 1, 2, 3, 3]) AS line FROM good",
    "q39_raw_calls": f"WITH {CALLS} SELECT * FROM raw",
    "q40_calls_in_functions": f"WITH {CALLS} SELECT caller, count(*) AS n, max(line) AS last FROM raw WHERE caller <> '<module>' GROUP BY caller",
    "q41_call_lists": f"""
        WITH {SRC} SELECT file, 'C' || k || '.go' AS owner, 'deco, self.step, helper, self.step(total).finish, self.step' AS calls FROM good
        UNION ALL SELECT file, 'C' || k || '.step', err FROM good WHERE even UNION ALL SELECT file, 'make_' || s, 'inner().go, C' || k || ', inner' FROM good""",
    "q42_class_bases": f"WITH {SRC} SELECT 'C' || k AS class, unnest(['Base' || n, 'ext.Mixin']) AS base, unnest([0, 1])::BIGINT AS pos, 5 + o AS line, file FROM good",
    "q43_source_slices": f"WITH {SYMS} SELECT qualified_name, file, md5(text) AS digest, (end_line - line + 1)::BIGINT AS n_lines FROM syms",
    "q44_slice_without_node": f"""
        WITH {SRC}, whole AS (SELECT file, (k % 40)::INTEGER AS line, string_split({_WHOLE} || repeat('x = 1' || chr(10), 99) || 'x = 1', chr(10)) AS lines FROM src)
        SELECT file, line, md5(array_to_string(lines[line + 1:line + 80], chr(10))) AS digest FROM whole""",
    "q45_parse_errors": f"WITH {SRC} SELECT file, broken AS failed, CASE WHEN broken THEN 0 ELSE 4 END::BIGINT AS n_symbols FROM src",
    "q46_code_features": f"""
        WITH {SYMS}
        SELECT file, qualified_name, true AS parsed, CASE WHEN type = 'class' OR name = 'step' THEN err ELSE '' END AS raised,
               CASE WHEN type = 'class' THEN 'deco|self.step|helper|finish' || CASE WHEN even THEN '|' || err ELSE '' END WHEN name = 'go' THEN 'self.step|helper|finish' WHEN name = 'step' THEN CASE WHEN even THEN err ELSE '' END ELSE 'go|C' || k || '|inner' END AS calls,
               CASE WHEN type = 'class' OR name = 'go' THEN 'total' ELSE '' END AS assigned, CASE WHEN type = 'class' OR name = 'go' THEN 'total|self.ctx.total' ELSE '' END AS targets,
               CASE WHEN type = 'class' OR name = 'go' THEN 'the result of `finish()`' WHEN type = 'function' THEN 'the result of `go()`|the result of `C' || k || '()`' ELSE '' END AS returned,
               NOT even AND (type = 'class' OR name = 'step') AS abstract, name <> 'step' AS calls_helper, type = 'class' OR name = 'go' AS assigns_total, type = 'class' OR name = 'go' AS assigns_ctx, type = 'class' OR name = 'step' AS is_async
        FROM syms""",
    "q47_first_paragraph": """
        WITH p AS (SELECT p_partkey, p_partkey % 3 <> 0 AS parsed, rtrim(repeat(p_name || ' ', p_size)) || ' of ' || p_brand AS said FROM part)
        SELECT p_partkey, parsed, CASE WHEN parsed THEN CASE WHEN length(said) > 300 THEN left(said, 297) || '...' ELSE said END END AS paragraph FROM p""",
    "q48_behaviours": f"WITH {SAID} SELECT id, array_to_string(said, ' ') AS said FROM said",
    "q49_path_bullets": f"""
        WITH {SAID}, opened AS (SELECT id, CASE WHEN id % 5 = 0 THEN '`App.` contains the main implementation logic' ELSE '`App.add_rule_' || id || '` implements the `add rule ' || id || '` operation' END AS opening, said FROM said)
        SELECT id, array_to_string(list_transform(list_concat([opening], said), lambda x: '- ' || x), chr(10)) AS bullets FROM opened""",
    "q50_vector_text": f"WITH {DOCS} SELECT id, md5(concat_ws(' ', qualified_name, name, type, file, text)) AS digest FROM docs",
    "q51_encode": f"WITH {ENCODED} SELECT id, {', '.join(f'round((c{i} / size)::FLOAT::DOUBLE, 4) AS e{i}' for i in range(4))}, round((1 / size)::FLOAT::DOUBLE, 4) AS e4 FROM encoded",
    "q52_vector_cache": f"WITH {ENCODED} SELECT id, round((c0 / size)::FLOAT::DOUBLE, 4) AS e0, (SELECT count(DISTINCT text) FROM documents) AS n_cached FROM encoded",
    "q53_first_filled": f"SELECT c_custkey, coalesce({_some(3, 'c_name')}, {_some(4, 'c_mktsegment')}, {_some(5, chr(39) + 'last' + chr(39))}, '') AS code FROM customer",
    "q54_deferred_paths": f"""
        WITH {PATHS}, late AS (SELECT a.qualified_name AS source, [b.qualified_name] AS targets FROM nation JOIN docs a ON a.id = n_nationkey * 5 JOIN docs b ON b.id = n_nationkey * 5 + 3),
        longer AS (
            WITH RECURSIVE walk AS (
                SELECT qid, rank, [name] AS path, 1 AS size, true AS alive FROM starts
                UNION ALL
                SELECT w.qid, w.rank, CASE WHEN len(nxt) > 0 THEN list_append(path, nxt[1]) ELSE path END, size + 1, len(nxt) > 0
                FROM (SELECT w.*, list_concat(coalesce(list_filter(l.targets, lambda x: NOT list_contains(w.path, x)), []), coalesce(list_filter(c.targets, lambda x: NOT list_contains(w.path, x) AND list_contains(a.names, x)), [])) AS nxt
                      FROM walk w JOIN allowed a USING (qid) LEFT JOIN calls c ON c.source = w.path[-1] LEFT JOIN late l ON l.source = w.path[-1] WHERE w.alive AND w.size < 8) w)
            SELECT qid, rank, arg_max(path, size) AS path FROM walk GROUP BY ALL),
        unlike AS (SELECT l.qid, path, min(rank) AS start, 10 * len(path) + 5 * len(list_filter(path, lambda x: list_contains(any_value(names), x))) AS score FROM longer l JOIN allowed USING (qid) GROUP BY l.qid, path)
        SELECT qid, rank, score::BIGINT AS score, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, start) AS rank FROM unlike) WHERE rank <= 5""",
    "q55_prompt_context": f"WITH {CONTEXTS} SELECT qid, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM contexts",
    "q56_prompt": f"""
        WITH {CONTEXTS}
        SELECT qid, md5('Answer from the supplied repository evidence alone.' || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || query || chr(10) || chr(10) || 'IMPLEMENTATION PATH:' || chr(10) || lines || chr(10) || chr(10)
                        || 'SOURCE CODE:' || chr(10) || text || chr(10) || chr(10) || 'Give a concise factual answer. Do not speculate.' || chr(10)) AS digest FROM contexts""",
    "q57_provider_answers": f"WITH {ASKED} SELECT qid, CASE WHEN qid % 4 = 0 THEN {_text(BLANK_QUESTION)} WHEN qid % 3 = 0 THEN 'known ' || qid ELSE {_text(MockProvider().generate(''))} END AS answer FROM asked",
    "q58_answers": f"""
        WITH {SRC}, named AS (SELECT *, 'C' || k || '.step' AS own, 'Base' || n || '.step' AS inherited, chr(10) AS nl FROM src),
        keyed AS (SELECT *, CASE WHEN even THEN own ELSE inherited END AS name, CASE WHEN even THEN inherited ELSE own END AS other, {_said('It creates a URL rule and')} AS did FROM named)
        SELECT k AS qid, CASE WHEN broken THEN {_text(NO_RESULT)} ELSE concat_ws(nl,
            'Based on the retrieved repository code, the relevant implementation path for ''how does ' || s || ' step'' is:', '', 'Implementation path:', '- `' || name || '` implements the `step` operation', CASE WHEN NOT even THEN '- ' || did END,
            '', 'The key implementation is `' || name || '`.', CASE WHEN even THEN 'It is defined in `' || file || '` at line 16.' ELSE 'It is defined in `pkg' || n || '.py` at line 3.' END,
            CASE WHEN NOT even THEN nl || 'Behavior: ' || did END,
            '', 'Implementation structure:', CASE WHEN even THEN '- `' || own || '` inherits its method implementation from `' || inherited || '`.' END, '- Related implementations of `step` were retrieved: ' || name || ', ' || other || '.',
            CASE WHEN even THEN concat_ws(nl, '', 'Code graph evidence:', '- `make_' || s || '` calls `' || own || '`', '- `' || own || '` inherits the method `' || inherited || '`') END,
            '', 'Why this result was selected:', '- BM25 retrieved this result at rank 2', CASE WHEN k % 3 = 0 THEN '- SEMANTIC retrieved this result at rank 7' END, CASE WHEN k % 4 = 0 THEN '- GRAPH retrieved this result at rank 1' END,
            CASE WHEN k % 5 = 0 THEN '- Exact identifier evidence (score: 0.50)' END,
            '', 'Other relevant implementations:', CASE WHEN even THEN '- `' || inherited || '` — pkg' || n || '.py:3' ELSE '- `' || own || '` — ' || file || ':16' END,
            '', 'Primary retrieved code:', '```python', CASE WHEN even THEN '    async def step(self):' || nl || '        raise errors.Missing()' ELSE 'def step(self):' || nl || '    self.url_map.add(rule)' END, '```') END AS answer
        FROM keyed""",
    "q59_code_graph": f"""
        WITH {SRC}, links AS (
            SELECT 1 AS part, 'C' || k AS source, 'C' || k || '.' || unnest(['go', 'step']) AS target, 'DEFINES' AS type, unnest([11, 16]) + o AS line, file FROM good
            UNION ALL SELECT 2, 'C' || k, unnest(['Base' || n, 'ext.Mixin']), 'INHERITS', 5 + o, file FROM good
            UNION ALL SELECT 3, 'C' || k || '.go', 'C' || k || '.step', 'CALLS', unnest([12, 14]) + o, NULL FROM good)
        SELECT source, target, type, line, file, row_number() OVER (ORDER BY part, source, line, target) AS ord FROM links""",
    "q60_index_files": """
        SELECT 'R' || r_regionkey AS qualified_name, 'R' AS type, 'geo' AS file, r_regionkey::INTEGER AS line, true AS absent FROM region UNION ALL SELECT 'N' || n_nationkey, 'N', 'geo', n_nationkey::INTEGER, true FROM nation
        UNION ALL SELECT 'S' || s_suppkey, 'S', 'geo', s_suppkey::INTEGER, true FROM supplier UNION ALL SELECT 'C' || c_custkey, 'C', 'geo', c_custkey::INTEGER, true FROM customer""",
    "q70_reply_ledger": "SELECT conv_id * 1000 + turn AS qid, length(coalesce(text, '')) || ' characters' AS answer, (SELECT count(DISTINCT coalesce(text, '')) FROM conversations) AS n_asked FROM conversations",
    "q61_load_documents": """
        SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN 'N' || doc_id ELSE 'D' || doc_id END AS qualified_name, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS n_chars
        FROM documents WHERE doc_id % 7 <> 6 AND (doc_id % 4 > 0 OR (doc_id // 250 % 3 = 2 AND doc_id % 44 <> 0))""",
    "q62_tree_scan": f"SELECT file, strlen(text) AS size FROM ({TREE}) WHERE doc_id % 7 <> 6",
    "q63_read_sources": f"SELECT file, text FROM ({TREE}) WHERE doc_id % 7 <> 5",
    "q64_structure_report": f"""
        WITH {SRC}, t AS (SELECT *, chr(10) AS nl, chr(10) || '      → ' AS deep, chr(10) || '    → ' AS near FROM good)
        SELECT file, 'CODE STRUCTURE' || nl || nl || 'File: ' || file || nl || nl || 'CLASS: C' || k || nl || '  Inherits from: Base' || n || ', ext.Mixin'
               || nl || nl || '  METHOD: go' || nl || '    CALLS:' || deep || 'self.step' || deep || 'helper' || deep || 'self.step(total).finish' || deep || 'self.step' || deep || 'deco'
               || nl || nl || '  METHOD: step' || CASE WHEN even THEN nl || '    CALLS:' || deep || err ELSE '' END
               || nl || nl || 'FUNCTION: make_' || s || nl || '  CALLS:' || near || 'C' || k || near || 'inner().go' || near || 'inner' AS report FROM t""",
    "q65_symbol_report": f"""
        WITH {SYMS}, ranked AS (SELECT *, row_number() OVER (ORDER BY file, line, qualified_name) AS i FROM syms)
        SELECT count(*) AS n_symbols, 'Total symbols: ' || count(*) || chr(10) || chr(10) || 'First 10 symbols:' || chr(10) || chr(10) || string_agg(qualified_name || ' | ' || type || ' | ' || file || ' | line ' || line, chr(10) ORDER BY i) FILTER (i <= 10) AS report FROM ranked""",
    "q66_context_report": f"""
        WITH {CONTEXTS}, both_ways AS (SELECT target AS node, 'incoming' AS direction, * FROM edges UNION ALL SELECT source, 'outgoing', * FROM edges),
        spots AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY direction, ord) AS place FROM both_ways),
        near AS (SELECT qid, direction, spots.type, source, target, min(i * 1000000 + place) AS spot FROM placed JOIN spots ON node = qualified_name GROUP BY ALL),
        said AS (SELECT qid, string_agg(CASE WHEN direction = 'incoming' THEN target || ' <- ' || type || ' - ' || source ELSE source || ' - ' || type || ' -> ' || target END, chr(10) ORDER BY spot) AS near FROM near GROUP BY qid),
        reports AS (
            SELECT qid, concat_ws(chr(10), chr(10) || '{RULE}', 'CODEBASE CONTEXT', '{RULE}', CASE WHEN query <> '' THEN chr(10) || 'QUERY:' || chr(10) || query END, chr(10) || 'RETRIEVED RESULTS:', found,
                   chr(10) || 'IMPLEMENTATION PATHS:', numbered, chr(10) || 'GRAPH RELATIONSHIPS:', near, '{RULE}') AS report FROM contexts LEFT JOIN said USING (qid))
        SELECT qid, length(report)::BIGINT AS n_chars, md5(report) AS digest FROM reports""",
    "q67_search_paths": f"WITH {SEARCHED} SELECT qid, rank, score, array_to_string(path, '>') AS path FROM paths",
    "q68_search_context": f"WITH {FOUND_CONTEXTS} SELECT qid, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM contexts",
}
