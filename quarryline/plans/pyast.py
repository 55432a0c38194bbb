"""One parser for source text: everything the relational operators need from a syntax tree."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.runtime import spread, written

#: What a symbol can be asked for.
SYMBOL = {"name": "string", "qualified_name": "string", "type": "string", "line": "int", "end_line": "int", "text": "string", "bases": "array<string>"}


def _symbols_type(fields: Collection[str]) -> str:
    return f"array<struct<{','.join(f'{f}:{kind}' for f, kind in SYMBOL.items() if f in fields)}>>"


#: What a parsed file can be asked for.
PARTS = {
    "symbols": _symbols_type(SYMBOL),
    "imports": "array<struct<module:string,name:string,level:int,line:int>>",
    "calls": "array<struct<caller:string,callee:string,line:int>>",
    "flat_calls": "array<struct<owner:string,call:string,line:int,place:int,plain:boolean>>",
}
_TEXT, _NUMBER, _TEXTS = pa.string(), pa.int32(), pa.list_(pa.string())
_SYMBOL_ARROW = {"name": _TEXT, "qualified_name": _TEXT, "type": _TEXT, "line": _NUMBER, "end_line": _NUMBER, "text": _TEXT, "bases": _TEXTS}
#: The same for Arrow, which takes rows as they are; nested values through pandas cost more than the parser.
_ARROW = {
    "file": _TEXT,
    "error": _TEXT,
    "symbols": pa.list_(pa.struct(_SYMBOL_ARROW)),
    "imports": pa.list_(pa.struct({"module": _TEXT, "name": _TEXT, "level": _NUMBER, "line": _NUMBER})),
    "calls": pa.list_(pa.struct({"caller": _TEXT, "callee": _TEXT, "line": _NUMBER})),
    "flat_calls": pa.list_(pa.struct({"owner": _TEXT, "call": _TEXT, "line": _NUMBER, "place": _NUMBER, "plain": pa.bool_()})),
}
FILE_SCHEMA = "file string, error string, " + ", ".join(f"{k} {v}" for k, v in PARTS.items())
CODE_SCHEMA = "parsed boolean, raised array<string>, calls array<string>, assigned array<string>, targets array<string>, returned array<string>, node_types array<string>, docstring string"
_CODE_ARROW = pa.struct({"parsed": pa.bool_(), "raised": _TEXTS, "calls": _TEXTS, "assigned": _TEXTS, "targets": _TEXTS, "returned": _TEXTS, "node_types": _TEXTS, "docstring": _TEXT})
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
MODULE = "<module>"


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of an attribute chain; its base counts only if it is a name. None for other expressions."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.insert(0, node.id)
    return ".".join(names) or None


def _plain_source(node: ast.AST) -> str | None:
    """The source of names, attributes and calls of them, whose arguments are such too; None for anything else."""
    ends, inner = [], node
    while True:
        kind = type(inner)
        if kind is ast.Attribute:
            ends.append(f".{inner.attr}")
            inner = inner.value
        elif kind is ast.Call and not inner.keywords:
            given = [_plain_source(a) for a in inner.args]
            if None in given:
                return None
            ends.append(f"({', '.join(given)})")
            inner = inner.func
        else:
            return "".join([inner.id, *reversed(ends)]) if kind is ast.Name else None


def source_of(node: ast.AST) -> str:
    """What ``ast.unparse`` gives, which is slow for the names, attribute chains and calls that most are."""
    plain = _plain_source(node)
    return ast.unparse(node) if plain is None else plain


#: What has no call below it: how many nodes it is, with the context of a name. Values that are no nodes count none.
_PLAIN = {type(None): 0, str: 0, int: 0, bool: 0, ast.Name: 2} | {k: 1 for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for k in base.__subclasses__()}
_PLAIN |= {k: 1 for k in (ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal)}


def _below(node: ast.AST) -> list[ast.AST | int]:
    """The children that calls may be in or below, in order; of the nodes between them only how many there are."""
    out: list[ast.AST | int] = []
    between = 0
    for field in node._fields:
        value = getattr(node, field, None)
        for v in value if type(value) is list else (value,):
            n = _PLAIN.get(type(v))
            if n is None and type(v) is ast.Attribute:
                n, inner = 4, v.value
                while type(inner) is ast.Attribute:
                    n, inner = n + 2, inner.value
                n = n if type(inner) is ast.Name else None
            if n is not None:
                between += n
            elif isinstance(v, ast.AST):
                if between:
                    out.append(between)
                    between = 0
                out.append(v)
    if between:
        out.append(between)
    return out


def _children(node: ast.AST) -> list[ast.AST]:
    """``ast.iter_child_nodes`` as a list."""
    if type(node) is ast.Name:
        return [node.ctx]
    out: list[ast.AST] = []
    if type(node) is not ast.Constant:
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, ast.AST):
                out.append(value)
            elif isinstance(value, list):
                out += [v for v in value if isinstance(v, ast.AST)]
    return out


def _symbols(tree: ast.Module, text: str, fields: Collection[str]) -> list[dict]:
    """Texts and bases are only made where ``fields`` has them."""
    out = []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if "text" in fields else None

    def add(node, owner: str | None) -> None:
        is_class = isinstance(node, ast.ClassDef)
        row = {
            "name": node.name,
            "qualified_name": f"{owner}.{node.name}" if owner else node.name,
            "type": "class" if is_class else "method" if owner else "function",
            "line": node.lineno,
            "end_line": node.end_lineno,
        }
        if lines is not None:
            row["text"] = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        if "bases" in fields:
            row["bases"] = [source_of(b) for b in node.bases] if is_class else []
        out.append(row)

    for node in tree.body:
        if isinstance(node, (ast.ClassDef, *_DEFS)):
            add(node, None)
        if isinstance(node, ast.ClassDef):
            for child in node.body:
                if isinstance(child, _DEFS):
                    add(child, node.name)
    return out


def _imports(tree: ast.Module) -> Iterator[dict]:
    """Nearest to the surface first. No expression holds a statement, so none is entered."""
    nodes: list[ast.AST] = [tree]
    for node in nodes:
        if isinstance(node, ast.Import):
            yield from ({"module": a.name, "name": None, "level": 0, "line": node.lineno} for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from ({"module": node.module or "", "name": a.name, "level": node.level, "line": node.lineno} for a in node.names)
        nodes += [c for c in _children(node) if not isinstance(c, ast.expr)]


def _calls(tree: ast.Module, parts: Collection[str] = ("calls", "flat_calls")) -> dict[str, list[dict]]:
    """``calls`` in source order, and ``flat_calls`` of each function and method, nearest to the surface first.

    The former have the outermost function around them as caller; decorators and defaults belong to it too. Of the
    latter, ``place`` is the order in which the source has them; ``plain`` calls are those of a name or an attribute.
    """
    owners: dict[int, str] = {}
    if "flat_calls" in parts:
        owners = {id(n): n.name for n in tree.body if isinstance(n, _DEFS)}
        owners |= {id(n): f"{c.name}.{n.name}" for c in tree.body if isinstance(c, ast.ClassDef) for n in c.body if isinstance(n, _DEFS)}
    out: list[dict] = []
    flat: dict[int, list[tuple[int, int, ast.Call]]] = {k: [] for k in owners}
    todo: list = [(tree, 0, None, None, None)]
    at, start = -1, 0
    while todo:
        met = todo.pop()
        if type(met) is int:
            at += met
            continue
        node, depth, owner, caller, own = met
        at += 1
        kind = type(node)
        if kind is ast.ClassDef:
            owner = node.name
        elif kind in _DEFS:
            if caller is None:
                caller = f"{owner}.{node.name}" if owner else node.name
            if id(node) in flat:
                own, start = flat[id(node)], at
        elif kind is ast.Call:
            if callee := dotted(node.func):
                out.append({"caller": caller or MODULE, "callee": callee, "line": node.lineno})
            if own is not None:
                own.append((depth, at - start, node))
        below = _below(node)
        below.reverse()
        todo += [c if type(c) is int else (c, depth + 1, owner, caller, own) for c in below]
    # Nodes of one depth are met in source order, so depth and place make the breadth-first order.
    near = [{"owner": owners[k], "call": source_of(n.func), "line": n.lineno, "place": place, "plain": isinstance(n.func, (ast.Name, ast.Attribute))} for k, found in flat.items() for _, place, n in sorted(found, key=lambda x: x[:2])]
    return {p: found for p, found in (("calls", out), ("flat_calls", near)) if p in parts}


def parse_file(file: str, text: str | None, parts: Collection[str] = tuple(PARTS), fields: Collection[str] = tuple(SYMBOL)) -> dict:
    out: dict = {"file": file, "error": None} | {p: [] for p in parts}
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}
    if "symbols" in parts:
        out["symbols"] = _symbols(tree, text or "", fields)
    if "imports" in parts:
        out["imports"] = list(_imports(tree))
    if "calls" in parts or "flat_calls" in parts:
        out |= _calls(tree, parts)
    return out


def _return_description(value: ast.AST | None) -> str | None:
    if value is None:
        return None
    if isinstance(value, ast.Call):
        if isinstance(value.func, ast.Call) and dotted(value.func.func) in ("self.ensure_sync", "ensure_sync"):
            return "the matched endpoint's view function's result"
        name = dotted(value.func) if isinstance(value.func, (ast.Name, ast.Attribute)) else None
        return f"the result of `{name}()`" if name else "the result of a function call"
    if isinstance(value, ast.Name):
        return f"`{value.id}`"
    if isinstance(value, ast.Attribute):
        return f"`{dotted(value)}`"
    return repr(value.value) if isinstance(value, ast.Constant) else "the computed result"


def parse_code(code: str | None) -> dict:
    """Features of a snippet, which may be indented; of one that does not parse, none."""
    none = {"parsed": False, "raised": [], "calls": [], "assigned": [], "targets": [], "returned": [], "node_types": [], "docstring": None}
    try:
        tree = ast.parse(textwrap.dedent(code or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return none
    out = {k: dict.fromkeys([]) for k in ("raised", "calls", "assigned", "targets", "returned", "node_types")}
    nodes: list[ast.AST] = [tree]
    for node in nodes:
        nodes += _children(node)
        kind = type(node)
        out["node_types"][kind.__name__] = None
        if kind is ast.Name or kind is ast.Constant:
            continue
        if kind is ast.Raise and node.exc is not None:
            name = dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc)
            if name:
                out["raised"][name] = None
        elif kind is ast.Call and (name := dotted(node.func)):
            out["calls"][name] = None
        elif kind is ast.Assign:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    out["assigned"][target.id] = None
                out["targets"][source_of(target)] = None
        elif kind is ast.Return and (said := _return_description(node.value)):
            out["returned"][said] = None
    return {"parsed": True, "docstring": ast.get_docstring(tree, clean=True)} | {k: list(v) for k, v in out.items()}


#: Files whose parts a task holds at once.
PER_BATCH = 1000


def parse_sources(sources: DataFrame, parts: Collection[str] = tuple(PARTS), fields: Collection[str] = tuple(SYMBOL), dealt: bool = False, once: bool = False) -> DataFrame:
    """``FILE_SCHEMA`` of (file, text), with those of its ``PARTS`` that are asked for, and of symbols the ``fields`` that
    are: each file parsed once and written out, since many operators read it. What is read only ``once`` is not written.

    A file that does not parse has its ``error`` and nothing else; the job goes on. The files are dealt out to all cores
    first, unless they are ``dealt``: a small table of long texts, or texts made of a small table, would be read by one task.
    """
    parts, fields = tuple(p for p in PARTS if p in parts), tuple(f for f in SYMBOL if f in fields)
    arrow = {c: _ARROW[c] for c in ("file", "error", *parts)}
    types = {p: PARTS[p] for p in parts}
    if "symbols" in parts:
        arrow["symbols"], types["symbols"] = pa.list_(pa.struct({f: _SYMBOL_ARROW[f] for f in fields})), _symbols_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PER_BATCH):
                some = batch.slice(a, PER_BATCH)
                rows = [parse_file(f, t, parts, fields) for f, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(arrow))

    schema = "file string, error string" + "".join(f", {p} {kind}" for p, kind in types.items())
    texts = sources.select("file", "text")
    parsed = (texts if dealt else spread(texts, "file")).mapInArrow(run, schema)
    return parsed if once else written(parsed, "parsed")


#: Lines that stand for a symbol whose end is not known.
LINES_WITHOUT_END = 80


def source_slice(text: Column, line: Column, end_line: Column) -> Column:
    """The lines of ``text`` from ``line``, counted from 1, to ``end_line``; without an end the next 80, or what is left."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "")
    return F.array_join(F.slice(F.split(plain, "\n"), line, F.coalesce(end_line - line + 1, F.lit(LINES_WITHOUT_END))), "\n")


def code_features():
    """A column function: the features of a snippet as a struct of ``CODE_SCHEMA``."""

    def run(codes: pa.Array) -> pa.Array:
        return pa.array([parse_code(c) for c in codes.to_pylist()], _CODE_ARROW)

    # The annotations are strings in this module, and the kind of function is read from the types.
    run.__annotations__ = {"codes": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, CODE_SCHEMA)
