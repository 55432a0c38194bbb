"""Files parsed by all cores, whatever table they come from, and the parser against the plain walks of ``ast``."""

import ast
import inspect
import re

import pytest
from pyspark.sql import functions as F

from quarryline import catalogue_code
from quarryline.operators import edges, lexical
from quarryline.plans import pyast
from quarryline.runtime import made, written


def test_a_small_table_of_files_is_parsed_by_many_tasks(spark, tmp_path):
    spark.range(400).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit("def f():\n    g()\n").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/one")
    parsed = pyast.parse_sources(spark.read.parquet(f"{tmp_path}/one"), ("calls",))
    assert parsed.columns == ["file", "error", "calls"] and parsed.count() == 400
    assert len(parsed.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_the_parser_gives_what_plain_walks_give():
    nested = "class A:\n    def m(self, x=f(1)):\n        def n():\n            import q.r\n            return a.b(c)(d)[e(g())].h()\n        return n()\n    class B:\n        def o(self): self.p.q(r())\nif s():\n    from . import t\n    async def u(): await v(w())\n"
    for text in (nested, *(inspect.getsource(m) for m in (ast, pyast, catalogue_code))):
        tree, got = ast.parse(text), pyast.parse_file("f", text)
        walked = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
        assert [(i["name"] if isinstance(n, ast.ImportFrom) else i["module"], i["line"]) for n, i in zip([n for n in walked for _ in n.names], got["imports"], strict=True)] == [(a.name, n.lineno) for n in walked for a in n.names]
        owners = [(n.name, n) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        owners += [(f"{c.name}.{n.name}", n) for c in tree.body if isinstance(c, ast.ClassDef) for n in c.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        assert [(c["owner"], c["call"], c["line"]) for c in got["flat_calls"]] == [(o, ast.unparse(n.func), n.lineno) for o, f in owners for n in ast.walk(f) if isinstance(n, ast.Call)]
        assert [(c["callee"], c["line"]) for c in got["calls"]] == [(pyast.dotted(n.func), n.lineno) for n in _in_source_order(tree) if isinstance(n, ast.Call) and pyast.dotted(n.func)]
        places = [{id(n): i for i, n in enumerate(_in_source_order(f))}[id(c)] for _, f in owners for c in ast.walk(f) if isinstance(c, ast.Call)]
        assert [c["place"] for c in got["flat_calls"]] == places


def test_repetitive_rows_are_not_broadcast(spark):
    rows = written(spark.range(30_000).select("id", F.repeat(F.lit("x"), 10_000).alias("text")), "repetitive")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    asked = spark.range(60_000)
    assert "Broadcast" not in plan(asked.join(rows.withColumn("more", F.length("text")), "id"))
    assert "Broadcast" not in plan(rows.join(rows.groupBy("id").agg(F.max("text").alias("m")), "id"))
    assert "BroadcastHashJoin" in plan(asked.join(F.broadcast(rows), "id"))  # where the caller says so
    assert "BroadcastHashJoin" in plan(asked.join(written(spark.range(10), "few"), "id"))


def test_bounds_of_blocks_are_only_made_for_searches_that_use_them(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(40)], "id long, text string")
    before = made()
    index = lexical.build_index(docs)
    assert lexical.top(index, docs.limit(1).select(F.col("id").alias("qid"), F.lit("word3").alias("query")), 3).count() == 3
    assert not [p for p in made()[len(before) :] if "/blocks-" in p] and index.blocks.count() > 0


def _in_source_order(node):
    yield node
    for child in ast.iter_child_nodes(node):
        yield from _in_source_order(child)


def test_a_prompt_is_made_in_its_contexts_own_row(spark):
    before = made()
    plan = catalogue_code.q56_prompt(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in made()[len(before) :] if "/context-" in p]
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:", plan)) == 1  # no second reading of the texts, to be joined


def test_scores_of_all_queries_and_documents_do_not_become_rows(spark, monkeypatch):
    docs = spark.range(300).select("id", F.concat(F.lit("common word"), (F.col("id") % 7).cast("string"), F.lit(" x"), F.repeat(F.lit(" common"), (F.col("id") % 5).cast("int"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(300, None), (301, "  ")], "id long, text string"))
    asked = spark.range(40).select(F.col("id").alias("qid"), F.concat(F.lit("common common x word"), (F.col("id") % 9).cast("string")).alias("query"))
    rows = lambda found: sorted((r.qid, r.id, round(r.score, 9), r["rank"]) for r in found.collect())
    index = lexical.build_index(docs)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and index.corpus.first().n_docs == 302
    got = lexical.top(index, asked, 5)
    assert not re.search(r"keys=\[qid#\d+L?, id#\d+L?\], functions=\[(partial_)?sum", got._jdf.queryExecution().executedPlan().toString())
    small = rows(got)
    monkeypatch.setattr(lexical, "AT_ONCE", 50)
    assert rows(lexical.top(index, asked, 5)) == small
    counted = lexical.build_index(docs)
    assert sorted(counted.postings.collect()) == sorted(index.postings.collect()) and counted.corpus.first() == index.corpus.first()
    monkeypatch.setattr(lexical, "_numbered", lambda *_: False)
    assert rows(lexical.top(index, asked, 5)) == small
    twice = docs.unionByName(docs.where("id < 3"))
    assert lexical.build_index(twice).corpus.first().n_docs == 302  # rows with one id and length are one document


def test_calls_are_found_without_writing_source(monkeypatch):
    text = "class A:\n    def go(self):\n        return self.step(x.y, f(z)).finish(k=1)[0].end()\ng(h(1))\n"
    expressions = ["a.b(c)(d.e, f(g))", "f(a, *b)", "f(x=1).y", "f(1).g", "f((a, b))", "(a + b).c()", "f()()", "f(lambda: 0)", "a[0].b()", "(yield_ or a)()"]
    assert [pyast.source_of(ast.parse(e).body[0].value) for e in expressions] == [ast.unparse(ast.parse(e).body[0].value) for e in expressions]
    whole = pyast.parse_file("f", text)
    assert [c["call"] for c in whole["flat_calls"]] == ["self.step(x.y, f(z)).finish(k=1)[0].end", "self.step(x.y, f(z)).finish", "self.step", "f"]
    monkeypatch.setattr(ast, "unparse", lambda _: 1 / 0)
    assert pyast.parse_file("f", text, ("calls",))["calls"] == whole["calls"] and len(whole["calls"]) == 6
    assert pyast.parse_file("f", "def f():\n    a(b).c(d())\n", ("flat_calls",))["flat_calls"][0]["call"] == "a(b).c"


@pytest.mark.parametrize("query", ["q37_symbols", "q42_class_bases", "q43_source_slices", "q45_parse_errors"])
def test_a_query_that_reads_the_parsed_files_once_neither_shuffles_nor_writes_their_texts(spark, query):
    before = made()
    plan = getattr(catalogue_code, query)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in made()[len(before) :] if "/parsed-" in p]
    assert "MapInArrow" in plan and re.findall(r"Exchange (\w+\(\w+)", plan) == ["hashpartitioning(c_custkey"]


def test_symbols_have_the_fields_that_are_asked_for(spark):
    text = "class A(b.C, D[int]):\r\n    def m(self):\r\n        pass\r\ndef f(): g()\r\n"
    whole = pyast.parse_file("f", text, ("symbols",))["symbols"]
    assert [s["bases"] for s in whole] == [["b.C", "D[int]"], [], []] and whole[1]["text"] == "    def m(self):\n        pass"
    for fields in (("name", "text"), ("bases", "line"), ("line",)):
        assert [{f: s[f] for f in fields} for s in pyast.parse_file("f", text, ("symbols",), fields)["symbols"]] == [{f: s[f] for f in fields} for s in whole]
    files = spark.createDataFrame([("f", text), ("bad", "def ("), ("none", None)], "file string, text string")
    some = pyast.parse_sources(files, ("symbols",), ("type", "bases"), once=True)
    assert {r.file: (r.error is None, len(r.symbols)) for r in some.collect()} == {"f": (True, 3), "bad": (False, 0), "none": (True, 0)}
    rows = edges.symbols(some)
    assert rows.columns == ["type", "file", "bases"]
    assert sorted(map(tuple, rows.collect())) == [("class", "f", ["b.C", "D[int]"]), ("function", "f", []), ("method", "f", [])]


def test_the_symbol_report_has_only_written_what_it_reads(spark):
    before = made()
    catalogue_code.q65_symbol_report(spark, "/root/testdata/sf0.001")
    (path,) = [p for p in made()[len(before) :] if "/parsed-" in p]
    assert spark.read.parquet(path).schema["symbols"].dataType.elementType.names == ["qualified_name", "type", "line"]
