"""Golden fixtures: a small source tree, a graph, scalars, fusion and paths."""

import random
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.engine import CodeIndex, Settings
from quarryline.functions import text as T
from quarryline.operators import answers, context, edges, evaluation, fusion, lexical, paths, providers, proximity, vectors
from quarryline.plans.pyast import code_features, parse_code, parse_sources
from quarryline.sources import files

TREE = {
    "__init__.py": "from .core import Base, run\n",
    "sub/__init__.py": "",
    "util.py": "def helper_fn():\n    return 1\n",
    "sub/tool.py": "from .. import util\nfrom ..core import Child\n",
    "broken.py": "def (:\n",
    "core.py": """import os
from . import util
from .sub import tool
from .missing import x


class Base(Generic[T], ext.Mixin):
    @deco("a")
    def go(self):
        return self.step()

    def step(self):
        raise NotImplementedError


class Child(Base):
    def step(self):
        def inner():
            self.go()
        inner()
        self.ctx.go(1)
        return self.step

    async def wait(self):
        return f().g()


def run(n):
    return Child().step()


if True:
    def hidden():
        pass

run(1)
""",
}


@pytest.fixture(scope="session")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text)
    (folder / ".git").mkdir()
    (folder / ".git/config").write_text("x")
    return str(folder)


@pytest.fixture(scope="session")
def parsed(spark, root):
    return parse_sources(files.read_sources(spark, root))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scan_prunes_folders_and_reads_relative_paths(spark, root):
    assert {r.file for r in files.scan_tree(spark, root).collect()} == set(TREE)
    assert {r.file: r.text for r in files.read_sources(spark, root).collect()} == TREE


def test_symbols_and_their_text(parsed):
    found = edges.symbols(parsed)
    assert rows(found, "qualified_name", "type", "line", "end_line") == sorted(
        [("Base", "class", 7, 13), ("Base.go", "method", 9, 10), ("Base.step", "method", 12, 13), ("Child", "class", 16, 25), ("Child.step", "method", 17, 22), ("Child.wait", "method", 24, 25), ("run", "function", 28, 29), ("helper_fn", "function", 1, 2)]
    )
    assert found.where("qualified_name = 'Base.go'").first().text == "    def go(self):\n        return self.step()"
    assert [r.file for r in parsed.where("error is not null").collect()] == ["broken.py"]


def test_document_ids_follow_file_line_and_name(parsed):
    docs = edges.documents(edges.symbols(parsed))
    assert [r.qualified_name for r in docs.orderBy("id").collect()] == ["Base", "Base.go", "Base.step", "Child", "Child.step", "Child.wait", "run", "helper_fn"]
    assert sorted(r.id for r in docs.collect()) == list(range(8))


def test_imports_and_their_edges(parsed):
    assert [tuple(r) for r in edges.imports(parsed).where("file = 'core.py'").orderBy("line").select("module", "name", "level", "line").collect()] == [("os", None, 0, 1), ("", "util", 1, 2), ("sub", "tool", 1, 3), ("missing", "x", 1, 4)]
    found = edges.resolve_imports(edges.imports(parsed), parsed)
    assert rows(found, "source", "target", "line") == sorted([("__init__.py", "core.py", 1)] * 2 + [("core.py", "util.py", 2), ("core.py", "sub/__init__.py", 3), ("sub/tool.py", "util.py", 1), ("sub/tool.py", "core.py", 2)])


def test_calls_belong_to_the_outermost_function(parsed):
    every = [("Base.go", "deco", 8), ("Base.go", "self.step", 10), ("Child.step", "self.go", 19), ("Child.step", "inner", 20), ("Child.step", "self.ctx.go", 21), ("Child.wait", "f", 25), ("Child.wait", "g", 25), ("run", "Child", 29), ("run", "step", 29), ("<module>", "run", 36)]
    assert rows(edges.raw_calls(parsed), "caller", "callee", "line") == sorted(every)
    assert rows(edges.raw_calls(parsed, False), "caller", "callee", "line") == sorted(every[:-1])
    assert {r.owner: r.calls for r in edges.call_lists(parsed).collect()}["Child.wait"] == ["f().g", "f"]


def test_graph(parsed):
    nodes, graph = edges.build_graph(parsed, [("Child", "ctx", "Base")])
    kind = lambda k: rows(graph.where(F.col("type") == k), "source", "target", "line")
    assert kind("DEFINES") == [("Base", "Base.go", 9), ("Base", "Base.step", 12), ("Child", "Child.step", 17), ("Child", "Child.wait", 24)]
    assert kind("INHERITS") == [("Base", "Generic[T]", 7), ("Base", "ext.Mixin", 7), ("Child", "Base", 16)]
    assert kind("INHERITS_METHOD") == [("Child.step", "Base.step", 17)]
    assert kind("CALLS") == [("Base.go", "Base.step", 10), ("Child.step", "Base.go", 19), ("Child.step", "Base.go", 21)]
    ords = [r.ord for r in graph.orderBy("ord").collect()]
    assert ords == list(range(1, len(ords) + 1))
    assert rows(edges.counters(nodes, graph).where("what = 'nodes'"), "n") == [(8,)]


def test_lookup_searches_breadth_first_and_survives_cycles(spark):
    bases = spark.createDataFrame([("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "D", 0), ("D", "A", 0)], "class string, base string, pos int")
    names = spark.createDataFrame([("C.m",), ("D.m",), ("D.k",), ("Z.m",)], "qualified_name string")
    wanted = spark.createDataFrame([("A", "m"), ("A", "k"), ("A", "none"), ("Z", "m")], "class string, method string")
    assert rows(edges.inherited_methods(wanted, bases, names), "class", "method", "target") == [("A", "k", "D.k"), ("A", "m", "C.m"), ("Z", "m", "Z.m")]


STAR = [("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "c", "INHERITS_METHOD"), ("c", "d", "IMPORTS"), ("a", "x", "INHERITS"), ("e", "a", "DEFINES"), ("b", "b", "CALLS"), ("d", "a", "CALLS")]


@pytest.mark.parametrize(
    ("seeds", "depth", "expected"),
    [
        ("a", 1, {"b": 3.0, "d": 1.5, "x": 1.0}),
        ("a", 2, {"b": 3.0, "a": 2.75, "c": 1.5, "d": 1.5, "x": 1.0}),
        ("az", 2, {"b": 3.0, "a": 2.75, "c": 1.5, "d": 1.5, "x": 1.0}),
        ("ac", 2, {"b": 5.0, "a": 2.75, "d": 2.5, "c": 1.5, "x": 1.0}),
    ],
)
def test_proximity(spark, seeds, depth, expected):
    graph = spark.createDataFrame(STAR, "source string, target string, type string")
    nodes = spark.createDataFrame([(n, "f", 1, "t") for n in "abcde"], "qualified_name string, file string, line int, type string")
    found = proximity.scores(spark.createDataFrame([(1, s) for s in seeds], "qid long, name string"), graph, nodes, depth)
    assert {r.name: r.score for r in found.collect()} == expected
    if (seeds, depth) == ("a", 2):
        assert [r.qualified_name for r in proximity.top(found, nodes, 5).orderBy("rank").collect()] == ["b", "a", "c", "d"]


def test_proximity_equals_a_queue(spark):
    rng = random.Random(5)
    kinds = ["CALLS", "INHERITS", "INHERITS_METHOD", "IMPORTS", "DEFINES"]
    weight = {"CALLS": 1.5, "INHERITS_METHOD": 2.0, "INHERITS": 1.0, "IMPORTS": 1.0}
    graph = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(kinds)) for _ in range(40)]
    known = [f"n{i}" for i in range(10)]
    near = defaultdict(list)
    for s, t, k in graph:
        if k != "DEFINES" and s != t:
            near[s].append((t, weight[k]))
            near[t].append((s, weight[k]))
    at, score, todo = {"n0": 0, "n1": 0}, Counter(), deque(["n0", "n1"])
    while todo:
        u = todo.popleft()
        if at[u] < 3:
            for v, w in near[u]:
                score[v] += w / (at[u] + 1)
                if v not in at:
                    at[v] = at[u] + 1
                    todo.append(v)
    nodes = spark.createDataFrame([(n,) for n in known], "qualified_name string")
    found = proximity.scores(spark.createDataFrame([(1, "n0"), (1, "n1")], "qid long, name string"), spark.createDataFrame(graph, "source string, target string, type string"), nodes, 3)
    assert {r.name: round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in score.items()}


def test_scalars(spark):
    assert one(spark, T.tokenize(F.lit("Save save_session __x"))) == ["save", "save_session", "save", "session", "__x", "x"]
    assert set(one(spark, T.name_tokens(F.lit("App.add_url_rule")))) == {"app", "add_url_rule", "add", "url", "rule"}
    assert one(spark, T.identifiers(F.lit("use app.run and save_x, save_x. End."))) == ["app.run", "save_x"]
    assert one(spark, T.identifiers(F.lit("foo_é"))) == one(spark, T.identifiers(F.lit("é_foo x"))) == []
    asked = T.identifiers(F.lit("save_session"))
    assert [one(spark, T.identifier_score(asked, F.lit(n))) for n in ("S.save_session", "S.save_session_now", "S.open")] == [1.0, 0.5, 0.0]
    assert one(spark, T.name_score(T.query_tokens(F.lit("how does app add rule")), T.name_tokens(F.lit("App.add_url_rule")))) == 1.0
    assert [one(spark, T.entity_score(T.query_tokens(F.lit("app run")), F.lit(n))) for n in ("App.x", "Apps.x")] == [1.0, 0.0]
    table = (("save it", ("a", "b")), ("it", ("b", "c")))
    assert one(spark, T.expand(F.lit("Save   it now"), table)) == "Save   it now a b c"
    assert one(spark, T.expand(F.lit("none"), table)) == "none"
    assert [one(spark, T.action(F.lit(n))) for n in ("C.add_url_rule", "C.__init__")] == ["add url rule", "init"]
    assert one(spark, T.operation(F.lit("x.full_dispatch_request(); raise"))) == "dispatches the request to the matched endpoint and performs the request dispatch pipeline and reraises the exception when no handler is available"
    assert one(spark, T.first_paragraph(F.lit("a\n  b\n\nc"))) == "a b"
    assert one(spark, T.first_filled(F.lit(""), F.lit("x"))) == "x"
    assert one(spark, T.relationship_type(F.lit("calls: x"))) == "CALLS"


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "qid long, id long, rank int")
    found = {r.id: r for r in fusion.fuse(ranked([1, 2]), ranked([3, 1]), ranked([2, 4])).collect()}
    assert {i: round(r.rrf_score, 6) for i, r in found.items()} == {1: 0.032522, 2: 0.021867, 3: 0.016393, 4: 0.005645}
    assert {i: r.sources for i, r in found.items()} == {1: ["bm25", "semantic"], 2: ["bm25", "graph"], 3: ["semantic"], 4: ["graph"]}


def test_paths(spark):
    hops = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "d"), ("d", "a")]
    graph = spark.createDataFrame([(s, t, "CALLS", 1, k) for k, (s, t) in enumerate(hops)], "source string, target string, type string, line int, ord long")
    found = spark.createDataFrame([(1, n, k + 1) for k, n in enumerate("abc")], "qid long, name string, rank int")
    got = paths.build_paths(found, graph)
    assert [(r.path, r.score) for r in got.orderBy("rank").collect()] == [(["b", "a", "c"], 45), (["a", "b"], 30), (["c"], 15)]
    late = spark.createDataFrame([("c", "z"), ("b", "gone")], "source string, target string")
    known = spark.createDataFrame([("z",)], "qualified_name string")
    got = paths.build_paths(found, graph, late, known)
    assert ["c", "z"] in [r.path for r in got.collect()]
    assert ("c", "z", "DEFERRED") in rows(paths.path_steps(got, graph, late), "source", "target", "type")


def test_bm25_fills_the_tail_with_zero_scores(spark):
    texts = ["alpha beta", "beta", "gamma", "delta alpha alpha", "eps", "zeta"]
    index = lexical.build_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = lexical.top(index, spark.createDataFrame([(1, "alpha"), (2, "nothing here")], "qid long, query string"), 5)
    assert [r.id for r in got.where("qid = 1").orderBy("rank").collect()] == [3, 0, 1, 2, 4]
    assert [(r.id, r.score) for r in got.where("qid = 2").orderBy("rank").collect()] == [(i, 0.0) for i in range(5)]


def test_code_features():
    got = parse_code("    def f(self):\n        '''Doc.'''\n        x, y = 1, 2\n        endpoint = g()\n        raise a.B('x')\n        return self.q()\n")
    assert got["raised"] == ["a.B"] and got["assigned"] == ["endpoint"] and "(x, y)" in got["targets"]
    assert got["returned"] == ["the result of `self.q()`"] and got["docstring"] is None
    assert not parse_code("def (")["parsed"]
    assert parse_code("class A:\n  def m(self):\n    return self.ensure_sync(f)(1)")["returned"] == ["the matched endpoint's view function's result"]


def test_behaviours(spark):
    code = "def add(self):\n    endpoint = _endpoint_from_view_func(f)\n    methods = 1\n    self.url_map.add(r)\n    self.view_functions[endpoint] = f\n"
    df = spark.createDataFrame([(code,), ("def f():\n    return 1",), ("def f():\n    raise NotImplementedError",), ("oops (",)], "code string").withColumn("x", code_features()(F.col("code")))
    got = {r.code: r.b for r in df.select("code", answers.behaviours(F.col("code"), F.col("x")).alias("b")).collect()}
    assert got[code] == ["It determines the endpoint and allowed HTTP methods.", "It creates a URL rule and adds it to the application's URL map.", "It associates the endpoint with the view function."]
    assert got["def f():\n    return 1"] == ["It returns 1."] and got["oops ("] == []
    assert got["def f():\n    raise NotImplementedError"] == ["It defines an abstract contract and raises `NotImplementedError`."]


def bag(texts):
    return np.array([[len(t) + 1, t.count("e") + 1, t.count("s") + 1] for t in texts], float)


def test_engine_end_to_end(spark, root, tmp_path):
    settings = Settings(attribute_types=(("Child", "ctx", "Base"),), deferred=(("run", "helper_fn", "run defers helper_fn."),))
    CodeIndex.from_folder(spark, root, encoder=bag, settings=settings).save(str(tmp_path / "index"))
    index = CodeIndex.load(spark, str(tmp_path / "index"), bag, settings)
    asked = spark.createDataFrame([(1, "how does Child.step go"), (2, "helper_fn")], "qid long, query string")
    found = index.search(asked)
    top = {r.qid: r for r in found.where("rank = 1").collect()}
    assert top[1].qualified_name == "Child.step" and top[2].qualified_name == "helper_fn"
    assert "Exact identifier match detected" in top[1].explanation and "bm25" in top[1].sources
    answer = {r.qid: r.answer for r in index.answer(asked, found).collect()}
    assert "The key implementation is `Child.step`." in answer[1] and "`Child.step` calls `Base.go`" in answer[1] and answer[1].endswith("```")
    made = index.context(asked, found)
    text = {r.qid: r.text for r in context.prompt_text(made).collect()}
    assert text[1].startswith("USER QUERY:\nhow does") and "RETRIEVED CODE:" in text[1] and "--CALLS--> " in text[1]
    assert any("directly calls" in r.text for r in index.explain_paths(found).collect())
    assert {r.answer for r in index.ask(asked, " Mock ").collect()} == {providers.MockProvider().generate("")}
    cases = spark.createDataFrame([(1, "Child.step"), (2, "nowhere")], "qid long, expected string")
    ranked = found.select("qid", F.col("qualified_name").alias("name"), "rank")
    assert tuple(evaluation.metrics(cases, ranked).first()) == (2, 0.5, 0.5)
    assert evaluation.diagnose(cases, ranked).where("is_expected").count() == 1


def test_document_loader_takes_three_shapes(spark, tmp_path):
    path = tmp_path / "docs.json"
    doc = '{"id": 1, "qualified_name": "A", "text": "x"}'
    for body, expected in ((f'[{doc}, 3, {{"id": 2}}]', {"A": "x"}), (f'{{"documents": [{doc}]}}', {"A": "x"}), ('{"K": {"code": "c"}, "L": 4}', {"K": "c"})):
        path.write_text(body)
        assert {r.qualified_name: r.text for r in files.load_documents(spark, str(path)).collect()} == expected
    with pytest.raises(FileNotFoundError):
        files.load_documents(spark, str(tmp_path / "none.json"))


def test_indexes_and_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "CALLS", 1, None)], files.EDGE)
    for name in ("edges", "edges.json"):
        files.write_index(df, str(tmp_path / name))
    assert files.read_index(spark, str(tmp_path / "edges"), files.EDGE).collect() == df.collect()
    docs = spark.createDataFrame([(1, "aa"), (2, "b")], "id long, text string")
    asked = []
    encode = lambda t: (asked.append(t.count()), vectors.encode(t, bag, "digest"))[1]
    for _ in range(2):
        assert files.cached_vectors(docs, str(tmp_path / "vec"), encode).count() == 2
    assert asked == [2, 0]


def test_providers():
    with pytest.raises(ValueError, match="Unknown provider"):
        providers.get_provider("other")
    with pytest.raises(ValueError, match="is not set"):
        providers.HostedProvider("NO_SUCH_KEY_HERE", "m", lambda k, m, p: p)
    with pytest.raises(RuntimeError):
        providers.LocalProvider("http://127.0.0.1:9", timeout=1).generate("x")


def test_choice_prefers_concrete_targets(spark):
    edge = [("A.m", "C.m", "INHERITS_METHOD", 1, "outgoing")]
    kind = "qid long, rank int, qualified_name string, file string, line int, abstract boolean, relationships array<struct<source:string,target:string,type:string,line:int,direction:string>>"
    df = spark.createDataFrame([(1, 1, "A.m", "f", 1, True, edge), (1, 2, "B.m", "f", 2, False, []), (1, 3, "C.m", "f", 3, False, []), (2, 1, "A.m", "f", 1, False, edge), (2, 2, "B.m", "f", 2, False, [])], kind)
    assert rows(answers.choose(df), "qid", "rank") == [(1, 3), (2, 1)]
    first = df.where("rank = 1")
    assert rows(answers.related(df, first).where("qid = 1"), "place", "qualified_name") == [(1, "C.m"), (2, "B.m")]
    assert answers.structure(df, first).where("qid = 2").first().structure == ["`A.m` inherits its method implementation from `C.m`.", "Related implementations of `m` were retrieved: A.m, B.m."]


def test_files_can_be_streamed(spark, root, tmp_path):
    from quarryline.streaming.feed import feed_symbols

    files.read_sources(spark, root).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, text string").parquet(str(tmp_path / "in"))
    feed_symbols(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
