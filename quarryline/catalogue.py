"""The catalogue of queries over the synthetic tables, and their SQL.

The tables hold no source code, so documents stand for symbols (``source.lang_doc_n``), a star graph is made of the
sales tables, and a document graph of arithmetic on ids. The operators are the engine's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import answers, context, edges, evaluation, fusion, lexical, names, paths, proximity, vectors

CANDIDATES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adapters ------------------------------------------------------------------------------------------------


def documents(spark, sf_dir) -> DataFrame:
    name = F.concat("lang", F.lit("_doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), name.alias("name"), F.concat("source", F.lit("."), name).alias("qualified_name"), F.col("lang").alias("type"), F.concat("source", F.lit("/"), "lang").alias("file"), F.lit(1).alias("line"), "text"
    )


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def star_graph(spark, sf_dir, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    nation, region, customer, supplier, orders, items = (table(spark, sf_dir, t) for t in ("nation", "region", "customer", "supplier", "orders", "lineitem"))
    edge = lambda df, s, t, kind, line: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), line.cast("long").alias("line"))
    sold = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    parts = [
        edge(nation, _key("R", "n_regionkey"), _key("N", "n_nationkey"), "DEFINES", F.col("n_nationkey")),
        edge(customer, _key("C", "c_custkey"), _key("N", "c_nationkey"), "INHERITS", F.col("c_custkey")),
        edge(supplier, _key("S", "s_suppkey"), _key("N", "s_nationkey"), "INHERITS", F.col("s_suppkey")),
        edge(supplier.where(F.col("s_acctbal") < 0), _key("S", "s_suppkey"), F.lit("EXT"), "INHERITS", F.col("s_suppkey")),
        edge(nation, _key("N", "n_nationkey"), F.concat(F.lit("N"), ((F.col("n_nationkey") + 1) % 25).cast("string")), "INHERITS_METHOD", F.col("n_nationkey")),
        edge(region, _key("R", "r_regionkey"), F.concat(F.lit("R"), ((F.col("r_regionkey") + 1) % 5).cast("string")), "IMPORTS", F.col("r_regionkey")),
        edge(sold, _key("C", "o_custkey"), _key("S", "l_suppkey"), "CALLS", F.col("l_orderkey") * 10 + F.col("l_linenumber")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    node = lambda df, letter, key: df.select(_key(letter, key).alias("qualified_name"), F.lit(letter).alias("type"), F.lit("geo").alias("file"), F.col(key).cast("int").alias("line"))
    nodes = node(region, "R", "r_regionkey").unionByName(node(nation, "N", "n_nationkey")).unionByName(node(supplier, "S", "s_suppkey")).unionByName(node(customer, "C", "c_custkey"))
    return nodes, edges.numbered(every, ["type", "source", "target", "line"]) if ordered else every


def document_graph(spark, sf_dir) -> DataFrame:
    """Edges between documents: calls to 7 i + 1, inherited methods from i + 20, imports of i + 1, a base outside."""
    docs = documents(spark, sf_dir).select("id", "qualified_name", "type")
    n = F.broadcast(docs.agg((F.max("id") + 1).alias("n")))  # one row
    aims = [("CALLS", F.col("id") * 7 + 1), ("CALLS", F.col("id") + 2), ("INHERITS_METHOD", F.col("id") + 20), ("IMPORTS", F.col("id") + 1)]
    to = docs.select(F.col("id").alias("to"), F.col("qualified_name").alias("target"))
    rows = docs.crossJoin(n)
    out = rows.where(F.col("type") == "de").select(F.col("qualified_name").alias("source"), F.lit("EXT").alias("target"), F.lit("INHERITS").alias("type"), F.col("id").alias("line"))
    for kind, aim in aims:
        hop = rows.withColumn("to", aim % F.col("n")).join(to, "to")
        out = out.unionByName(hop.select(F.col("qualified_name").alias("source"), "target", F.lit(kind).alias("type"), F.col("id").alias("line")))
    return edges.numbered(out, ["type", "source", "target", "line"])


def questions(spark, sf_dir) -> DataFrame:
    """Each test item as a question that names a document."""
    aim = F.concat(F.lit(" src"), (F.col("item_id") % 20).cast("string"), F.lit(".en_doc_"), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", aim).alias("query"))


def six(column):
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


class Hybrid:
    """The stages of a search over all questions."""

    def __init__(self, spark, sf_dir) -> None:
        self.docs = documents(spark, sf_dir)
        self.questions = questions(spark, sf_dir)
        self.features = fusion.query_features(self.questions)
        self.names = self.docs.select("id", F.col("qualified_name").alias("name"))
        self.graph = document_graph(spark, sf_dir)
        self.spark, self.sf_dir = spark, sf_dir

    def bm25(self, k: int = CANDIDATES) -> DataFrame:
        index = lexical.build_index(self.docs.select("id", T.lexical_text().alias("text")))
        return lexical.top(index, self.features.select("qid", F.col("expanded").alias("query")), k)

    def semantic(self, k: int = CANDIDATES) -> DataFrame:
        known = table(self.spark, self.sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(self.docs.select("id"), "id", "left_semi")
        asked = known.join(self.questions.select(F.col("qid").alias("id")), "id", "left_semi").withColumnRenamed("id", "qid")
        return vectors.top(known, asked, k)

    def candidates(self, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame, DataFrame]:
        from quarryline.runtime import written

        bm25, semantic = written(self.bm25(k), "bm25"), written(self.semantic(k), "semantic")
        named = [r.join(self.names, "id").select("qid", "name") for r in (bm25, semantic)]
        nodes = self.docs.select("qualified_name", "file", "line", "type")
        near = proximity.top(proximity.scores(fusion.seeds(*named), self.graph, nodes), nodes, k)
        return bm25, semantic, near.join(self.names, F.col("qualified_name") == F.col("name")).select("qid", "id", "rank", "score")

    def fused(self) -> DataFrame:
        return fusion.fuse(*self.candidates())

    def results(self, top_k: int = 5) -> DataFrame:
        from quarryline.runtime import written

        return written(fusion.rank(self.fused(), self.docs, self.features, top_k), "results")


# --- queries -------------------------------------------------------------------------------------------------


def q01_scan_project(spark, sf_dir):
    return documents(spark, sf_dir).select("id", "type", F.md5(T.lexical_text()).alias("digest"))


def _class_symbols(spark, sf_dir) -> DataFrame:
    none = F.array().cast("array<string>")
    row = lambda df, name, kind, line, bases=none: df.select(name.alias("qualified_name"), F.lit(kind).alias("type"), F.lit("geo.py").alias("file"), line.cast("int").alias("line"), bases.alias("bases"))
    nation, region, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    return (
        row(region, _key("R", "r_regionkey"), "class", F.col("r_regionkey"))
        .unionByName(row(nation, F.concat(_key("R", "n_regionkey"), F.lit("."), F.lower("n_name")), "method", F.col("n_nationkey")))
        .unionByName(row(supplier, F.concat(_key("X", "s_suppkey"), F.lit(".m")), "method", F.col("s_suppkey")))
        .unionByName(row(customer, _key("C", "c_custkey"), "class", F.col("c_custkey"), F.array(_key("N", "c_nationkey"), F.concat(F.lit("seg."), "c_mktsegment"))))
    )


def q02_defines(spark, sf_dir):
    return edges.defines(_class_symbols(spark, sf_dir)).select("source", "target", "type", "line")


def q03_inherits(spark, sf_dir):
    return edges.inherits(edges.class_bases(_class_symbols(spark, sf_dir))).select("source", "target", "type", "line")


def q04_inherits_method(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("method", F.lower("c_mktsegment"))
    methods = customer.select(_key("C", "c_custkey").alias("class"), "method", F.col("c_custkey").alias("line"), F.lit("geo.py").alias("file"))
    bases = customer.select(_key("C", "c_custkey").alias("class"), _key("N", "c_nationkey").alias("base"))
    known = methods.select(F.concat_ws(".", "class", "method").alias("qualified_name")).unionByName(customer.where(F.col("c_acctbal") > 9500).select(F.concat_ws(".", _key("N", "c_nationkey"), "method").alias("qualified_name")))
    return edges.inherits_method(methods, bases, known).select("source", "target", "type", "line")


def q05_resolve_imports(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mod = lambda n: F.concat(F.lit("m"), (F.col("doc_id") % n).cast("string"))
    folder = F.concat_ws("/", "source", "lang")
    files = docs.select(F.concat(folder, F.lit("/"), mod(50), F.lit(".py")).alias("file")).union(docs.select(F.concat(folder, F.lit("/__init__.py")))).distinct()
    which = F.col("doc_id") % 3
    found = docs.select(
        F.concat(folder, F.lit("/"), mod(50), F.lit(".py")).alias("file"),
        F.when(which == 0, mod(70)).when(which == 1, F.col("lang")).otherwise("").alias("module"),
        mod(60).alias("name"),
        (F.col("doc_id") % 4).cast("int").alias("level"),
        F.col("doc_id").cast("int").alias("line"),
    )
    return edges.resolve_imports(found, files).select("source", "target", "type", "line")


def _lookup_tables(spark, sf_dir):
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    base = lambda df, c, b, pos: df.select(c.alias("class"), b.alias("base"), F.lit(pos).alias("pos"))
    bases = (
        base(customer, _key("C", "c_custkey"), _key("N", "c_nationkey"), 0)
        .unionByName(base(customer, _key("C", "c_custkey"), F.concat(F.lit("N"), ((F.col("c_nationkey") + 1) % 25).cast("string")), 1))
        .unionByName(base(nation, _key("N", "n_nationkey"), _key("R", "n_regionkey"), 0))
        .unionByName(base(nation, _key("N", "n_nationkey"), F.lit("EXT"), 1))
    )
    has = lambda df, letter, key, mod: df.select(key, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).where((F.col(key) + F.col("j")) % mod == 0).select(F.concat(_key(letter, key), F.lit(".m"), F.col("j").cast("string")).alias("qualified_name"))
    names = has(region, "R", "r_regionkey", 2).unionByName(has(nation, "N", "n_nationkey", 3)).unionByName(has(customer, "C", "c_custkey", 7))
    return bases, names


def q06_calls(spark, sf_dir):
    bases, names = _lookup_tables(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    callee = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "self.ctx.").when(F.col("o_orderkey") % 4 == 1, "other.").otherwise("self."), F.lit("m"), (F.col("o_orderkey") % 5).cast("string"))
    found = orders.select(F.concat(_key("C", "o_custkey"), F.lit(".run")).alias("caller"), callee.alias("callee"), F.col("o_orderkey").cast("int").alias("line"))
    known = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(_key("C", "c_custkey").alias("class"), F.lit("ctx").alias("attribute"), F.concat(F.lit("R"), (F.col("c_custkey") % 5).cast("string")).alias("target_class"))
    return edges.calls(found, bases, names, known).select("source", "target", "type", "line")


def q07_inherited_lookup(spark, sf_dir):
    bases, names = _lookup_tables(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").select(_key("C", "c_custkey").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select("class", F.concat(F.lit("m"), F.col("j").cast("string")).alias("method"))
    return edges.inherited_methods(wanted, bases, names)


def q08_graph_assembly(spark, sf_dir):
    return edges.counters(*star_graph(spark, sf_dir, ordered=False))


def q09_adjacency(spark, sf_dir):
    return edges.outgoing_calls(star_graph(spark, sf_dir)[1]).select("node", F.size("targets").cast("long").alias("n"), F.array_join("targets", ",").alias("targets"))


def q10_undirected(spark, sf_dir):
    return edges.undirected(star_graph(spark, sf_dir, ordered=False)[1]).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("n_other"))


def q11_relationships(spark, sf_dir):
    nodes, links = star_graph(spark, sf_dir)
    rows = edges.relationships(links, nodes.where(F.col("type").isin("N", "R")).select(F.col("qualified_name").alias("node")))
    return rows.select("node", "place", "direction", T.relationship_line(F.col("type"), F.col("source"), F.col("target")).alias("said"))


def q12_tokenize(spark, sf_dir):
    tokens = T.tokenize(T.lexical_text())
    return documents(spark, sf_dir).select("id", tokens.alias("t")).select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def q13_token_sets(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("qualified_name").alias("key"), F.array_join(F.sort_array(T.name_tokens(F.col("qualified_name"))), " ").alias("tokens"))
    asked = questions(spark, sf_dir).select(F.concat(F.lit("q"), F.col("qid").cast("string")).alias("key"), F.array_join(F.sort_array(T.query_tokens(F.col("query"))), " ").alias("tokens"))
    return docs.unionByName(asked)


SAMPLE_QUERIES = ((1, "how does src1.en_doc_1 save sessions"), (2, "use en_doc_25, en_doc_25 and src5. End."), (3, "Process   Request  of src3 for doc_3"), (4, "plain words only"), (5, "How does Flask register URL rules and routing?"), (6, "the en doc of src7"))


def _samples(spark) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_QUERIES), "qid long, query string")


def q14_identifiers(spark, sf_dir):
    return _every_question(spark, sf_dir).select("qid", F.array_join(T.identifiers(F.col("query")), "|").alias("identifiers"))


def _every_question(spark, sf_dir) -> DataFrame:
    return _samples(spark).unionByName(questions(spark, sf_dir).select((F.col("qid") + 100).alias("qid"), "query"))


def _asked_names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return fusion.query_features(_every_question(spark, sf_dir)), documents(spark, sf_dir).select("id", F.col("qualified_name").alias("name"))


def q15_identifier_score(spark, sf_dir):
    """Of every question and document that score; so are the next two."""
    return names.identifier_scores(*_asked_names(spark, sf_dir))


def q16_name_match(spark, sf_dir):
    return names.name_scores(*_asked_names(spark, sf_dir)).select("qid", "id", six("score").alias("score"))


def q17_entity(spark, sf_dir):
    return names.entity_scores(*_asked_names(spark, sf_dir))


def q18_expand(spark, sf_dir):
    return _every_question(spark, sf_dir).select("qid", T.expand(F.col("query")).alias("expanded"))


def q19_action(spark, sf_dir):
    name = F.col("qualified_name")
    return documents(spark, sf_dir).select("id", T.action(name).alias("action"), T.last_part(name).alias("last"), T.first_part(name).alias("first"))


def q20_vector_topk(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.top(known, known.where(F.col("id") % 100 == 0).withColumnRenamed("id", "qid"), 5)
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), six("score").alias("score"))


def q21_bm25_topk(spark, sf_dir):
    index = lexical.build_index(documents(spark, sf_dir).select("id", T.lexical_text().alias("text")))
    asked = questions(spark, sf_dir).unionByName(spark.createDataFrame([(-1, "zzzqqq nothing"), (-2, "the the src1")], "qid long, query string"))
    return lexical.top(index, asked, 5).select("qid", "id", F.col("rank").cast("long").alias("rank"), six("score").alias("score"))


def _star_seeds(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    own = nation.select(F.col("n_nationkey").cast("long").alias("qid"), _key("N", "n_nationkey").alias("name"))
    more = nation.where(F.col("n_nationkey") % 2 == 0).select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("S"), (F.col("n_nationkey") + 1).cast("string")).alias("name"))
    return own.unionByName(more).unionByName(own.select("qid", F.lit("nowhere").alias("name")))


def q22_graph_scores(spark, sf_dir):
    nodes, links = star_graph(spark, sf_dir, ordered=False)
    return proximity.scores(_star_seeds(spark, sf_dir), links, nodes).select("qid", "name", six("score").alias("score"))


def q23_graph_topk(spark, sf_dir):
    nodes, links = star_graph(spark, sf_dir, ordered=False)
    found = proximity.top(proximity.scores(_star_seeds(spark, sf_dir), links, nodes), nodes, CANDIDATES)
    return found.select("qid", "qualified_name", "type", six("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def q24_rrf(spark, sf_dir):
    return Hybrid(spark, sf_dir).fused().select("qid", "id", six("rrf_score").alias("rrf_score"), F.array_join("sources", ",").alias("sources"))


def q25_final(spark, sf_dir):
    rows = Hybrid(spark, sf_dir).results()
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), "document_id", "qualified_name", *[six(c).alias(c) for c in ("rrf_score", "identifier_score", "name_match_score", "entity_match_score", "final_score")])


def q26_explain(spark, sf_dir):
    rows = Hybrid(spark, sf_dir).results()
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), F.array_join("explanation", "; ").alias("explanation"))


def _retrieved(spark, sf_dir) -> DataFrame:
    """A ranking without a search: for each document, a chain of the document graph from it and two others."""
    docs = documents(spark, sf_dir).select("id", "qualified_name", "file", "line")
    n = F.broadcast(docs.agg((F.max("id") + 1).alias("n")))
    heads = docs.select("id").crossJoin(n)
    hop = [F.col("id") % F.col("n")]
    for _ in range(3):
        hop.append((hop[-1] * 7 + 1) % F.col("n"))
    more = [(F.col("id") + 20) % F.col("n"), (F.col("id") + 3) % F.col("n")]
    rows = heads.select(F.col("id").alias("qid"), F.posexplode(F.array(*hop, *more)).alias("pos", "doc"))
    named = rows.join(docs.withColumnRenamed("id", "doc"), "doc")
    return named.select("qid", (F.col("pos") + 1).alias("rank"), F.col("doc").alias("id"), "qualified_name", "file", "line")


def _paths(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, graph = _retrieved(spark, sf_dir), document_graph(spark, sf_dir)
    return paths.build_paths(found.select("qid", F.col("qualified_name").alias("name"), "rank"), graph), graph, found


def q27_paths(spark, sf_dir):
    return _paths(spark, sf_dir)[0].select("qid", "rank", "score", F.array_join("path", ">").alias("path"))


def q28_steps(spark, sf_dir):
    found, graph, _ = _paths(spark, sf_dir)
    return paths.path_steps(found, graph).select("qid", "rank", "step", "source", "target", "type", F.col("line").cast("long").alias("line"))


def q29_context(spark, sf_dir):
    found, graph, results = _paths(spark, sf_dir)
    steps = paths.path_results(found, paths.path_steps(found, graph.withColumn("line", F.col("line").cast("int"))))
    asked = results.select("qid").distinct().select("qid", F.concat(F.lit("question "), F.col("qid").cast("string")).alias("query"))
    made = context.build(asked, results, documents(spark, sf_dir), steps, max_results=5)
    return made.select("qid", F.size("documents").cast("long").alias("n_documents"), F.size("path_results").cast("long").alias("n_paths"), F.array_join("results", ",").alias("results"), F.md5(F.array_join(F.transform("documents", lambda d: d["text"]), "|")).alias("texts"))


def q30_narrate(spark, sf_dir):
    found, graph, _ = _paths(spark, sf_dir)
    details = documents(spark, sf_dir).select("qualified_name", F.col("text").alias("code"), "file", "line")
    return context.narrate(found, edges.first_edges(graph), details)


def _enriched(spark, sf_dir) -> DataFrame:
    graph, found = document_graph(spark, sf_dir), _retrieved(spark, sf_dir)
    near = edges.relationships(graph.withColumn("line", F.col("line").cast("int")), found.select(F.col("qualified_name").alias("node")))
    rows = context.enrich(found, documents(spark, sf_dir), near)
    return rows.withColumn("abstract", F.contains("code", F.lit("tion")) & (F.col("id") % 3 == 0))


def q31_choose(spark, sf_dir):
    rows = _enriched(spark, sf_dir)
    return answers.choose(rows).join(rows.select("qid", "rank", "qualified_name"), ["qid", "rank"]).select("qid", F.col("rank").cast("long").alias("rank"), "qualified_name")


def q32_related(spark, sf_dir):
    rows = _enriched(spark, sf_dir)
    first = rows.where(F.col("rank") == 1)
    return answers.related(rows, first).select("qid", "place", "qualified_name").join(answers.structure(rows, first).select("qid", F.array_join("structure", " ").alias("structure")), "qid")


def q33_listing(spark, sf_dir):
    found, graph = _retrieved(spark, sf_dir), document_graph(spark, sf_dir)
    return context.relationship_listing(edges.relationships(graph, found.select(F.col("qualified_name").alias("node"))))


def q34_histogram(spark, sf_dir):
    return evaluation.folder_histogram(documents(spark, sf_dir))


def _cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    index = lexical.build_index(documents(spark, sf_dir).select("id", T.lexical_text().alias("text")))
    names = documents(spark, sf_dir).select("id", F.col("qualified_name").alias("name"))
    ranked = lexical.top(index, questions(spark, sf_dir), 10).join(names, "id")
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    cases = names.join(good, "id", "left_semi").select(F.col("id").alias("qid"), F.col("name").alias("expected"))
    return cases.join(questions(spark, sf_dir).select("qid"), "qid", "left_semi"), ranked


def q35_eval(spark, sf_dir):
    return evaluation.metrics(*_cases(spark, sf_dir)).select("n_cases", six("recall").alias("recall"), six("mrr").alias("mrr"))


def q36_diagnose(spark, sf_dir):
    return evaluation.diagnose(*_cases(spark, sf_dir)).select("qid", F.col("rank").cast("long").alias("rank"), "name", "is_expected")


def q69_vector_cells(spark, sf_dir):
    """The nearest vectors of every vector, itself left out, by cells."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found, _ = vectors.top_by_cells(known, known.withColumnRenamed("id", "qid"), 4)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = found.where(F.col("qid") != F.col("id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3)
    return ranked.select("qid", "id", F.col("rank").cast("long").alias("rank"), six("score").alias("score"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
