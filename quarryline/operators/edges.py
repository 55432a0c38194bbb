"""Tables of a source tree: symbols, documents, and the edges of its code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline import config
from quarryline.functions.text import first_part, last_part
from quarryline.plans.order import positions
from quarryline.plans.pyast import MODULE
from quarryline.runtime import written


def symbols(parsed: DataFrame) -> DataFrame:
    """A row for each symbol, with the fields that were asked for."""
    fields = parsed.schema["symbols"].dataType.elementType.names
    columns = [f if f == "file" else f"s.{f}" for f in ("name", "qualified_name", "type", "file", "line", "end_line", "text", "bases") if f == "file" or f in fields]
    return parsed.select("file", F.explode("symbols").alias("s")).select(*columns)


def documents(symbols_: DataFrame) -> DataFrame:
    """Symbols with an id: their place by file, line and name.

    Ranges of the order are placed by the sizes of those before them, so no task sees them all.
    """
    placed = positions(symbols_.select("name", "qualified_name", "type", "file", "line", "text"), "file", "line", "qualified_name", label="symbol-order")
    return placed.select(F.col("at").cast("long").alias("id"), "row.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.explode("imports").alias("i")).select("file", "i.module", "i.name", "i.level", "i.line")


def raw_calls(parsed: DataFrame, with_module: bool = True) -> DataFrame:
    calls = parsed.select("file", F.explode("calls").alias("c")).select("file", "c.caller", "c.callee", "c.line")
    return calls if with_module else calls.where(F.col("caller") != MODULE)


def call_lists(parsed: DataFrame) -> DataFrame:
    """(file, owner, calls): the source text of all callees of each function and method, in order."""
    flat = parsed.select("file", F.posexplode("flat_calls").alias("ord", "c")).select("file", "ord", "c.owner", "c.call")
    return flat.groupBy("file", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "call"))), lambda x: x["call"]).alias("calls"))


def _edge(source: Column | str, target: Column | str, kind: str, line: Column | str = "line", file: Column | str = "file") -> list[Column]:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return [col(source).alias("source"), col(target).alias("target"), F.lit(kind).alias("type"), col(line).cast("int").alias("line"), col(file).alias("file")]


def defines(symbols_: DataFrame) -> DataFrame:
    """A class to each of its methods, where the method is a symbol."""
    methods = symbols_.where(F.col("type") == "method")
    classes = symbols_.where(F.col("type") == "class").select(F.col("qualified_name").alias("owner"), F.col("file").alias("at")).distinct()
    owned = methods.join(classes, (first_part(F.col("qualified_name")) == F.col("owner")) & (F.col("file") == F.col("at")), "left_semi")
    return owned.select(*_edge(first_part(F.col("qualified_name")), "qualified_name", "DEFINES"))


def class_bases(symbols_: DataFrame) -> DataFrame:
    """(class, base, pos, line, file), one row per base; a base is its source text."""
    rows = symbols_.where(F.col("type") == "class").select("qualified_name", F.posexplode("bases").alias("pos", "base"), "line", "file")
    return rows.withColumnRenamed("qualified_name", "class")


def inherits(bases: DataFrame) -> DataFrame:
    return bases.select(*_edge("class", "base", "INHERITS"))


def inherits_method(methods: DataFrame, bases: DataFrame, names: DataFrame) -> DataFrame:
    """``C.m`` to ``B.m`` for each direct base B of C, where both are symbols.

    ``methods``: (class, method, line, file); ``bases``: (class, base); ``names``: (qualified_name).
    """
    full = lambda owner: F.concat_ws(".", F.col(owner), F.col("method"))
    pairs = methods.join(bases.select("class", "base"), "class").withColumns({"from": full("class"), "to": full("base")})
    known = names.select("qualified_name").distinct()
    for end in ("from", "to"):
        pairs = pairs.join(known.withColumnRenamed("qualified_name", end), end, "left_semi")
    return pairs.select(*_edge("from", "to", "INHERITS_METHOD"))


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges between files for relative imports, one per imported name.

    A level of n climbs n - 1 folders from the importing file's; ``p.py`` is preferred to ``p/__init__.py``.
    What climbs above the root or does not exist is dropped.
    """
    parts = F.split("file", "/")
    depth = F.size(parts) - F.col("level")
    folder = F.slice(parts, F.lit(1), F.greatest(depth, F.lit(0)))
    below = F.split(F.when(F.coalesce("module", F.lit("")) != "", F.col("module")).otherwise(F.col("name")), r"\.")
    wanted = found.where((F.col("level") > 0) & (depth >= 0)).withColumn("stem", F.array_join(F.concat(folder, below), "/"))
    known = files.select("file").distinct()
    module = known.select(F.col("file").alias("as_module"), F.regexp_replace("file", r"\.py$", "").alias("stem")).where(F.col("as_module").endswith(".py"))
    package = known.where(F.col("file").endswith("/__init__.py")).select(F.col("file").alias("as_package"), F.regexp_replace("file", r"/__init__\.py$", "").alias("stem"))
    hit = wanted.join(module, "stem", "left").join(package, "stem", "left").withColumn("target", F.coalesce("as_module", "as_package"))
    return hit.where(F.col("target").isNotNull()).select(*_edge("file", "target", "IMPORTS", "line", F.lit(None).cast("string")))


def ancestry(bases: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(class, ancestor, depth, path): every class that breadth-first search over the bases reaches, itself included.

    ``path`` holds the positions of the bases taken; (depth, path) orders the search. Cycles end at visited classes.
    Paths are doubled: after n rounds all ancestors of depth up to 2 ** n are known, each by its first path, and a
    further one is reached by the first path to an ancestor at exactly that depth and the first path from there. So
    the rounds grow with the logarithm of the depth. Raises if ``max_rounds`` are not enough.
    """
    edges = bases.select(F.col("class").alias("c"), "base", "pos").distinct()
    first = F.min(F.struct("depth", "path")).alias("way")
    own = edges.select(F.col("c").alias("class"), F.col("c").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    one = edges.select(F.col("c").alias("class"), F.col("base").alias("ancestor"), F.lit(1).alias("depth"), F.array("pos").cast("array<int>").alias("path"))
    known = written(own.unionByName(one).groupBy("class", "ancestor").agg(first).select("class", "ancestor", "way.*"), "ancestry")
    reach = 1
    for _ in range(max_rounds):
        far = known.where(F.col("depth") == reach).select("class", F.col("ancestor").alias("via"), F.col("path").alias("ahead"))
        on = known.where("depth > 0").select(F.col("class").alias("via"), "ancestor", F.col("depth").alias("more"), F.col("path").alias("behind"))
        step = far.join(on, "via").select("class", "ancestor", (F.col("more") + reach).alias("depth"), F.concat("ahead", "behind").alias("path"))
        step = step.groupBy("class", "ancestor").agg(first).select("class", "ancestor", "way.*").join(known.select("class", "ancestor"), ["class", "ancestor"], "left_anti")
        fresh = written(step, "ancestry")
        if fresh.isEmpty():
            return known
        known, reach = known.unionByName(fresh), 2 * reach
    raise RuntimeError(f"the bases of some class are more than 2 ** {max_rounds} levels deep")


def inherited_methods(wanted: DataFrame, bases: DataFrame, names: DataFrame) -> DataFrame:
    """(class, method, target): the first class in search order that has the method; no row without one.

    ``wanted``: (class, method); ``names``: (qualified_name) of all symbols.
    """
    pairs = wanted.select("class", "method").distinct()
    reached = ancestry(bases).unionByName(pairs.join(bases.select("class"), "class", "left_anti").select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")).distinct())
    tried = pairs.join(reached, "class").withColumn("target", F.concat_ws(".", "ancestor", "method"))
    tried = tried.join(names.select(F.col("qualified_name").alias("target")).distinct(), "target", "left_semi")
    return tried.groupBy("class", "method").agg(F.min_by("target", F.struct("depth", "path")).alias("target"))


def calls(found: DataFrame, bases: DataFrame, names: DataFrame, attributes: DataFrame) -> DataFrame:
    """CALLS edges of calls on ``self``.

    ``self.m`` is looked up on the caller's class, ``self.attribute. ... .m`` on the class that ``attributes``
    (class, attribute, target_class) gives the attribute; others are dropped.
    """
    own = found.where(F.col("callee").startswith("self.") & F.contains("caller", F.lit("."))).withColumn("class", first_part(F.col("caller")))
    chain = F.split("callee", r"\.")
    own = own.withColumns({"method": F.element_at(chain, -1), "attribute": F.when(F.size(chain) > 2, chain[1])})
    own = own.join(attributes.select("class", "attribute", "target_class"), ["class", "attribute"], "left")
    own = own.withColumn("class", F.when(F.col("attribute").isNull(), F.col("class")).otherwise(F.col("target_class"))).where(F.col("class").isNotNull())
    return own.join(inherited_methods(own, bases, names), ["class", "method"]).select(*_edge("caller", "target", "CALLS", "line", F.lit(None).cast("string")))


def assemble(*tables: DataFrame) -> DataFrame:
    """All edges in the order of the tables with ``ord``, their place: by table, source, line, target."""
    parts = [t.select("source", "target", "type", "line", *([F.col("file")] if "file" in t.columns else [F.lit(None).cast("string").alias("file")]), F.lit(k).alias("part")) for k, t in enumerate(tables)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbered(every, ["part", "source", "line", "target"]).drop("part")


def numbered(edges: DataFrame, order: list[str]) -> DataFrame:
    """``edges`` with ``ord``, their place from 1 in the order; ranges of it are placed by the sizes of those before."""
    return positions(edges, *order, label="edge-order").select("row.*", (F.col("at") + 1).cast("long").alias("ord"))


def valid_edges(edges: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("source", "target", "type")]
    return edges.where(filled[0] & filled[1] & filled[2])


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, direction, other, type, line, ord): every edge from both of its ends."""
    rows = valid_edges(edges)
    out = rows.select(F.col("source").alias("node"), F.lit("outgoing").alias("direction"), F.col("target").alias("other"), "type", "line", "ord")
    return rows.select(F.col("target").alias("node"), F.lit("incoming").alias("direction"), F.col("source").alias("other"), "type", "line", "ord").unionByName(out)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "type").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "type"))


def outgoing_calls(edges: DataFrame) -> DataFrame:
    """(node, targets): the targets of a node's CALLS, in edge order."""
    rows = valid_edges(edges).where(F.col("type") == "CALLS")
    return rows.groupBy(F.col("source").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("targets"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge between each source and target, of any type."""
    return edges.groupBy("source", "target").agg(F.min_by(F.struct("type", "line"), "ord").alias("e")).select("source", "target", "e.type", "e.line")


#: Places of the edge order that are ranked together.
PIECE_EDGES = 1 << 16


def relationships(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, source, target, type, line, direction, place) of the ``nodes``: incoming edges first, then outgoing.

    A node's edges are ranked in pieces of ``PIECE_EDGES`` places of the edge order, so that no task sorts those of a hub:
    a piece's edges are numbered by themselves, and the sizes of a node's earlier pieces are added.
    """
    wanted = nodes.select("node").distinct()
    rows = valid_edges(edges)
    into = rows.withColumns({"node": F.col("target"), "direction": F.lit("incoming")})
    out = rows.withColumns({"node": F.col("source"), "direction": F.lit("outgoing")})
    both = into.unionByName(out).join(wanted, "node", "left_semi")
    both = both.withColumn("piece", F.floor(F.col("ord") / PIECE_EDGES))
    whole = ["node", "direction", "piece"]
    sizes = both.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("node").orderBy("direction", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*whole).orderBy("ord"))
    ranked = both.withColumn("inside", place).join(sizes.select(*whole, before.alias("before")), whole)
    return ranked.select("node", "source", "target", "type", "line", "direction", (F.col("before") + F.col("inside")).cast("long").alias("place"))


def counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes, edges, and edges of each type."""
    n = F.count(F.lit(1)).alias("n")
    kinds = edges.groupBy(F.concat(F.lit("edges:"), "type").alias("what")).agg(n)
    return nodes.agg(n).select(F.lit("nodes").alias("what"), "n").unionByName(edges.agg(n).select(F.lit("edges").alias("what"), "n")).unionByName(kinds)


def last_of_name(rows: DataFrame, key: str = "qualified_name", order: str = "id") -> DataFrame:
    """One row per name: the last in order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def build_graph(parsed: DataFrame, attribute_types=config.ATTRIBUTE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a parsed tree, in one acyclic pass."""
    spark = parsed.sparkSession
    nodes = symbols(parsed)
    bases = class_bases(nodes)
    methods = nodes.where(F.col("type") == "method").select(first_part(F.col("qualified_name")).alias("class"), last_part(F.col("qualified_name")).alias("method"), "line", "file")
    known = spark.createDataFrame(list(attribute_types), "class string, attribute string, target_class string")
    links = calls(raw_calls(parsed, with_module=False), bases, nodes, known)
    edges = assemble(defines(nodes), inherits(bases), inherits_method(methods, bases, nodes), links, resolve_imports(imports(parsed), parsed))
    return nodes.select("name", "qualified_name", "type", "file", "line"), edges
