"""Context of a query: documents, paths, relationships, and texts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import first_filled, operation
from quarryline.operators.edges import last_of_name

NO_PATH = "The supplied repository evidence does not establish an implementation path."


def ordered(rows: DataFrame, key: str, place: str, item: Column, name: str) -> DataFrame:
    """(key, name): the items of each key in order of ``place``."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("_p"), item.alias("_x")))), lambda s: s["_x"]).alias(name))


def relevant_documents(results: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, rank, qualified_name, file, line, text): the document of each distinct result, by the result's best rank."""
    first = results.groupBy("qid", "qualified_name").agg(F.min("rank").alias("rank"))
    wanted = documents.join(first.select("qualified_name").distinct(), "qualified_name", "left_semi")
    return first.join(last_of_name(wanted.select("id", "qualified_name", "file", "line", "text")), "qualified_name").select("qid", "rank", "qualified_name", "file", "line", "text")


def needed(relationships: DataFrame, most: int) -> DataFrame:
    """Of each node's relationships (with ``place``) what an answer reads: its bases, and the first ``most`` that are told."""
    told = F.col("type") != "DEFINES"
    nth = F.row_number().over(Window.partitionBy("node", told).orderBy("place"))
    bases = F.col("type").isin("INHERITS", "INHERITS_METHOD") & (F.col("source") == F.col("node"))
    return relationships.withColumn("nth", nth).where(bases | (told & (F.col("nth") <= most))).drop("nth")


def enrich(results: DataFrame, documents: DataFrame, relationships: DataFrame, most: int | None = None) -> DataFrame:
    """``results`` with ``code`` of the document and ``relationships``, its edges in order.

    With ``most`` only those travel that an answer reads, so that a hub's edges are not copied for each question.
    """
    relationships = relationships if most is None else needed(relationships, most)
    text = relevant_documents(results, documents).select("qid", "qualified_name", F.col("text").alias("code"))
    near = ordered(relationships, "node", "place", F.struct("source", "target", "type", "line", "direction"), "relationships").withColumnRenamed("node", "qualified_name")
    empty = F.array().cast("array<struct<source:string,target:string,type:string,line:int,direction:string>>")
    rows = results.join(text, ["qid", "qualified_name"], "left").join(near, "qualified_name", "left")
    return rows.withColumns({"code": first_filled(F.col("code")), "relationships": F.coalesce("relationships", empty)})


def limited(results: DataFrame, most: int | None) -> DataFrame:
    return results if most is None else results.where(F.col("rank") <= most)


def build(queries: DataFrame, results: DataFrame, documents: DataFrame, path_results: DataFrame, max_results: int | None = None) -> DataFrame:
    """One row per query: results, documents, implementation_paths and path_results as ordered arrays."""
    results = limited(results, max_results)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    found = ordered(results, "qid", "rank", F.col("qualified_name"), "results")
    docs = ordered(relevant_documents(results, documents), "qid", "rank", F.struct("qualified_name", "file", "line", "text"), "documents")
    paths = ordered(path_results, "qid", "rank", F.struct("path", "steps"), "path_results")
    out = queries.select("qid", "query").join(found, "qid", "left").join(docs, "qid", "left").join(paths, "qid", "left")
    kinds = dict(out.dtypes)
    out = out.withColumns({c: none(F.col(c), kinds[c]) for c in ("results", "documents", "path_results")})
    return out.withColumn("implementation_paths", F.transform("path_results", lambda p: p["path"]))


def prompt_text(context: DataFrame, *more: str) -> DataFrame:
    """(qid, text): the context as sections of text for a language model.

    ``more`` names columns of the context to keep: a join with the context would move the documents' texts twice more.
    """
    numbered = lambda items, render: F.transform(items, lambda x, i: render(x, (i + 1).cast("string")))
    section = lambda title, items, rows: F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array().cast("array<string>"))
    docs = numbered(F.col("documents"), lambda d, i: F.concat(F.lit("\n["), i, F.lit("] "), d["qualified_name"], F.lit("\nFile: "), F.coalesce(d["file"], F.lit("unknown")), F.lit("\n\n"), F.coalesce(d["text"], F.lit(""))))
    step = lambda s: F.concat(F.lit("- "), s["source"], F.lit(" --"), s["type"], F.lit("--> "), s["target"])
    paths = F.flatten(numbered(F.col("path_results"), lambda p, i: F.concat(F.array(F.concat(F.lit("\nPath "), i, F.lit(":")), F.array_join(p["path"], " -> ")), F.transform(p["steps"], step))))
    found = numbered(F.col("results"), lambda r, i: F.concat(i, F.lit(". "), r))
    parts = F.concat(
        F.when(F.coalesce("query", F.lit("")) != "", F.array(F.concat(F.lit("USER QUERY:\n"), "query"))).otherwise(F.array().cast("array<string>")),
        section("\nRETRIEVED CODE:", F.col("documents"), docs),
        section("\nIMPLEMENTATION PATHS:", F.col("path_results"), paths),
        section("\nRETRIEVAL EVIDENCE:", F.col("results"), found),
    )
    return context.select("qid", *more, F.array_join(parts, "\n").alias("text"))


def scored_name(name: Column, score: Column) -> Column:
    """``name (score=0.1234)``, or the name alone without a score."""
    return F.when(score.isNotNull(), F.concat(name, F.lit(" (score="), F.format_string("%.4f", score), F.lit(")"))).otherwise(name)


def narrate(paths: DataFrame, edges_of: DataFrame, details: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """(qid, rank, text): a numbered account of each path (qid, rank, path).

    ``edges_of`` (source, target, type) holds the first edge of each pair, ``details`` (qualified_name, code, file,
    line) the symbols, ``sentences`` (source, target, sentence) what to say of deferred hops. A hop is told if it is
    deferred or a CALLS edge; the last node by what its code does, else by its place; other hops are silent.
    """
    last = F.size("path")
    spots = paths.select("qid", "rank", F.col("path")[0].alias("start"), F.posexplode("path").alias("pos", "name"), F.get("path", F.lit(0)).alias("_0"), last.alias("n"), F.col("path").alias("p"))
    spots = spots.withColumn("next", F.get("p", F.col("pos") + 1))
    rows = spots.join(edges_of.select(F.col("source").alias("name"), F.col("target").alias("next"), "type"), ["name", "next"], "left")
    rows = rows.join(details.select(F.col("qualified_name").alias("name"), "code", "file", "line"), "name", "left")
    said = F.lit(None).cast("string")
    if sentences is not None:
        rows = rows.join(sentences.select(F.col("source").alias("name"), F.col("target").alias("next"), "sentence"), ["name", "next"], "left")
        said = F.col("sentence")
    doing = operation(F.coalesce("code", F.lit("")))
    place = F.concat(F.when(F.coalesce("file", F.lit("")) != "", F.concat(F.lit(" in "), "file")).otherwise(""), F.when(F.col("line").isNotNull() & (F.col("line") != 0), F.concat(F.lit(" at line "), F.col("line").cast("string"))).otherwise(""))
    tail = F.when(doing.isNotNull(), F.concat("name", F.lit(" "), doing, F.lit("."))).otherwise(F.concat("name", F.lit(" is the final implementation component"), place, F.lit(".")))
    step = F.when(said.isNotNull(), said).when(F.col("next").isNull(), tail).when(F.col("type") == "CALLS", F.concat("name", F.lit(" directly calls "), "next", F.lit(".")))
    steps = rows.withColumn("step", step).groupBy("qid", "rank").agg(F.first("start").alias("start"), F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda s: s["step"])).alias("steps"))
    lines = F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    whole = F.concat(F.lit("The repository evidence shows the implementation starting at "), "start", F.lit(":\n\n"), lines)
    return steps.select("qid", "rank", F.when(F.size("steps") > 0, whole).otherwise(NO_PATH).alias("text"))


def relationship_listing(relationships: DataFrame) -> DataFrame:
    """The distinct (source, type, target) among the relationships of several nodes."""
    return relationships.select("source", "type", "target").distinct()
