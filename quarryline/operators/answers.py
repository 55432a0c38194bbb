"""Deterministic answers from enriched results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline import config
from quarryline.functions.text import action, distinct_lines, first_paragraph, last_part, relationship_line, strings

#: An answer shows as many relationships and related implementations at most.
MOST_RELATIONSHIPS, MOST_RELATED = 8, 5
NO_RESULT = "I could not find a sufficiently relevant implementation in the indexed repository."


def is_abstract(features: Column) -> Column:
    return F.coalesce(F.array_contains(features["raised"], "NotImplementedError"), F.lit(False))


def contains_call(features: Column, names: set[str]) -> Column:
    return F.coalesce(F.arrays_overlap(features["calls"], strings(sorted(names))), F.lit(False))


def assigns(features: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(features["assigned"], name), F.lit(False))


def assigns_part(features: Column, part: str) -> Column:
    return F.coalesce(F.exists(features["targets"], lambda t: F.contains(t, F.lit(part))), F.lit(False))


def has_node(features: Column, kind: str) -> Column:
    return F.coalesce(F.array_contains(features["node_types"], kind), F.lit(False))


def behaviours(code: Column, features: Column, rules=config.RULES) -> Column:
    """Sentences on what code does: the rules that fire, else what it returns; an abstract contract comes last."""
    said, fired = [], {}
    for group, calls, texts, names, targets, sentence in rules:
        on = F.coalesce(features["parsed"], F.lit(False))
        for c in calls:
            on = on & contains_call(features, c)
        for t in texts:
            on = on & F.contains(code, F.lit(t))
        for choice in names:
            any_of = F.lit(False)
            for n in sorted(choice.get("assigned", ())):
                any_of = any_of | assigns(features, n)
            if choice.get("calls"):
                any_of = any_of | contains_call(features, choice["calls"])
            on = on & any_of
        for t in targets:
            on = on & assigns_part(features, t)
        if group:
            before = fired.get(group, F.lit(False))
            fired[group] = before | on
            on = on & ~before
        said.append(F.when(on, F.lit(sentence)))
    told = F.array_compact(F.array(*said))
    returned = F.transform(features["returned"], lambda r: F.concat(F.lit("It returns "), r, F.lit(".")))
    none = F.array().cast("array<string>")
    body = F.when(F.size(told) > 0, told).otherwise(F.coalesce(returned, none))
    return distinct_lines(F.concat(body, F.when(is_abstract(features), F.array(F.lit(config.ABSTRACT_SENTENCE))).otherwise(none)))


def choose(results: DataFrame) -> DataFrame:
    """(qid, rank) of the key implementation among results (qid, rank, qualified_name, abstract, relationships).

    The first result, unless it is abstract: then the first of its INHERITS_METHOD targets, in edge order, that is
    among the results and not abstract; else the first other result with its last name part that is not abstract;
    else still the first.
    """
    best = results.where(F.col("rank") == 1).select("qid", F.col("qualified_name").alias("top"), F.col("abstract").alias("top_abstract"), "relationships")
    aims = F.filter("relationships", lambda r: (r["type"] == "INHERITS_METHOD") & (r["source"] == F.col("top")))
    best = best.withColumn("aims", F.transform(aims, lambda r: r["target"])).drop("relationships")
    rows = results.select("qid", "rank", "qualified_name", "abstract").join(best, "qid")
    aim = F.array_position("aims", F.col("qualified_name"))
    concrete = F.col("top_abstract") & ~F.col("abstract")
    level = F.when(concrete & (aim > 0), 0).when(concrete & (F.col("rank") > 1) & (last_part(F.col("qualified_name")) == last_part(F.col("top"))), 1).when(F.col("rank") == 1, 2)
    rows = rows.withColumn("level", level).where(F.col("level").isNotNull())
    order = F.struct("level", F.when(F.col("level") == 0, aim).otherwise(F.lit(0)), "rank")
    return rows.groupBy("qid").agg(F.min_by("rank", order).alias("rank"))


def related(results: DataFrame, primary: DataFrame, most: int = MOST_RELATED) -> DataFrame:
    """(qid, place, qualified_name, file, line): inherited targets first, then results with the same last name part.

    ``primary`` is (qid, qualified_name, relationships).
    """
    key = primary.select("qid", F.col("qualified_name").alias("key"), F.transform(F.filter("relationships", lambda r: (r["type"] == "INHERITS_METHOD") & (r["source"] == F.col("qualified_name")) & (r["target"] != "")), lambda r: r["target"]).alias("aims"))
    rows = results.select("qid", "rank", "qualified_name", "file", "line").join(key, "qid")
    aim = F.array_position("aims", F.col("qualified_name"))
    # Of several results with an inherited target's name the first counts, unless the name part matches as well.
    alike = (F.col("qualified_name") != F.col("key")) & (last_part(F.col("qualified_name")) == last_part(F.col("key")))
    nth = F.row_number().over(Window.partitionBy("qid", "qualified_name").orderBy("rank"))
    rows = rows.withColumns({"nth": nth, "aim": aim, "alike": alike}).withColumn("lead", (F.col("aim") > 0) & (F.col("nth") == 1)).where(F.col("lead") | F.col("alike"))
    order = Window.partitionBy("qid").orderBy(F.desc("lead"), F.when(F.col("lead"), F.col("aim")).otherwise(F.lit(0)), "rank")
    place = F.row_number().over(order).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= most).select("qid", "place", "qualified_name", "file", "line")


def structure(results: DataFrame, primary: DataFrame) -> DataFrame:
    """(qid, structure): sentences on inherited methods, base classes and results of the same method."""
    peers = results.select("qid", "rank", F.col("qualified_name").alias("peer")).join(primary.select("qid", "qualified_name"), "qid")
    peers = peers.where((F.col("peer") != F.col("qualified_name")) & (last_part(F.col("peer")) == last_part(F.col("qualified_name"))))
    peers = peers.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer"))), lambda s: s["peer"]).alias("peers"))
    rows = primary.join(peers, "qid", "left")
    name, quote = F.col("qualified_name"), lambda c: F.concat(F.lit("`"), c, F.lit("`"))

    def told(kind: str, words: str) -> Column:
        own = F.filter("relationships", lambda r: (r["type"] == kind) & (r["source"] == name) & (r["target"] != ""))
        return F.transform(own, lambda r: F.concat(quote(r["source"]), F.lit(words), quote(r["target"]), F.lit(".")))

    same = F.concat(F.lit("Related implementations of "), quote(last_part(name)), F.lit(" were retrieved: "), F.array_join(F.concat(F.array(name), "peers"), ", "), F.lit("."))
    none = F.array().cast("array<string>")
    every = F.concat(told("INHERITS_METHOD", " inherits its method implementation from "), told("INHERITS", " inherits from "), F.when(F.col("peers").isNotNull(), F.array(same)).otherwise(none))
    return rows.select("qid", distinct_lines(every).alias("structure"))


def opening(name: Column) -> Column:
    """The first bullet of an implementation path."""
    verb = action(name)
    return F.when(verb != "", F.concat(F.lit("`"), name, F.lit("` implements the `"), verb, F.lit("` operation"))).otherwise(F.concat(F.lit("`"), name, F.lit("` contains the main implementation logic")))


def path_bullets(name: Column, said: Column) -> Column:
    """The lines of an implementation path, each once: what the name promises, then what the code does."""
    return F.transform(F.array_distinct(F.concat(F.array(opening(name)), said)), lambda x: F.concat(F.lit("- "), x))


def explanation(features: Column, said: Column) -> Column:
    """Documentation and behaviour of code, a line each."""
    doc = F.when(F.coalesce(features["docstring"], F.lit("")) != "", F.concat(F.lit("Documentation: "), first_paragraph(features["docstring"])))
    return F.concat_ws("\n", doc, F.when(F.size(said) > 0, F.concat(F.lit("Behavior: "), F.array_join(said, " "))))


def generate(queries: DataFrame, results: DataFrame, code_features) -> DataFrame:
    """(qid, answer) for queries (qid, query) from enriched results; ``code_features`` parses the code of each once."""
    from quarryline.runtime import written

    rows = written(results.withColumn("features", code_features(F.col("code"))), "answer-results").withColumn("abstract", is_abstract(F.col("features")))
    primary = rows.join(choose(rows), ["qid", "rank"])
    said = behaviours(F.col("code"), F.col("features"))
    primary = primary.withColumn("said", said)
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    near = related(rows, primary).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), tick(F.col("qualified_name")), F.lit(" — "), "file", F.lit(":"), F.col("line").cast("string")).alias("x")))), lambda s: s["x"]).alias("near"))
    full = queries.select("qid", "query").join(primary.drop("query"), "qid", "left").join(structure(rows, primary), "qid", "left").join(near, "qid", "left")
    none = F.array().cast("array<string>")
    dashed = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    block = lambda title, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit(title)), items)).otherwise(none)
    links = F.slice(F.filter(F.transform("relationships", lambda r: relationship_line(r["type"], r["source"], r["target"])), lambda x: x != ""), 1, MOST_RELATIONSHIPS)
    at = lambda s: F.when(F.col(f"evidence.{s}").isNotNull(), F.concat(F.lit(f"- {s.upper()} retrieved this result at rank "), F.col(f"evidence.{s}.rank").cast("string")))
    exact = F.when(F.col("evidence.identifier.score") > 0, F.concat(F.lit("- Exact identifier evidence (score: "), F.format_string("%.2f", F.col("evidence.identifier.score")), F.lit(")")))
    note = explanation(F.col("features"), F.col("said"))
    lines = F.concat(
        F.array(F.concat(F.lit("Based on the retrieved repository code, the relevant implementation path for '"), "query", F.lit("' is:")), F.lit(""), F.lit("Implementation path:")),
        path_bullets(F.col("qualified_name"), F.col("said")),
        F.array(F.lit(""), F.concat(F.lit("The key implementation is "), tick(F.col("qualified_name")), F.lit(".")), F.concat(F.lit("It is defined in "), tick(F.col("file")), F.lit(" at line "), F.col("line").cast("string"), F.lit("."))),
        F.when(note != "", F.array(F.lit(""), note)).otherwise(none),
        block("Implementation structure:", dashed(F.coalesce("structure", none))),
        block("Code graph evidence:", dashed(links)),
        F.concat(F.array(F.lit(""), F.lit("Why this result was selected:")), F.array_compact(F.array(*[at(s) for s in ("bm25", "semantic", "graph")], exact))),
        block("Other relevant implementations:", F.coalesce("near", none)),
        F.array(F.lit(""), F.lit("Primary retrieved code:"), F.lit("```python"), F.regexp_replace("code", r"\s+$", ""), F.lit("```")),
    )
    return full.select("qid", F.when(F.col("qualified_name").isNull(), NO_RESULT).otherwise(F.array_join(lines, "\n")).alias("answer"))
