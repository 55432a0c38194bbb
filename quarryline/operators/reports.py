"""Reports for people: the structure of a file, the first symbols of an index, the context of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.context import ordered

RULE = "=" * 70
SHOWN_SYMBOLS = 10


def structure(parsed: DataFrame) -> DataFrame:
    """(file, report): classes with their bases and methods, and functions, each with its calls in source order.

    Files that do not parse have no report.
    """
    good = parsed.where(F.col("error").isNull())
    calls = good.select("file", F.explode("flat_calls").alias("c")).where("c.plain").select("file", F.col("c.owner").alias("qualified_name"), "c.place", "c.call")
    calls = calls.groupBy("file", "qualified_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "call"))), lambda x: x["call"]).alias("calls"))
    rows = good.select("file", F.posexplode("symbols").alias("pos", "s")).select("file", "pos", "s.name", "s.qualified_name", "s.type", "s.bases").join(calls, ["file", "qualified_name"], "left")
    indent = F.when(F.col("type") == "method", "  ").otherwise("")
    listed = F.when(F.col("calls").isNotNull(), F.concat(F.lit("\n"), indent, F.lit("  CALLS:"), F.array_join(F.transform("calls", lambda c: F.concat(F.lit("\n"), indent, F.lit("    → "), c)), ""))).otherwise("")
    bases = F.when(F.size("bases") > 0, F.concat(F.lit("\n  Inherits from: "), F.array_join("bases", ", "))).otherwise("")
    block = F.when(F.col("type") == "class", F.concat(F.lit("CLASS: "), "name", bases)).when(F.col("type") == "method", F.concat(F.lit("\n  METHOD: "), "name", listed)).otherwise(F.concat(F.lit("\nFUNCTION: "), "name", listed))
    blocks = ordered(rows.withColumn("block", block), "file", "pos", F.col("block"), "blocks")
    whole = good.select("file").join(blocks, "file", "left")
    return whole.select("file", F.concat(F.lit("CODE STRUCTURE\n\nFile: "), "file", F.lit("\n\n"), F.coalesce(F.array_join("blocks", "\n"), F.lit(""))).alias("report"))


def symbols(rows: DataFrame, shown: int = SHOWN_SYMBOLS) -> DataFrame:
    """(n_symbols, report): how many symbols there are, and the first by file and line."""
    first = rows.orderBy("file", "line", "qualified_name").limit(shown)  # a report shows a few
    line = F.concat_ws(" | ", "qualified_name", "type", "file", F.concat(F.lit("line "), F.col("line").cast("string")))
    head = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "qualified_name", line.alias("text")))), lambda s: s["text"]), "\n").alias("head"))
    total = rows.agg(F.count(F.lit(1)).alias("n_symbols"))
    text = F.concat(F.lit("Total symbols: "), F.col("n_symbols").cast("string"), F.lit(f"\n\nFirst {shown} symbols:\n\n"), "head")
    return total.crossJoin(F.broadcast(head)).select("n_symbols", text.alias("report"))  # one row each


def context(made: DataFrame, relationships: DataFrame) -> DataFrame:
    """(qid, report) of contexts and the relationships of their results: each relation once, where it comes first."""
    nodes = made.select("qid", F.posexplode("results").alias("pos", "node"))
    near = nodes.join(relationships, "node").groupBy("qid", "direction", "type", "source", "target").agg(F.min(F.struct("pos", "place")).alias("at"))
    line = F.when(F.col("direction") == "incoming", F.concat("target", F.lit(" <- "), "type", F.lit(" - "), "source")).otherwise(F.concat("source", F.lit(" - "), "type", F.lit(" -> "), "target"))
    near = ordered(near.withColumn("line", line), "qid", "at", F.col("line"), "near")
    numbered = lambda items, render: F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), render(x)))
    rows = made.join(near, "qid", "left")
    lines = F.concat(
        F.array(F.lit(f"\n{RULE}"), F.lit("CODEBASE CONTEXT"), F.lit(RULE)),
        F.when(F.coalesce("query", F.lit("")) != "", F.array(F.concat(F.lit("\nQUERY:\n"), "query"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("\nRETRIEVED RESULTS:")),
        numbered("results", lambda x: x),
        F.array(F.lit("\nIMPLEMENTATION PATHS:")),
        numbered("implementation_paths", lambda p: F.array_join(p, " -> ")),
        F.array(F.lit("\nGRAPH RELATIONSHIPS:")),
        F.coalesce("near", F.array().cast("array<string>")),
        F.array(F.lit(RULE)),
    )
    return rows.select("qid", F.array_join(lines, "\n").alias("report"))
