"""Call paths through retrieved symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.edges import first_edges, valid_edges

PATH_NODES = 8
#: Documents named here follow a deferred edge: (source, target) rows, whose target is taken before any CALLS.


def build_paths(results: DataFrame, edges: DataFrame, deferred: DataFrame | None = None, known: DataFrame | None = None, max_nodes: int = PATH_NODES, max_paths: int = 5) -> DataFrame:
    """(qid, path, score, rank) from results (qid, name, rank).

    From each retrieved name, the first CALLS target in edge order that is retrieved and not on the path yet is
    followed, up to ``max_nodes`` names. A ``deferred`` edge (source, target) to a name of ``known`` is taken first.
    Equal paths count once, from the best rank; they are ranked by 10 per node and 5 per retrieved node.

    A query's retrieved names and their targets travel as one small map per query, so a path is one expression.
    """
    first = results.groupBy("qid", "name").agg(F.min("rank").alias("rank"))
    none = F.array().cast("array<string>")
    # Of a name's targets only those travel that its own query has retrieved.
    hops = valid_edges(edges).where(F.col("type") == "CALLS").select(F.col("source").alias("name"), "target", "ord").join(first.select("qid", "name"), "name")
    hops = hops.join(first.select("qid", F.col("name").alias("target")), ["qid", "target"], "left_semi")
    hops = hops.groupBy("qid", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("targets"))
    if deferred is not None:
        late = deferred.select(F.col("source").alias("node"), F.col("target").alias("late"))
        if known is not None:
            late = late.join(known.select(F.col("qualified_name").alias("late")).distinct(), "late", "left_semi")
        late = late.groupBy("node").agg(F.array_sort(F.collect_list("late")).alias("late"))
    else:
        late = results.sparkSession.createDataFrame([], "node string, late array<string>")
    # Deferred targets may lead outside the results, from where a deferred edge may lead on.
    far = late.agg(F.map_from_entries(F.collect_list(F.struct("node", "late"))).alias("deferred"))
    maps = first.join(hops, ["qid", "name"], "left").groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("targets", none)))).alias("targets"),
        F.collect_set("name").alias("allowed"),
    )
    rows = first.join(maps, "qid").crossJoin(F.broadcast(far))  # one row, the configured deferred edges

    def grow(path, _):
        last = F.element_at(path, -1)
        fresh = lambda x: ~F.array_contains(path, x)
        late = F.filter(F.coalesce(F.try_element_at("deferred", last), none), fresh)
        plain = F.filter(F.coalesce(F.try_element_at("targets", last), none), lambda x: fresh(x) & F.array_contains("allowed", x))
        return F.concat(path, F.slice(F.concat(late, plain), 1, 1))

    path = F.aggregate(F.sequence(F.lit(2), F.lit(max_nodes)), F.array("name"), grow)
    rows = rows.withColumn("path", path).withColumn("inside", F.size(F.array_intersect("path", "allowed")))
    rows = rows.groupBy("qid", "path").agg(F.min("rank").alias("start"), F.max(10 * F.size("path") + 5 * F.col("inside")).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "start"))
    return rows.withColumn("rank", place).where(F.col("rank") <= max_paths).select("qid", "path", "score", F.col("rank").cast("long").alias("rank"))


def path_steps(paths: DataFrame, edges: DataFrame, deferred: DataFrame | None = None) -> DataFrame:
    """(qid, rank, step, source, target, type, line): the hops of each path with their first edge's type.

    A hop without an edge is DEFERRED if the table says so, else UNKNOWN.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("step"), F.get("path", i - 1).alias("source"), F.get("path", i).alias("target")))
    hops = paths.where(F.size("path") > 1).select("qid", "rank", F.explode(pairs).alias("s")).select("qid", "rank", F.col("s.step").cast("long").alias("step"), "s.source", "s.target")
    wanted = hops.select("source", "target").distinct()
    found = first_edges(edges.join(wanted, ["source", "target"], "left_semi"))
    rows = hops.join(found, ["source", "target"], "left")
    if deferred is None:
        late = F.lit(None).cast("string")
    else:
        rows = rows.join(deferred.select("source", "target", F.lit("DEFERRED").alias("late")).distinct(), ["source", "target"], "left")
        late = F.col("late")
    return rows.select("qid", "rank", "step", "source", "target", F.coalesce("type", late, F.lit("UNKNOWN")).alias("type"), "line")


def path_results(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(qid, rank, path, steps): each path with its steps in order."""
    listed = steps.groupBy("qid", "rank").agg(F.array_sort(F.collect_list(F.struct("step", "source", "target", "type", "line"))).alias("steps"))
    empty = F.array().cast("array<struct<step:bigint,source:string,target:string,type:string,line:int>>")
    return paths.join(listed, ["qid", "rank"], "left").select("qid", "rank", "path", F.coalesce("steps", empty).alias("steps"))
