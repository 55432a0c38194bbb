"""Graph proximity: weighted evidence from the neighbourhood of seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline import config
from quarryline.operators.edges import undirected


def edge_weight(kind: Column, weights=config.EDGE_WEIGHTS, other: float = config.OTHER_EDGE_WEIGHT) -> Column:
    out = F.lit(other)
    for name, value in weights.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def scores(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int = 2) -> DataFrame:
    """(qid, name, score) from seeds (qid, name).

    A node at distance d < max_depth from the nearest seed gives each neighbour weight / (d + 1), once per edge.
    Distances ignore directions, DEFINES and loops; seeds that are no nodes are dropped. The levels are unrolled
    into joins on one table of half edges, so that the number of shuffles is fixed by ``max_depth``.
    """
    half = undirected(edges.where((F.col("type") != "DEFINES") & (F.col("source") != F.col("target"))))
    half = half.groupBy("source", "target").agg(F.sum(edge_weight(F.col("type"))).alias("w"))
    front = seeds.select("qid", "name").distinct().join(nodes.select(F.col("qualified_name").alias("name")).distinct(), "name", "left_semi").select("qid", "name")
    seen, given = front, None
    for depth in range(max_depth):
        step = front.join(half, front["name"] == half["source"]).select("qid", F.col("target").alias("name"), (F.col("w") / (depth + 1)).alias("score"))
        given = step if given is None else given.unionByName(step)
        if depth + 1 < max_depth:
            front = step.select("qid", "name").distinct().join(seen, ["qid", "name"], "left_anti")
            seen = seen.unionByName(front)
    return given.groupBy("qid", "name").agg(F.sum("score").alias("score"))


def top(scored: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(qid, qualified_name, file, line, type, score, rank): the ``k`` best, of which those that are no nodes then go.

    Ties go to the smaller name. So fewer than ``k`` rows are possible; the ranks are given anew.
    """
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "name")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    found = best.join(nodes.select("qualified_name", "file", "line", "type"), F.col("name") == F.col("qualified_name"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return found.withColumn("rank", rank).select("qid", "qualified_name", "file", "line", "type", "score", "rank")
