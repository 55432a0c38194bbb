"""Fusing ranked lists, scoring anew, and explaining the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline import config
from quarryline.functions import text as T


def seeds(*ranked: DataFrame) -> DataFrame:
    """The distinct (qid, name) of several candidate lists."""
    every = ranked[0].select("qid", "name")
    for r in ranked[1:]:
        every = every.union(r.select("qid", "name"))
    return every.distinct()


def fuse(bm25: DataFrame, semantic: DataFrame, graph: DataFrame, rrf_k: int = config.RRF_K, graph_share: float = config.GRAPH_SHARE) -> DataFrame:
    """(qid, id, rrf_score, sources, evidence) from three lists (qid, id, rank).

    A full outer join of the lists, as one union and one aggregation. Rows without an id are dropped; the ranks
    of the others do not change.
    """
    lists = (("bm25", bm25, 1.0), ("semantic", semantic, 1.0), ("graph", graph, graph_share))
    every = None
    for name, rows, share in lists:
        part = rows.where(F.col("id").isNotNull()).select("qid", "id", F.lit(name).alias("source"), F.col("rank").cast("long").alias("rank"), (share / (rrf_k + F.col("rank"))).alias("gain"))
        every = part if every is None else every.unionByName(part)
    sums = {}
    for name, _, share in lists:
        own = F.col("source") == name
        more = [F.lit(share).alias("graph_weight")] if name == "graph" else []
        sums[name] = F.when(F.max(F.when(own, 1)) == 1, F.struct(F.min(F.when(own, F.col("rank"))).alias("rank"), F.sum(F.when(own, F.col("gain"))).alias("rrf_contribution"), *more)).alias(name)
    # The gains are added in a fixed order, so that equal inputs give equal sums.
    gain = lambda name: F.coalesce(F.col(f"{name}.rrf_contribution"), F.lit(0.0))
    out = every.groupBy("qid", "id").agg(F.sort_array(F.collect_set("source")).alias("sources"), *sums.values())
    return out.select("qid", "id", (gain("bm25") + gain("semantic") + gain("graph")).alias("rrf_score"), "sources", F.struct(*sums).alias("evidence"))


def query_features(queries: DataFrame, expansions=config.EXPANSIONS) -> DataFrame:
    """(qid, query) with expanded, tokens and identifiers: computed once per query, not once per candidate."""
    rows = queries.withColumn("expanded", T.expand(F.col("query"), expansions))
    return rows.withColumns({"tokens": T.query_tokens(F.col("query")), "identifiers": T.identifiers(F.col("expanded"))})


def rank(fused: DataFrame, documents: DataFrame, features: DataFrame, top_k: int = 5, identifier_weight: float = config.IDENTIFIER_WEIGHT, stop_words=config.STOP_WORDS) -> DataFrame:
    """The ``top_k`` results of each query by final score, then fused score, then id, with evidence and explanation."""
    rows = fused.join(documents.select("id", "qualified_name", "file", "line"), "id").join(features.select("qid", "query", "tokens", "identifiers"), "qid")
    name = F.col("qualified_name")
    rows = rows.withColumns(
        {
            "identifier_score": T.identifier_score(F.col("identifiers"), name),
            "name_match_score": T.name_score(F.col("tokens"), T.name_tokens(name), stop_words),
            "entity_match_score": T.entity_score(F.col("tokens"), name),
        }
    )
    final = F.col("rrf_score") + identifier_weight * F.col("identifier_score") + config.NAME_WEIGHT * F.col("name_match_score") + config.ENTITY_WEIGHT * F.col("entity_match_score")
    rows = rows.withColumn("final_score", final)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("final_score", 9)), F.desc(F.round("rrf_score", 9)), "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    scored = lambda c: F.struct(F.col(c).alias("score"))
    evidence = F.struct("evidence.*", scored("identifier_score").alias("identifier"), scored("name_match_score").alias("name_match"), scored("entity_match_score").alias("entity_match"))
    rows = rows.withColumn("evidence", evidence).withColumn("explanation", explain(F.col("evidence")))
    return rows.select(
        "qid", "query", "rank", F.col("id").alias("document_id"), "qualified_name", "file", "line", "rrf_score", "identifier_score",
        "name_match_score", "entity_match_score", "final_score", F.lit(None).cast("double").alias("rerank_score"), "sources", "evidence", "explanation",
    )


def explain(evidence: Column) -> Column:
    """Sentences on where a result came from."""
    at = lambda source, words: F.when(evidence[source].isNotNull(), F.concat(F.lit(f"{words} at rank "), evidence[source]["rank"].cast("string")))
    score = evidence["identifier"]["score"]
    found = F.array_compact(
        F.array(
            at("bm25", "BM25 retrieved this result"),
            at("semantic", "Semantic retrieval found this result"),
            at("graph", "Code graph retrieved this result"),
            F.when(score == 1.0, "Exact identifier match detected").when(score > 0, "Partial identifier match detected"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Result was retrieved by the hybrid search system")))
