"""The engine as one object: build or open an index of a source tree, search, make contexts and answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import config
from quarryline.functions import text as T
from quarryline.operators import answers, context, edges, evaluation, fusion, lexical, paths, providers, proximity, vectors
from quarryline.plans.pyast import code_features, parse_sources
from quarryline.runtime import written
from quarryline.sources.files import DOCUMENT, EDGE, read_index, read_sources, write_index

Encoder = Callable[[list[str]], np.ndarray]


@dataclass
class Settings:
    """The configurable tables of an engine."""

    expansions: tuple = config.EXPANSIONS
    stop_words: tuple[str, ...] = config.STOP_WORDS
    attribute_types: tuple = config.ATTRIBUTE_TYPES
    deferred: tuple = config.DEFERRED
    rules: tuple = config.RULES


@dataclass
class CodeIndex:
    """Documents, edges, postings and, if an encoder or vectors are given, embeddings of a source tree."""

    documents: DataFrame
    graph: DataFrame
    lexical: lexical.LexicalIndex
    embeddings: DataFrame | None = None
    encoder: Encoder | None = None
    errors: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    @classmethod
    def build(cls, sources: DataFrame, encoder: Encoder | None = None, settings: Settings | None = None) -> CodeIndex:
        """Index (file, text). Files that do not parse are listed in ``errors`` and otherwise passed over."""
        settings = settings or Settings()
        parsed = parse_sources(sources)
        documents = written(edges.documents(edges.symbols(parsed)), "documents")
        graph = written(edges.build_graph(parsed, settings.attribute_types)[1], "graph")
        found = vectors.encode(documents.select("id", T.vector_text().alias("text")), encoder) if encoder else None
        postings = lexical.build_index(documents.select("id", T.lexical_text().alias("text")))
        return cls(documents, graph, postings, found, encoder, parsed.where(F.col("error").isNotNull()).select("file", "error"), settings)

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, **more) -> CodeIndex:
        return cls.build(read_sources(spark, root), **more)

    def save(self, path: str) -> None:
        write_index(self.documents, f"{path}/documents")
        write_index(self.graph, f"{path}/graph", ("type",))
        self.lexical.save(f"{path}/lexical")
        if self.embeddings is not None:
            write_index(self.embeddings, f"{path}/embeddings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: Encoder | None = None, settings: Settings | None = None) -> CodeIndex:
        documents = read_index(spark, f"{path}/documents", DOCUMENT)
        graph = read_index(spark, f"{path}/graph", f"{EDGE}, ord long")
        try:
            found = read_index(spark, f"{path}/embeddings", "id long, embedding array<float>")
        except FileNotFoundError:
            found = None
        return cls(documents, graph, lexical.LexicalIndex.load(spark, f"{path}/lexical"), found, encoder, None, settings or Settings())

    def _deferred(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.settings.deferred), "source string, target string, sentence string")

    def search(self, queries: DataFrame, top_k: int = 5, candidate_k: int = 10, rrf_k: int = config.RRF_K, identifier_weight: float = config.IDENTIFIER_WEIGHT, query_vectors: DataFrame | None = None, stages: evaluation.Stages | None = None) -> DataFrame:
        """The ``top_k`` results of each query (qid, query), or of its vector (qid, embedding) if those are given.

        ``stages`` is told when each stage has written its rows; with it the graph's candidates are written as well.
        """
        told = stages.end if stages is not None else lambda name, rows: None
        features = written(fusion.query_features(queries, self.settings.expansions), "query-features")
        told("features", features)
        bm25 = written(lexical.top(self.lexical, features.select("qid", F.col("expanded").alias("query")), candidate_k), "bm25")
        told("bm25", bm25)
        if query_vectors is None and self.encoder is not None:
            query_vectors = vectors.encode(queries.select("qid", F.col("query").alias("text")), self.encoder, "qid")
        if self.embeddings is not None and query_vectors is not None:
            semantic = written(vectors.top(self.embeddings, query_vectors, candidate_k), "semantic")
        else:
            semantic = bm25.limit(0)
        told("semantic", semantic)
        names = edges.last_of_name(self.documents.select("id", "qualified_name", "file", "line", "type"))
        by_id = self.documents.select("id", F.col("qualified_name").alias("name"))
        seeds = fusion.seeds(bm25.join(by_id, "id"), semantic.join(by_id, "id"))
        near = proximity.top(proximity.scores(seeds, self.graph, names), names, candidate_k)
        graph = near.join(names.select("id", "qualified_name"), "qualified_name").select("qid", "id", "rank")
        if stages is not None:
            graph = written(graph, "graph-candidates")
        told("graph", graph)
        fused = fusion.fuse(bm25, semantic, graph, rrf_k)
        results = written(fusion.rank(fused, self.documents, features, top_k, identifier_weight, self.settings.stop_words), "results")
        told("results", results)
        return results

    def enrich(self, results: DataFrame, most: int | None = None) -> DataFrame:
        """Results with their code and their edges, or with ``most`` only those that an answer reads."""
        wanted = results.select(F.col("qualified_name").alias("node")).distinct()
        return context.enrich(results, self.documents, edges.relationships(self.graph, wanted), most)

    def paths(self, results: DataFrame, max_paths: int = 5) -> DataFrame:
        """(qid, rank, path, steps) of the implementation paths through the results."""
        deferred = self._deferred()
        found = paths.build_paths(results.select("qid", F.col("qualified_name").alias("name"), "rank"), self.graph, deferred, self.documents, max_paths=max_paths)
        found = written(found, "paths")
        return paths.path_results(found, paths.path_steps(found, self.graph, deferred))

    def context(self, queries: DataFrame, results: DataFrame, max_results: int | None = None) -> DataFrame:
        kept = context.limited(results, max_results)
        return context.build(queries, kept, self.documents, self.paths(kept))

    def explain_paths(self, results: DataFrame) -> DataFrame:
        """(qid, rank, text): an account of each path."""
        details = edges.last_of_name(self.documents.select("id", "qualified_name", F.col("text").alias("code"), "file", "line"))
        return context.narrate(self.paths(results), edges.first_edges(self.graph), details, self._deferred())

    def answer(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        """(qid, answer) without a language model."""
        return answers.generate(queries, self.enrich(results, answers.MOST_RELATIONSHIPS), code_features())

    def ask(self, queries: DataFrame, provider: str, top_k: int = 5, candidate_k: int = 20) -> DataFrame:
        """(qid, answer) by a provider, from the context of the results. A blank question is told so."""
        asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
        made = written(context.prompt_text(self.context(asked, self.search(asked, top_k, candidate_k)), "implementation_paths"), "prompts")
        path = F.array_join(F.transform("implementation_paths", lambda p: F.array_join(p, " -> ")), "\n")
        rows = queries.select("qid", "query").join(made.select("qid", path.alias("path"), "text"), "qid", "left")
        prompt = providers.prompt(F.col("query"), F.coalesce("path", F.lit("")), F.coalesce("text", F.lit("")))
        return providers.answer_questions(rows.select("qid", "query", prompt.alias("prompt"), F.lit(None).cast("string").alias("explanation")), provider)

    def latencies(self, cases: DataFrame, top_k: int = 5, candidate_k: int = 20) -> tuple[DataFrame, DataFrame, float]:
        """(latencies, results, seconds) of a search for cases (qid, query): see ``evaluation.latencies``."""
        queries = cases.select("qid", "query")
        stages = evaluation.Stages()
        found = self.search(queries, top_k, candidate_k, stages=stages)
        return evaluation.latencies(queries, stages), found, stages.seconds

    def timed_evaluation(self, cases: DataFrame, top_k: int = 5, candidate_k: int = 20) -> DataFrame:
        """(n_cases, recall, mrr, mean_latency, max_latency) of cases (qid, query, expected); latencies are sums of a question's shares of the stages."""
        timed, found, _ = self.latencies(cases, top_k, candidate_k)
        ranked = found.select("qid", F.col("qualified_name").alias("name"), "rank")
        measured = evaluation.metrics(cases.select("qid", "expected"), ranked, top_k)
        each = timed.groupBy("qid").agg(F.sum("seconds").alias("seconds"))
        # Each of the two is one row; a left join on a constant keeps the metrics of no cases.
        spent = each.agg(F.avg("seconds").alias("mean_latency"), F.max("seconds").alias("max_latency"), F.lit(1).alias("one"))
        return measured.withColumn("one", F.lit(1)).join(spent, "one", "left").drop("one")
