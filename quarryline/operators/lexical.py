"""BM25 over postings, with bounds for blocks of documents.

Documents whose ids lie together form a block. For each term and block the greatest weight that a document of the block
gets is kept. Where the postings of all queries are many, a search goes by these bounds: the blocks with the greatest
sums are scored first, and the score of the k-th document found is a threshold. In any other block, the terms with the
least bounds that stay below the threshold together cannot bring a document into the result; only documents with one of
the remaining terms are met, and only those whose bound reaches the threshold are scored. A block without remaining
terms is skipped.

Where the queries' terms are few, a document's postings of these terms make one row, and numpy adds them up for all queries
within the task: only the best of each batch of documents leave it, not a row for each query and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline import config
from quarryline.functions.text import tokenize
from quarryline.operators.vectors import best_of
from quarryline.runtime import written

#: Up to so many terms of all queries together, their table is broadcast; so is what they want of blocks.
SMALL_ROWS = 100_000
#: Ids of a block, and blocks of a query that are scored to find its threshold.
BLOCK_IDS, FIRST_BLOCKS = 64, 16
#: Up to so many meetings of a query's term with a document, all are scored, which costs less than bounds do.
SCORE_ALL = 200_000_000
#: So many times more where no meeting becomes a row; tokens, meetings, and scores, that a task holds at once.
WITHIN_ROWS, AT_ONCE = 50, 1 << 21


@dataclass
class LexicalIndex:
    """``postings`` (term, id, tf, length), ``terms`` (term, df), ``corpus`` (n_docs, avgdl, mean_raw), ``ids`` and
    ``blocks`` (term, block, best): the greatest weight of a term in a block, before its idf."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    ids: DataFrame
    blocks: DataFrame

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("terms", "corpus", "ids", "blocks"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "corpus", "ids", "blocks")))


def block_of(id_: Column) -> Column:
    return F.floor(id_ / BLOCK_IDS)


def weight(k1: float, b: float) -> Column:
    """What an occurrence count and a length make of a term, before its idf."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))


def _counted(tokens: DataFrame) -> DataFrame:
    """(id, length, term, tf, leads) of (id, tokens), whose ids differ: each document's terms are counted in its own task.

    A document's first row leads; one without tokens has that row alone, without a term.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            yield batch.slice(a, z - a)
            a = z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in ((some.column(0), some.column(1)) for batch in batches for some in cut(batch)):
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            n_terms = len(coded.dictionary)
            own = np.concatenate([np.repeat(np.arange(len(ids)), lengths), np.flatnonzero(lengths == 0)])
            codes = np.concatenate([coded.indices.to_numpy(), np.full((lengths == 0).sum(), n_terms)])
            found, tf = np.unique(own * (n_terms + 1) + codes, return_counts=True)
            doc, code = found // (n_terms + 1), found % (n_terms + 1)
            leads = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
            term = coded.dictionary.take(pa.array(code, mask=code == n_terms))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(lengths[doc]), term, pa.array(np.where(code == n_terms, 0, tf)), pa.array(leads)], ["id", "length", "term", "tf", "leads"])

    return tokens.mapInArrow(run, f"id {tokens.schema['id'].dataType.simpleString()}, length long, term string, tf long, leads boolean")


def build_index(docs: DataFrame, text="text", keep: bool = True, k1: float = config.BM25_K1, b: float = config.BM25_B) -> LexicalIndex:
    """Index (id, text). Statistics cover the whole vocabulary, which the floor of rare weights needs.

    The bounds of the blocks hold for ``k1`` and ``b``; they are made when a search goes by them, or the index is saved.
    """
    tokens = docs.select("id", tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        counts = _counted(tokens)
    else:  # rows with one id and length count as one document
        words = tokens.select("id", F.size("tokens").cast("long").alias("length"), F.posexplode_outer("tokens").alias("pos", "term"))
        # The row of a document's first token, or of a document without one, stands for the document.
        counts = words.groupBy("id", "length", "term").agg(F.count("term").alias("tf"), (F.coalesce(F.min("pos"), F.lit(0)) == 0).alias("leads"))
    if keep:
        counts = written(counts, "postings")
    postings = counts.where(F.col("term").isNotNull()).select("term", "id", "tf", "length")
    ids = counts.where("leads").select("id", "length")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if keep:
        terms = written(terms, "terms")
    size = ids.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = terms.crossJoin(F.broadcast(size)).agg(F.avg(raw).alias("mean_raw"))  # one row each
    corpus = size.crossJoin(mean)
    corpus = written(corpus, "corpus") if keep else corpus
    blocks = postings.crossJoin(F.broadcast(corpus)).groupBy("term", block_of(F.col("id")).alias("block")).agg(F.max(weight(k1, b)).alias("best"))  # one row
    return LexicalIndex(postings, terms, corpus, ids, blocks)


def query_terms(index: LexicalIndex, queries: DataFrame, epsilon: float = config.BM25_EPSILON) -> DataFrame:
    """(qid, term, times, idf, avgdl, df) of the terms of queries (qid, query) that the index has.

    A term of the query counts as often as it occurs there. Negative weights become ``epsilon`` times the mean
    weight of the vocabulary.
    """
    asked = queries.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    corpus = F.broadcast(index.corpus)  # one row
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = asked.join(index.terms, "term").crossJoin(corpus).withColumn("idf", F.when(raw < 0, epsilon * F.col("mean_raw")).otherwise(raw))
    return weighed.select("qid", "term", "times", "idf", "avgdl", "df")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _summed(hits: DataFrame, k1: float, b: float) -> DataFrame:
    return hits.groupBy("qid", "id").agg(F.sum(F.col("times") * F.col("idf") * weight(k1, b)).alias("score"))


def _best_by_documents(index: LexicalIndex, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(qid, id, score, key) with the ``k`` best scored documents of each query among them; ``terms`` are few."""
    spark, asked = terms.sparkSession, terms.toArrow().combine_chunks()  # SMALL_ROWS at most
    names, number = np.unique(asked.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
    qids, query = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
    order = np.argsort(number, kind="stable")
    gains = (asked.column("times").to_numpy() * asked.column("idf").to_numpy())[order]
    held = spark.sparkContext.broadcast((np.searchsorted(number[order], np.arange(len(names) + 1)), query[order], gains, qids))
    numbers = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "t": np.arange(len(names), dtype=np.int32)}))
    hits = index.postings.join(F.broadcast(numbers), "term").withColumn("avgdl", F.lit(asked.column("avgdl")[0].as_py()))
    rows = hits.groupBy("id").agg(F.collect_list(F.struct("t", weight(k1, b).alias("w"))).alias("hits"))  # a document's terms that are asked for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, query, gains, qids = held.value
        n_of = np.diff(start)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten()
            t, w = flat.field("t").to_numpy(), flat.field("w").to_numpy()
            ends = np.r_[0, np.cumsum(batch.column(1).value_lengths().to_numpy())]
            meets = np.r_[0, np.cumsum(n_of[t])][ends]
            a = 0
            while a < len(ids):
                z = min(int(np.searchsorted(meets, meets[a] + AT_ONCE, "right")) - 1, a + AT_ONCE // len(qids), len(ids))
                z = max(z, a + 1)
                some = slice(ends[a], ends[z])
                fan = n_of[t[some]]
                at = np.repeat(start[t[some]] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
                doc = np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
                cell = np.repeat(doc * len(qids), fan) + query[at]
                score = np.bincount(cell, np.repeat(w[some], fan) * gains[at], (z - a) * len(qids))
                score[np.bincount(cell, minlength=len(score)) == 0] = -np.inf  # no term in common
                score = score.reshape(z - a, len(qids))
                keys = np.round(score, 9)
                row, column = best_of(ids[a:z], keys, k)
                met = keys[row, column] > -np.inf
                row, column = row[met], column[met]
                yield pa.RecordBatch.from_arrays([pa.array(qids[column]), pa.array(ids[a:z][row]), pa.array(score[row, column]), pa.array(keys[row, column])], ["qid", "id", "score", "key"])
                a = z

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"qid {kind(terms, 'qid')}, id {kind(rows, 'id')}, score double, key double")


def _numbered(terms: DataFrame, index: LexicalIndex) -> bool:
    """Whether queries are few and they and the documents go by numbers, as numpy sorts them."""
    whole = all(df.schema[c].dataType.simpleString() in ("int", "bigint") for df, c in ((terms, "qid"), (index.postings, "id")))
    return whole and 0 < terms.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def scores(index: LexicalIndex, queries: DataFrame, k1: float = config.BM25_K1, b: float = config.BM25_B, epsilon: float = config.BM25_EPSILON) -> DataFrame:
    """(qid, id, score) of all documents that share a term with a query (qid, query)."""
    return _summed(index.postings.join(_sized(query_terms(index, queries, epsilon)), "term"), k1, b)


def block_bounds(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """(qid, block, term, bound): no document of the block gets more from the term; one of negative weight may be missing."""
    met = index.blocks.join(_sized(terms), "term")
    return met.select("qid", "block", "term", (F.greatest(F.col("idf"), F.lit(0.0)) * F.col("times") * F.col("best")).alias("bound"))


def block_hits(index: LexicalIndex, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings, with the query's weights, that the ``wanted`` (qid, block, term) meet."""
    need = written(wanted.select("qid", "block", "term").join(terms, ["qid", "term"]), "wanted-blocks")
    return index.postings.withColumn("block", block_of(F.col("id"))).join(_sized(need), ["term", "block"])


def best_in_blocks(index: LexicalIndex, terms: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best scored documents of each query (qid, id, score, key), and the (qid, block, term) that were met."""
    order = Window.partitionBy("qid").orderBy(F.desc("key"), "id")
    rank, key = F.row_number().over(order), F.round("score", 9)
    bounds = written(block_bounds(index, terms), "block-bounds")
    sums = bounds.groupBy("qid", "block").agg(F.sum("bound").alias("bound"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block"))
    first = written(sums.withColumn("place", place).where(F.col("place") <= FIRST_BLOCKS).select("qid", "block"), "first-blocks")
    met = bounds.join(first, ["qid", "block"], "left_semi")
    found = written(_summed(block_hits(index, terms, met), k1, b).withColumn("key", key).withColumn("rank", rank).where(F.col("rank") <= k), "first-scores")

    reached = found.where(F.col("rank") == k).select("qid", (F.col("key") - 2e-9).alias("least"))  # keys are rounded, and equal ones count
    rest = bounds.join(first, ["qid", "block"], "left_anti").join(reached, "qid", "left")
    by_bound = Window.partitionBy("qid", "block").orderBy("bound", "term")
    needed = F.col("least").isNull() | (F.sum("bound").over(by_bound) >= F.col("least"))
    rest = written(rest.withColumn("needed", needed), "other-blocks")
    needed = rest.where("needed")
    slack = rest.groupBy("qid", "block").agg(F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("bound"))).alias("slack"), F.first("least").alias("least")).where("least is not null")
    parts = block_hits(index, terms, needed).groupBy("qid", "block", "id").agg(F.sum(F.col("times") * F.col("idf") * weight(k1, b)).alias("part"))
    able = F.col("least").isNull() | (F.col("part") + F.col("slack") >= F.col("least"))
    likely = written(parts.join(slack, ["qid", "block"], "left").where(able).select("qid", "block", "id"), "likely-documents")
    more = rest.join(likely.select("qid", "block").distinct(), ["qid", "block"], "left_semi")
    more = block_hits(index, terms, more).join(likely.select("qid", "id"), ["qid", "id"], "left_semi")
    every = found.drop("rank").unionByName(_summed(more, k1, b).withColumn("key", key))
    read = met.unionByName(needed.select(met.columns)).select("qid", "block", "term")
    return every.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), read


def top(index: LexicalIndex, queries: DataFrame, k: int = 5, k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
    """(qid, id, score, rank): the ``k`` best of all documents, ties to the smaller id.

    Documents without a term of the query have score 0 and fill the tail in order of their ids. A query lacks
    at most ``k`` of them, and those are among the ``2 k`` smallest ids, or the query has ``k`` scored documents with
    smaller ids and, unless scores are negative, no tail. So no query meets every document. ``k1`` and ``b`` are those
    of the index.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("key"), "id")
    terms = written(query_terms(index, queries), "query-terms")
    few = _numbered(terms, index)
    if terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] <= SCORE_ALL * (WITHIN_ROWS if few else 1):
        best = _best_by_documents(index, terms, k, k1, b) if few else _summed(index.postings.join(_sized(terms.drop("df")), "term"), k1, b).withColumn("key", F.round("score", 9))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    else:
        best, _ = best_in_blocks(index, terms.drop("df"), k, k1, b)
    firsts = F.broadcast(index.ids.select("id").orderBy("id").limit(2 * k))  # 2 k rows
    # Which of those few share a term with a query.
    theirs = index.postings.join(firsts, "id", "left_semi").join(_sized(terms.select("qid", "term")), "term").select("qid", "id").distinct()
    filler = queries.select("qid").distinct().crossJoin(firsts).join(theirs, ["qid", "id"], "left_anti")
    filler = filler.select("qid", "id", F.lit(0.0).alias("score"), F.lit(0.0).alias("key"))
    every = best.unionByName(filler)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")
