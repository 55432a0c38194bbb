"""Quality selection by importance resampling.

Two bag models over hashed word uni- and bigrams are estimated: one of target text (rows labelled as good), one
of all raw text. A document's log importance is the sum of its n-grams' log ratios. Resampling without
replacement adds Gumbel noise and keeps the ``k`` largest sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.textnp import BASE, code_points, mixed, slices, word_char, word_hashes, word_spans
from quarryline.runtime import written

#: Bins for the search of the k-th largest sum; only the bin that holds it is ranked.
BINS = 4096
#: At most so many ids of good documents are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def gram_slots(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed uni- and bigrams of all texts and the text that each belongs to.

    Tokens are runs of word characters and runs of other characters than blanks.
    """
    points, text_ends = code_points([t.lower() for t in texts])
    words, marks = word_spans(points), word_spans(points, lambda c: not c.isspace() and not word_char(c))
    starts, ends = (np.sort(np.concatenate(x)) for x in zip(words, marks, strict=True))
    h = word_hashes(points, starts, ends)
    row = np.searchsorted(text_ends, starts, side="right")
    pair = mixed(h[:-1] * np.uint64(BASE) + h[1:]) if len(h) else h
    same = row[:-1] == row[1:]
    return (np.concatenate([h, pair[same]]) % np.uint64(slots)).astype(np.int64), np.concatenate([row, row[:-1][same]])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(2)).cast("int")


def gram_totals(rows: DataFrame, slots: int) -> np.ndarray:
    """(2 x slots): how often each slot occurs in the texts of either fold; every task sends one sum per slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * slots, np.int64)
        for batch in batches:
            texts, part = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            for a, b in slices(texts, 1 << 20):
                slot, row = gram_slots(texts[a:b], slots)
                total += np.bincount(slot + slots * part[a:b][row], minlength=2 * slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * slots, dtype=np.int32)), pa.array(total)], ["slot", "n"])

    table = rows.select("text", fold(F.col("doc_id")).alias("fold")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(2 * slots, np.int64)
    out[table["slot"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(2, slots)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(2 x slots): for each fold the log ratio of the models, the target's from the texts of the other fold.

    So no document is judged by a model that has seen it. The raw model is smoothed by one occurrence per
    slot, the target's by as many in all, spread like the raw model. 0 without target text.
    """
    slots = target.shape[1]
    base = (raw.sum(0) + 1) / (raw.sum() + slots)
    seen = target[::-1]
    return np.log((seen + slots * base) / (seen.sum(1, keepdims=True) + slots)) - np.log(base)


def importance(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, log_ratio) of every row and whole text; null counts as empty."""
    held, slots = docs.sparkSession.sparkContext.broadcast(ratios.ravel()), ratios.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part = [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_numpy()
            sums = [np.zeros(0)]
            for a, b in slices(texts, 1 << 20):
                slot, row = gram_slots(texts[a:b], slots)
                sums.append(np.bincount(row, weights=held.value[slot + slots * part[a:b][row]], minlength=b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.concatenate(sums), 6))], ["doc_id", "log_ratio"])

    return docs.select(F.col("doc_id").cast("long"), "text", fold(F.col("doc_id")).alias("fold")).mapInArrow(score, "doc_id long, log_ratio double")


def top_k(rows: DataFrame, by: str, k: int, ties: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``selected``: whether it is one of the ``k`` largest in ``by``, then smallest in ``ties``.

    Counts of bins find the bin of the k-th row; only its rows are ranked.
    """
    edges = rows.agg(F.percentile_approx(by, [i / BINS for i in range(1, BINS)], 4 * BINS)).first()[0] or []
    bound = np.array(sorted(set(edges)))
    place = F.pandas_udf(lambda v: pd.Series(np.searchsorted(bound, v.to_numpy(), side="right").astype(np.int32)), "int")
    rows = written(rows.withColumn("_bin", place(F.col(by))), "binned")
    counts = sorted(((r["_bin"], r["n"]) for r in rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # BINS rows at most
    cut, rest = -1, 0
    above = 0
    for b, n in counts:
        if above + n > k:
            cut, rest = b, k - above
            break
        above += n
    order = Window.partitionBy("_bin").orderBy(F.col(by).desc(), *ties)
    inside = rows.where(F.col("_bin") == cut).withColumn("selected", F.row_number().over(order) <= rest)
    return rows.where(F.col("_bin") != cut).withColumn("selected", F.col("_bin") > cut).unionByName(inside).drop("_bin")


def resample(docs: DataFrame, labels: DataFrame, slots: int = 1 << 14, share: float | None = None, seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, log_ratio, sampling_key, selected.

    The target model is fitted on the texts of every document that all its labels call good (quality 1, not
    toxic); the raw model on all documents.
    ``share`` of all rows is selected; by default the share of good ones among the labelled. The noise
    depends on ``seed`` and doc_id only. Null and empty texts have log_ratio 0. Without labels no row is
    preferred and all are selected. Ties go to the smaller doc_id. An empty table gives no rows; other
    columns are ignored.
    """
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(((F.min("quality") >= 1) & (F.coalesce(F.max("toxic"), F.lit(0)) < 1)).alias("good"))
    judged = judged.withColumn("good", F.coalesce("good", F.lit(False)))
    total, n_good = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    if share is None:
        share = n_good / total if total and n_good else 1.0
    chosen = judged.where("good").select("doc_id")
    chosen = F.broadcast(chosen) if n_good <= BROADCAST_ROWS else chosen.hint("merge")
    target = gram_totals(docs.join(chosen, "doc_id", "left_semi"), slots)
    rows = importance(docs, log_ratios(target, gram_totals(docs, slots)))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    rows = rows.withColumn("sampling_key", F.round(F.col("log_ratio") - F.log(-F.log(uniform)), 6))
    rows = written(rows, "importance")
    return top_k(rows, "sampling_key", round(share * rows.count()), ("doc_id", "log_ratio"))
