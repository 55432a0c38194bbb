"""Retrieval metrics and reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import top_folder


def first_hits(cases: DataFrame, ranked: DataFrame, depth: int = 5) -> DataFrame:
    """``cases`` (qid, expected) with ``rank``, the first place of the expected name among the ``depth`` first, or null."""
    hits = ranked.where(F.col("rank") <= depth).groupBy("qid", F.col("name").alias("expected")).agg(F.min("rank").alias("rank"))
    return cases.join(hits, ["qid", "expected"], "left")


def metrics(cases: DataFrame, ranked: DataFrame, depth: int = 5) -> DataFrame:
    """(n_cases, recall, mrr) over all cases."""
    found = first_hits(cases, ranked, depth)
    return found.agg(F.count(F.lit(1)).alias("n_cases"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def diagnose(cases: DataFrame, ranked: DataFrame, depth: int = 10) -> DataFrame:
    """The first ``depth`` of each case's ranking, with ``expected`` marked."""
    rows = ranked.where(F.col("rank") <= depth).join(cases.select("qid", F.col("expected").alias("want")), "qid")
    return rows.withColumn("is_expected", F.col("name") == F.col("want")).drop("want")


def folder_histogram(files: DataFrame, path: str = "file") -> DataFrame:
    """(folder, n), the most frequent first."""
    return files.groupBy(top_folder(F.col(path)).alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder")


class Stages:
    """A clock of a batch's stages, each from the end of the one before it; ``rows`` of a stage have ``qid``."""

    def __init__(self) -> None:
        self.began = self.last = time.perf_counter()
        self.spent: list[tuple[str, float, DataFrame]] = []

    def end(self, name: str, rows: DataFrame) -> None:
        now = time.perf_counter()
        self.spent.append((name, now - self.last, rows))
        self.last = now

    @property
    def seconds(self) -> float:
        return self.last - self.began


def latencies(queries: DataFrame, stages: Stages) -> DataFrame:
    """(qid, stage, n_rows, seconds): each question's share of each stage of a batch, by the rows the stage made for it.

    A batch's questions are worked on together, so a question has no time of its own; a stage's seconds are spread by
    rows, with one more for each question, so that one without rows has its share of what all of them cost. Over all
    questions and stages the seconds sum to the measured ones. Rows of one qid are one question; a null qid is one too.
    """
    every = queries.select("qid").distinct()
    count = every.count()
    out = every.limit(0).select("qid", F.lit("").alias("stage"), F.lit(0).cast("long").alias("n_rows"), F.lit(0.0).alias("seconds"))
    for name, spent, rows in stages.spent:
        made = rows.groupBy(F.col("qid").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        total = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + count
        n = F.coalesce("n", F.lit(0))
        part = every.join(made, F.col("qid").eqNullSafe(F.col("of")), "left")
        out = out.unionByName(part.select("qid", F.lit(name).alias("stage"), n.alias("n_rows"), (F.lit(spent) * (n + 1) / F.lit(total)).alias("seconds")))
    return out
