"""Scores of names for whole batches of questions, by inverted indexes of the names' parts.

A question meets only names that share a part with it; every pair that is not returned has score 0. So the work grows
with the pairs that score, not with questions times names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline import config
from quarryline.functions import text as T

#: Longest run of characters by which an identifier within a name is sought.
GRAM = 3


def _runs(text: Column, n: int) -> Column:
    """All runs of ``n`` characters."""
    found = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))


def _grams(text: Column) -> Column:
    """All runs of 1 to ``GRAM`` characters of a text, each once."""
    return F.array_distinct(F.concat(*[_runs(text, n) for n in range(1, GRAM + 1)]))


def name_scores(asked: DataFrame, names: DataFrame, stop_words=config.STOP_WORDS) -> DataFrame:
    """(qid, id, score): the share of a question's meaningful ``tokens`` that a name has, where it has one."""
    wanted = asked.select("qid", F.array_except("tokens", T.strings(stop_words)).alias("wanted")).where(F.size("wanted") > 0)
    wanted = wanted.select("qid", F.size("wanted").alias("n"), F.explode("wanted").alias("part"))
    parts = names.select("id", F.explode(T.name_tokens(F.col("name"))).alias("part"))
    return wanted.join(parts, "part").groupBy("qid", "id").agg((F.count(F.lit(1)) / F.first("n")).alias("score"))


def entity_scores(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, id, score): 1 where the first part of a name is one of the question's ``tokens``."""
    wanted = asked.select("qid", F.explode(F.array_distinct("tokens")).alias("part"))
    return wanted.join(names.select("id", F.lower(T.first_part(F.col("name"))).alias("part")), "part").select("qid", "id", F.lit(1.0).alias("score"))


def identifier_scores(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, id, score): 1 where one of the question's ``identifiers`` is the name or a dotted part of it, 0.5 where it
    lies within the name.

    An identifier within a name shares all its runs of characters with it; it is met through the rarest of its longest.
    """
    wanted = asked.select("qid", F.explode(F.transform("identifiers", lambda x: F.lower(x))).alias("part")).distinct()
    low = names.select("id", F.lower("name").alias("low"))
    whole = low.select("id", F.explode(F.array_distinct(F.concat(F.split("low", r"\."), F.array("low")))).alias("part"))
    exact = wanted.join(whole, "part").select("qid", "id", F.lit(1.0).alias("score"))
    grams = low.select("id", "low", F.explode(_grams(F.col("low"))).alias("gram"))
    own = wanted.select("part").distinct().select("part", F.explode(_grams(F.col("part"))).alias("gram")).where(F.length("gram") == F.least(F.length("part"), F.lit(GRAM)))
    frequency = grams.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A run that no name has proves that no name has the identifier.
    rarest = own.join(frequency, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0").select("part", "least.gram")
    within = rarest.join(grams, "gram").where(F.contains("low", F.col("part"))).select("part", "id")
    inside = wanted.join(within, "part").select("qid", "id", F.lit(0.5).alias("score"))
    return exact.unionByName(inside).groupBy("qid", "id").agg(F.max("score").alias("score"))
