"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges within each source: the first hexadecimal digits of the key.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """A hash of seed and id; the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary").cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The weights repeat along the sources in code-point order, null last. All sizes together are shared by
    weight; no target exceeds ``repeats`` times its source, the excess going to the others by weight. The
    fixed point is found in one pass: in order of size / weight, the first sources are capped, up to the
    level at which the rest by weight lies below all their caps.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumns({"place": place, "weight": weight}).withColumn("most", F.col("source_size") * float(repeats))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "capped": F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(everything).cast("double"),
        }
    )
    rows = rows.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    found = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.least(F.col("most"), found * F.col("weight")).alias("target"))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mixed(docs: DataFrame, weights: tuple[int, ...], repeats: int, seed: str, size: Column | str) -> DataFrame:
    """(row, size, source_size, target, taken); ``row`` holds the columns of ``docs``, whatever their names."""
    key = random_key(F.col("doc_id"), seed)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("origin"), _column(size).alias("size"), key.alias("key"), F.substring(key, 1, RANGE_DIGITS).alias("part"))
    ranges = rows.groupBy("origin", "part").agg(F.sum("size").alias("sum"))
    offset = F.coalesce(F.sum("sum").over(Window.partitionBy("origin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(ranges.groupBy(F.col("origin").alias("source")).agg(F.sum("sum").alias("source_size")), weights, repeats)
    ranges = ranges.withColumn("offset", offset).drop("sum").alias("r")
    targets = targets.withColumnRenamed("source", "of").alias("t")
    ranges = ranges.join(targets, F.col("r.origin").eqNullSafe(F.col("t.of"))).select(F.col("r.origin").alias("of"), F.col("r.part").alias("of_part"), "offset", "source_size", "target")
    inside = Window.partitionBy("origin", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, F.col("origin").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("ahead")))
    return rows.select("row", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix", size: Column | str = "size") -> DataFrame:
    """All columns of ``docs`` plus source_size, target and taken; ``size`` is the words of each row.

    Within a source, rows are ordered by a random key of their id. Whole epochs are taken while the budget
    allows; the last is cut at the budget, so its last document is taken in part. The order is split into
    16 ** RANGE_DIGITS ranges of the key: sums of the ranges give each range's offset, a window inside one
    range the rest, so no task sees a whole source. Rows of one id have one key, hence one range. Null sources
    form one source. Rows without words are taken 0 times; equal rows are told apart by their order only. Columns
    named source_size, target or taken are replaced, all others kept. An empty table gives no rows.
    """
    kept = docs.drop("source_size", "target", "taken")
    return _mixed(kept, weights, repeats, seed, size).select("row.*", "source_size", "target", "taken")


def _times(size: Column, taken: Column) -> Column:
    """In part counts as once."""
    return F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")


def repeated(mixed: DataFrame, size: Column | str = "size") -> DataFrame:
    """Each row of a mix as often as it is taken, in part counting as once; rows never taken go."""
    rows = mixed.select(F.struct("*").alias("row"), _times(_column(size), F.col("taken")).alias("times"))
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix", size: Column | str = "size") -> DataFrame:
    """``repeated`` of ``mix``, with the columns of ``docs`` and no others."""
    rows = _mixed(docs, weights, repeats, seed, size).select("row", _times(F.col("size"), F.col("taken")).alias("times"))
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
