"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.plans.order import positions, running_totals
from quarryline.runtime import written

#: Up to so many values of a label, its table of positions is broadcast.
BROADCAST_VALUES = 50_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (n points, d coordinates below 2 ** bits).

    Each level of the cube contributes one d-bit group: the Gray-code rank of the sub-cube in the frame
    of its parent, which is kept as an entry corner and an axis direction.
    """
    n, d = cells.shape
    full = (1 << d) - 1
    entry, axis, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for k in range(d):
            corner |= ((cells[:, k].astype(np.int64) >> level) & 1) << k
        local = corner ^ entry
        turn = (axis + 1) % d
        local = ((local >> turn) | (local << (d - turn))) & full
        rank = local.copy()
        for s in (1, 2, 4, 8):
            rank ^= rank >> s
        out = (out << d) | rank
        # Entry corner and direction of the sub-cube with this rank.
        before = np.where(rank == 0, 0, ((rank - 1) // 2) * 2)
        start = before ^ (before >> 1)
        odd = np.where(rank % 2 == 1, rank, np.maximum(rank - 1, 0))
        ones = np.zeros(n, np.int64)
        run = odd.copy()
        for _ in range(d + 1):
            grow = (run & 1) == 1
            ones += grow
            run = np.where(grow, run >> 1, 0)
        along = np.where(rank == 0, 0, ones % d)
        entry ^= ((start << turn) | (start >> (d - turn))) & full
        axis = (axis + along + 1) % d
    return out


def curve_table(df_spark, dims: int, bits: int) -> DataFrame:
    """(cell, curve) for every cell of the grid: 2 ** (dims * bits) rows, a fixed size."""
    cell = np.arange(1 << (dims * bits), dtype=np.int64)
    coords = np.stack([(cell >> (bits * k)) & ((1 << bits) - 1) for k in range(dims)], axis=1)
    return df_spark.createDataFrame(pd.DataFrame({"cell": cell, "curve": hilbert_index(coords, bits)}))


def rank_positions(df: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, position): each distinct value's place among all rows, as a share of 2 ** bits; null last."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, "n", F.col("value").asc_nulls_last(), label="label-order")
    return ranked.select("row.value", F.floor(F.col("before") * (1 << bits) / F.col("total")).alias("position"))


def log_position(size: Column, bits: int) -> Column:
    """Half powers of two, up to the last cell."""
    return F.least(F.lit((1 << bits) - 1), F.floor(2 * F.log2(F.greatest(size / 8, F.lit(1.0)))))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hilbert_shards(
    rows: DataFrame,
    n_shards: int = 24,
    labels: tuple[Column | str, ...] = ("source", "lang"),
    size: Column | str = "size",
    tie: tuple[Column | str, ...] = ("text_key", "doc_id"),
    bits: int = 5,
    group: Column | str | None = None,
    outputs: tuple[str, ...] = ("curve", "shard", "slot"),
) -> DataFrame:
    """All columns of ``rows`` plus those of ``outputs``; counts of the shards differ by one at most.

    The dimensions are the ``labels`` (placed by cumulative share of rows, null last) and the logarithm of
    ``size``. Rows are range-partitioned and sorted by (curve index, ``tie``); the position in the whole order
    is the position in the partition plus the rows of those before it. With ``group`` the labels and size of a
    group's first row hold for all of it, so that its rows lie side by side. Nulls in ``tie`` come first;
    fully equal rows get neighbouring slots. Columns named as an output are replaced, all others kept, whatever
    their names. An empty table gives no rows.
    """
    spark = rows.sparkSession
    held = rows.drop(*outputs)
    # The table's own columns travel in one struct, so that no name of theirs can meet one of these.
    names = [f"label{i}" for i in range(len(labels))]
    inner = rows.select(F.struct(*[rows[f"`{c}`"] for c in held.columns]).alias("held"), *[_column(c).alias(n) for n, c in zip(names, labels)], _column(size).alias("size"), F.col("doc_id").alias("id"), *[_column(c).alias(f"tie{i}") for i, c in enumerate(tie)], (_column(group) if group is not None else F.lit(None)).alias("group"))
    base = inner
    if group is not None:
        lead = inner.groupBy(F.col("group").alias("of")).agg(F.min(F.struct("id", *names, "size")).alias("lead"))
        inner = inner.join(lead, F.col("group").eqNullSafe(F.col("of")), "left").drop("of", *names, "size").select("*", *[F.col(f"lead.{c}").alias(c) for c in (*names, "size")]).drop("lead")
    cell = log_position(F.col("size"), bits)
    for i, c in enumerate(names):
        places = written(rank_positions(base, c, bits).select(F.col("value").alias(f"value{i}"), F.col("position").alias(f"place{i}")), "places")
        # A label with few values is joined without moving the rows; one with many has no hot value to speak of.
        places = F.broadcast(places) if places.count() <= BROADCAST_VALUES else places
        inner = inner.join(places, F.col(c).eqNullSafe(F.col(f"value{i}")), "left").drop(f"value{i}")
        cell = cell + F.coalesce(f"place{i}", F.lit(0)) * (1 << (bits * (i + 1)))
    dims = len(labels) + 1
    table = F.broadcast(curve_table(spark, dims, bits).withColumnRenamed("cell", "at_cell"))
    inner = inner.withColumn("cell", cell.cast("long")).join(table, F.col("cell") == F.col("at_cell"), "left")
    ties = [f"tie{i}" for i in range(len(tie))]
    out = positions(inner.select("held", "curve", *ties), "curve", *ties, label="curve-order")
    low, extra = F.expr(f"total div {n_shards}"), F.col("total") % n_shards
    edge = extra * (low + 1)
    first = F.col("at") < edge
    shard = F.when(first, F.expr(f"at div (total div {n_shards} + 1)")).otherwise(extra + ((F.col("at") - edge) / F.greatest(low, F.lit(1))).cast("long"))
    slot = F.when(first, F.col("at") % (low + 1)).otherwise((F.col("at") - edge) % F.greatest(low, F.lit(1)))
    made = {"curve": F.col("row.curve"), "shard": shard.cast("int"), "slot": slot.cast("long")}
    return out.select("row.held.*", *[made[c].alias(c) for c in outputs])


def describe_rows(docs: DataFrame) -> DataFrame:
    """The narrow table that the order needs: doc_id, source, lang, size, text_crc32 and a key of the text."""
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", "lang", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_key"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
