"""Exact search by dot product.

Up to ``PASS`` queries are broadcast, and every batch of vectors is multiplied with them. More queries meet the vectors
through cells: each vector belongs to the nearest of some pivots, and with a pivot p, the greatest distance r of its
vectors from it and a query q, no vector of the cell gives more than q p + |q| r. A query meets its most promising cells
first; the k-th score found there is the threshold that the bound of any other cell, and then any score, must reach.
Neighbouring cells make bundles and queries parts, some twelve of each however many there are, so that a query or a
vector is sent a bounded number of times; no query passes through the driver. What is met grows with the square of the
rows, as the search does that no bound cuts short; what is sent and held grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

#: Query vectors that are multiplied at once within a task, and that are broadcast.
BLOCK = 1024
PASS = 16_384
#: Cells at most, vectors of the sample from which their pivots are fitted, and rounds of fitting.
CELLS, SAMPLE, ROUNDS = 1024, 16_384, 4
#: Vectors that are multiplied at once with ``BLOCK`` queries; cells that a query meets first.
CHUNK, FIRST_CELLS = 4096, 2
#: Bundles of cells and parts of the queries aimed at; rows and bytes of numbers that one of them holds at most.
SIDE, PIECE, PIECE_BYTES = 12, 65_536, 32 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best scores of each column, ties to the smaller id."""
    n = len(ids)
    rows, columns = np.nonzero(scores >= np.partition(scores, n - k, axis=0)[n - k]) if n > k else np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((ids[rows], -scores[rows, columns], columns))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(columns)) - np.searchsorted(columns, columns)
    return rows[place < k], columns[place < k]


def _first(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each column, ties to the smaller id."""
    order = np.lexsort((ids[rows], -scores, columns))
    rows, columns, scores = rows[order], columns[order], scores[order]
    kept = np.arange(len(columns)) - np.searchsorted(columns, columns) < k
    return rows[kept], columns[kept], scores[kept]


def best_dots(ids: np.ndarray, scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` best of each column by the score to nine digits, ties to the smaller id.

    Of a column with ``least`` only scores that reach it; where all columns have one, the others are never put in order.
    """
    n = len(ids)
    bar = least.copy()
    open_ = np.isnan(bar)
    if open_.any():
        bar[open_] = np.partition(scores[:, open_], n - k, axis=0)[n - k] if n > k else -np.inf
    bar = bar - 2e-9 - np.where(np.isfinite(bar), 1e-14 * np.abs(bar), 0)  # what is as good by nine digits
    rows, columns = np.nonzero(scores >= bar)
    found = np.round(scores[rows, columns], 9)
    good = ~(found < least[columns])
    return _first(ids, rows[good], columns[good], found[good], k)


def _one_pass(table: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    part = asked.combine_chunks()
    held = table.sparkSession.sparkContext.broadcast((part.column("qid").to_numpy(), _matrix(part.column("embedding").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for a in range(0, len(names), BLOCK):
                scores = np.round(own @ matrix[a : a + BLOCK].T, 9)
                rows, columns = best_of(ids, scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(names[a + columns]), pa.array(ids[rows]), pa.array(scores[rows, columns])], ["qid", "id", "score"])

    return table.mapInArrow(run, "qid long, id long, score double")


def fit_pivots(table: DataFrame, n_rows: int) -> np.ndarray:
    """Pivots by some rounds of k-means over a sample: the ``SAMPLE`` rows with the least hash of their id."""
    found = table.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()  # a bounded sample
    sample = _matrix(found.column("embedding").combine_chunks())
    pivots = np.unique(sample, axis=0)
    n_cells = int(max(1, min(CELLS, len(pivots), n_rows**0.5 / 4)))
    pivots = pivots[np.linspace(0, len(pivots) - 1, n_cells).astype(int)]
    for _ in range(ROUNDS):
        near = ((pivots**2).sum(1) - 2 * sample @ pivots.T).argmin(1)
        for c in np.unique(near):
            pivots[c] = sample[near == c].mean(0)
    return pivots


def in_cells(table: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, id, embedding, far): each vector with its nearest pivot and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(1))
                near = ((pivots**2).sum(1) - 2 * own @ pivots.T).argmin(1)
                far = np.sqrt(((own - pivots[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns, pa.array(far)], ["cell", "id", "embedding", "far"])

    return table.mapInArrow(run, f"cell int, id long, embedding {table.schema['embedding'].dataType.simpleString()}, far double")


def cell_bounds(own: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bound, place) of each query and cell; ``place`` orders a query's cells by bound."""
    # A little is added for what floating point may lose.
    bound = own @ centres.T + np.sqrt((own**2).sum(1))[:, None] * radius[None] + 1e-8
    order = np.argsort(-bound, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None].repeat(len(own), 0), 1)
    return bound, place


def cells_to_meet(queries: DataFrame, pivots: np.ndarray, reach: dict[int, float], bundles: dict[int, int], first: bool) -> DataFrame:
    """(qid, bundle, wanted, least): the cells of each bundle that a query meets, of its first ones or of all others.

    ``queries``: (qid, embedding, least); a cell whose bound is below ``least`` is left out.
    """
    cells = np.array(sorted(reach, key=lambda c: (bundles[c], c)), np.int32)
    centres, radius, of = pivots[cells], np.array([reach[c] for c in cells.tolist()]), np.array([bundles[c] for c in cells.tolist()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                bound, place = cell_bounds(_matrix(some.column(1)), centres, radius)
                least = some.column(2).to_numpy(zero_copy_only=False)
                who, at = np.nonzero(place < FIRST_CELLS if first else (place >= FIRST_CELLS) & ~(bound < least[:, None]))
                if not len(who):
                    continue
                starts = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(of[at]) != 0)])
                wanted = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(who)].astype(np.int32)), pa.array(cells[at]))
                rows = who[starts]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), pa.array(of[at][starts]), wanted, some.column(2).take(pa.array(rows))], ["qid", "bundle", "wanted", "least"])

    return queries.select("qid", "embedding", "least").mapInArrow(run, "qid long, bundle int, wanted array<int>, least double")


def _met(cells: DataFrame, asked: DataFrame, k: int, sizes: dict[int, int], piece: int) -> DataFrame:
    """(qid, id, score): the best of each piece of a bundle for each query; ``asked`` is (qid, bundle, wanted, least, embedding).

    ``cells`` has the bundle, ``sizes`` the vectors of each bundle. Of a query with ``least`` only scores that reach it count.
    """
    kind = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(own: pa.Table, queries: pa.Table) -> pa.Table:
        if not own.num_rows or not queries.num_rows:
            return kind.empty_table()
        own = own.sort_by("cell")
        cell, ids, matrix = own.column("cell").to_numpy(), own.column("id").to_numpy(), _matrix(own.column("embedding").combine_chunks())
        parts = [kind.empty_table()]
        for a in range(0, queries.num_rows, BLOCK):
            some = queries.slice(a, BLOCK).combine_chunks()
            names, asking, least = some.column("qid").to_numpy(), _matrix(some.column("embedding").combine_chunks()), some.column("least").to_numpy()
            wanted = some.column("wanted").combine_chunks()
            who, which = np.repeat(np.arange(len(names)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            found = []
            for c in np.unique(which):
                mine = who[which == c]
                start, end = np.searchsorted(cell, [c, c + 1])
                for b in range(start, end, CHUNK):
                    rows = slice(b, min(b + CHUNK, end))
                    i, j, score = best_dots(ids[rows], matrix[rows] @ asking[mine].T, k, least[mine])
                    found.append((b + i, mine[j], score))
            if not found:
                continue
            rows, columns, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            rows, columns, scores = _first(ids, rows, columns, scores, k)
            parts.append(pa.table([pa.array(names[columns]), pa.array(ids[rows]), pa.array(scores)], schema=kind))
        return pa.concat_tables(parts)

    spark = cells.sparkSession
    spots = F.broadcast(spark.createDataFrame([(b, -(-n // piece)) for b, n in sizes.items()], "bundle int, n_own int"))  # a row a bundle
    n_asked = asked.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("n_asked"))
    spots = F.broadcast(n_asked.join(spots, "bundle"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cells.join(spots, "bundle").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_own")).cast("int")).withColumn("some", each("n_asked"))
    right = asked.join(spots, "bundle").withColumn("some", F.pmod(F.xxhash64("qid"), F.col("n_asked")).cast("int")).withColumn("own", each("n_own"))
    place = ["bundle", "own", "some"]
    left, right = left.select(*place, "cell", "id", "embedding"), right.select(*place, "qid", "wanted", "least", "embedding")
    n = max(SIDE * SIDE, sum(-(-n // piece) for n in sizes.values()))
    left, right = left.repartition(n, *place), right.repartition(n, *place)  # few rows' worth of work is not put together by their bytes
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(run, "qid long, id long, score double")


def bundled(sizes: dict[int, int], piece: int) -> dict[int, int]:
    """The bundle of each cell: neighbours of ``piece`` vectors together, or one larger cell."""
    out, bundle, held = {}, 0, 0
    for cell in sorted(sizes):
        if held and held + sizes[cell] > piece:
            bundle, held = bundle + 1, 0
        out[cell], held = bundle, held + sizes[cell]
    return out


def top_by_cells(table: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score) with the ``k`` best of each query among them, and the (qid, cell) that were met."""
    n_rows = table.count()
    pivots = fit_pivots(table, n_rows)
    cells = written(in_cells(table, pivots), "vector-cells")
    counted = cells.groupBy("cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row a cell
    reach, sizes = {r.cell: r.r for r in counted}, {r.cell: r.n for r in counted}
    queries = written(queries, "vector-queries")
    piece = max(1, min(PIECE, PIECE_BYTES // (8 * pivots.shape[1]), -(-max(n_rows, queries.count()) // SIDE)))
    bundles = bundled(sizes, piece)
    held: dict[int, int] = {}
    for cell, n in sizes.items():
        held[bundles[cell]] = held.get(bundles[cell], 0) + n
    of = F.broadcast(table.sparkSession.createDataFrame(list(bundles.items()), "cell int, bundle int"))  # a row a cell
    own = cells.select("cell", "id", "embedding").join(of, "cell")
    met = lambda asked: _met(own, asked.join(queries, "qid"), k, held, piece)
    first = written(cells_to_meet(queries.withColumn("least", F.lit(None).cast("double")), pivots, reach, bundles, True), "first-cells-met")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    found = written(met(first).withColumn("rank", rank).where(F.col("rank") <= k), "first-cells")
    reached = found.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = written(cells_to_meet(queries.join(reached, "qid", "left"), pivots, reach, bundles, False), "other-cells")
    return found.drop("rank").unionByName(met(rest)), first.unionByName(rest).select("qid", F.explode("wanted").alias("cell"))


def top(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, score, rank): for each query (qid, embedding) the ``k`` best of (id, embedding) by dot product.

    Scores are rounded to nine digits; ties go to the smaller id. Null and empty vectors are passed over. Up to ``PASS``
    queries are broadcast, more go by cells; both are exact.
    """
    held = queries.where(F.size("embedding") > 0).select(F.col("qid").cast("long").alias("qid"), "embedding")
    table = vectors.where(F.size("embedding") > 0).select(F.col("id").cast("long"), "embedding")
    first = held.limit(PASS + 1).toArrow()  # bounded
    if not first.num_rows or table.isEmpty():
        out = vectors.sparkSession.createDataFrame([], "qid long, id long, score double")
    elif first.num_rows <= PASS:
        out = _one_pass(table, first, k)
    else:
        out, _ = top_by_cells(table, held, k)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], key: str = "id") -> DataFrame:
    """(key, embedding) of (key, text): ``encoder`` maps texts to rows, which are scaled to unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.asarray(encoder([t or "" for t in batch.column(1).to_pylist()]), np.float64)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))], [key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, embedding array<float>")
