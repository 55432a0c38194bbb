"""Vector code compression: product codes from a weighted Lloyd iteration over distinct integer parts.

1. *Integers.* Components become floor(256 x); each vector is cut into equal consecutive parts.
2. *Distinct rows.* Equal vectors fold into one row with a count, then equal parts of one position into one row whose
   weight is the number of vectors that have it. A hot vector or part is one row from here on, and both counts are
   combined map side before they are shuffled.
3. *Lloyd.* Each round assigns the distinct parts to their nearest entry in numpy batches and adds up weights and
   weighted components by (part, entry): ``parts`` x ``entries`` rows of sums reach the driver, whatever the input.
4. *Join.* Codes and errors of the distinct parts are joined back to the distinct vectors, and those to the rows. The
   joins have no aggregate on the same shuffle, so that the adaptive skew join may split a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

#: Up to so many labels, their sums are broadcast; beyond, rows are joined to them by shuffle.
BROADCAST_LABELS = 50_000
_LONG = "9223372036854775807"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale x), clamped where the squared distances of a whole vector could exceed a long."""
    bound = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size(vector)) / 2 - 1)
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -bound.cast("double")), bound.cast("double"))))


def kept_rows(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, ints) of the rows whose vector can be coded."""
    vector = F.col("embedding")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.coalesce(sound, F.lit(False))
    return rows.where(able).select("vec_id", "label", integers(vector, scale).alias("ints"))


def cut(vectors: DataFrame, parts: int) -> DataFrame:
    """(vid, n, width, part, piece): the parts of each distinct vector."""
    width = F.size("ints")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("ints", (p * width / parts).cast("int") + 1, (width / parts).cast("int")))
    return vectors.select("vid", "n", width.alias("width"), F.posexplode(pieces).alias("part", "piece"))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """(parts, entries, length) of each width: the parts of the vectors with the smallest ids, then the smallest components."""
    order = Window.partitionBy(F.size("ints")).orderBy(F.col("vec_id").asc_nulls_last(), "ints")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries).orderBy("place").select("ints").collect()  # ``entries`` vectors of each width
    books: dict[int, list[list[int]]] = {}
    for r in first:
        books.setdefault(len(r.ints), []).append(r.ints)
    return {w: np.array(b, np.int64).reshape(len(b), parts, w // parts).transpose(1, 0, 2) for w, b in books.items()}


def nearest(pieces: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest row of ``book`` for each of ``pieces``, the lowest of equals, and the squared distance."""
    code, error = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for a in range(0, len(pieces), 1 << 14):
        some = pieces[a : a + (1 << 14)]
        distance = np.zeros((len(some), len(book)), np.int64)
        for j in range(book.shape[1]):
            distance += (some[:, j, None] - book[None, :, j]) ** 2
        code[a : a + len(some)] = distance.argmin(1)
        error[a : a + len(some)] = distance.min(1)
    return code, error


def assign(distinct: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``distinct`` (width, part, piece, weight) with the code and error of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, part = (batch.column(i).to_numpy() for i in (0, 1))
            values, starts = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())[:-1]])
            code, error = np.zeros(len(width), np.int32), np.zeros(len(width), np.int64)
            for w, p in set(zip(width.tolist(), part.tolist(), strict=True)):
                at = np.flatnonzero((width == w) & (part == p))
                book = books[w][p]
                code[at], error[at] = nearest(values[starts[at, None] + np.arange(book.shape[1])], book)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "width int, part int, piece array<long>, weight long, code int, error long")


def moved(distinct: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after one round: each entry the floor of the weighted mean of its parts; unused entries stay."""
    spread = assign(distinct, books).select("width", "part", "code", "weight", F.posexplode("piece").alias("at", "value"))
    exact = F.col("weight").cast("decimal(19,0)") * F.col("value").cast("decimal(19,0)")
    sums = spread.groupBy("width", "part", "code", "at").agg(F.sum(exact).alias("total"), F.sum("weight").alias("weight"))
    books = {w: b.copy() for w, b in books.items()}
    for r in sums.collect():  # one row per component of an entry
        books[r.width][r.part, r.code, r.at] = int(r.total) // r.weight
    return books


def digest(books: dict[int, np.ndarray]) -> dict[int, str]:
    return {w: hashlib.sha256(",".join(map(str, b.reshape(-1).tolist())).encode()).hexdigest() for w, b in books.items()}


def trained(rows: DataFrame, distinct: DataFrame, parts: int, entries: int, rounds: int) -> dict[int, np.ndarray]:
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        books = moved(distinct, books)
    return books


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row per codable row of (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, has null or non-finite components, is empty or cannot be cut into ``parts`` equal parts
    are dropped. Vectors of different lengths have codebooks of their own. Integer components are clamped where a
    vector's error could exceed a long (some 2 ** 27 at 64 components). ``code`` has two hexadecimal digits a part (at
    most 256 ``entries``). Codebooks start with the vectors of the smallest ids, null ids last and equal ids by their
    components; with fewer vectors there are fewer entries. A repeated row counts each time. ``label_error`` adds up
    the errors of the rows of one label, nulls together, and stops at the greatest long. An empty table gives no rows;
    other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hexadecimal digits a part")
    rows = written(kept_rows(vectors, parts, scale), "code-rows")
    whole = rows.groupBy("ints").agg(F.count(F.lit(1)).alias("n"))
    whole = written(whole.select(F.monotonically_increasing_id().alias("vid"), "ints", "n"), "code-vectors")
    pieces = cut(whole, parts)
    distinct = written(pieces.groupBy("width", "part", "piece").agg(F.sum("n").alias("weight")), "code-parts")
    books = trained(rows, distinct, parts, entries, rounds)
    signed = digest(books)

    coded = written(assign(distinct, books), "code-assigned")
    met = pieces.select("vid", "width", "part", "piece").join(coded, ["width", "part", "piece"])
    hexed = F.lower(F.lpad(F.hex("code"), 2, "0"))
    codes = met.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("part", hexed.alias("c")))).alias("of"), F.sum("error").alias("error"))
    codes = codes.select("vid", F.array_join(F.transform("of", lambda x: x["c"]), "").alias("code"), "error")
    book = F.lit(None).cast("string")
    for w, s in signed.items():
        book = F.when(F.size("ints") == w, s).otherwise(book)
    found = rows.join(whole.select("vid", "ints").join(codes, "vid"), "ints").select("vec_id", "label", "code", "error", book.alias("codebooks_sha256"))
    found = written(found, "code-rows-coded")

    most = F.lit(_LONG).cast("decimal(38,0)")
    labels = found.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    labels = written(labels, "label-errors")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    return found.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
