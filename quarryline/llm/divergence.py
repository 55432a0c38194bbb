"""Source divergence audit: how the terms of each source differ from those of the other sources of its language.

1. *Counts.* Texts are split as bytes in Arrow batches; (lang, source, term) counts are folded in each task before they
   are shuffled, together with the number of documents that have the term.
2. *Vocabulary.* A language keeps the terms of enough documents. A kept term belongs to a chunk by its hash, and has a
   position in it.
3. *Packed vectors.* A group's counts in one chunk are one row: positions and counts of the terms that occur there.
4. *Tiles.* Groups of a language are hashed into blocks. Each packed vector is replicated to the tiles of its block
   with every block of its language (itself included); a long vocabulary is cut into spans as well. A task sorts the
   vectors of its tiles by chunk and adds each chunk to the submatrix of the tile, so that it holds the dense vectors
   of one chunk at a time, whatever the vocabulary. Submatrices of the spans are added up.
5. *Ranks.* Of pairs within a group, and of the terms that a group has more often than its language.

All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

#: Probabilities are in billionths, plus one.
ONE = 1_000_000_000
#: Entries of a task's table of counts, beyond which it is passed on.
FOLD = 200_000
#: Groups and languages up to which their totals are broadcast; beyond, joins shuffle.
BROADCAST_GROUPS = 100_000
#: Of ASCII, letters stay, capitals as small ones; all other bytes below 128 separate.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bare(docs: DataFrame) -> DataFrame:
    """(lang, source, text as bytes), nulls as ''."""
    none = F.lit("")
    return docs.select(*[F.coalesce(c, none).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), none).cast("binary").alias("body"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n_docs, n) from ``bare`` rows; a row of the empty term stands for each group."""

    def passed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        rows = [(*group, term, seen[term], n) for group, (seen, counts) in held.items() for term, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n_docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                group = (lang.as_py(), source.as_py())
                if group not in held:
                    held[group] = (Counter({b"": 0}), Counter({b"": 0}))
                seen, counts = held[group]
                size -= len(counts)
                own = Counter(body.as_py().translate(_TERM).split())
                counts.update(own)
                seen.update(own.keys())
                size += len(counts)
                if size > FOLD:
                    yield passed(held)
                    held, size = {}, 0
        yield passed(held)

    folded = docs.mapInArrow(run, "lang string, source string, term binary, n_docs long, n long")
    return folded.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def share(n: str, total: str, size: str) -> Column:
    """1 + floor(ONE (n + 1) / (total + size)) of columns, in two steps that stay within longs up to 9e13 occurrences."""
    high, whole = f"(({n} + 1) * 100000)", f"({total} + {size})"
    return F.expr(f"1 + {high} div {whole} * 10000 + {high} % {whole} * 10000 div {whole}")


def shares(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """``share`` of a matrix of counts, one row per group."""
    whole = (totals + size)[:, None]
    high = (counts + 1) * 100_000
    return 1 + high // whole * 10_000 + high % whole * 10_000 // whole


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def vocabularies(counts: DataFrame, least: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(lang, size, lang_total, n_chunks) of the languages that keep a term; (lang, term, lang_n, chunk, at) of the kept terms."""
    terms = counts.where(F.octet_length("term") > 0).groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n"))
    terms = written(terms.where(F.col("n_docs") >= least).drop("n_docs"), "kept-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("lang_total"))
    langs = written(langs.withColumn("n_chunks", F.ceil(F.col("size") / chunk)), "term-languages")
    placed = terms.join(_bounded(langs.select("lang", "n_chunks")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("n_chunks")))
    at = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return langs, placed.select("lang", "term", "lang_n", "chunk", at.alias("at"))


def tiles(own: DataFrame, groups: DataFrame, block: int, span: int) -> DataFrame:
    """Packed vectors by tile: (lang, i, j, span, chunk, source, block, total, size, n_terms, at, n), sorted within partitions.

    Every group has a row in every chunk of its language, with empty ``at`` and ``n`` where none of its terms fall.
    """
    packed = own.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("of"))
    places = own.groupBy("lang", "chunk").agg((F.max("at") + 1).alias("n_terms"))
    frame = groups.where("n_groups > 1").select("lang", "source", "total", "size", F.ceil(F.col("n_groups") / block).alias("n_blocks"), F.explode(F.sequence(F.lit(0), F.greatest("n_chunks", F.lit(1)) - 1)).alias("chunk"))
    frame = frame.join(packed, ["lang", "source", "chunk"], "left").join(places, ["lang", "chunk"], "left")
    frame = frame.withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    none = F.array()
    rows = frame.select(
        "lang",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.floor(F.col("chunk") / span).alias("span"),
        "chunk",
        "source",
        "block",
        "total",
        "size",
        F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"),
        F.coalesce("of.at", none.cast("array<int>")).alias("at"),
        F.coalesce("of.n", none.cast("array<bigint>")).alias("n"),
    )
    return rows.repartition("lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "span", "chunk", "source")


class Tile:
    """The submatrix of one tile: of each ordered pair of its groups, the sum so far."""

    def __init__(self, lang: str) -> None:
        self.lang, self.sums, self.names = lang, {}, []

    def add(self, rows: list[tuple], i: int, j: int) -> None:
        """One chunk: rows (source, block, total, size, n_terms, at, n)."""
        size, n_terms = rows[0][3], rows[0][4]
        counts = np.zeros((len(rows), n_terms), np.int64)
        for k, r in enumerate(rows):
            counts[k, r[5]] = r[6]
        p = shares(counts, np.array([r[2] for r in rows], np.int64), size) if n_terms else counts
        left = [k for k, r in enumerate(rows) if r[1] == i]
        right = np.array([k for k, r in enumerate(rows) if r[1] == j], np.int64)
        for a in left:
            others = right[right > a] if i == j else right
            if not len(others):
                continue
            square = (p[others] - p[a]) ** 2
            forth, back = (square // p[others]).sum(1), (square // p[a]).sum(1)
            for b, x, y in zip(others, forth.tolist(), back.tolist(), strict=True):
                for pair, value in (((rows[a][0], rows[b][0]), x), ((rows[b][0], rows[a][0]), y)):
                    self.sums[pair] = self.sums.get(pair, 0) + value

    def table(self) -> pa.RecordBatch:
        pairs = list(self.sums)
        columns = [pa.array([self.lang] * len(pairs), pa.string()), *(pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)), pa.array(list(self.sums.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def submatrices(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each tile and span, from sorted rows of ``tiles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held, tile = None, None, [], None
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(8)]
            totals, sizes, n_terms = (batch.column(k).to_pylist() for k in range(7, 10))
            for r in range(batch.num_rows):
                key, at = tuple(keys[k][r] for k in range(4)), keys[4][r]
                if held and (key, at) != (now, chunk):
                    tile.add(held, now[1], now[2])
                    held = []
                if key != now:
                    if tile:
                        yield tile.table()
                    tile, now = Tile(key[0]), key
                chunk = at
                held.append((keys[5][r], keys[6][r], totals[r], sizes[r], n_terms[r], *(batch.column(k)[r].values.to_numpy() for k in (10, 11))))
        if tile:
            tile.add(held, now[1], now[2])
            yield tile.table()

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least: int = 3, top: int = 200, chunk: int = 8192, block: int = 32, span: int = 16) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for the groups (lang, source) of ``docs``.

    Terms are runs of ASCII letters and of characters beyond ASCII, only A to Z lower-cased. A language keeps the terms
    of at least ``least`` of its rows. With n occurrences of a term in a group, N of all kept terms and V kept terms,
    p = 1 + floor(10 ** 9 (n + 1) / (N + V)); two shares differ by floor((p - q) ** 2 / q). Part ``pair`` has every
    other source of the language, q being its share, summed over all kept terms; part ``term`` the ``top`` terms that
    the group has and whose share is above that of the language, q. Ranks go by value, then by the item's bytes.

    Null text, language and source count as ''. Repeated rows count each time; ids are not used. Groups without a kept
    term take part in pairs, and have no row if theirs is the only source. An empty table gives no rows; other columns
    are ignored. ``chunk`` terms, ``block`` groups and ``span`` chunks bound a task.
    """
    counts = written(term_counts(bare(docs)), "term-counts")
    langs, terms = vocabularies(counts, least, chunk)
    own = written(counts.drop("n_docs").join(terms, ["lang", "term"]), "group-terms")
    groups = counts.where(F.octet_length("term") == 0).select("lang", "source")
    in_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(in_lang, "lang").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("total", "size", "lang_total", "n_chunks")]), "term-groups")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    met = own.join(_bounded(groups.select("lang", "source", "total", "size", "lang_total")), ["lang", "source"])
    met = met.withColumns({"p": share("n", "total", "size"), "q": share("lang_n", "lang_total", "size")}).where("p > q")
    of_terms = met.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    of_terms = of_terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    sums = submatrices(tiles(own, groups, block, span)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    of_pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return of_pairs.unionByName(of_terms)
