"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set, each partition spanning a factor of two. For the
items of a partition with at most ``u`` shingles, documents are seen as windows of ``2 u`` shingles that start
every ``u``; an item of any of these sizes lies whole in some window, and containment ``t`` of an item with
more than ``u / 2`` shingles in a window of ``2 u`` bounds their Jaccard similarity from below by
``t q / (2 u + q - t q)``, however long the document is. That bound gives the number of MinHash values of which
one must agree.

1. An item's MinHash values are the hashes of some of its own shingles. A window without any of these shingles
   agrees with no item, so a first pass over all documents keeps those that have one.
2. Of these documents all windows with such a shingle get their MinHash values, by a grouped minimum.
3. Agreeing values give candidate pairs of document and item.
4. A candidate is verified by the exact share of the item's shingles that the whole document has.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.runtime import written

#: Rows of item shingles up to which they are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def with_shingles(df: DataFrame, n: int, text: str = "text", into: str = "set") -> DataFrame:
    """``df`` with the hashes of the runs of ``n`` words in order; one of all the words if there are fewer.

    Words are lower-case runs of letters, digits and underscores. They are bound to a lambda variable: the
    optimizer would otherwise copy their expression into the inner lambda, to be evaluated for each run.
    """
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)]))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    return df.withColumn(into, F.transform(F.array(F.array_remove(split, "")), runs)[0])


def hash_values(needed: float, floor: float) -> int:
    """How many MinHash values make a miss at similarity ``floor`` rarer than ``needed``."""
    return max(8, math.ceil(math.log(needed) / math.log(1 - floor)))


def minhash(shingle: Column, k: int) -> Column:
    return F.xxhash64(shingle, F.lit(k))


def item_table(items: DataFrame, n: int) -> DataFrame:
    """(item_id, s, q, part): each item's distinct shingles, their number and the power of two that bounds it."""
    sets = with_shingles(items.where(F.col("item_id").isNotNull()).select("item_id", "text"), n).where(F.size("set") > 0)
    sets = sets.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"))
    q = F.size("set")
    return sets.select("item_id", q.alias("q"), F.pow(F.lit(2), F.ceil(F.log2(q))).cast("int").alias("part"), F.explode("set").alias("s"))


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, miss: float = 1e-5) -> DataFrame:
    """Pairs (doc_id, item_id, containment, n_shared, n_item): the item's share of shingles in the document
    is ``threshold`` or more.

    A text of fewer than ``n`` words is one shingle of all its words, so it is only found in a text of the
    same words. Null, empty and wordless texts give no pair, nor do rows without an id; rows with one item_id
    are one item; repeated documents give one pair. Rows with one doc_id are one document: items are sought in each of
    its texts, and the share is that of all its texts together. Empty tables give no rows; other columns are ignored.
    """
    table = written(item_table(items, n), "items")
    n_rows = table.count()
    small = n_rows <= BROADCAST_ROWS
    floor = threshold * 0.5 / (2 + 0.5 * (1 - threshold))
    values = hash_values(miss, floor)
    signs = table.groupBy("item_id", "q", "part").agg(*[F.min_by("s", minhash(F.col("s"), k)).alias(f"s{k}") for k in range(values)])
    signs = signs.select("item_id", "part", F.posexplode(F.array(*[f"s{k}" for k in range(values)])).alias("k", "s"))
    signs = written(signs, "item-signatures")
    marks = signs.select("s", "part").distinct()
    few_signs = signs.count() <= BROADCAST_ROWS

    # Windows are those of one text; rows with one id and text fall together.
    bare = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("of"))
    # The outer forms keep the optimizer from filtering on the array's size, which would compute it twice.
    spread = with_shingles(bare, n).select("doc_id", "of", F.posexplode_outer("set").alias("at", "s"))
    # Every position of a marked shingle, and the one or two windows of its part that hold it.
    met = spread.join(_sized(marks, few_signs), "s")
    block = F.floor(F.col("at") / F.col("part")).cast("int")
    met = met.select("doc_id", "of", "part", F.explode(F.array(block, block - 1)).alias("window")).where("window >= 0")
    windows = written(met.distinct(), "marked-windows")

    hit = written(windows.select("doc_id").distinct(), "marked-ids")
    again = bare.join(_sized(hit, hit.count() <= BROADCAST_ROWS), "doc_id", "left_semi")
    again = written(with_shingles(again, n).select("doc_id", "of", F.posexplode_outer("set").alias("at", "s")).where("s is not null"), "marked-documents")
    parts = [r.part for r in signs.select("part").distinct().collect()]  # at most 31 powers of two
    sizes = F.array(*[F.lit(p) for p in parts]) if parts else F.array().cast("array<int>")
    cells = again.select("doc_id", "of", "s", "at", F.explode(sizes).alias("part"))
    block = F.floor(F.col("at") / F.col("part")).cast("int")
    cells = cells.select("doc_id", "of", "s", "part", F.explode(F.array_distinct(F.array(block, F.greatest(block - 1, F.lit(0))))).alias("window"))
    cells = cells.join(windows, ["doc_id", "of", "part", "window"], "left_semi")
    sketches = cells.groupBy("doc_id", "of", "part", "window").agg(*[F.min(minhash(F.col("s"), k)).alias(f"m{k}") for k in range(values)])
    sketches = sketches.select("doc_id", "part", F.posexplode(F.array(*[f"m{k}" for k in range(values)])).alias("k", "m"))
    signs = signs.withColumn("m", F.xxhash64("s", "k")).drop("s")
    pairs = written(sketches.join(_sized(signs, few_signs), ["part", "k", "m"]).select("doc_id", "item_id").distinct(), "candidates")

    own = again.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "s").distinct()
    # Candidates meet their items' shingles first: a shingle common to many items and documents does not multiply.
    sought = pairs.join(_sized(table.select("item_id", "s", "q"), small), "item_id")
    shared = sought.join(own, ["doc_id", "s"])
    share = shared.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("q").cast("long").alias("n_item"))
    share = share.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return share.where(F.col("containment") >= threshold - 1e-9).select("doc_id", "item_id", "containment", "n_shared", "n_item")


def without_contaminated(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that are in no pair; rows without doc_id stay."""
    return docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
