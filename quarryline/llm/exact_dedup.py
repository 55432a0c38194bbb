"""Exact deduplication over an extendible-hash index kept as files in the shared folder.

1. *Rows.* One pass over the texts leaves (doc_id, code points, key, digest, length) of the normalised text: its 64-bit
   key and the SHA-256 of its bytes. No later step but the comparison of bytes moves a text.
2. *Directory.* A pointer is the top ``depth`` bits of a key. Starting from one bucket, every bucket with more than
   ``capacity`` keys is split and the directory doubled, until all fit or the pointer has no more bits. The outcome is
   computed from the counts of all tree nodes at once. An overfull bucket at the last level keeps all its entries.
3. *Comparison.* The texts of keys that several rows share are gathered as sets of their bytes, which map-side
   aggregation folds to one text per task and key. Every different text of a key becomes a link of its chain.
4. *Owners.* Each row finds its bucket through the directory. Entries are aggregated per bucket, key and digest, map
   side first; range-partitioned tasks own the buckets, order the entries and write the index files.
5. *Probe.* Rows go pointer, bucket, chain: they are joined to the index by bucket, key and digest. The adaptive
   skew join may split a hot key, since each index entry is unique.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

#: The characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Room for any doc_id beside the number of code points in one exact decimal.
_SHIFT = "36893488147419103232"
_TOP = "9223372036854775807"
#: Rows of ids up to which they are broadcast; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a pointer at most: a directory of 2 ** 20 rows is some 20 MB.
MAX_DEPTH = 20


def normalised(text: Column) -> Column:
    bare = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return bare


def _standing(n_points: Column, doc_id: Column) -> Column:
    """Greater for more code points, then for the smaller id; rows without an id come last."""
    at = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    return (n_points.cast("decimal(12,0)") * F.lit(_SHIFT).cast("decimal(21,0)") + at).cast("decimal(38,0)")


def _key(bare: Column) -> Column:
    return F.xxhash64(bare)


def _digest(bare: Column) -> Column:
    return F.unhex(F.sha2(bare, 256))


def narrow_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, points, key, digest, n_bytes) of every row."""
    rows = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("bare"))
    return rows.select("doc_id", "points", _key(F.col("bare")).alias("key"), _digest(F.col("bare")).alias("digest"), F.octet_length("bare").alias("n_bytes"))


def pointer(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def pointer_bits(n_keys: int, capacity: int) -> int:
    """Four bits more than even buckets need, so that hashed keys fit; at most ``MAX_DEPTH``."""
    return min(MAX_DEPTH, 4 + math.ceil(math.log2(max(1, n_keys / capacity))))


def split_directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(pointer, depth, bucket): one row per used pointer, at most 2 ** max_depth in all.

    ``keys`` are distinct. ``depth`` is the number of leading bits that the pointer's bucket shares, ``bucket`` the
    first pointer of its range.
    """
    used = keys.groupBy(pointer(F.col("key"), max_depth).alias("pointer")).agg(F.count(F.lit(1)).alias("n"))
    nodes = used.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    nodes = nodes.withColumn("node", F.expr(f"shiftright(pointer, {max_depth} - depth)"))
    fits = nodes.groupBy("depth", "node").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == max_depth))
    leaf = nodes.drop("n").join(fits, ["depth", "node"]).groupBy("pointer").agg(F.min("depth").alias("depth"))
    return leaf.withColumn("bucket", F.expr(f"shiftleft(shiftright(pointer, {max_depth} - depth), {max_depth} - depth)"))


def located(rows: DataFrame, directory: DataFrame, max_depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory gives for their key, and its depth."""
    # At most 2 ** MAX_DEPTH pointers of 20 bytes: a proven bound.
    return rows.withColumn("pointer", pointer(F.col("key"), max_depth)).join(F.broadcast(directory), "pointer").drop("pointer")


def chains(docs: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, digest, link): the different texts of each key of ``shared``, told apart by their bytes.

    Raises if two texts have one digest: their rows could not be told apart.
    """
    ids = rows.join(shared, "key", "left_semi").select("doc_id").distinct()
    ids = written(ids, "shared-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    mine = docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    texts = mine.select(normalised(F.col("text")).alias("bare")).select(_key(F.col("bare")).alias("key"), "bare")
    different = texts.groupBy("key").agg(F.collect_set("bare").alias("texts"))
    links = different.select("key", F.posexplode(F.array_sort(F.transform("texts", _digest))).alias("link", "digest"))
    twice = F.lag("digest").over(Window.partitionBy("key").orderBy("digest")) == F.col("digest")
    links = links.withColumn("digest", F.when(twice, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("digest")).cast("binary"))
    return links.select("key", "digest", "link")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int, max_depth: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Write the index and return it as a table (bucket, depth, key, link, digest, keep_id, keep_points, group_size),
    with the directory and its bits. ``rows`` are the narrow rows of ``docs``."""
    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "exact-keys")
    if max_depth is None:
        max_depth = pointer_bits(keys.count(), capacity)
    directory = written(split_directory(keys, capacity, max_depth), "exact-directory")
    standing = located(rows, directory, max_depth).withColumn("s", _standing(F.col("points"), F.col("doc_id")))
    entries = standing.groupBy("bucket", "depth", "key", "digest").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("group_size"))
    compared = chains(docs, rows, keys.where("n_rows > 1").select("key"))
    entries = entries.join(compared, ["key", "digest"], "left")
    shift, top = F.lit(_SHIFT).cast("decimal(21,0)"), F.lit(_TOP).cast("decimal(20,0)")
    # With no id the remainder is -1 below a multiple of the shift; +1 keeps the quotient whole.
    points = F.floor((F.col("s") + 1) / shift)
    rest = (F.col("s") - points.cast("decimal(12,0)") * shift).cast("decimal(21,0)")
    entries = entries.select(
        "bucket",
        "depth",
        "key",
        # The only text of its key, seen in one row, has nothing to be compared with.
        F.coalesce("link", F.lit(0)).alias("link"),
        "digest",
        F.when(rest >= 0, (top - rest).cast("long")).alias("keep_id"),
        points.cast("int").alias("keep_points"),
        "group_size",
    )
    owned = entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "link")
    return written(owned, "exact-index"), directory, max_depth


def probe(rows: DataFrame, index: DataFrame, directory: DataFrame, max_depth: int) -> DataFrame:
    """Each of ``rows`` with the entry of the index that its pointer, bucket and chain lead to."""
    return located(rows, directory, max_depth).drop("depth").join(index, ["bucket", "key", "digest"])


def exact_duplicates(docs: DataFrame, capacity: int = 4096, max_depth: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the entry's bucket and chain.

    Texts are equal when identical without the characters of ``BLANKS``; null counts as the empty text.
    Of equal texts the row with the most code points stays, then the one with the smallest doc_id. A row
    that occurs several times with one id and one text stays or goes as a whole. A row without doc_id
    stays only in a group that has no id at all (keep_id is null then). An empty table gives no rows;
    other columns are ignored. Pointers have ``max_depth`` bits, by default as many as the number of keys needs.
    """
    docs = docs.select("doc_id", "text")
    rows = written(narrow_rows(docs), "exact-rows")
    index, directory, bits = build_index(docs, rows, capacity, max_depth)
    joined = probe(rows, index, directory, bits)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("bucket").cast("long"), F.col("link").alias("chain"))
