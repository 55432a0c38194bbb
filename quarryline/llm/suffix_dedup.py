"""Removal of repeated passages by suffix arrays.

A *window* is a string of ``length`` bytes; a window is repeated if the same bytes start earlier, in a smaller document
or earlier in the same one. Every byte of a repeated window goes.

1. *Pieces.* The minimizer of a window is its run of 32 bytes with the least hash, the leftmost of equals. Neighbouring
   windows with one minimizer form a piece. Equal windows have equal minimizers at the same place, so only pieces that
   share a minimizer can have a window in common, and no piece has one twice.
2. *Fingerprints.* Pieces are folded by their content in each slice of texts: all but the earliest are repeated. The
   earliest goes, as 26 bytes in a packed array, to the bucket of its minimizer, which folds the slices' in turn. Pieces
   that share their minimizer with a different piece are left. A minimizer found more often than one shard takes, in a
   slice or over all, is *hot*: its pieces are cut finer (see ``cut_piece``), so that their neighbourhood decides
   where they go, and a common line has no shard of its own.
3. *Shards.* The bytes of the pieces that are left meet in the shard of their minimizer. A shard sorts the suffixes of
   all its pieces by induced sorting and computes permuted common prefixes. Of suffixes that agree in ``length`` bytes,
   all but the earliest are repeated windows.
4. *Documents.* Repeated stretches are joined to their documents; documents without any stay where they are while
   the ids of the others can be broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import suffix_array
from quarryline.llm.textnp import mixed
from quarryline.runtime import written

#: Bytes of a minimizer: five doublings of one byte.
RUN = 32
#: Windows of a hot minimizer's piece are cut by eighths of their place.
HOT_SHIFT = 3
#: Different pieces of one minimizer in a slice, and over all, from which it is hot.
HOT_IN_SLICE, HOT = 64, 4096
#: Bytes of a slice of texts; a longer text is read in overlapping sections of this size.
SLICE = 1 << 21
#: Pieces that a bucket of fingerprints has about, and bytes of a shard of pieces.
BUCKET_PIECES, SHARD_BYTES = 1 << 18, 1 << 20
#: Keys of documents up to which they are broadcast (16 bytes each); beyond, all texts are joined by shuffle.
BROADCAST_ROWS = 500_000
_LAST = 9223372036854775807

FINGERPRINT = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("content", "<u8"), ("mark", "<u8"), ("at", "<i4"), ("windows", "u1"), ("place", "u1")])


def keyed(docs: DataFrame, tied: bool) -> DataFrame:
    """``docs`` as (doc, tie, id, body): the order of documents is that of (doc, tie), null ids last.

    ``tie`` is 0 for all if no id is null or repeated, else a hash of the text.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tie = F.xxhash64(body, F.col("doc_id").isNull()) if tied else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), tie.alias("tie"), F.col("doc_id"), body.alias("body"))


def run_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``RUN`` bytes from each position; positions too near the end have none."""
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    out, width = table[data], 1
    while width < RUN:
        factor = mixed(np.array([width + 1000], np.uint64))[0] | np.uint64(1)
        out = out[:-width] * factor + out[width:]
        width *= 2
    return mixed(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def find_pieces(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, place, mark, content) of the pieces of texts that end at ``ends``, in order of start.

    ``place`` is where the minimizer stands in the first window, ``mark`` its hash and ``content`` a hash of all bytes.
    """
    n_windows, none = len(data) - length + 1, np.zeros(0, np.int64)
    if n_windows <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = run_hashes(data)
    keys = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(keys, length - RUN + 1)[:n_windows]
    # No window may reach over the end of its text.
    whole = np.ones(n_windows, bool)
    bound = np.zeros(len(data) + 1, np.int32)
    np.add.at(bound, np.maximum(ends - length + 1, np.concatenate([[0], ends[:-1]])), 1)
    np.add.at(bound, ends, -1)
    whole = np.cumsum(bound[:n_windows]) == 0
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n_windows))
    keep = whole[first]
    first, count = first[keep], count[keep]
    spot = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    last = first + count - 1 + length - RUN
    content = mixed(count.astype(np.uint64) + hashes[last])
    for k in range(0, 2 * length, RUN):
        content = mixed(content * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(first + k, last)])
    return first, count, spot - first, hashes[spot], content


def merged(at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches sorted by start."""
    if not len(at):
        return at, until
    reach = np.maximum.accumulate(until)
    new = np.concatenate([[True], at[1:] > reach[:-1]])
    return at[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]


SPANS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("until", pa.int32())])


def spans_table(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, until: np.ndarray) -> pa.Table:
    """Rows of ``SPANS``, with the stretches of one document merged."""
    if not len(doc):
        return SPANS.empty_table()
    order = np.lexsort((at, tie, doc))
    doc, tie, at, until = doc[order], tie[order], at[order].astype(np.int64), until[order].astype(np.int64)
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))])
    # One line for all documents: each has a stretch of it of its own.
    shift = group << 32
    a, b = merged(at + shift, until + shift)
    lead = np.searchsorted(group, a >> 32)
    return pa.table([pa.array(doc[lead]), pa.array(tie[lead]), pa.array((a & 0xFFFFFFFF).astype(np.int32)), pa.array((b & 0xFFFFFFFF).astype(np.int32))], schema=SPANS)


def earliest_first(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order of fingerprints by ``more``, then by document and place."""
    return np.lexsort((rows["at"], rows["tie"], rows["doc"], *more))


def folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of the fingerprints of each content, and the later ones; a row that is there twice is no later one."""
    rows = rows[earliest_first(rows, rows["content"])]
    lead = np.concatenate([[True], rows["content"][1:] != rows["content"][:-1]]) if len(rows) else np.zeros(0, bool)
    first = rows[np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))]
    same = (rows["doc"] == first["doc"]) & (rows["tie"] == first["tie"]) & (rows["at"] == first["at"])
    return rows[lead], rows[~same]


#: One output for all that a slice says: fingerprints of a bucket (``bucket`` >= 0), a stretch that goes (-1, ``at`` to
#: ``until``) and pieces of hot minimizers (-2).
SAID = "bucket int, doc long, tie long, at int, until int, body binary"
_SAID = pa.schema([("bucket", pa.int32()), *SPANS, ("body", pa.binary())])


def _said(bucket, table: pa.Table, body=None) -> pa.Table:
    n = table.num_rows
    return pa.table([pa.array(np.full(n, bucket, np.int32)), *table.columns, pa.nulls(n, pa.binary()) if body is None else body], schema=_SAID)


def sections(body: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in sections that share ``length`` - 1 bytes, so that each window lies in one of them."""
    for a in range(0, max(len(body) - length + 1, 0), SLICE):
        yield a, body[a : a + SLICE + length - 1]


def fingerprints(texts: list[tuple[int, int, int, bytes]], length: int) -> np.ndarray:
    """Of sections (doc, tie, offset, bytes)."""
    data = np.frombuffer(b"".join(t[3] for t in texts), np.uint8)
    ends = np.cumsum(np.fromiter((len(t[3]) for t in texts), np.int64, len(texts)))
    first, count, place, mark, content = find_pieces(data, ends, length)
    of = np.searchsorted(ends, first, side="right")
    out = np.zeros(len(first), FINGERPRINT)
    for k, name in enumerate(("doc", "tie", "at")):
        out[name] = np.array([t[k] for t in texts], np.int64)[of]
    out["at"] += (first - (ends[of] - np.array([len(t[3]) for t in texts], np.int64)[of])).astype(np.int32)
    out["windows"], out["place"], out["mark"], out["content"] = count, place, mark, content
    return out


def describe(docs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """What every slice says of its texts: rows of ``SAID``."""

    def say(texts: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = fingerprints(texts, length)
        lead, rest = folded(rows)
        yield from _said(-1, spans_table(rest["doc"], rest["tie"], rest["at"], rest["at"] + rest["windows"] + (length - 1))).to_batches()
        # Different pieces of one minimizer: with many, the bucket gets one of no windows that stands for them all.
        marks, back, n = np.unique(lead["mark"], return_inverse=True, return_counts=True)
        hot = n[back] > HOT_IN_SLICE
        if hot.any():
            some = lead[hot]
            bodies = pa.array([r.tobytes() for r in some], pa.binary())
            keys = pa.table([some["doc"], some["tie"], some["at"], some["at"]], schema=SPANS)
            yield from _said(-2, keys, bodies).to_batches()
            sign = np.zeros(int((n > HOT_IN_SLICE).sum()), FINGERPRINT)
            sign["mark"] = sign["content"] = marks[n > HOT_IN_SLICE]
            lead = np.concatenate([lead[~hot], sign])
        bucket = (lead["mark"] % np.uint64(n_buckets)).astype(np.int64)
        lead = lead[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        if len(lead):
            bodies = [part.tobytes() for part in np.split(lead, cut)]
            zero, none = np.zeros(len(bodies), np.int64), np.zeros(len(bodies), np.int32)
            table = _said(0, pa.table([zero, zero, none, none], schema=SPANS), pa.array(bodies, pa.binary()))
            yield from table.set_column(0, _SAID.field(0), pa.array(bucket[np.concatenate([[0], cut])].astype(np.int32))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for doc, tie, body in zip(*(batch.column(k) for k in range(3)), strict=True):
                for at, part in sections(body.as_py(), length):
                    held.append((doc.as_py(), tie.as_py(), at, part))
                    size += len(part)
                    if size >= SLICE:
                        yield from say(held)
                        held, size = [], 0
        if held:
            yield from say(held)

    return docs.select("doc", "tie", "body").mapInArrow(run, SAID)


def resolve(table: pa.Table, length: int) -> pa.Table:
    """One bucket: stretches that go, and the pieces that share a minimizer with a different one (body set)."""
    rows = np.frombuffer(b"".join(table.column("body").to_pylist()), FINGERPRINT)
    lead, rest = folded(rows)
    gone = spans_table(rest["doc"], rest["tie"], rest["at"], rest["at"] + rest["windows"] + np.where(rest["windows"] > 0, length - 1, 0))
    gone = gone.filter(pc.greater(gone.column("until"), gone.column("at")))
    _, back, n = np.unique(lead["mark"], return_inverse=True, return_counts=True)
    signed = np.zeros(len(n), bool)
    signed[back[lead["windows"] == 0]] = True
    shared = ((n > 1) | signed)[back] & (lead["windows"] > 0)
    hot = (signed | (n > HOT))[back]
    left = lead[shared]
    keys = pa.table([left["doc"], left["tie"], left["at"], left["at"]], schema=SPANS)
    bodies = pa.array([r.tobytes() for r in left], pa.binary())
    table = _said(0, keys, bodies).set_column(0, _SAID.field(0), pa.array(np.where(hot[shared], -2, 0).astype(np.int32)))
    return pa.concat_tables([_said(-1, gone), table])


def cut_piece(body: bytes, row: np.void, length: int, hot: bool) -> Iterator[tuple[int, int, int]]:
    """(key, at, windows): a piece whole under its minimizer, or, if that is hot, in parts.

    A part has the windows whose minimizer stands in one eighth of the places; all of them share the bytes from
    where the last one starts to where the first one ends, some 90, and these are the part's key. So equal windows keep
    a common key, while the windows of a common line part by what stands around it.
    """
    at, windows, place, mark = int(row["at"]), int(row["windows"]), int(row["place"]), int(row["mark"])
    if not hot:
        yield mark, at, windows
        return
    spot = at + place
    low = place - windows + 1
    for eighth in range(low >> HOT_SHIFT, (place >> HOT_SHIFT) + 1):
        a, b = max(low, eighth << HOT_SHIFT), min(place, (eighth << HOT_SHIFT) + (1 << HOT_SHIFT) - 1)
        core = body[spot - (eighth << HOT_SHIFT) : spot - (eighth << HOT_SHIFT) - (1 << HOT_SHIFT) + 1 + length]
        yield int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=eighth.to_bytes(2, "little")).digest(), "little"), spot - b, b - a + 1


PIECES = "shard int, doc long, tie long, at int, body binary"
_PIECES = pa.schema([("shard", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("body", pa.binary())])


def extract(texts: DataFrame, length: int, n_shards: int) -> DataFrame:
    """Pieces by shard from (doc, tie, body, rows: hot flags and fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for doc, tie, body, rows in zip(*(batch.column(k) for k in range(4)), strict=True):
                body = body.as_py()
                for r in rows.as_py():
                    row = np.frombuffer(r["body"], FINGERPRINT)[0]
                    for key, at, windows in cut_piece(body, row, length, r["bucket"] == -2):
                        piece = body[at : at + windows + length - 1]
                        size += len(piece)
                        for column, value in zip(out, (key % n_shards, doc.as_py(), tie.as_py(), at, piece), strict=True):
                            column.append(value)
                if size > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)
                    out, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return texts.mapInArrow(run, PIECES)


def repeated_windows(pieces: list[bytes], rank: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which positions of ``joined`` pieces start a window that starts earlier too, by the suffix array of the pieces.

    ``rank`` orders the pieces' documents, ``at`` is where a piece starts in its document.
    """
    data, starts, left = suffix_array.joined(pieces)
    order = suffix_array.suffix_array(*suffix_array.letters_of(data, left))[1:]
    _, common = suffix_array.permuted_common_prefixes(data, left, order)
    # Suffixes next to each other that agree in a whole window are one group.
    group = np.flatnonzero(common[order] < length)
    of = np.repeat(np.arange(len(pieces)), np.diff(np.append(starts, len(data))))
    position = (rank[of] << 32) + at[of] + np.arange(len(data)) - starts[of]
    least = np.repeat(np.minimum.reduceat(position[order], group), np.diff(np.append(group, len(order))))
    later = np.zeros(len(data), bool)
    later[order] = position[order] > least
    return later & (left >= length)


def sort_shard(table: pa.Table, length: int) -> pa.Table:
    """The repeated stretches among the pieces of one shard."""
    doc, tie, at = (table.column(c).to_numpy() for c in ("doc", "tie", "at"))
    pieces = table.column("body").to_pylist()
    order = np.lexsort((tie, doc))
    new = np.concatenate([[0], np.cumsum((doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1]))])
    rank = np.zeros(len(doc), np.int64)
    rank[order] = new
    later = np.flatnonzero(repeated_windows(pieces, rank, at.astype(np.int64), length))
    _, starts, _ = suffix_array.joined(pieces)
    of = np.searchsorted(starts, later, side="right") - 1
    start = at[of] + (later - starts[of])
    return spans_table(doc[of], tie[of], start, start + length)


def strip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) from (doc_id, body, spans), the spans united and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("until", pa.int32())]))
        for batch in batches:
            for k in range(batch.num_rows):
                # A row at a time: one text may be as large as a batch.
                body, spans = batch.column(1)[k].as_py(), sorted((s["at"], s["until"]) for s in batch.column(2)[k].as_py())
                a, b = (x.tolist() for x in merged(*(np.array([s[k] for s in spans], np.int64) for k in (0, 1))))
                kept = b"".join(body[x:y] for x, y in zip([0, *b], [*a, len(body)], strict=True))
                spans = [{"at": x, "until": y} for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(body)], pa.int64()), pa.array([kept], pa.binary()), pa.array([spans], kind)], ["doc_id", "n_bytes", "kept", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "body", "spans").mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<at:int,until:int>>")


def _touched(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose (doc, tie) is in ``keys``, without moving any, and the others; all rows and None if there are too many keys."""
    if keys.count() > BROADCAST_ROWS:
        return rows, None
    return rows.join(F.broadcast(keys), ["doc", "tie"], "left_semi"), rows.join(F.broadcast(keys), ["doc", "tie"], "left_anti")


def repeated_spans(rows: DataFrame, length: int = 100) -> DataFrame:
    """(doc, tie, at, until) of the stretches of ``keyed`` rows that repeated windows cover; stretches may overlap."""
    if length < 2 * RUN or length > 255 - RUN:
        raise ValueError(f"windows have {2 * RUN} to {255 - RUN} bytes")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    n_buckets = max(parts, 2 * total // (length - RUN + 2) // BUCKET_PIECES)
    said = written(describe(rows, length, n_buckets), "passage-fingerprints")
    found = said.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda table: resolve(table, length), SAID)
    found = written(found, "passage-pieces")

    left = said.where("bucket = -2").unionByName(found.where("bucket <> -1"))
    wanted = written(left.groupBy("doc", "tie").agg(F.collect_list(F.struct("bucket", "body")).alias("rows"), F.sum(F.when(F.col("bucket") == -2, 4 * length).otherwise(2 * length)).alias("size")), "passage-documents")
    n_bytes = wanted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    some, _ = _touched(rows, wanted.select("doc", "tie"))
    texts = some.select("doc", "tie", "body").join(wanted.drop("size"), ["doc", "tie"])
    pieces = extract(texts, length, max(parts, n_bytes // SHARD_BYTES))
    later = pieces.groupBy("shard").applyInArrow(lambda table: sort_shard(table, length), "doc long, tie long, at int, until int")
    columns = ["doc", "tie", "at", "until"]
    return said.where("bucket = -1").select(columns).unionByName(found.where("bucket = -1").select(columns)).unionByName(later)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_bytes, kept, spans; the UTF-8 text without repeated windows.

    Each byte covered by a string of ``length`` bytes that also starts earlier is removed; strings are judged on the
    input. ``kept`` has the bytes that stay, which may end within a character; ``spans`` are the stretches (at, until)
    that go, in order and apart. Documents come in order of doc_id, null ids last, and rows of one id in order of a
    hash of their text; a row that repeats with id and text counts once, and all its copies get one result. Null texts
    are empty; texts under ``length`` bytes stay. An empty table gives no rows; other columns are ignored.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    rows = keyed(docs, bool(ids.limit(1).count()))
    spans = written(repeated_spans(rows, length), "passage-spans")
    spans = written(spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "until")).alias("spans")), "passage-removed")
    some, others = _touched(rows, spans.select("doc", "tie"))
    none = F.array().cast("array<struct<at:int,until:int>>")
    if others is None:
        return strip(some.join(spans, ["doc", "tie"], "left").withColumn("spans", F.coalesce("spans", none)))
    whole = others.select(F.col("doc_id").cast("long"), F.octet_length("body").cast("long").alias("n_bytes"), F.col("body").alias("kept"), none.alias("spans"))
    return strip(some.join(spans, ["doc", "tie"])).unionByName(whole)
