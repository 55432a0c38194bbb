"""Entries of large JSON files, found a byte range at a time, so that one file is read by many tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

#: Bytes that a task looks at in one piece.
RANGE_BYTES = 4 << 20
_BLANKS = b" \t\r\n"
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = np.zeros(256, bool)
_MARK[list(b",[]{}")] = True


def _read(f, at: int, until: int) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read(until - at), np.uint8)


def _backslashes(f, at: int) -> int:
    """How many backslashes stand directly before a place."""
    n, block = 0, 64
    while n < at:
        b = _read(f, max(0, at - n - block), at - n)
        kept = len(bytes(b).rstrip(b"\\"))
        n += len(b) - kept
        if kept:
            break
        block *= 2
    return n


def _quotes(b: np.ndarray, ahead: int) -> np.ndarray:
    """Places of the quotes that open or close a string: no odd run of backslashes, ``ahead`` of them before ``b``, precedes."""
    found = np.flatnonzero(b == 34)
    slash = b == 92
    if not len(found) or not (ahead or slash.any()):
        return found
    other = np.maximum.accumulate(np.where(slash, -1 - ahead, np.arange(len(b), dtype=np.int64)))
    before = np.where(found > 0, other[found - 1], -1 - ahead)
    return found[(found - 1 - before) % 2 == 0]


def _marks(b: np.ndarray, ahead: int, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(places of brackets and commas outside strings, depth after each, whether the end is inside a string, depth there)."""
    quotes = _quotes(b, ahead)
    places = np.flatnonzero(_MARK[b])
    places = places[(inside + np.searchsorted(quotes, places)) % 2 == 0]
    after = depth + np.cumsum(_STEP[b[places]])
    return places, after, (inside + len(quotes)) % 2, int(after[-1]) if len(after) else depth


def _bounds(b: np.ndarray, places: np.ndarray, after: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, opens): the marks that part entries at ``level``, and whether an entry follows."""
    kind = b[places]
    comma = (kind == 44) & (after == level)
    opening = (_STEP[kind] > 0) & (after == level)
    closing = (_STEP[kind] < 0) & (after == level - 1)
    at = comma | opening | closing
    return places[at], ~closing[at]


def _rest(f, at: int, size: int, inside: int, depth: int, level: int) -> bytes | None:
    """What remains of the entry that goes on at ``at``; None if the file ends before it does."""
    parts = []
    while at < size:
        b = _read(f, at, min(size, at + RANGE_BYTES))
        places, after, still, below = _marks(b, _backslashes(f, at), inside, depth)
        bounds, _ = _bounds(b, places, after, level)
        if len(bounds):
            return b"".join([*parts, bytes(b[: bounds[0]])])
        parts.append(bytes(b))
        at, inside, depth = at + len(b), still, below
    return None


def _is_key(f, at: int, name: str) -> bool:
    """Whether the value that begins at ``at`` has the key ``name``."""
    block, most = 256, 6 * len(name) + 2
    while True:
        begin = max(0, at - block)
        head = bytes(_read(f, begin, at)).rstrip(_BLANKS)
        if head and not head.endswith(b":"):
            return False
        head = head[:-1].rstrip(_BLANKS)
        if len(head) > most or begin == 0:
            break
        block *= 2
    for k in range(max(0, len(head) - most), len(head)):
        if head[k] == 34 and (k == 0 or head[k - 1] != 92):
            try:
                if json.loads(head[k:]) == name:
                    return True
            except ValueError:
                pass
    return False


def _over_ranges(ranges: DataFrame, open_file: Callable, schema: str, look: Callable) -> DataFrame:
    """What ``look`` (open file, range as a dict) yields, as rows; a task has one range in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["file"]) as f:
                    found = list(look(f, row))
                if found:
                    yield pa.RecordBatch.from_pylist(found, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "file", "at").mapInArrow(run, schema)


def _measure(f, row: dict) -> Iterator[dict]:
    """Quotes of a range, and how it changes the depth if it begins outside and inside a string."""
    b = _read(f, row["at"], row["until"])
    ahead = _backslashes(f, row["at"])
    out = [_marks(b, ahead, inside, 0) for inside in (0, 1)]
    first = bytes(b[:1]) if len(b) and b[0] not in _BLANKS else bytes(b).lstrip(_BLANKS)[:1]
    yield row | {"quotes": out[0][2], "outside": out[0][3], "inside": out[1][3], "first": first.decode("latin-1") or None}


def _closes(name: str) -> Callable:
    def look(f, row: dict) -> Iterator[dict]:
        """The first place where a range comes back to the root's members, and arrays that begin in it under ``name``."""
        b = _read(f, row["at"], row["until"])
        places, after, _, _ = _marks(b, _backslashes(f, row["at"]), row["in_string"], row["depth"])
        kind = b[places]
        shut = places[(_STEP[kind] < 0) & (after == 1)] + row["at"]
        if len(shut):
            yield {"file": row["file"], "at": row["at"], "opened": None, "closed": int(shut[0])}
        for p in places[(kind == 91) & (after == 2)] + row["at"]:
            if _is_key(f, int(p), name):
                later = shut[shut > p]
                yield {"file": row["file"], "at": row["at"], "opened": int(p), "closed": int(later[0]) if len(later) else None}

    return look


def _cut(f, row: dict) -> Iterator[dict]:
    """The entries that begin in a range; one that goes on is read to its end."""
    at, level = row["at"], row["level"]
    b = _read(f, at, row["until"])
    places, after, still, below = _marks(b, _backslashes(f, at), row["in_string"], row["depth"])
    bounds, opens = _bounds(b, places, after, level)
    kept = (bounds + at >= row["lowest"]) & (bounds + at <= row["highest"])
    bounds, opens = bounds[kept], opens[kept]
    for i in np.flatnonzero(opens):
        begin = int(bounds[i]) + 1
        if i + 1 < len(bounds):
            raw = bytes(b[begin : bounds[i + 1]])
        else:
            more = _rest(f, row["until"], row["size"], still, below, level)
            if more is None:
                continue
            raw = bytes(b[begin:]) + more
        key, text = None, raw.decode("utf-8", "replace").strip()
        if row["named"]:
            try:
                key, used = json.JSONDecoder(strict=False).raw_decode(text)
            except ValueError:
                continue
            text = text[used:].lstrip().removeprefix(":").lstrip()
        if text.startswith("{") and (key is None or isinstance(key, str)):
            yield {"file": row["file"], "pos": at + begin, "key": key, "entry": text}


def object_entries(files: DataFrame, open_file: Callable, listed_under: str = "documents", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, pos, key, entry): the entries of JSON files that are objects, as text, with their place in the file.

    ``files`` is (file, size), ``open_file`` opens one on an executor, seekable. A file is an array, an object with an
    array under ``listed_under`` (the last of that name), or an object by name, whose names are the keys. Every task
    looks at ranges of ``range_bytes`` and goes on beyond a range only to the end of an entry. What stands ahead of a
    range (strings opened, depth) is summed from one row per range. Entries that are no objects, or that the file ends
    within, are passed over, as are empty files and files of another kind. Bytes that are no UTF-8 are replaced.
    """
    ranges = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("at"))
    ranges = ranges.withColumn("until", F.least("size", F.col("at") + range_bytes))
    told = "file string, size long, at long, until long"
    seen = written(_over_ranges(ranges, open_file, f"{told}, quotes long, outside long, inside long, first string", _measure), "json-ranges")
    ahead = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = seen.withColumns({"in_string": F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2, "root": F.first("first", True).over(whole)})
    seen = seen.withColumn("change", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    seen = seen.withColumn("depth", F.coalesce(F.sum("change").over(ahead), F.lit(0))).where(F.col("root").isin("[", "{"))
    seen = written(seen.select("file", "size", "at", "until", "in_string", "depth", "root"), "json-depths")

    shut = written(_over_ranges(seen.where("root = '{'"), open_file, "file string, at long, opened long, closed long", _closes(listed_under)), "json-arrays")
    last = shut.where("opened is not null").groupBy("file").agg(F.max_by(F.struct("at", "opened", "closed"), "opened").alias("a")).select("file", "a.*")
    later = shut.where("opened is null").select("file", F.col("at").alias("later"), F.col("closed").alias("end"))
    later = last.join(later, "file").where("closed is null and later > at").groupBy("file").agg(F.min("end").alias("end"))
    arrays = last.join(later, "file", "left").select("file", "opened", F.coalesce("closed", "end").alias("closed"))

    rows = seen.join(arrays, "file", "left")
    listed = F.col("opened").isNotNull()
    rows = rows.select(*("file", "size", "at", "until", "in_string", "depth"), F.when(listed, 2).otherwise(1).alias("level"), (~listed & (F.col("root") == "{")).alias("named"), F.coalesce("opened", F.lit(0)).alias("lowest"), F.coalesce("closed", "size").alias("highest"))
    rows = rows.where("until > lowest and at <= highest")
    return _over_ranges(rows, open_file, "file string, pos long, key string, entry string", _cut)
