"""Reading source trees and reading and writing indexes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline import config
from quarryline.runtime import written
from quarryline.sources.json_entries import RANGE_BYTES, object_entries

SYMBOL = "name string, qualified_name string, type string, file string, line int"
DOCUMENT = f"id long, {SYMBOL}, text string"
EDGE = "source string, target string, type string, line int, file string"


#: (store, path in it) of a URI; runs on executors.
Opener = Callable[[str], tuple["fs.FileSystem", str]]


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or absolute path, with the credentials that the machine has for it. Hadoop's s3a go by s3."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _below(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}" if name else root


def _listed(spark: SparkSession, root: str, pruned: tuple[str, ...] = (), opener: Opener = open_store) -> DataFrame:
    """(file, size) of all files below ``root`` but for those under a ``pruned`` folder, which is not entered.

    Executors list the folders of one level after the other; the names stay in tables in the shared folder, and
    the driver only asks whether a level has folders. One folder is listed by one task. (Spark's own readers pass over
    names that begin with an underscore, as ``__init__.py`` does.) A link is followed as its store does; a folder that
    is gone by the time it is listed has no files.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opener(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(_below(top, folder), allow_not_found=True))
                for a in range(0, len(found), 10_000):
                    some = found[a : a + 10_000]
                    names = [f"{folder}/{x.base_name}" if folder else x.base_name for x in some]
                    columns = [pa.array(names, pa.string()), pa.array([x.base_name for x in some], pa.string()), pa.array([x.type == fs.FileType.Directory for x in some]), pa.array([x.size or 0 for x in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "name", "is_folder", "size"])

    level, files = spark.createDataFrame([("",)], "folder string"), None
    while True:
        found = written(level.mapInArrow(entries, "file string, name string, is_folder boolean, size long"), "tree-level")
        own = found.where(~F.col("is_folder")).select("file", "size")
        files = own if files is None else files.unionByName(own)
        level = found.where(F.col("is_folder") & ~F.col("name").isin(*pruned)).select(F.col("file").alias("folder"))
        if level.isEmpty():
            return files
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")


def scan_tree(spark: SparkSession, root: str, pruned: tuple[str, ...] = config.PRUNED, opener: Opener = open_store) -> DataFrame:
    """(file, size) of all files below ``root`` but for those under a pruned folder."""
    return _listed(spark, root, pruned, opener)


def read_sources(spark: SparkSession, root: str, suffix: str = ".py", opener: Opener = open_store) -> DataFrame:
    """(file, text) of every source file below ``root``; paths are relative, with ``/``.

    Executors list the folders and read the texts, a file at a time; bytes that are no UTF-8 are replaced.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opener(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(_below(top, name)) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], ["file", "text"])

    names = _listed(spark, root, opener=opener).where(F.col("file").endswith(suffix)).select("file")
    return names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(read, "file string, text string")


def write_tree(rows: DataFrame, root: str, opener: Opener = open_store) -> int:
    """Write (file, text) as a tree below ``root``, a null text as an empty file; how many were written.

    Executors write under a name of the attempt and rename, so that a task that is run again leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opener(root)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = _below(top, name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write((text or "").encode())
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("file", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def require(spark: SparkSession, path: str) -> str:
    """``path`` if it exists in its file system; otherwise FileNotFoundError."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        raise FileNotFoundError(f"No index at {path}")
    return path


def read_index(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An index written by ``write_index``, or a file that holds a JSON array."""
    require(spark, path)
    if path.endswith(".json"):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        lines = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
        return spark.read.schema(schema).json(path, multiLine=not lines)
    return spark.read.schema(schema).parquet(path)


def write_index(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the index at ``path``, as JSON, a row a line, if it is named so, else as parquet."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.json if path.endswith(".json") else writer.parquet)(path)


def load_documents(spark: SparkSession, path: str, opener: Opener = open_store, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Documents from JSON files, each an array, an object with ``documents``, or an object by name.

    ``path`` is a file, or a folder whose files are all read but for those hidden by ``_`` or ``.``. A file is read
    by many tasks, a range of bytes each. Entries that are no objects or have no name are passed over; of one name the
    last counts, by file and place in it.
    """
    require(spark, path)
    store, top = opener(path)
    known = store.get_file_info(top)
    if known.type == fs.FileType.Directory:
        hidden = F.substring_index("file", "/", -1).substr(1, 1).isin("_", ".")
        found = _listed(spark, path, opener=opener).where(~hidden)
    else:
        found = spark.createDataFrame([("", known.size)], "file string, size long")

    def open_file(name: str):
        store, top = opener(path)
        return store.open_input_file(_below(top, name))

    rows = object_entries(found, open_file, range_bytes=range_bytes)
    rows = rows.withColumn("d", F.from_json("entry", f"{DOCUMENT}, file_path string, code string, content string"))
    rows = rows.withColumn("full", F.coalesce("d.qualified_name", "key")).where(F.coalesce("full", F.lit("")) != "")
    last = rows.groupBy("full").agg(F.max_by("d", F.struct("file", "pos")).alias("d"))
    text = F.coalesce(*[F.when(F.col(f"d.{c}") != "", F.col(f"d.{c}")) for c in ("text", "code", "content")], F.lit(""))
    return last.select("d.id", F.col("d.name"), F.col("full").alias("qualified_name"), "d.type", F.coalesce("d.file", "d.file_path").alias("file"), "d.line", text.alias("text"))


def cached_vectors(documents: DataFrame, path: str, encode) -> DataFrame:
    """(id, embedding): read from ``path`` where the text has been encoded before, else by ``encode``.

    Rows are keyed by the SHA-256 of the text, null counting as '', so that a changed text is encoded anew. ``encode``
    takes a frame (digest, text) and returns (digest, embedding). Several jobs may fill one cache: a text that two have
    encoded is there twice and read once, with the lesser of the two vectors. One id gets one row for each of its rows.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = documents.select(F.sha2(text, 256).alias("digest"), text.alias("text")).distinct()
    schema = "digest string, embedding array<float>"
    try:
        known = spark.read.schema(schema).parquet(require(spark, path))
    except FileNotFoundError:
        known = None
    missing = texts if known is None else texts.join(known.select("digest"), "digest", "left_anti")
    encode(missing).select("digest", "embedding").write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).groupBy("digest").agg(F.min("embedding").alias("embedding"))
    return documents.select("id", F.sha2(text, 256).alias("digest")).join(known, "digest").select("id", "embedding")
