"""Session building and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "quarryline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package() -> None:
    """Send this package's functions to the executors by value, so that they need no copy of it."""
    import quarryline

    if quarryline.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(quarryline)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``. Only a local session may do without; it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="quarryline-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: A table made of little is written in no more files than these for each core of the cluster; more input, more files.
FILES_PER_CORE = 4
BYTES_PER_FILE = 64 << 20
#: Rows from which a written table is no longer broadcast by Spark's own estimate: that is the size of its files, which for
#: repetitive rows is a small part of what they take in memory.
BROADCAST_ROWS = 20_000
#: Folders that ``written`` has made and ``release`` has not deleted.
_MADE: list[str] = []


def _files(df: DataFrame) -> int:
    """How many files will do, by the size of what the plan reads; tables of unknown size do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(n for n in sizes if n < 1 << 60)
    return max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, min(read // BYTES_PER_FILE, 1 << 24))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out to all cores by ``key``, for work that costs more than the move: a small file is one task otherwise."""
    return df.repartition(_files(df), key)


def written(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    At most ``files`` files are written where the caller knows how many will do. ``release`` deletes what is no
    longer read. Joins with a table of more than ``BROADCAST_ROWS`` shuffle, unless the caller asks for a broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.coalesce(min(files or 1 << 24, _files(df))).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.hint("merge") if back.count() > BROADCAST_ROWS else back  # counted by the files' footers


def made() -> tuple[str, ...]:
    """The tables written so far, for ``release``."""
    return tuple(_MADE)


def release(spark: SparkSession, paths: tuple[str, ...] | None = None, but: DataFrame | None = None) -> None:
    """Delete tables that ``written`` has made: all, or those of ``paths``, without the files that ``but`` reads."""
    spared = {f.rsplit("/", 2)[-2] for f in but.inputFiles()} if but is not None else set()
    for path in paths if paths is not None else made():
        if path.rsplit("/", 1)[-1] not in spared:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            if path in _MADE:
                _MADE.remove(path)
