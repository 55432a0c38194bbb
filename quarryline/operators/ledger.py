"""Replies of generators, kept by the digest of their prompt, so that a task that is run again does not ask again."""

from __future__ import annotations

import time
import urllib.error
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.runtime import shared_folder, written
from quarryline.sources.files import Opener, open_store, require

SCHEMA = "digest string, reply string"
#: Replies below 500 that may be different the next time: time-out, conflict, too early, too many requests.
PASSING = (408, 409, 425, 429)


def digest(prompt: Column, name: str = "") -> Column:
    """The key of a prompt put to the generator ``name``."""
    return F.sha2(F.concat_ws("\n", F.lit(name), prompt), 256)


def _may_pass(e: RuntimeError) -> bool:
    cause = e.__cause__
    return not isinstance(cause, urllib.error.HTTPError) or cause.code >= 500 or cause.code in PASSING


def ask(generator, prompt: str, attempts: int, pause: float) -> str:
    """The reply to a prompt, asked up to ``attempts`` times with doubled pauses; an error that will not pass is raised at once."""
    for left in reversed(range(attempts)):
        try:
            return generator.generate(prompt)
        except RuntimeError as e:
            if not left or not _may_pass(e):
                raise
        time.sleep(pause)
        pause *= 2
    raise ValueError("attempts must be 1 or more")


def replies(prompts: DataFrame, make: Callable, place: str | None = None, at_once: int = 4, tasks: int | None = None, attempts: int = 4, pause: float = 1.0, opener: Opener = open_store) -> DataFrame:
    """(digest, reply) of (digest, prompt), each digest asked once; ``make`` builds the generator on an executor.

    ``place`` is a folder that all machines share; a later call with the same one asks only what is new. Without one
    the call has its own. A reply is a file there before its row goes on, so that a task that fails and is run again
    reads what it has paid for; at the end the replies become a parquet table and the files go. At most ``at_once``
    times ``tasks`` calls run at a time. A call that still fails ends the job and leaves the replies so far. Two
    attempts of a task at the same time (speculation), or two jobs, may each ask; one reply is then read.
    """
    spark = prompts.sparkSession
    place = (place or f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}").rstrip("/")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{place}/table"

    def file_of(top: str, key: str) -> str:
        return f"{top}/fresh/{key[:2]}/{key}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opener(place)
        generator = make()

        def one(key: str, text: str) -> str:
            path = file_of(top, key)
            try:
                with store.open_input_stream(path) as f:
                    return f.read().decode()
            except FileNotFoundError:
                pass
            reply = ask(generator, text, attempts, pause)
            part = f"{path}.{uuid.uuid4().hex}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(part) as f:
                f.write(reply.encode())
            store.move(part, path)
            return reply

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                try:
                    said = list(pool.map(one, keys, batch.column(1).to_pylist()))
                except BaseException:
                    pool.shutdown(cancel_futures=True)
                    raise
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(said, pa.string())], ["digest", "reply"])

    def forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opener(place)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                try:
                    store.delete_file(file_of(top, key))
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    asked = prompts.groupBy("digest").agg(F.first("prompt").alias("prompt"))
    try:
        known = spark.read.schema(SCHEMA).parquet(require(spark, table))
        asked = asked.join(known.select("digest").distinct(), "digest", "left_anti")
    except FileNotFoundError:
        pass
    fresh = written(asked.repartition(tasks, "digest").mapInArrow(run, SCHEMA), "replies")
    fresh.write.mode("append").parquet(table)
    fresh.select("digest").mapInArrow(forget, "n long").agg(F.sum("n")).collect()  # one row
    said = spark.read.schema(SCHEMA).parquet(table).groupBy("digest").agg(F.min("reply").alias("reply"))
    return said.join(prompts.select("digest").distinct(), "digest", "left_semi")
