"""Feeding an index from a stream of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quarryline.operators.edges import symbols
from quarryline.plans.pyast import parse_sources


def feed_symbols(files: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the symbols of each micro-batch of (file, text) to ``path``/batch=<n>; a batch run again replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        symbols(parse_sources(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
