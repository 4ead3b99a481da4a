"""Streaming sources over the driver tables.

A folder of parquet files is read as a stream with the table's fixed schema
(no inference); the caller bounds the files per micro-batch where a long history
is waiting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartograph.session import checkpoint_dir
from cartograph.sources.tables import DRIVER_SCHEMAS, table_path


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Stream the files of one driver table, at most ``files_per_trigger`` of
    them in a micro-batch if given."""
    reader = spark.readStream.schema(DRIVER_SCHEMAS[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = table_path(sf_dir, name)
    # a one-letter class makes the path a pattern: a stream takes a pattern
    # that meets one file as well as a folder, but no plain file
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def checkpoint_location(spark: SparkSession, query_name: str) -> str:
    """Per-query checkpoint folder under the session's shared checkpoint
    directory (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{query_name}"
