"""Structured Streaming into datasets: rename, upsert by micro-batch, converge if asked.

Late rows need no watermark: what arrives while a run converges is found by the next diff. A micro-batch
that is run again upserts the same keys to the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colstate.plans.engine import Engine
from colstate.plans.model import Source
from colstate.sources import records
from colstate.sources.snapshots import SnapshotTable


def files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def kafka(spark: SparkSession, servers: str, source: Source) -> DataFrame:
    """Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", source.topic).load()


def renamed(stream: DataFrame, source: Source) -> DataFrame:
    """The stream's columns under the dataset's names."""
    return stream.withColumnsRenamed(source.mapping)


def start(
    stream: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    *,
    on_update: str = "invalidate",
    order_by: list | None = None,
    engine: Engine | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Upsert each micro-batch; with an engine, converge after it. Without an interval: all there is, then stop."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            table.upsert(df, on_update, order_by)
            if engine is not None:
                engine.converge()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def appending(table: SnapshotTable) -> Callable[[DataFrame], None]:
    """A sink of start_enriching: each micro-batch is appended to a dataset."""
    return lambda df: table.append(df)


def start_enriching(bodies: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, interval: str | None = "500 milliseconds") -> StreamingQuery:
    """Single serialised records, enriched and appended by micro-batch."""

    def batch(df: DataFrame, _: int) -> None:
        sink(records.enriched(records.users_from_protobuf(df)))

    writer = bodies.where(F.col("body").isNotNull()).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
