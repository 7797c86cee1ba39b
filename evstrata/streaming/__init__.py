"""Streaming forms of duplicate removal and of roll-over by age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY


def stream_events(spark, path: str, schema: str) -> DataFrame:
    """A directory that files keep arriving in."""
    return spark.readStream.schema(schema).parquet(path)


def drop_duplicates(stream: DataFrame, delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first copy of each ID; what is remembered ends with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(KEY))


def roll_by_age(stream: DataFrame, age: str = "1 hour", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts of the files that roll-over by age would write: one per window of event time and run."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, age), "run").agg(F.count("*").alias("events"), F.min("event").alias("first_event"), F.max("event").alias("last_event"))


def write_rolled(stream: DataFrame, path: str, checkpoint: str, records: int = 1_000_000):
    """Append micro-batches as files of at most ``records`` rows, by run."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", records).partitionBy("run").outputMode("append")
