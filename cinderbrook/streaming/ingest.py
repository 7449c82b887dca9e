"""Streams of observations: deduplicated ingest, daily means, pairing with events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import segment
from ..operators.quality import new_rows


def read_stream(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "7 days") -> DataFrame:
    """The first row per key, as long as repeats come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_means(stream: DataFrame, site: str, time: str, value: str, delay: str = "1 day") -> DataFrame:
    """(site, date, mean, n), each day once its rows can no longer come."""
    window = F.window(time, "1 day")
    found = stream.withWatermark(time, delay).groupBy(site, window.alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return found.select(site, F.col("w.start").cast("date").alias("date"), "mean", "n")


def paired_with_events(stream: DataFrame, events: DataFrame, site: str, day: str, start: str, end: str, years: int = 3) -> DataFrame:
    """Each observation with the events of its site in whose windows it lies; the events are a static table."""
    joined = stream.join(events, site).withColumn("segment", segment(F.col(day), F.col(start), F.col(end), years))
    return joined.where("segment is not null")


def append_new_rows(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order: Sequence[str] | None = None) -> StreamingQuery:
    """Appends to a table the rows whose keys it lacks; a batch that is replayed after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
        present = spark.read.schema(batch.schema).parquet(path) if there else batch.limit(0)
        new_rows(batch, present, keys, order).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
