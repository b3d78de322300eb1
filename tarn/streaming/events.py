"""Streams of events: windows with watermarks, incremental profiles, idempotent ingest. The plans are the same over a
table, which is how their results are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, schema: StructType, folder: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window(time, size), time, by, value, late)


def sliding(events: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window(time, size, step), time, by, value, late)


def sessions(events: DataFrame, time: str, by: list[str], value: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    return _windowed(events, F.session_window(time, gap), time, by, value, late)


def _windowed(events: DataFrame, window, time: str, by: list[str], value: str, late: str | None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends what is new, once a key, until the source is read up. With a time column keys are remembered in the state
    for as long as rows may be late, so that the cost of a batch doesn't grow with what was written. Without one each
    batch is held against the keys of the target, so that another checkpoint (or a batch that runs again) adds nothing;
    that reads the target's key column at every batch."""
    if time:
        fresh = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
        return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The rows that a stream of append mode gives until its source is read up."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)
