"""Streams over files: windowed counts, an incremental materialised view, deduplication within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The file as a stream: its folder is watched, other files are left out by name."""
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/data")


def tumbling_counts(spark: SparkSession, path: str, out: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(day, event_type, n) of a stream by tumbling windows; batches are merged into the result by foreachBatch in update mode."""
    counts = events_stream(spark, path).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = flat.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).option("recursiveFileLookup", False).parquet(f"{out}/batch=*")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def materialized_view(spark: SparkSession, path: str, out: str) -> DataFrame:
    """(user_id, n, v): each batch's partial sums are appended once; reading adds them up."""

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same number overwrites: a retried batch counts once

    query = events_stream(spark, path).writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def deduplicated(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The stream with one row for each event_id within the watermark."""
    return _run(events_stream(spark, path).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]), out)
