"""A Structured Streaming front end: records that arrive are matched against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import adapters as A
from ..sources.io import work_path


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream over files that are there, run once through and written as Parquet exactly once per batch."""
    out = work_path(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        at = 0 if mode == "complete" else epoch  # a batch that is run again replaces itself; a complete result replaces the last
        batch.write.mode("overwrite").parquet(f"{out}/epoch={at}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", work_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/epoch=*")


def match_stream(stream: DataFrame, index: DataFrame) -> DataFrame:
    """Arriving (entity_id, country, name) joined to a static index (target_id, country, name)."""
    return stream.join(index, ["country", "name"]).select(F.col("entity_id").alias("s1_id"), "target_id")


def streamed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda df: df.select("entity_id", F.upper("country").alias("country"), X.token_normalize(F.col("business_name")).alias("name"))
    path = work_path(spark, "arriving")
    A.s1(spark, sf_dir).write.parquet(path)
    arriving = key(spark.readStream.schema(A.s1(spark, sf_dir).schema).parquet(path))
    index = key(A.targets(spark, sf_dir)).withColumnRenamed("entity_id", "target_id")
    return run_to_end(spark, match_stream(arriving, index), "matches")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type as a stream with a watermark; late rows within it count."""
    path = work_path(spark, "events")
    A.table(spark, sf_dir, "events").write.parquet(path)  # a stream reads a folder that files arrive in
    events = spark.readStream.schema(A.table(spark, sf_dir, "events").schema).parquet(path)
    hours = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "36500 days").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_end(spark, hours.select(F.col("w.start").cast("timestamp_ntz").alias("ts_hour"), "event_type", "n"), "hours", "complete")
