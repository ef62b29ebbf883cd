"""Streams: runtime observations to nodes, and generation-wise materialization of a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.changefeed import BucketedTable
from palimpsest.sources.scan import observation_nodes


def stream_observations(observations: DataFrame, granted: list[str], namespace: str, delay: str = "1 hour") -> DataFrame:
    """Observation nodes of a stream, each id once within ``delay``.

    State is bounded by a watermark on the observation's time: an observation later than the delay is dropped, and one repeated after it
    comes out again. ``observation_nodes`` over what has been stored is the exact way; ids are digests of the content, so it drops such
    repeats and, run over the source, has the late ones too.
    """
    timed = observations.withColumn("observed_at", F.timestamp_micros(F.expr("observed_at_nanos div 1000")))
    content = F.concat_ws("|", "producer_namespace", "subject", "relation", "object", F.col("observed_at_nanos").cast("string"))
    usable = timed.where(
        (F.col("producer_namespace") == namespace) & F.col("relation").isin(granted) & F.col("subject").isNotNull() & F.col("object").isNotNull()
        & (F.col("observed_at_nanos") >= 0)
    )
    return (
        usable.withColumn("node_id", F.sha2(content, 256))
        .withWatermark("observed_at", delay)
        .dropDuplicatesWithinWatermark(["node_id"])
        .select("node_id", F.lit("RuntimeObservation").alias("kind"), "subject", "relation", "object", "observed_at_nanos")
    )


def windowed_counts(observations: DataFrame, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Observations by relation in tumbling windows of their time; rows later than the delay are dropped by the watermark."""
    timed = observations.withColumn("observed_at", F.timestamp_micros(F.expr("observed_at_nanos div 1000")))
    return timed.withWatermark("observed_at", delay).groupBy(F.window("observed_at", width), "relation").agg(F.count("*").alias("observations"))


def materialize_feed(feed: DataFrame, root: str, buckets: int, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of a change feed to a bucketed table. Applying a batch again changes nothing, so a retry is safe."""
    spark = feed.sparkSession

    def apply(batch: DataFrame, _: int) -> None:
        BucketedTable(spark, root, buckets).apply(batch)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["materialize_feed", "observation_nodes", "stream_observations", "windowed_counts"]
