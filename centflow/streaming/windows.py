"""Windowed counts, duplicate removal, feature lookup and triggers on streams."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from centflow import schemas as sc


def velocity_windows(
    events: DataFrame, size: str, slide: str | None = None, watermark: str | None = None,
    key: str = "merchant_id", ts: str = "received_at",
) -> DataFrame:
    """Event counts per key in tumbling or sliding windows; the same on static and streaming frames."""
    if events.isStreaming and watermark:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, size, slide), key).count()


def velocity_1m(events: DataFrame) -> DataFrame:
    return velocity_windows(events, "1 minute", watermark="2 minutes")


def velocity_5m(events: DataFrame) -> DataFrame:
    return velocity_windows(events, "5 minutes", "1 minute", watermark="10 minutes")


def by_arrival(df: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Put the watermark on the time of arrival, that of the micro-batch, in a column ``_arrived``.

    State expires by it, but no row is ever behind it: a delivery of any age is seen.
    """
    if "_arrived" in df.columns:
        return df
    return df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)


def stream_dedup(df: DataFrame, keys: list[str], delay: str = "24 hours") -> DataFrame:
    """Drop copies that arrive within ``delay`` of the first one."""
    return by_arrival(df, delay).dropDuplicatesWithinWatermark(keys).select(*df.columns)


def stream_feature_lookup(
    events: DataFrame, features: DataFrame, wait: str = "10 seconds", keep: str = "1 hour"
) -> DataFrame:
    """Attach features that arrive within ``wait`` of the event; later or never gives the defaults.

    The time bound lets both sides drop their state, and an unmatched event is emitted when the
    watermark has passed the bound.
    """
    e = events.withWatermark("received_at", wait).alias("e")
    f = (
        features.withColumnsRenamed({"event_id": "feature_event_id"})
        .withColumn("features_available", F.lit(True))
        .withWatermark("feature_ts", wait).alias("f")
    )
    bound = F.expr(
        "e.event_id = f.feature_event_id"
        f" AND f.feature_ts >= e.received_at - INTERVAL {keep} AND f.feature_ts <= e.received_at + INTERVAL {wait}"
    )
    joined = e.join(f, bound, "left_outer")
    found = F.col("features_available")
    return joined.select(
        "e.*",
        *[F.when(found, F.coalesce(F.col(f"f.{c}"), F.lit(0.0))).otherwise(F.lit(sc.FEATURE_DEFAULTS[c])).alias(c)
          for c in sc.FEATURE_ORDER],
        F.coalesce(found, F.lit(False)).alias("features_available"),
    )


def trigger(once: bool = False) -> dict:
    """Every ten seconds, or all available input and stop."""
    return {"availableNow": True} if once else {"processingTime": "10 seconds"}


def start_all(
    spark: SparkSession, jobs: dict[str, tuple[DataFrame, str, Callable]], checkpoint_root: str, once: bool = False
) -> list[StreamingQuery]:
    """Start one query per (frame, output mode, foreachBatch function), each with its own checkpoint."""
    return [
        df.writeStream.queryName(name).outputMode(mode).foreachBatch(sink)
        .option("checkpointLocation", f"{checkpoint_root}/{name}").trigger(**trigger(once)).start()
        for name, (df, mode, sink) in jobs.items()
    ]


def wait_all(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Return when all queries have ended; if one fails, stop the others and raise."""
    try:
        while any(q.isActive for q in queries):
            spark.streams.awaitAnyTermination()
            spark.streams.resetTerminated()
        for q in queries:
            q.awaitTermination()
    finally:
        for q in queries:
            q.stop()
