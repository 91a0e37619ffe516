"""The streamed feature service: window counts and the eight features of every event, each in its own store."""

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc
from centflow.functions.scalar import enrich
from centflow.operators.features import VELOCITIES, device_switch, tx_velocity, with_merchant_risk
from centflow.sources.tables import feature_sink, velocity_sink
from centflow.streaming.carried import zscore_sink
from centflow.streaming.windows import velocity_1m, velocity_5m

_USED = ["event_id", "merchant_id", "stripe_customer_id", "amount_cents", "received_at"]


def feature_job(state: str, store: str, risk: DataFrame, now: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts the eight features of a batch's events into ``store``.

    ``state`` keeps the events, by micro-batch and day, and the moments of the z-scores. Velocities and device
    switches need the events of the last five minutes before the batch's first one; only their days are read.
    """
    reach = timedelta(seconds=max(*VELOCITIES.values(), sc.DEVICE_TTL_SECONDS))
    scores, sink = zscore_sink(f"{state}/moments", f"{state}/zscores"), feature_sink(store, now=now)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{state}/events/batch_id={batch_id}"
        batch.select(*_USED, F.to_date("received_at").alias("day")).write.mode("overwrite").partitionBy("day").parquet(path)
        stored = spark.read.parquet(f"{state}/events").where(F.col("batch_id") <= batch_id)
        own = stored.where(F.col("batch_id") == batch_id).select(*_USED)
        first = own.agg(F.min("received_at")).first()[0]
        if first is None:
            return
        scores(own, batch_id)
        since = first - reach
        near = stored.where((F.col("day") >= F.lit(since.date())) & (F.col("received_at") >= F.lit(since)))
        live = tx_velocity(device_switch(near.select(*_USED, "batch_id")), VELOCITIES).where(F.col("batch_id") == batch_id)
        zscores = spark.read.parquet(f"{state}/zscores/batch_id={batch_id}").select("event_id", "amount_zscore")
        sink(enrich(with_merchant_risk(live.drop("batch_id"), risk)).join(zscores, "event_id"), batch_id)

    return process


def feature_service(events: DataFrame, risk: DataFrame, folder: str, now: Column | None = None) -> dict:
    """The three jobs, for ``windows.start_all``: counts of one and five minutes, and features."""
    return {
        "velocity_1m": (velocity_1m(events), "update", velocity_sink(f"{folder}/velocity_1m", now=now)),
        "velocity_5m": (velocity_5m(events), "update", velocity_sink(f"{folder}/velocity_5m", now=now)),
        "features": (events, "append", feature_job(f"{folder}/state", f"{folder}/features", risk, now)),
    }
