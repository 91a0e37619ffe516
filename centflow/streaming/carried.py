"""Running z-scores, rate limits and device switches on a stream for keys too hot for one task.

The state is a table with one row per key and micro-batch: what the batch adds to the key. A batch runs
the block-wise batch operator on its own rows and joins what all earlier batches carry, so a hot key is
split like in the batch job. Writing a batch again replaces its own files, which makes a rerun exact.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from centflow import schemas as sc
from centflow.operators.ordered import Part, ordered_blocks, previous, running_moments, running_sum
from centflow.operators.skew import spread_join

_ORDER = ["received_at", "event_id"]


@dataclass
class Carry:
    """How the rows of a key carry over to later micro-batches.

    ``delta`` gives a batch's rows of state, at most one per key; ``merged`` makes one row per key, with the
    same columns, from those of many batches; ``result`` adds its columns to the batch's rows (a ``Part``) with
    the merged state of all earlier batches. ``kept``, if any, drops what a snapshot need not remember.
    """

    keys: list[str]
    delta: Callable[[DataFrame, int], DataFrame]
    merged: Callable[[DataFrame], DataFrame]
    result: Callable[[Part, DataFrame], DataFrame]
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows


def carried_sink(carry: Carry, state: str, out: str, compact_every: int = 100):
    """A foreachBatch function that writes the batch with its results to ``out``.

    Every ``compact_every`` batches the merged state is also written as a snapshot, and later
    batches read only the last snapshot and what follows it.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        blocks = ordered_blocks(batch, carry.keys, _ORDER)
        carry.delta(blocks, batch_id).write.mode("overwrite").parquet(f"{state}/deltas/batch_id={batch_id}")
        snapshot = batch_id // compact_every * compact_every
        try:
            old = spark.read.parquet(f"{state}/deltas").where(
                (F.col("batch_id") >= snapshot) & (F.col("batch_id") < batch_id)
            ).drop("batch_id")
            if snapshot > 0:
                old = old.unionByName(spark.read.parquet(f"{state}/snapshots/upto={snapshot}"))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            raise RuntimeError(f"the state under {state} is incomplete") from missing
        carry.result(Part(blocks, carry.keys, _ORDER), carry.merged(old)).write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}"
        )
        if (batch_id + 1) % compact_every == 0:
            everything = old.unionByName(spark.read.parquet(f"{state}/deltas/batch_id={batch_id}"))
            carry.kept(carry.merged(everything)).write.mode("overwrite").parquet(f"{state}/snapshots/upto={batch_id + 1}")
    return process


def _merged_moments(rows: DataFrame) -> DataFrame:
    """One row per merchant from the moments of many batches, merged around the first mean."""
    key = "merchant_id"
    anchored = rows.groupBy(key).agg(F.min("mean").alias("m0"))
    off = F.col("mean") - F.col("m0")
    sums = rows.join(anchored, key).groupBy(key, "m0").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * off).alias("s1"),
        F.sum(F.col("m2") + F.col("n") * off * off).alias("s2"),
    )
    return sums.select(
        key, "n", (F.col("m0") + F.col("s1") / F.col("n")).alias("mean"),
        (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")).alias("m2"),
    )


def zscore_sink(state: str, out: str, min_n: int = 3, compact_every: int = 100):
    """Add ``amount_zscore``; the state is the moments of a merchant's amounts."""
    value = "amount_cents"

    def delta(rows: DataFrame, batch_id: int) -> DataFrame:
        v = F.col(value).cast("double")
        return rows.groupBy("merchant_id").agg(
            F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))

    def result(part: Part, old: DataFrame) -> DataFrame:
        columns = [c for c in part.rows.columns if c != "_block"]
        old = old.select("merchant_id", F.col("n").alias("_on"), F.col("mean").alias("_omean"), F.col("m2").alias("_om2"))
        run = spread_join(running_moments(part, value), old, ["merchant_id"], "left")
        n = F.coalesce("_on", F.lit(0)) + F.col("_n")
        gap = F.col("_mean") - F.coalesce("_omean", F.lit(0.0))
        known = F.col("_on").isNotNull()
        mean = F.when(known, F.col("_omean") + gap * F.col("_n") / n).otherwise(F.col("_mean"))
        m2 = F.when(known, F.col("_om2") + F.col("_m2") + gap * gap * F.col("_on") * F.col("_n") / n).otherwise(F.col("_m2"))
        std = F.when(m2 > 0, F.sqrt(m2 / (n - 1))).otherwise(1.0)
        z = F.when(n < min_n, 0.0).otherwise((F.col(value) - mean) / std)
        return run.withColumn("amount_zscore", z).select(*columns, "amount_zscore")

    return carried_sink(Carry(["merchant_id"], delta, _merged_moments, result), state, out, compact_every)


def rate_limit_sink(
    state: str, out: str, limit: int = sc.RATE_LIMIT_PER_MINUTE, bucket_seconds: int = 60,
    types: tuple[str, ...] = (sc.SUCCEEDED,), keep_seconds: int = 7 * 86_400, compact_every: int = 100,
):
    """Add ``position`` and ``limited``; the state is the number of counted events per (merchant, bucket).

    Positions follow the order of micro-batches and inside one that of time. A snapshot forgets buckets that begin
    more than ``keep_seconds`` before its newest one; a row later than that counts in a fresh bucket.
    """
    counted, bucket = F.col("event_type").isin(*types), "_bucket"
    keys = ["merchant_id", bucket]

    def delta(rows: DataFrame, batch_id: int) -> DataFrame:
        return rows.where(counted).groupBy(*keys).agg(F.count("*").alias("n"))

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"))

    def kept(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max(bucket)).first()[0]
        return rows if newest is None else rows.where(F.col(bucket) >= newest - keep_seconds // bucket_seconds)

    def result(part: Part, old: DataFrame) -> DataFrame:
        columns = [c for c in part.rows.columns if c not in ("_block", bucket)]
        run = running_sum(part, {"_n": counted.cast("long")})
        run = spread_join(run, old.withColumnRenamed("n", "_on"), keys, "left")
        position = F.when(counted, F.col("_n") + F.coalesce("_on", F.lit(0)))
        return run.select(*columns, position.alias("position"), F.coalesce(position > limit, F.lit(False)).alias("limited"))

    process = carried_sink(Carry(keys, delta, merged, result, kept), state, out, compact_every)

    def with_bucket(batch: DataFrame, batch_id: int) -> None:
        process(batch.withColumn(bucket, F.floor(F.unix_seconds("received_at") / bucket_seconds)), batch_id)
    return with_bucket


def device_sink(state: str, out: str, ttl_seconds: int = sc.DEVICE_TTL_SECONDS, compact_every: int = 100):
    """Add ``device_switch_flag``; the state is a customer's last merchant and time in the last batch that saw it.

    Events without a customer share no device: they leave no state and get 0.
    """
    key = "stripe_customer_id"

    def delta(rows: DataFrame, batch_id: int) -> DataFrame:
        last = F.max_by(F.struct("merchant_id", "received_at"), F.struct(*_ORDER)).alias("last")
        return rows.where(F.col(key) != "").groupBy(key).agg(last).withColumn("seq", F.lit(batch_id).cast("long"))

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by("last", "seq").alias("last"), F.max("seq").alias("seq"))

    def result(part: Part, old: DataFrame) -> DataFrame:
        columns = [c for c in part.rows.columns if c != "_block"]
        seen = previous(part, {"merchant_id": "_was", "received_at": "_then"})
        seen = spread_join(seen, old.select(key, F.col("last").alias("_last")), [key], "left")
        first = F.col("_then").isNull()
        was = F.when(first, F.col("_last.merchant_id")).otherwise(F.col("_was"))
        then = F.when(first, F.col("_last.received_at")).otherwise(F.col("_then"))
        gap = F.unix_micros("received_at") - F.unix_micros(then)
        switched = (F.col(key) != "") & (was != F.col("merchant_id")) & (gap <= ttl_seconds * 1_000_000)
        return seen.select(*columns, F.coalesce(switched, F.lit(False)).cast("int").alias("device_switch_flag"))

    return carried_sink(Carry([key], delta, merged, result), state, out, compact_every)
