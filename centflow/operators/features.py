"""The eight risk features, from stored events."""

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc
from centflow.functions.scalar import date_range, enrich
from centflow.operators.ordered import (
    Part, in_order, key_moments, moment_totals, peer_totals, previous, running_moments, running_sum_with_peers,
)
from centflow.operators.skew import spread_join
from centflow.session import written


VELOCITIES = {"tx_velocity_1m": 60, "tx_velocity_5m": 300}


def _with_exits(df: DataFrame, sizes: dict[str, int], key: str, ts: str, tie: str) -> DataFrame:
    """The rows at ``_at``, and for each trailing window one slim row where they leave it.

    A row enters a trailing count at ts and leaves it one microsecond after ts + size. The count at
    any time is then a running sum of entries minus exits: linear, whatever a window holds. Exit
    rows carry only the key, their time and the id that keeps equal times apart.
    """
    known = F.col(ts).isNotNull()
    # which step a row makes: arrays of plain numbers, so that no struct is built for each
    steps = df.withColumn("_step", F.explode(
        F.when(known, F.array(*map(F.lit, range(len(sizes) + 1)))).otherwise(F.array(F.lit(0)))
    ))
    later = F.lit(0)
    for i, seconds in enumerate(sizes.values(), 1):
        later = F.when(F.col("_step") == i, F.lit(seconds * 1_000_000 + 1)).otherwise(later)
    row, kept = F.col("_step") == 0, {key, tie}
    return steps.select(
        *[F.col(c) if c in kept else F.when(row, F.col(c)).alias(c) for c in df.columns],
        (F.unix_micros(ts) + later).alias("_at"), row.alias("_row"),
        *[
            F.when(row & known, 1).when(F.col("_step") == i, -1).otherwise(0).alias(f"_d_{n}")
            for i, n in enumerate(sizes, 1)
        ],
    )


def _steps(sizes: dict[str, int]) -> dict[str, Column]:
    return {n: F.col(f"_d_{n}") for n in sizes}


def _trailing(
    part: Part, sizes: dict[str, int], rows: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Trailing counts on rows with exits; drops the exit rows."""
    counted = running_sum_with_peers(part, "_at", _steps(sizes), rows, totals)
    return counted.where("_row").withColumns({
        n: F.when(F.col("_at").isNotNull(), F.col(n)) for n in sizes
    })


def tx_velocity(
    df: DataFrame, sizes: dict[str, int] = VELOCITIES, key: str = "merchant_id", ts: str = "received_at",
    tie: str = "event_id",
) -> DataFrame:
    """Add for each size (seconds) the rows of the key in [ts - size, ts]; equal times count each other."""
    def counts(part: Part) -> DataFrame:
        return _trailing(part, sizes).select(*df.columns, *sizes)

    return in_order(_with_exits(df, sizes, key, ts, tie), [key], ["_at", tie], counts)


def _running_z(value: str, min_n: int) -> Column:
    std = F.when(F.col("_m2") > 0, F.sqrt(F.col("_m2") / (F.col("_n") - 1))).otherwise(1.0)
    return F.when(F.col("_n") < min_n, 0.0).otherwise((F.col(value) - F.col("_mean")) / std)


def zscore_running(
    df: DataFrame, key: str = "merchant_id", ts: str = "received_at", value: str = "amount_cents",
    tie: str = "event_id", min_n: int = 3, out: str = "amount_zscore",
) -> DataFrame:
    """z-score of each value against the rows of its key so far, itself included; 0 below ``min_n`` rows."""
    def z(part: Part) -> DataFrame:
        return running_moments(part, value).withColumn(out, _running_z(value, min_n)).select(*df.columns, out)

    return in_order(df, [key], [ts, tie], z)


def velocity_and_zscore(df: DataFrame) -> DataFrame:
    """``tx_velocity`` and ``zscore_running`` on one ordering of the merchants' events."""
    key, ts, tie, value = "merchant_id", "received_at", "event_id", "amount_cents"

    def both(part: Part) -> DataFrame:
        totals = part.per_block(*moment_totals(value), *peer_totals("_at", _steps(VELOCITIES)))
        rows = _trailing(part, VELOCITIES, running_moments(part, value, totals), totals)
        return rows.withColumn("amount_zscore", _running_z(value, 3)).select(*df.columns, *VELOCITIES, "amount_zscore")

    steps = _with_exits(df, VELOCITIES, key, ts, tie)
    return in_order(steps, [key], ["_at", tie], both)


def key_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))


def batch_z(value: str) -> Column:
    return F.when(
        F.col("_std").isNull() | (F.col("_std") == 0), 0.0
    ).otherwise((F.col(value) - F.col("_mean")) / F.col("_std"))


def zscore_batch(
    df: DataFrame, key: str = "merchant_id", value: str = "amount_cents", out: str = "amount_zscore"
) -> DataFrame:
    """z-score against all rows of the key in ``df``; 0 where the deviation is null or 0.

    A partial aggregate and a join back instead of a window over the whole key.
    """
    joined = spread_join(df, key_stats(df, key, value), [key], "left")
    return joined.withColumn(out, batch_z(value)).drop("_mean", "_std")


def device_switch(
    df: DataFrame, ttl_seconds: int = sc.DEVICE_TTL_SECONDS, customer: str = "stripe_customer_id",
    merchant: str = "merchant_id", ts: str = "received_at", tie: str = "event_id",
) -> DataFrame:
    """1 if the customer's previous event was at another merchant no longer ago than the TTL.

    Events without a customer share no device and get 0.
    """
    def flag(part: Part) -> DataFrame:
        seen = previous(part, {merchant: "_was", ts: "_then"})
        gap = F.unix_micros(ts) - F.unix_micros("_then")
        switched = (
            (F.col(customer) != "") & (F.col("_was") != F.col(merchant)) & (gap <= ttl_seconds * 1_000_000)
        )
        return seen.withColumn("device_switch_flag", F.coalesce(switched, F.lit(False)).cast("int")).select(
            *df.columns, "device_switch_flag"
        )

    return in_order(df, [customer], [ts, tie], flag)


def with_merchant_risk(
    df: DataFrame, risk: DataFrame, default: float = sc.DEFAULT_MERCHANT_RISK
) -> DataFrame:
    """Add ``merchant_risk_score``; merchants without a score get the default."""
    scores = risk.select("merchant_id", F.col("score").alias("merchant_risk_score"))
    joined = spread_join(df, scores, ["merchant_id"], "left")
    return joined.withColumn("merchant_risk_score", F.coalesce("merchant_risk_score", F.lit(default)))


def live_features(events: DataFrame, risk: DataFrame) -> DataFrame:
    """All eight features for every event, in event-time order.

    The device flag comes first and is stored: the bounds of the second ordering's blocks are found by
    sampling, which would compute the flag again.
    """
    df = events.select("event_id", "merchant_id", "stripe_customer_id", "amount_cents", "received_at")
    df = velocity_and_zscore(written(device_switch(df).drop("stripe_customer_id"), "devices"))
    df = enrich(with_merchant_risk(df, risk))
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sc.FEATURE_ORDER]
    return df.select("event_id", "merchant_id", "received_at", *numbers)


def settled_history(
    state_log: DataFrame, ledger: DataFrame, start=None, end=None, inclusive_end: bool = False
) -> DataFrame:
    """INITIATED log rows with each DEBIT of their transaction; both sides are bags."""
    first = date_range(
        state_log.where(F.col("from_state").isNull() & (F.col("to_state") == sc.INITIATED)),
        "created_at", start, end, inclusive_end,
    ).select("transaction_id", "merchant_id", "event_id", "created_at")
    debits = ledger.where(F.col("entry_type") == "DEBIT").select(
        "transaction_id", "amount_cents", F.col("created_at").alias("settled_at")
    )
    return first.join(debits, "transaction_id")


def reconstruct_features(
    state_log: DataFrame, ledger: DataFrame, risk: DataFrame, start=None, end=None, inclusive_end: bool = False
) -> DataFrame:
    """The offline feature table of settled transactions; an empty input gives an empty table.

    Velocities and z-scores see only the selected, settled rows. The device sequence is not stored,
    so its flag is 0. Both features of the merchant come from one ordering of the joined history.
    """
    history = settled_history(state_log, ledger, start, end, inclusive_end).select(
        "transaction_id", "merchant_id", "event_id", "created_at", "amount_cents", "settled_at"
    )

    def both(part: Part) -> DataFrame:
        rows = _trailing(part, VELOCITIES, key_moments(part, "amount_cents"))
        return rows.withColumn("amount_zscore", batch_z("amount_cents")).select(
            *history.columns, *VELOCITIES, "amount_zscore"
        )

    steps = _with_exits(history, VELOCITIES, "merchant_id", "created_at", "event_id")
    df = in_order(steps, ["merchant_id"], ["_at", "event_id"], both)
    df = enrich(with_merchant_risk(df, risk), ts="created_at")
    return df.withColumn("device_switch_flag", F.lit(0)).select(
        "transaction_id", "merchant_id", "event_id", "settled_at",
        *[F.col(c).cast("double").alias(c) for c in sc.FEATURE_ORDER],
    )
