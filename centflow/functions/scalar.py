"""Scalar column functions."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def hour_of_day(ts: str) -> Column:
    return F.hour(ts)


def weekend_flag(ts: str) -> Column:
    """1 on Saturday and Sunday."""
    return F.dayofweek(ts).isin(1, 7).cast("int")


def log_cents(cents: str) -> Column:
    """ln(1 + cents); null at -1 and below."""
    return F.log1p(F.col(cents).cast("double"))


def enrich(events: DataFrame, ts: str = "received_at", cents: str = "amount_cents") -> DataFrame:
    """Add the three stateless features; works on static and streaming frames."""
    return events.withColumns({
        "hour_of_day": hour_of_day(ts), "weekend_flag": weekend_flag(ts), "amount_cents_log": log_cents(cents),
    })


def epoch_minute(ts: str) -> Column:
    return F.floor(F.unix_seconds(ts) / 60)


def usd(cents: str | Column) -> Column:
    return (F.col(cents) if isinstance(cents, str) else cents) / 100


def unit_interval(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def utc_day(ts: str, day: date) -> Column:
    """All instants of one UTC day as a half-open range, so that partitions and row groups prune."""
    start = F.lit(day.isoformat()).cast("timestamp")
    end = F.lit((day + timedelta(days=1)).isoformat()).cast("timestamp")
    return (F.col(ts) >= start) & (F.col(ts) < end)


def date_range(df: DataFrame, ts: str, start: date | None, end: date | None, inclusive_end: bool = False) -> DataFrame:
    """Optional bounds on ``ts``. The end bound is midnight of that date unless ``inclusive_end``."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start.isoformat()).cast("timestamp"))
    if end is not None and inclusive_end:
        df = df.where(F.col(ts) < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp"))
    elif end is not None:
        df = df.where(F.col(ts) <= F.lit(end.isoformat()).cast("timestamp"))
    return df
