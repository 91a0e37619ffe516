"""Request-log metrics: error rate, latency quantiles, request rate and alerts.

The log has ``ts``, ``is_error`` and ``latency``.
"""

from pyspark.sql import DataFrame, Window, functions as F

from centflow.operators.ordered import in_order, running_sum
from centflow.operators.skew import spread_join

#: Values that a level of a latency sketch keeps.
SKETCH_K = 1_024


def error_rate(log: DataFrame, size: str = "5 minutes", threshold: float = 0.01) -> DataFrame:
    rate = F.avg(F.col("is_error").cast("int"))
    return (
        log.groupBy(F.window("ts", size).alias("w"))
        .agg(F.count("*").alias("requests"), rate.alias("error_rate"))
        .select(F.col("w.start").alias("window_start"), "requests", "error_rate",
                (F.col("error_rate") > threshold).alias("breach"))
    )


def latency_quantiles(
    log: DataFrame, size: str = "5 minutes", quantiles: dict[str, float] | None = None, threshold: float = 0.2
) -> DataFrame:
    """Exact interpolated quantiles per window, and whether the highest is above the threshold.

    Equal latencies are first counted; the rank of each distinct value is a running count. No task
    ever holds all values of a window that is hot, unlike the exact percentile aggregate.
    """
    quantiles = quantiles or {"p50": 0.5, "p99": 0.99}
    known = log.where(F.col("latency").isNotNull()).select(
        F.window("ts", size)["start"].alias("window_start"), "latency"
    )
    counted = known.groupBy("window_start", "latency").agg(F.count("*").alias("_n"))
    ranked = in_order(
        counted, ["window_start"], ["latency"], lambda part: running_sum(part, {"_upto": F.col("_n")}).select(
            *counted.columns, "_upto"),
    )
    totals = counted.groupBy("window_start").agg(F.sum("_n").alias("_all"))
    ranked = spread_join(ranked, totals, ["window_start"])

    def at(position):
        """The value at a 0-based position of the sorted latencies."""
        covers = (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_n"))
        return F.max(F.when(covers, F.col("latency")))

    aggregates = []
    for name, q in quantiles.items():
        place = (F.col("_all") - 1) * F.lit(q)
        aggregates += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"),
                       F.max(place - F.floor(place)).alias(f"{name}_part")]
    values = ranked.groupBy("window_start").agg(*aggregates)
    out = {n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part") for n in quantiles}
    highest = max(quantiles, key=quantiles.get)
    return values.withColumns(out).select(
        "window_start", *quantiles, (F.col(highest) > threshold).alias("breach")
    )


def latency_sketches(log: DataFrame, size: str = "1 minute", k: int = SKETCH_K) -> DataFrame:
    """One mergeable sketch of the latencies per window: (window_start, requests, sketch binary).

    A KLL sketch keeps a few thousand values at most, whatever it has seen: the rank of a quantile it gives is off by
    less than 1 % of the rows with the default ``k``, and by nothing up to ``k`` rows. Sketches of short windows are kept
    and rolled up to any longer one without the log.
    """
    known = log.where(F.col("latency").isNotNull())
    return known.groupBy(F.window("ts", size)["start"].alias("window_start")).agg(
        F.count("*").alias("requests"), F.kll_sketch_agg_double(F.col("latency").cast("double"), k).alias("sketch"))


def rolled_up(sketches: DataFrame, size: str) -> DataFrame:
    """The sketches of longer windows, which the shorter ones must divide."""
    return sketches.groupBy(F.window("window_start", size)["start"].alias("window_start")).agg(
        F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float] | None = None, threshold: float = 0.2) -> DataFrame:
    """A value of the log near each quantile, and whether the highest is above the threshold."""
    quantiles = quantiles or {"p50": 0.5, "p99": 0.99}
    highest = max(quantiles, key=quantiles.get)
    return sketches.select(
        "window_start", "requests", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(n) for n, q in quantiles.items())
    ).withColumn("breach", F.col(highest) > threshold)


def request_rate(log: DataFrame, size_seconds: int = 60) -> DataFrame:
    """Requests per second in each tumbling window."""
    w = F.window("ts", f"{size_seconds} seconds")
    return log.groupBy(w["start"].alias("window_start")).agg(
        (F.count("*") / size_seconds).alias("requests_per_second")
    )


def request_total(log: DataFrame) -> DataFrame:
    """Running number of requests per minute.

    Minutes accumulate inside their day; the carry over days is a window over one row per calendar
    day, the only unpartitioned step.
    """
    minutes = log.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"))
    minutes = minutes.withColumn("_day", F.to_date("minute"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        minutes.groupBy("_day").agg(F.sum("requests").alias("_n"))
        .select("_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    upto = Window.partitionBy("_day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return minutes.join(days, "_day").select(
        "minute", "requests", (F.col("_before") + F.sum("requests").over(upto)).alias("total_requests")
    )


def alert_state(series: DataFrame, every_seconds: int = 300, checks: int = 5) -> DataFrame:
    """``series`` (window_start, breach) with ``firing``: a breach at each of the last ``checks`` checks.

    Each check is handed to the next ``checks`` evaluation times and counted there, so the series
    needs no single ordered task.
    """
    steps = F.sequence(F.lit(0), F.lit(checks - 1))
    handed = (
        series.select("window_start", "breach", F.explode(steps).alias("_k"))
        .withColumn("_at", F.timestamp_micros(
            F.unix_micros("window_start") + F.col("_k") * F.lit(every_seconds * 1_000_000)
        ))
        .groupBy(F.col("_at").alias("window_start"))
        .agg(F.count_if(F.col("breach")).alias("breaches"),
             F.max(F.when(F.col("_k") == 0, F.col("breach"))).alias("breach"))
    )
    return handed.where(F.col("breach").isNotNull()).select(
        "window_start", "breach", (F.col("breaches") == checks).alias("firing")
    )
