"""Duplicate deliveries and per-merchant rate limits."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc
from centflow.operators.ordered import Part, in_order, running_sum
from centflow.session import written


def _first(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"), F.max(ts).alias("_last")
    )


def dedup_first(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The first row per key. Copies are already reduced on the map side."""
    return _first(df, keys, ts, tie).select(*keys, "_row.*").select(*df.columns)


def dedup_ttl(df: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: int = 86_400) -> DataFrame:
    """Accept a row if its key was not accepted within the TTL before; a dropped copy extends nothing.

    Keys whose rows all lie within the TTL of their first one, the usual case, are done by one aggregation. In the
    others every row points to its successor, the first row at or after the end of its TTL, which one ordering of
    the rows and of those ends gives. The accepted rows are those that the pointers lead to from the first row;
    they are followed by doubling, so a key with n accepted rows takes about log2(n) rounds, and a hot key is split
    in each of them. A null in a key is a value like any other.
    """
    first = written(_first(df, keys, ts, tie), "dedup")
    until = F.timestamp_micros(F.unix_micros(F.col("_row")[ts]) + F.lit(ttl_seconds * 1_000_000))
    alone = first.withColumn("_deep", F.col("_last") >= until)
    deep = written(alone.where("_deep").select(*keys, F.monotonically_increasing_id().alias("_k")), "deep-keys")
    done = alone.where("NOT _deep").select(*keys, "_row.*").select(*df.columns)
    if deep.isEmpty():
        return done
    same = reduce(Column.__and__, (df[k].eqNullSafe(deep[k]) for k in keys))
    rows = df.join(deep, same).select("_k", *(df[c] for c in df.columns))
    return done.unionByName(_by_successors(rows, ts, tie, ttl_seconds).select(*df.columns))


def _by_successors(rows: DataFrame, ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """The accepted rows of keys ``_k``."""
    end = F.timestamp_micros(F.unix_micros(ts) + F.lit(ttl_seconds * 1_000_000))
    # the end of a TTL comes before the rows of the same time; ends follow each other like their rows
    ends = rows.select("_k", end.alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"))
    marks = rows.select("_k", F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"),
                        F.struct(*(c for c in rows.columns if c != "_k")).alias("_row"))

    def numbers(part: Part) -> DataFrame:
        counts = {"_rows": F.col("_kind"), "_ends": F.lit(1) - F.col("_kind")}
        return running_sum(part, counts).select("_k", "_kind", "_row", "_rows", "_ends")

    both = marks.unionByName(ends, allowMissingColumns=True)
    numbered = written(in_order(both, ["_k"], ["_at", "_kind", "_tie"], numbers), "numbered")
    last = numbered.where("_kind = 1").groupBy("_k").agg(F.max("_rows").alias("_n"))
    pointers = numbered.where("_kind = 0").select("_k", (F.col("_ends") - 1).alias("_from"), F.col("_rows").alias("_to"))
    pointers = written(pointers.join(last, "_k").where("_to < _n").drop("_n"), "successors")
    reached = last.select("_k", F.lit(0).cast("long").alias("_from"))
    while True:
        found = written(reached.join(pointers, ["_k", "_from"]).select("_k", F.col("_to").alias("_from")), "reached")
        if found.isEmpty():
            break
        reached = reached.unionByName(found)
        ahead = pointers.select("_k", F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        pointers = written(pointers.join(ahead, ["_k", "_to"]).select("_k", "_from", F.col("_far").alias("_to")), "successors")
    marks = numbered.where("_kind = 1").select("_k", (F.col("_rows") - 1).alias("_from"), "_row")
    return marks.join(reached, ["_k", "_from"]).select("_row.*")


def rate_limit(
    df: DataFrame, limit: int = sc.RATE_LIMIT_PER_MINUTE, bucket: str = "minute",
    types: tuple[str, ...] = (sc.SUCCEEDED,), key: str = "merchant_id", ts: str = "received_at",
    tie: str = "event_id",
) -> DataFrame:
    """Add ``position`` in the (key, bucket) and ``limited``; only ``types`` use up the quota.

    Positions are running counts, so even a bucket that holds most rows is split.
    """
    counted = F.col("event_type").isin(*types)
    columns = df.columns

    def positions(part: Part) -> DataFrame:
        position = F.when(counted, F.col("_n"))
        return running_sum(part, {"_n": counted.cast("int")}).withColumns({
            "position": position, "limited": F.coalesce(position > limit, F.lit(False))
        }).select(*columns, "position", "limited")

    return in_order(df.withColumn("_bucket", F.date_trunc(bucket, ts)), [key, "_bucket"], [ts, tie], positions)
