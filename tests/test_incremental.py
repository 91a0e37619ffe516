"""Refreshed marts against full builds, and sketches against exact ranks."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from centflow import schemas as sc
from centflow.operators import marts, service_metrics as metrics
from centflow.plans import incremental
from centflow.sources.partition_versions import Tables

T0 = datetime(2026, 3, 23, 12)
STATES = ["INITIATED", "VALIDATED", "SCORING", "AUTHORIZED", "FLAGGED", "SETTLED"]
LOG = "transaction_id string, merchant_id string, to_state string, from_state string, event_id string, created_at timestamp, id bigint"
LEDGER = "transaction_id string, merchant_id string, currency string, entry_type string, amount_cents bigint, created_at timestamp, id bigint"


def history(seed, n=150):
    """Log and ledger rows of transactions over eight days; some without ledger, debit, merchant or time."""
    rng = random.Random(seed)
    log, ledger = [], []
    for i in range(n):
        tx, merchant = f"t{i}", None if i % 31 == 0 else f"m{i % 9}"
        at = T0 + timedelta(minutes=rng.randrange(8 * 1440))
        for k, state in enumerate(STATES[: rng.randint(1, 6)]):
            log.append((tx, merchant, state, None, f"e{i}", None if i % 37 == 0 else at + timedelta(hours=7 * k), len(log)))
        for kind in rng.choice([[], ["DEBIT", "CREDIT"], ["DEBIT", "CREDIT"], ["DEBIT"], ["CREDIT"], ["DEBIT", "DEBIT", "CREDIT"]]):
            ledger.append((tx, merchant, "usd", kind, rng.choice([5, 7, None]), at + timedelta(days=1), len(ledger)))
    return log, ledger


def full(spark, log, ledger):
    log, ledger = spark.createDataFrame(log, LOG), spark.createDataFrame(ledger, LEDGER)
    fact = marts.fact_transactions(marts.stg_transactions(log, ledger), marts.dim_merchants(ledger))
    balanced = marts.fact_ledger_balanced(marts.stg_ledger_entries(ledger.withColumn("source_event_id", F.lit("s"))))
    return {"fact_transactions": fact, "fraud_metrics": marts.fraud_metrics(fact),
            "hourly_payment_volume": marts.hourly_payment_volume(fact), "merchant_performance": marts.merchant_performance(fact, balanced)}


def rows(df):
    at = sorted(df.columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*at).collect()), key=repr)


def test_equal_to_full_builds_after_late_rows(spark, folder):
    """Rows of all times come in any order: late states, late debits, merchants that become known late."""
    log, ledger = history(1)
    rng = random.Random(2)
    rng.shuffle(log)
    rng.shuffle(ledger)
    taken = [0, 0]
    for cuts in ((0.5, 0.1), (0.55, 0.6), (1, 1)):
        upto = [int(c * len(x)) for c, x in zip(cuts, (log, ledger))]
        new = spark.createDataFrame(log[taken[0]:upto[0]], LOG), spark.createDataFrame(ledger[taken[1]:upto[1]], LEDGER)
        incremental.refresh(spark, folder, *new, buckets=5)
        taken = upto
    want, got = full(spark, log, ledger), incremental.read_marts(spark, folder)
    assert {n: rows(df) for n, df in got.items()} == {n: rows(df) for n, df in want.items()}


def test_only_touched_partitions_are_written(spark, folder):
    log, ledger = history(3)
    incremental.refresh(spark, folder, spark.createDataFrame(log, LOG), spark.createDataFrame(ledger, LEDGER), buckets=16)
    before = Tables.open(spark, folder)
    stay = {t: dict(p) for t, p in before.places.items()}
    late = [("t7", "m7", "SETTLED", None, "e7", T0 + timedelta(days=30), 10_000)]
    days = incremental.refresh(spark, folder, spark.createDataFrame(late, LOG), spark.createDataFrame([], LEDGER), buckets=16)
    after = Tables.open(spark, folder)
    assert len(days) == 2 and "2026-04-22" in days
    for table in ("staged", "fraud", "hourly", "merchant"):
        assert {p for p in after.places[table] if stay[table].get(p) != after.places[table][p]} <= days
    assert sum(stay["latest"][p] != place for p, place in after.places["latest"].items()) == 1
    want = full(spark, log + late, ledger)
    got = incremental.read_marts(spark, folder)
    assert rows(got["fraud_metrics"]) == rows(want["fraud_metrics"])
    assert rows(got["merchant_performance"]) == rows(want["merchant_performance"])
    after.sweep()
    assert rows(incremental.read_marts(spark, folder)["fraud_metrics"]) == rows(want["fraud_metrics"])
    assert len(os.listdir(f"{folder}/merchant")) <= 2


def test_a_refresh_that_breaks_off_changes_nothing(spark, folder, monkeypatch):
    log, ledger = history(4, 40)
    frames = spark.createDataFrame(log, LOG), spark.createDataFrame(ledger, LEDGER)
    half = frames[0].where("id % 2 = 0"), frames[1].where("id % 2 = 0")
    incremental.refresh(spark, folder, *half, buckets=4)
    before = rows(incremental.read_marts(spark, folder)["fraud_metrics"])
    with monkeypatch.context() as m:
        m.setattr(incremental, "_count", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.refresh(spark, folder, *frames, buckets=4)
    assert rows(incremental.read_marts(spark, folder)["fraud_metrics"]) == before
    incremental.refresh(spark, folder, frames[0].where("id % 2 = 1"), frames[1].where("id % 2 = 1"), buckets=4)
    assert rows(incremental.read_marts(spark, folder)["fraud_metrics"]) == rows(full(spark, log, ledger)["fraud_metrics"])


def test_sketches_are_near_the_exact_ranks(spark):
    """300,000 latencies of one skewed day, rolled up from minutes in two steps."""
    log = spark.range(300_000, numPartitions=8).select(
        F.timestamp_seconds(F.lit(int(T0.timestamp()) // 86_400 * 86_400) + F.expr("pow(pmod(xxhash64(id), 100000) / 100000.0, 4) * 86000").cast("long")).alias("ts"),
        F.expr("case when id % 50 = 0 then null else pow(pmod(xxhash64(id, 1), 1000003) / 1000003.0, 3) end").alias("latency"))
    hours = metrics.rolled_up(metrics.latency_sketches(log), "1 hour")
    names = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = metrics.sketch_quantiles(metrics.rolled_up(hours, "1 day"), names).collect()
    assert len(got) == 1 and got[0].requests == log.where("latency is not null").count() and got[0].breach
    for name, q in names.items():
        rank = log.agg(F.count_if(F.col("latency") <= got[0][name]) / F.count("latency")).first()[0]
        assert abs(rank - q) < 0.01
    small = log.where("id < 900")
    exact = metrics.sketch_quantiles(metrics.latency_sketches(small, "1 day")).first()
    values = sorted(r.latency for r in small.where("latency is not null").collect())
    assert (exact.p50, exact.p99) == (values[-(-len(values) // 2) - 1], values[-(-len(values) * 99 // 100) - 1])
