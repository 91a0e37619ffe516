"""Streaming forms: late data, state over several micro-batches, and the whole lifecycle."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from centflow import schemas as sc
from centflow.functions.scalar import enrich
from centflow.operators import features as batch, intake, model as ml
from centflow.registry import drained
from centflow.operators import validate as rules
from centflow.plans.scoring import by_expression, by_model
from centflow.session import scratch_path
from centflow.sources.tables import feature_sink
from centflow.streaming import carried, lifecycle, stateful, windows

T0 = datetime(2026, 3, 23, 12)
EVENT = "event_id string, event_type string, amount_cents bigint, currency string, stripe_customer_id string, merchant_id string, received_at timestamp"


def event(i, merchant="m", customer="c", amount=100, seconds=0, kind=sc.SUCCEEDED):
    return (f"e{i:03d}", kind, amount, "usd", customer, merchant, T0 + timedelta(seconds=seconds))


@pytest.fixture
def feed(spark, folder):
    """Write each list of rows as one file and stream them one file per micro-batch."""
    def make(*batches, schema=EVENT, name="in"):
        path = f"{folder}/{name}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        frame = spark.createDataFrame([], schema)
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return make


def events(n=120):
    return [event(i, f"m{i % 7 % 3}", f"c{i % 5}", 100 + i * 37 % 91, i * 20) for i in range(n)]


def halves(rows):
    return rows[: len(rows) // 2], rows[len(rows) // 2:]


def test_windows_count_and_drop_late_rows(feed):
    # the second file moves the watermark to +58 min, which holds against late rows from the batch after next
    stream = feed([event(1), event(2, seconds=15), event(3, seconds=45)], [event(4, seconds=3600)],
                  [event(6, seconds=3600)], [event(5, seconds=20)])
    out = drained(windows.velocity_1m(stream), "update")
    got = {r.start: r.n for r in out.groupBy(F.col("window.start").alias("start")).agg(F.max_by("count", "batch_id").alias("n")).collect()}
    assert got == {T0: 3, T0 + timedelta(hours=1): 2}


def test_enrichment_drops_nothing(feed):
    out = drained(enrich(feed([event(1)], [event(2, seconds=7200)], [event(3)])))
    assert out.count() == 3


def test_zscore_keeps_state(spark, feed):
    rows = events()
    want = {r.event_id: r.amount_zscore for r in batch.zscore_running(spark.createDataFrame(rows, EVENT)).collect()}
    got = {r.event_id: r.amount_zscore for r in drained(stateful.stream_zscore(feed(*halves(rows)))).collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("compact_every", [2, 100])
def test_carried_zscore(spark, feed, many_blocks, compact_every):
    rows = events()
    want = {r.event_id: r.amount_zscore for r in batch.zscore_running(spark.createDataFrame(rows, EVENT)).collect()}
    state, out, checkpoint = (scratch_path(spark, n) for n in ("state", "out", "checkpoint"))
    parts = [rows[i:i + 24] for i in range(0, 120, 24)]
    jobs = {"carried": (feed(*parts), "append", carried.zscore_sink(state, out, compact_every=compact_every))}
    windows.wait_all(spark, windows.start_all(spark, jobs, checkpoint, once=True))
    got = {r.event_id: r.amount_zscore for r in spark.read.parquet(out).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_carried_zscore_reruns_a_batch(spark, folder):
    rows = events(40)
    sink = carried.zscore_sink(f"{folder}/state", f"{folder}/out")
    first, second = (spark.createDataFrame(r, EVENT) for r in halves(rows))
    for df, n in ((first, 0), (second, 1), (second, 1)):
        sink(df, n)
    want = {r.event_id: r.amount_zscore for r in batch.zscore_running(spark.createDataFrame(rows, EVENT)).collect()}
    assert {r.event_id: r.amount_zscore for r in spark.read.parquet(f"{folder}/out").collect()} == pytest.approx(want, abs=1e-9)


def test_device_switch_keeps_state(spark, feed):
    rows = events()
    want = {r.event_id: r.device_switch_flag for r in batch.device_switch(spark.createDataFrame(rows, EVENT)).collect()}
    got = {r.event_id: r.device_switch_flag for r in drained(stateful.stream_device_switch(feed(*halves(rows)))).collect()}
    assert got == want and sum(want.values()) > 0


def test_rate_limit_keeps_state(spark, feed):
    rows = [event(i, f"m{i % 2}", seconds=i * 4) for i in range(60)]
    want = {r.event_id: (r.position, r.limited) for r in intake.rate_limit(spark.createDataFrame(rows, EVENT), 3).collect()}
    out = drained(stateful.stream_rate_limit(feed(*halves(rows)), 3))
    assert {r.event_id: (r.position, r.limited) for r in out.collect()} == want
    assert any(limited for _, limited in want.values())


def test_dedup_across_batches(feed):
    out = drained(windows.stream_dedup(feed([event(1), event(2), event(1, seconds=5)], [event(1, seconds=3600)]), ["event_id", "event_type"]))
    assert sorted(r.event_id for r in out.collect()) == ["e001", "e002"]


def test_feature_lookup_waits_then_defaults(feed):
    schema = "event_id string, feature_ts timestamp, " + ", ".join(f"{c} double" for c in sc.FEATURE_ORDER)
    known = [("e001", T0 + timedelta(seconds=2), *[1.0] * 8), ("far", T0 + timedelta(hours=3), *[1.0] * 8)]
    stored = feed(known, schema=schema, name="features")
    stream = feed([event(1), event(2), event(3, seconds=3 * 3600)], [event(4, seconds=3 * 3600 + 60)])
    got = {r.event_id: (r.features_available, r.tx_velocity_1m) for r in drained(windows.stream_feature_lookup(stream, stored)).collect()}
    assert got["e001"] == (True, 1.0) and got["e002"] == (False, 10.0)


def delivery(i, kind=sc.SUCCEEDED, amount="1000", merchant="m", seconds=0):
    payload = '{"data":{"object":{"amount":%s,"customer":"c","metadata":{"merchant_id":"%s"}}}}' % (amount, merchant)
    return (f"e{i}", kind, payload, T0 + timedelta(seconds=seconds))


@pytest.fixture(scope="module")
def fitted(spark):
    """High risk exactly when the velocity is 5 or more."""
    df = spark.range(400).selectExpr(
        "CAST(id % 10 AS DOUBLE) tx_velocity_1m", *[f"0.0D {c}" for c in sc.FEATURE_ORDER[1:]], "CAST(id % 10 >= 5 AS DOUBLE) label")
    return ml.train(df)


def test_lifecycle(spark, feed, fitted, folder):
    received = [
        delivery(1), delivery(2), delivery(3, amount="0"), delivery(4, kind="charge.succeeded"), delivery(1, seconds=30),
        delivery(5, "payment_intent.canceled", "0"), delivery(6, merchant="other"),
        *[delivery(100 + i, merchant="busy", seconds=i) for i in range(4)],
    ]
    names = ", ".join(f"{c} double" for c in sc.FEATURE_ORDER)
    low, high = [1.0] + [0.0] * 7, [9.0] + [0.0] * 7
    known = [("e1", *low), ("e2", *high), ("e5", *low), *[(f"e{100 + i}", *low) for i in range(4)], ("e7", *low)]
    feature_sink(f"{folder}/features")(spark.createDataFrame(known, "event_id string, " + names), 0)
    stream = feed(received, [delivery(1, seconds=60), delivery(7, seconds=60)], schema=sc.WEBHOOK_RECEIVED)
    tables = f"{folder}/tables"
    lifecycle.start_lifecycle(stream, by_model(fitted), tables, f"{folder}/checkpoint", f"{folder}/features", limit=3, once=True).awaitTermination()

    def table(name):
        return spark.read.parquet(f"{tables}/{name}")

    log = {}
    for r in table("payment_state_log").orderBy("created_at").collect():
        log.setdefault(r.transaction_id, []).append(r.to_state)
    start = ["INITIATED", "VALIDATED", "SCORING"]
    settled, failed = [*start, "AUTHORIZED", "SETTLED"], ["INITIATED", "FAILED"]
    assert log == {
        "e1": settled, "e2": [*start, "FLAGGED"], "e3": failed, "e4": failed, "e5": [*start, "AUTHORIZED"],
        "e6": [*start, "FLAGGED"], "e7": settled, "e100": settled, "e101": settled, "e102": settled, "e103": failed,
    }
    assert {r.transaction_id: r["count"] for r in table("ledger_entries").groupBy("transaction_id").count().collect()} == {
        k: 2 for k in ("e1", "e7", "e100", "e101", "e102")}
    dead = {r.event_id: (r.failure_reason, r.error_detail) for r in table("dlq").collect()}
    assert dead == {"e3": ("SCHEMA_INVALID", "amount_zero"), "e4": ("SCHEMA_INVALID", "event_type"),
                    "e5": ("LEDGER_WRITE_FAIL", "amount_not_positive")}
    scored = {r.event_id: r for r in table("scored_events").collect()}
    assert not scored["e6"].features_available and scored["e6"].manual_review
    assert "e6" in {r.transaction_id for r in table("manual_review_queue").collect()}
    assert {r.key for r in table("alerts").collect()} == {"e2", "e6"}
    assert json.loads(table("alerts").first().value)["is_high_risk"] is True

    # a rerun of a finished micro-batch leaves the tables as they were
    before = {n: table(n).count() for n in ("payment_state_log", "ledger_entries", "dlq", "scored_events")}
    again = table("checked_events").where("batch_id = 0").drop("batch_id")
    again = again.withColumn("failure_reason", F.when(F.col("failure_reason") != "RATE_LIMITED", F.col("failure_reason")))
    stored = spark.createDataFrame(again.collect(), again.schema)
    lifecycle.process_batch(stored, 0, by_model(fitted), tables, f"{folder}/features")
    assert {n: table(n).count() for n in before} == before


def test_lifecycle_batches_do_not_read_what_came_before(spark, folder, monkeypatch):
    """Thirty batches: no batch reads a table of another one, and an event is scored once."""
    from pyspark.sql.readwriter import DataFrameReader

    read = []
    plain = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **more: read.append(paths) or plain(self, *paths, **more))
    schema = "stripe_event_id string, event_type string, payload string, received_at timestamp"
    received = spark.createDataFrame([delivery(n, merchant="m") for n in range(2)], schema)
    batch = rules.validate(received).withColumns({"limited": F.lit(False), "first": F.col("stripe_event_id") == "e0"})
    for n in range(30):
        lifecycle.process_batch(batch, n, by_expression(F.lit(0.1)), f"{folder}/tables", None)
        if n == 0:
            per_batch = len(read)
    assert len(read) == 30 * per_batch
    assert all(f"/batch_id={i // per_batch}" in path for i, paths in enumerate(read) for path in paths)
    states = spark.read.parquet(f"{folder}/tables/payment_state_log").groupBy("event_id").agg(F.count_if(F.col("to_state") == "SCORING").alias("n"))
    assert {r.event_id: r.n for r in states.collect()} == {"e0": 30, "e1": 0}


def test_first_of_an_event_id(feed):
    """Rows that do not count take nothing; of those that do one is first, in all batches."""
    rows = [event(1), event(2), event(1, seconds=5), event(3)], [event(1, seconds=9), event(3, seconds=1)], [event(3, seconds=2), event(2, seconds=1)]
    stream = feed(*rows).withColumn("good", ~((F.col("event_id") == "e003") & (F.col("received_at") <= F.lit(T0))))
    marked = stateful.stream_first(stream, F.col("good"), 3600)
    got = sorted((r.event_id, r.received_at, r["first"]) for r in drained(marked).collect())
    assert [(i, (t - T0).seconds, f) for i, t, f in got] == [
        ("e001", 0, True), ("e001", 5, False), ("e001", 9, False), ("e002", 0, True), ("e002", 1, False),
        ("e003", 0, False), ("e003", 1, True), ("e003", 2, False)]


def _carried(spark, stream, sink, **options):
    state, out, checkpoint = (scratch_path(spark, n) for n in ("state", "out", "checkpoint"))
    jobs = {"carried": (stream, "append", sink(state, out, **options))}
    windows.wait_all(spark, windows.start_all(spark, jobs, checkpoint, once=True))
    return spark.read.parquet(out)


@pytest.mark.parametrize("compact_every", [2, 100])
def test_carried_devices_and_limits_equal_the_batch(spark, feed, many_blocks, compact_every):
    # a customer and a merchant with most of the rows, an event without a customer, and payments that do not count
    rows = [event(i, f"m{i % 7 % 3}", ["c0", "c0", "", "c1"][i % 4], seconds=i * 20,
                  kind="payment_intent.payment_failed" if i % 9 == 0 else sc.SUCCEEDED) for i in range(100)]
    frame, parts = spark.createDataFrame(rows, EVENT), [rows[i:i + 20] for i in range(0, 100, 20)]
    want = {r.event_id: r.device_switch_flag for r in batch.device_switch(frame).collect()}
    got = _carried(spark, feed(*parts, name="devices"), carried.device_sink, compact_every=compact_every)
    assert {r.event_id: r.device_switch_flag for r in got.collect()} == want and 0 < sum(want.values()) < 100
    want = {r.event_id: (r.position, r.limited) for r in intake.rate_limit(frame, 5, "hour").collect()}
    got = _carried(spark, feed(*parts, name="limits"), carried.rate_limit_sink, limit=5, bucket_seconds=3600, compact_every=compact_every)
    assert {r.event_id: (r.position, r.limited) for r in got.collect()} == want
    assert got.columns == [*frame.columns, "position", "limited", "batch_id"]


def test_a_carried_hot_key_spans_tasks_and_batches_rerun(spark, folder, many_blocks):
    rows = [event(i, "hot" if i % 3 else f"m{i}", seconds=i) for i in range(300)]
    frame = spark.createDataFrame(rows, EVENT)
    sink = carried.rate_limit_sink(f"{folder}/state", f"{folder}/out", limit=50, bucket_seconds=86_400)
    for part, n in ((0, 0), (1, 1), (1, 1), (2, 2), (2, 2)):
        sink(spark.createDataFrame(rows[part * 100:part * 100 + 100], EVENT), n)
    want = {r.event_id: (r.position, r.limited) for r in intake.rate_limit(frame, 50, "day").collect()}
    assert {r.event_id: (r.position, r.limited) for r in spark.read.parquet(f"{folder}/out").collect()} == want
    blocks = carried.ordered_blocks(frame, ["merchant_id"], ["received_at", "event_id"])
    assert blocks.where("merchant_id = 'hot'").select("_block").distinct().count() > 1


def test_carried_limits_forget_old_buckets_only(spark, folder):
    sink = carried.rate_limit_sink(f"{folder}/state", f"{folder}/out", limit=1, bucket_seconds=60, keep_seconds=3600, compact_every=1)
    for n, seconds in enumerate((0, 1800, 1801, 9000, 9001)):
        sink(spark.createDataFrame([event(n, seconds=seconds)], EVENT), n)
    assert spark.read.parquet(f"{folder}/state/snapshots/upto=5").count() == 1
    got = {r.event_id: r.position for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"e000": 1, "e001": 1, "e002": 2, "e003": 1, "e004": 2}
