"""Exact cases of the batch operators."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from centflow import schemas as sc
from centflow.functions.scalar import date_range, enrich, usd, utc_day
from centflow.operators import features, intake, lifecycle, marts, model, quality, recon, reports, service_metrics
from centflow.operators import validate as rules
from centflow.plans import reconciliation, warehouse
from centflow.session import written
from centflow.sources import key_index, tables, topics

T0 = datetime(2026, 3, 23)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def webhook(spark, payload, event_type="payment_intent.succeeded", event_id="evt_test_123"):
    return spark.createDataFrame([(event_id, event_type, payload, T0)], sc.WEBHOOK_RECEIVED)


def detail(spark, payload, **kw):
    return rules.validate(webhook(spark, payload, **kw)).first().failure_detail


OBJECT = '{"data":{"object":{%s}}}'


@pytest.mark.parametrize("amount,want", [
    ('"amount":1000', None), ('"amount":0', "amount_zero"), ('"amount":-500', "amount_negative"),
    ('"amount":5.0', "amount_not_integer"), ('"amount":5.5', "amount_not_integer"),
    ('"amount":"5"', "amount_not_integer"), ('"amount":true', "amount_not_integer"),
    ('"amount":null', "amount_not_integer"), ('"amount":12345678901234567890', "amount_not_integer"),
    ('"other":1', "amount_missing"), ('"amount":5,"currency":null', "not_text"),
    ('"amount":5,"currency":7', "not_text"), ('"amount":5,"customer":{}', "not_text"),
    ('"amount":5,"metadata":{"merchant_id":null}', "not_text"), ('"amount":5,"metadata":null', None),
])
def test_amount_rules(spark, amount, want):
    assert detail(spark, OBJECT % amount) == want


def test_other_rules(spark):
    assert detail(spark, '{"data":{}}') == "object_missing"
    assert detail(spark, '{"data":{"object":null}}') == "object_missing"
    assert detail(spark, "{broken") == "envelope"
    assert detail(spark, OBJECT % '"amount":1', event_id=None) == "envelope"
    assert detail(spark, OBJECT % '"amount":1', event_type="charge.succeeded") == "event_type"
    assert detail(spark, OBJECT % '"amount":0', event_type="payment_intent.canceled") is None
    assert detail(spark, OBJECT % '"amount":-5', event_type="payment_intent.payment_failed") is None


def test_extraction_defaults(spark):
    got = rules.valid_events(rules.validate(webhook(spark, OBJECT % '"amount":1000,"customer":null'))).first()
    assert tuple(got) == ("evt_test_123", "payment_intent.succeeded", 1000, "usd", "", "unknown_merchant", T0)
    full = OBJECT % '"amount":1000,"currency":"eur","customer":"cus_1","metadata":{"merchant_id":"m"}'
    got = rules.valid_events(rules.validate(webhook(spark, full))).first()
    assert (got.currency, got.stripe_customer_id, got.merchant_id) == ("eur", "cus_1", "m")


def test_dead_letters(spark):
    _, dead = rules.split_valid(rules.validate(webhook(spark, "{broken")))
    assert dead.columns == sc.DLQ.fieldNames()
    r = dead.first()
    assert (r.failure_reason, r.retry_count, r.payload, r.original_topic) == (
        "SCHEMA_INVALID", 0, "{broken", "payment.webhook.received")


def test_envelope(spark):
    raw = spark.createDataFrame([('{"id":"evt_1","type":"payment_intent.succeeded","data":{"object":{"amount":7}}}',)], "body string")
    got = rules.envelope(raw, F.lit(T0))
    assert got.columns == sc.WEBHOOK_RECEIVED.fieldNames()
    assert rules.valid_events(rules.validate(got)).first().amount_cents == 7


def test_ledger_rules(spark):
    def one(payload):
        r = rules.validate_ledger(spark.createDataFrame([(payload,)], "payload string")).first()
        return r.failure_detail, r.event_id, r.source_event_id, r.currency

    good = '{"event_id":"e","amount_cents":5000,"merchant_id":"m"%s}'
    assert one(good % "") == (None, "e", "e", "usd")
    assert one(good % ',"currency":"eur","source_event_id":"s"') == (None, "e", "s", "eur")
    assert one("nope")[:2] == ("malformed_json", "unknown")
    assert one('{"amount_cents":5,"merchant_id":"m"}')[:2] == ("event_id_empty", "unknown")
    assert one('{"event_id":"e","merchant_id":"m"}')[0] == "amount_not_integer"
    assert one('{"event_id":"e","amount_cents":"5","merchant_id":"m"}')[0] == "amount_not_integer"
    assert one('{"event_id":"e","amount_cents":0,"merchant_id":"m"}')[0] == "amount_not_positive"
    assert one('{"event_id":"e","amount_cents":5,"merchant_id":""}')[0] == "merchant_id_empty"


def test_enrich(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 3, 16, 14, 30), 5000), (datetime(2024, 3, 18, 9, 0), 0), (datetime(2024, 3, 17, 0, 0), -1)],
        "received_at timestamp, amount_cents bigint")
    a, b, c = enrich(df).orderBy("amount_cents").collect()[::-1]
    assert (a.hour_of_day, a.weekend_flag) == (14, 1) and a.amount_cents_log == pytest.approx(8.517393, abs=1e-6)
    assert (b.hour_of_day, b.weekend_flag, b.amount_cents_log) == (9, 0, 0.0)
    assert c.weekend_flag == 1 and c.amount_cents_log is None


def test_batch_zscore(spark):
    df = spark.createDataFrame(
        [("a", 1000), ("a", 2000), ("a", 3000), ("b", 5), ("b", 5), ("c", 9)], "merchant_id string, amount_cents bigint")
    got = rows(features.zscore_batch(df), "merchant_id", "amount_cents", "amount_zscore")
    assert got == [("a", 1000, -1.0), ("a", 2000, 0.0), ("a", 3000, 1.0), ("b", 5, 0.0), ("b", 5, 0.0), ("c", 9, 0.0)]
    assert features.zscore_batch(df.limit(0)).count() == 0


def log_rows(spark, *chains):
    out, n = [], 0
    for tx, merchant, states in chains:
        before = None
        for s in states:
            n += 1
            out.append((n, tx, before, s, f"{tx}_{s}", merchant, T0 + timedelta(seconds=n)))
            before = s
    return spark.createDataFrame(out, sc.STATE_LOG)


def ledger_rows(spark, *entries):
    return spark.createDataFrame(
        [(i, tx, amount, kind, merchant, "USD", tx, at) for i, (tx, kind, amount, merchant, at) in enumerate(entries, 1)],
        sc.LEDGER_ENTRIES)


def test_latest_state_breaks_ties_by_id(spark):
    log = spark.createDataFrame(
        [(1, "t", None, "INITIATED", "e", "m", T0), (2, "t", "INITIATED", "VALIDATED", "e", "m", T0)], sc.STATE_LOG)
    assert rows(marts.latest_state(log), "current_state", "previous_state") == [("VALIDATED", "INITIATED")]


def test_staging_fans_out_on_several_debits(spark):
    log = log_rows(spark, ("t1", "m", ["INITIATED", "SETTLED"]), ("t2", "m", ["INITIATED"]))
    ledger = ledger_rows(spark, ("t1", "DEBIT", 5, "m", T0), ("t1", "DEBIT", 6, "m", T0), ("t1", "CREDIT", 5, "m", T0))
    assert rows(marts.stg_transactions(log, ledger), "transaction_id", "amount_cents") == [("t1", 5), ("t1", 6), ("t2", None)]


def test_merchant_performance_counts_joined_rows(spark):
    """Two fact rows meet two ledger rows: sums count four joined rows, distinct counts one transaction."""
    fact = spark.createDataFrame(
        [("t1", "m", "SETTLED", 5), ("t1", "m", "SETTLED", 6), ("t2", "m", "FLAGGED", None)],
        "transaction_id string, merchant_id string, current_state string, amount_cents bigint")
    balanced = spark.createDataFrame(
        [("t1", 5, 4), ("t1", 6, 6)], "transaction_id string, debit_amount_cents bigint, credit_amount_cents bigint")
    got = marts.merchant_performance(fact, balanced).first()
    assert tuple(got) == ("m", 2, 1, 1, 22, 22 / 5, 2)


def intents(spark, *items):
    return spark.createDataFrame(
        [(i, a, c, "succeeded", m, T0 + timedelta(hours=3)) for i, a, c, m in items], sc.PROCESSOR_INTENTS)


def test_reconciliation_types(spark):
    at = T0 + timedelta(hours=5)
    ledger = ledger_rows(
        spark, ("pi_2", "DEBIT", 4500, "m", at), ("pi_3", "DEBIT", 6000, "m", at), ("pi_4", "DEBIT", 5000, "m", at),
        ("pi_5", "DEBIT", 1, "m", at), ("pi_5", "CREDIT", 1, "m", at), ("pi_5", "DEBIT", 5000, "m", at))
    found = intents(spark, ("pi_1", 5000, "usd", None), ("pi_2", 5000, "usd", "x"), ("pi_3", 5000, "usd", "x"),
                    ("pi_4", 5000, "usd", "x"), ("pi_5", 5000, "usd", "x"))
    got = {(r.transaction_id, r.discrepancy_type): r for r in reconciliation.reconcile(found, ledger).collect()}
    assert set(got) == {("pi_1", "MISSING_INTERNALLY"), ("pi_2", "AMOUNT_MISMATCH"), ("pi_3", "AMOUNT_MISMATCH"),
                        ("pi_5", "DUPLICATE_LEDGER")}
    missing = got["pi_1", "MISSING_INTERNALLY"]
    assert tuple(missing)[2:] == ("pi_1", None, 5000, None, "USD", "unknown", T0 + timedelta(hours=3), T0.date())
    assert tuple(got["pi_2", "AMOUNT_MISMATCH"])[2:] == ("pi_2", 4500, None, 500, "USD", "m", None, T0.date())
    assert got["pi_3", "AMOUNT_MISMATCH"].diff_cents == -1000
    assert tuple(got["pi_5", "DUPLICATE_LEDGER"])[2:] == (None, None, None, None, "USD", "m", None, T0.date())


def test_reconciliation_stays_inside_the_day(spark):
    ledger = ledger_rows(spark, ("pi_1", "DEBIT", 5, "m", T0 + timedelta(days=1)), ("pi_1", "CREDIT", 5, "m", T0),
                         ("pi_1", "CREDIT", 5, "m", T0))
    got = reconciliation.reconcile(intents(spark, ("pi_1", 5, "usd", None)), ledger, T0.date(), T0.date()).collect()
    assert [r.discrepancy_type for r in got] == ["MISSING_INTERNALLY"]
    assert recon.recon_duplicates(ledger).count() == 0
    counts = recon.recon_run_counts(intents(spark, ("pi_1", 5, "usd", None)), ledger).first()
    assert tuple(counts)[1:] == (1, 0, 0)


def test_routing_and_booking(spark):
    scored = spark.createDataFrame(
        [("a", 0.69, True), ("b", 0.7, True), ("c", 0.85, True), ("d", 0.1, False), ("e", 1.7, True)],
        "event_id string, risk_score double, features_available boolean",
    ).selectExpr("event_id", "'payment_intent.succeeded' event_type", "5000L amount_cents", "'usd' currency",
                 "'cus' stripe_customer_id", "'m' merchant_id", "risk_score", "features_available")
    flagged = lifecycle.apply_fallback(lifecycle.flag_scores(scored))
    assert rows(flagged, "event_id", "risk_score", "is_high_risk", "manual_review") == [
        ("a", 0.69, False, False), ("b", 0.7, True, False), ("c", 0.85, True, True), ("d", 0.1, False, True),
        ("e", 1.0, True, True)]
    ways = {n: [r[0] for r in rows(df, "event_id")] for n, df in lifecycle.route(flagged).items()}
    assert ways == {"scored": list("abcde"), "alert": list("bce"), "ledger": list("ad"), "review": list("ce"),
                    "state": list("abcde")}
    booked = lifecycle.double_entry(lifecycle.route(flagged)["ledger"])
    assert rows(booked, "transaction_id", "entry_type", "amount_cents") == [
        ("a", "CREDIT", 5000), ("a", "DEBIT", 5000), ("d", "CREDIT", 5000), ("d", "DEBIT", 5000)]


def test_feature_lookup_defaults(spark):
    events = spark.createDataFrame([("a",), ("b",)], "event_id string")
    stored = spark.createDataFrame([("a", *[1.0] * 7, None)], "event_id string, " + ", ".join(f"{c} double" for c in sc.FEATURE_ORDER))
    a, b = lifecycle.lookup_features(events, stored).orderBy("event_id").select(*sc.FEATURE_ORDER, "features_available").collect()
    assert tuple(a) == (*[1.0] * 7, 0.0, True)
    assert tuple(b) == (10.0, 50.0, 2.0, 1.0, 1.0, 12.0, 0.0, 0.0, False)


def test_dedup_ttl(spark):
    def deliveries(*hours):
        return spark.createDataFrame([("e", "t", i, T0 + timedelta(hours=h)) for i, h in enumerate(hours)],
                                     "id string, type string, seq int, at timestamp")

    def kept(*hours):
        return [r.seq for r in intake.dedup_ttl(deliveries(*hours), ["id", "type"], "at", "seq").orderBy("seq").collect()]

    assert kept(0, 1, 23) == [0]
    assert kept(0, 23, 24, 25) == [0, 2]
    assert kept(0, 23, 30, 47, 54, 100) == [0, 2, 4, 5]
    assert kept(0, 0, 0) == [0]


@pytest.mark.parametrize("ttl", [30, 86_400])
def test_dedup_ttl_of_a_hot_key(spark, many_blocks, monkeypatch, ttl):
    """A hot key, a null one and ordinary ones against a plain loop; rounds are logarithmic."""
    rng = random.Random(ttl)
    rows = [(None if n % 50 == 0 else "hot" if n % 10 else f"k{n % 7}", n, T0 + timedelta(seconds=rng.randrange(ttl * 60))) for n in range(1500)]
    rows += [("tied", n, T0 + timedelta(seconds=ttl * (n // 4))) for n in range(40)]
    want, until = [], {}
    for key, seq, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in until or at >= until[key]:
            want.append(seq if key != "tied" else -seq)
            until[key] = at + timedelta(seconds=ttl)
    stored = []
    monkeypatch.setattr(intake, "written", lambda df, name: stored.append(name) or written(df, name))
    df = spark.createDataFrame(rows, "key string, seq int, at timestamp")
    got = intake.dedup_ttl(df, ["key"], "at", "seq", ttl).collect()
    assert sorted(r.seq if r.key != "tied" else -r.seq for r in got) == sorted(want)
    assert len([k for k in want]) > 60 and stored.count("reached") <= 8


def test_quality(spark):
    log = log_rows(spark, ("t1", "m", ["INITIATED", "VALIDATED", "SCORING", "AUTHORIZED", "SETTLED"]),
                   ("t2", "m", ["INITIATED", "SCORING"]))
    assert rows(quality.state_machine_audit(log), "transaction_id", "to_state", "bad_edge", "broken_chain") == [
        ("t2", "SCORING", True, False)]
    gap = log.where("NOT (transaction_id = 't1' AND to_state = 'SCORING')")
    assert ("t1", "AUTHORIZED", False, True) in rows(
        quality.state_machine_audit(gap), "transaction_id", "to_state", "bad_edge", "broken_chain")
    ledger = ledger_rows(spark, ("t1", "DEBIT", 5, "m", T0), ("t1", "CREDIT", 5, "m", T0), ("t9", "DEBIT", 7, "m", T0))
    assert quality.ledger_pair_audit(log, ledger).count() == 0
    assert quality.ledger_pair_audit(log, ledger.where("entry_type = 'DEBIT'")).count() == 1
    assert rows(quality.ledger_balance(ledger), "transaction_id", "balance_cents") == [("t9", -7)]
    assert quality.append_only_audit(ledger, ledger).count() == 0
    assert quality.append_only_audit(ledger, ledger.where("id <> 2")).count() == 1
    balanced = spark.createDataFrame([("t", "m", 10000, 9999), ("u", "m", 5, None)],
                                     "transaction_id string, merchant_id string, debit_amount_cents bigint, credit_amount_cents bigint")
    assert rows(quality.assert_ledger_balanced(balanced), "transaction_id") == [("t",)]


def test_alert_needs_every_check(spark):
    series = spark.createDataFrame(
        [(T0 + timedelta(minutes=i), i != 5) for i in range(12)], "window_start timestamp, breach boolean")
    got = service_metrics.alert_state(series, 60, 5).orderBy("window_start").collect()
    assert [i for i, r in enumerate(got) if r.firing] == [4, 10, 11]


def test_ranges(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in (0, 12, 24)], "at timestamp")
    assert df.where(utc_day("at", T0.date())).count() == 2
    assert date_range(df, "at", None, T0.date()).count() == 1
    assert date_range(df, "at", None, T0.date(), inclusive_end=True).count() == 2
    assert date_range(df, "at", T0.date() + timedelta(days=1), None).count() == 1
    assert df.select(usd(F.lit(250)).alias("x")).first().x == 2.5


def test_sources_and_sinks(spark, folder):
    with open(f"{folder}/seed.csv", "w") as f:
        f.write("transaction_id,debit_amount_cents,credit_amount_cents\nimbalanced_test_001,10000,9999\n")
    seed = tables.read_seed(spark, f"{folder}/seed.csv", sc.IMBALANCE_SEED)
    assert tuple(seed.first()) == ("imbalanced_test_001", 10000, 9999)
    path = tables.write_feature_store(seed, folder, date(2026, 3, 1))
    assert path.endswith("features_20260301.parquet") and spark.read.parquet(path).count() == 1

    ledger = ledger_rows(spark, ("t1", "DEBIT", 5, "m", T0), ("t1", "CREDIT", 5, "m", T0 + timedelta(days=2)))
    key_index.idempotent_append(ledger, f"{folder}/ledger", ["source_event_id", "entry_type"])
    key_index.idempotent_append(ledger, f"{folder}/ledger", ["source_event_id", "entry_type"])
    assert tables.read_table(spark, f"{folder}/ledger").count() == 2
    assert tables.read_table(spark, f"{folder}/ledger", sc.LEDGER_ENTRIES, end=T0.date()).count() == 1

    found = reconciliation.reconcile(intents(spark, ("pi_1", 5, "usd", None)), ledger)
    reconciliation.persist(found, f"{folder}/discrepancies")
    stored = spark.read.parquet(f"{folder}/discrepancies")
    assert tables.export_run_date(stored, T0.date(), f"{folder}/warehouse")
    assert not tables.export_run_date(stored, date(2000, 1, 1), f"{folder}/warehouse")
    assert spark.read.parquet(f"{folder}/warehouse").count() == 1
    message = reconciliation.messages(found).first()
    assert (message.topic, message.key) == ("payment.reconciliation.queue", "pi_1")

    intents(spark, ("pi_1", 5, "usd", None)).write.parquet(f"{folder}/intents")
    assert tables.read_intents(spark, f"{folder}/intents", T0.date()).count() == 1
    assert tables.read_intents(spark, f"{folder}/intents", T0.date() + timedelta(days=1)).count() == 0


def test_messages_round_trip(spark):
    df = spark.createDataFrame([("e", "t", 5, "usd", "c", "m", T0 + timedelta(microseconds=123457))], sc.VALIDATED_EVENT)
    assert topics.parse_messages(topics.to_topic(df, sc.TOPIC_VALIDATED, "event_id")).collect() == df.collect()


def test_expiring_upserts(spark, folder):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    later = F.lit("2026-01-01 00:10:00").cast("timestamp")
    window = F.struct(F.lit(T0).alias("start"), F.lit(T0).alias("end")).alias("window")

    def counts(n):
        return spark.range(1).select(window, F.lit("m").alias("merchant_id"), F.lit(n).cast("bigint").alias("count"))

    sink = tables.velocity_sink(f"{folder}/v", now=at)
    sink(counts(1), 0)
    sink(counts(2), 1)
    sink(counts(3), 1)
    got = tables.read_velocity(spark, f"{folder}/v", at).collect()
    assert [(r.merchant_id, r["count"]) for r in got] == [("m", 3)]
    assert got[0].epoch_minute == int(T0.timestamp()) // 60
    assert tables.read_velocity(spark, f"{folder}/v", later).count() == 0

    features_sink = tables.feature_sink(f"{folder}/f", now=at)
    features_sink(spark.createDataFrame([("e", None, 13)], "event_id string, amount_cents_log double, hour_of_day int"), 0)
    r = tables.read_features(spark, f"{folder}/f", later).first()
    assert (r.event_id, r.amount_cents_log, r.hour_of_day, r.tx_velocity_1m) == ("e", 0.0, 13.0, 0.0)


def test_marts_build_in_order(spark, folder):
    log = log_rows(spark, ("t1", "m", ["INITIATED", "SETTLED"]), ("t2", "new", ["INITIATED"]))
    ledger = ledger_rows(spark, ("t1", "DEBIT", 5, "m", T0), ("t1", "CREDIT", 5, "m", T0))
    found = reconciliation.reconcile(intents(spark, ("pi_1", 5, "usd", None)), ledger).withColumn("created_at", F.lit(T0))
    built = warehouse.build_marts(spark, log, ledger, found, folder)
    assert set(built) == {n for layer in warehouse.LAYERS.values() for n in layer}
    assert rows(built["fact_transactions"], "transaction_id") == [("t1",)]
    assert rows(marts.dash_fraud_metrics(log, ledger), "current_state", "transaction_count") == [("INITIATED", 1), ("SETTLED", 1)]
    assert built["hourly_payment_volume"].first().settled_count == 1
    assert spark.table("stg_transactions").count() == 2
    assert [r.total_settled_amount_cents for r in marts.in_mart_order(built["merchant_performance"], "merchant_performance").collect()] == [5]
    assert reports.filter_mart(built["fraud_metrics"], "current_state").count() == 1


def test_model(spark):
    df = spark.range(600).selectExpr(
        *[f"CAST(id % {7 + i} AS DOUBLE) {c}" for i, c in enumerate(sc.FEATURE_ORDER)], "CAST(id % 7 > 4 AS DOUBLE) label",
        "id % 2 = 0 features_available", "CAST(id AS STRING) event_id")
    train, held_out = model.split(df)
    ids = {r.event_id for r in held_out.collect()}
    assert ids == {r.event_id for r in model.split(df.repartition(7))[1].collect()} and 60 < len(ids) < 180
    assert train.count() == 600 - len(ids)
    fitted = model.train(train)
    assert model.auc(fitted, held_out) > 0.99
    for r in model.score(fitted, held_out).collect():
        assert 0.0 <= r.risk_score <= 1.0
        assert r.is_high_risk == (r.risk_score >= 0.7)
        assert r.manual_review == (r.risk_score >= 0.85 or not r.features_available)
    assert list(model.feature_vector(df).first().features) == [0.0] * 8
