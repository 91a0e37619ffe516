"""Digest trees, bucketed comparison, streamed alerts and compiled scores."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from centflow import schemas as sc
from centflow.operators import digests, model, quality, recon, service_metrics
from centflow.registry import drained
from centflow.session import scratch_path
from centflow.sources import bucketed
from centflow.streaming import alerts

T0 = datetime(2026, 3, 1, 12)
ROWS = "k string, amount bigint, note string, at timestamp"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def rows(n=400):
    return [(f"k{i % 90}", i, None if i % 5 == 0 else f"n{i}", T0 + timedelta(hours=i, microseconds=i)) for i in range(n)]


def audit(old, new, **trees):
    return sorted(map(tuple, digests.append_only_audit(old, new, "k", "at", ranges=4, **trees).collect()), key=repr)


def test_digests_find_what_the_plain_audit_finds(spark):
    old = rows()
    old += [old[7], old[7], ("hot", 1, "x", None), (None, None, None, None), (None, None, None, None)]
    new = list(old)
    new.remove(old[7])                                         # one of three copies
    new[50] = (*new[50][:3], new[50][3] + timedelta(microseconds=1))  # a time moved by a microsecond
    new[120] = (new[120][0], new[120][1], "", new[120][3])      # a null that became an empty text
    new.remove((None, None, None, None))
    new.append(("late", 1, "added", T0))
    old, new = table(spark, old), table(spark, new)
    want = sorted(map(tuple, quality.append_only_audit(old, new).collect()), key=repr)
    assert len(want) == 4 and audit(old, new) == want
    assert audit(old, old) == [] and audit(old.limit(0), new) == [] and len(audit(old, new.limit(0))) == old.count()


def test_only_differing_ranges_are_drilled_into(spark, folder):
    old, new = table(spark, rows()), table(spark, [r for r in rows() if r[1] != 77])
    digests.write_tree(digests.digest_tree(old, "k", "at", 4), f"{folder}/tree")
    stored, fresh = digests.read_tree(spark, f"{folder}/tree"), digests.digest_tree(new, "k", "at", 4)
    bad = digests.differing_ranges(stored, fresh).collect()
    assert [r._day for r in bad] == [rows()[77][3].date()]
    assert [r[1] for r in audit(old, new, old_tree=stored, new_tree=fresh)] == [77]


def test_many_differing_ranges_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(digests, "BROADCAST_RANGES", 0)
    old, new = table(spark, rows()), table(spark, [r for r in rows() if r[1] % 7])
    assert audit(old, new) == sorted(map(tuple, quality.append_only_audit(old, new).collect()), key=repr)


def test_bucketed_comparison_shuffles_neither_side(spark, folder):
    at = datetime(2026, 3, 1, 9)
    intents = spark.createDataFrame(
        [(f"t{i}", 100 + i, "usd", "succeeded", "m", at + timedelta(days=i % 3)) for i in range(60)],
        "id string, amount bigint, currency string, status string, merchant_id string, created timestamp")
    ledger = spark.createDataFrame(
        [(i, f"t{i}", 100 + i + (i % 4 == 0), "DEBIT", "m", "USD", "e", at + timedelta(days=i % 3)) for i in range(50)],
        "id bigint, transaction_id string, amount_cents bigint, entry_type string, merchant_id string, currency string, "
        "source_event_id string, created_at timestamp")
    names = [f"b{scratch_path(spark, 'x')[-12:]}{n}" for n in "il"]
    bucketed.save_by_transaction(intents, names[0], "id", "created", 4, f"{folder}/i")
    bucketed.save_by_transaction(ledger.where("id < 20"), names[1], "transaction_id", "created_at", 4, f"{folder}/l")
    bucketed.save_by_transaction(ledger.where("id >= 20"), names[1], "transaction_id", "created_at", 4, f"{folder}/l")
    stored = [spark.table(n) for n in names]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for days in ((None, None), (date(2026, 3, 2), date(2026, 3, 2))):
            found = recon.recon_compare(*stored, *days, id_col="transaction_id")
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            want = recon.recon_compare(intents, ledger, *days)
            assert sorted(found.collect()) == sorted(want.collect()) and found.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LOG = "ts timestamp, is_error boolean"


def replay(spark, folder, *batches, **options):
    for i, batch in enumerate(batches):
        spark.createDataFrame([(T0 + timedelta(minutes=m), e) for m, e in batch], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    out = drained(alerts.stream_alerts(stream, threshold=0.5, checks=3, **options)).orderBy("window_start").collect()
    return [(int((r.window_start - T0).total_seconds() // 300), r.breach, r.state) for r in out]


END = [(60 * 24 * 365, False)]


def test_alert_holds_resolves_and_takes_late_rows(spark, folder):
    # windows 0-3 are bad, the only request of window 1 comes after those of window 2, within the bound
    first, second, third = [(0, True), (11, True)], [(6, True), (16, True)], [(21, False), (26, True)]
    got = replay(spark, folder, first, second, third, END, late="10 minutes")
    assert got == [(0, True, "pending"), (1, True, "pending"), (2, True, "firing"), (3, True, "firing"),
                   (4, False, "resolved"), (5, True, "pending"), (6, None, "resolved")]
    log = spark.createDataFrame([(T0 + timedelta(minutes=m), e) for m, e in first + second + third], LOG)
    want = service_metrics.alert_state(service_metrics.error_rate(log, threshold=0.5), checks=3).orderBy("window_start").collect()
    assert [(b, s == "firing") for _, b, s in got if b is not None] == [(r.breach, r.firing) for r in want]


def test_a_missing_window_resolves_once(spark, folder):
    got = replay(spark, folder, [(0, True), (5, True), (10, True)], [(40, True)], [(41, True)], END)
    assert got == [(0, True, "pending"), (1, True, "pending"), (2, True, "firing"), (3, None, "resolved"), (8, True, "pending"),
                   (9, None, "resolved")]


def test_compiled_score_equals_the_model(spark):
    df = spark.range(200).select(
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 7).alias(c) for i, c in enumerate(sc.FEATURE_ORDER)],
        (F.col("id") % 3 == 0).cast("double").alias("label")).persist()
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=3, maxIter=4, seed=1)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=sc.FEATURE_ORDER, outputCol="features"), trees]).fit(df)
    odd = df.limit(1).withColumn(sc.FEATURE_ORDER[0], F.lit(float("inf")))
    both = model.score(fitted, df.unionByName(odd)).withColumn("again", model.compiled(fitted)).collect()
    assert [r.again for r in both] == pytest.approx([r.risk_score for r in both], abs=1e-9)
    assert len({r.again for r in both}) > 5
    assert df.limit(1).withColumn(sc.FEATURE_ORDER[3], F.lit(None).cast("double")).select(model.compiled(fitted)).first()[0] is None
