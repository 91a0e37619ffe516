"""Running values and trailing counts against brute force, with one key holding most rows."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from centflow.operators import features, intake, ordered, skew
from centflow.session import written

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def events():
    """600 events: two thirds of one merchant, a burst of equal times, a null merchant and a null time."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        merchant = rng.choice(["hot", "hot", "hot", "hot", "m1", "m2"])
        ts = START + timedelta(seconds=rng.randrange(900)) if i % 3 else START + timedelta(seconds=300)
        rows.append((f"e{i:03d}", merchant, f"c{rng.randrange(6)}", rng.randrange(1, 5000), ts,
                     rng.choice(["payment_intent.succeeded", "payment_intent.canceled"])))
    rows.append(("e900", None, "", 5, START, "payment_intent.succeeded"))
    rows.append(("e901", None, "", 7, START + timedelta(seconds=1), "payment_intent.succeeded"))
    return rows


@pytest.fixture(params=["one", "many"])
def layout(request):
    """All rows in one block, or keys that span blocks."""
    if request.param == "many":
        request.getfixturevalue("many_blocks")


COLUMNS = "event_id string, merchant_id string, stripe_customer_id string, amount_cents bigint, received_at timestamp, event_type string"


@pytest.fixture
def df(spark, events):
    return spark.createDataFrame(events, COLUMNS)


def test_hot_key_spans_blocks(df, many_blocks):
    blocks = ordered.ordered_blocks(df, ["merchant_id"], ["received_at", "event_id"])
    per_block = blocks.groupBy("_block").count().collect()
    assert len(per_block) == 4 and max(r["count"] for r in per_block) < 300
    assert blocks.where("merchant_id = 'hot'").select("_block").distinct().count() > 1


def test_key_moments(df, events, layout):
    blocks = ordered.ordered_blocks(df, ["merchant_id"], ["received_at", "event_id"])
    part = ordered.Part(blocks, ["merchant_id"], ["received_at", "event_id"])
    got = {r.event_id: r for r in ordered.key_moments(part, "amount_cents").collect()}
    assert len(got) == len(events) and set(got["e900"].asDict()) == {*blocks.columns, "_mean", "_std"}
    for e in events:
        values = [o[3] for o in events if o[1] == e[1]]
        assert got[e[0]]._mean == pytest.approx(statistics.mean(values), abs=1e-9)
        assert got[e[0]]._std == pytest.approx(statistics.stdev(values), abs=1e-9)


def test_few_blocks_stay_spread_over_tasks(spark, df):
    """A handful of blocks among many shuffle partitions, and joins that turn out to be broadcasts."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4096"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        blocks = ordered.ordered_blocks(df, ["merchant_id"], ["received_at", "event_id"])
        count = blocks.select("_block").distinct().count()
        assert 3 < count < 20
        part = ordered.Part(blocks, ["merchant_id"], ["received_at", "event_id"])
        assert part.placed().rdd.getNumPartitions() == count
        risk = spark.createDataFrame([("hot", 0.5)], "merchant_id string, score double").groupBy("merchant_id").agg(
            F.max("score").alias("score"))
        for rows in (ordered.key_moments(part, "amount_cents"), features.with_merchant_risk(part.placed(), risk)):
            tasks = rows.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in tasks) == 602 and max(r["count"] for r in tasks) < 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1, 60, 300])
def test_trailing_counts(df, events, layout, size):
    got = {r.event_id: r.n for r in features.tx_velocity(df, {"n": size}).collect()}
    for e in events:
        want = sum(o[1] == e[1] and timedelta(0) <= e[4] - o[4] <= timedelta(seconds=size) for o in events)
        assert got[e[0]] == want, e


def test_trailing_counts_ignore_null_times(spark, many_blocks):
    rows = [("a", "m", None), ("b", "m", START), ("c", "m", START + timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "event_id string, merchant_id string, received_at timestamp")
    got = {r.event_id: r.n for r in features.tx_velocity(df, {"n": 60}).collect()}
    assert got == {"a": None, "b": 1, "c": 2}


def test_running_zscore(df, events, layout):
    got = {r.event_id: r.amount_zscore for r in features.zscore_running(df).collect()}
    both = {r.event_id: r for r in features.velocity_and_zscore(df).collect()}
    seen = {}
    for e in sorted(events, key=lambda e: (e[4], e[0])):
        values = seen.setdefault(e[1], [])
        values.append(e[3])
        want = 0.0
        if len(values) >= 3:
            std = statistics.stdev(values)
            want = (e[3] - statistics.mean(values)) / (std if std > 0 else 1.0)
        assert got[e[0]] == pytest.approx(want, abs=1e-9)
        assert both[e[0]].amount_zscore == pytest.approx(want, abs=1e-9)


def test_running_zscore_examples(spark):
    def last(*amounts):
        rows = [(f"e{i}", "m", a, START + timedelta(seconds=i)) for i, a in enumerate(amounts)]
        df = spark.createDataFrame(rows, "event_id string, merchant_id string, amount_cents bigint, received_at timestamp")
        return [r.amount_zscore for r in features.zscore_running(df).orderBy("event_id").collect()]

    assert last(100) == [0.0] and last(100, 200) == [0.0, 0.0]
    assert last(100, 200, 300)[2] == pytest.approx(1.0)
    assert last(500, 500, 500, 500) == [0.0] * 4


def test_large_amounts_keep_their_digits(spark, many_blocks):
    rows = [(f"e{i:03d}", "m", 10**12 + i % 3, START + timedelta(seconds=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id string, merchant_id string, amount_cents bigint, received_at timestamp")
    got = features.zscore_running(df).orderBy("event_id").collect()[-1].amount_zscore
    values = [r[2] for r in rows]
    exact = (values[-1] - 10**12 - 1) / statistics.stdev([v - 10**12 for v in values])
    assert got == pytest.approx(exact, abs=1e-4)


def test_device_switch(df, events, layout):
    got = {r.event_id: r.device_switch_flag for r in features.device_switch(df).collect()}
    last = {}
    for e in sorted(events, key=lambda e: (e[4], e[0])):
        was = last.get(e[2])
        want = int(bool(e[2]) and was is not None and was[1] != e[1] and e[4] - was[4] <= timedelta(seconds=300))
        last[e[2]] = e
        assert got[e[0]] == want, e


def test_rate_limit(df, events, layout):
    got = {r.event_id: (r.position, r.limited) for r in intake.rate_limit(df, 5).collect()}
    used = {}
    for e in sorted(events, key=lambda e: (e[4], e[0])):
        if e[5] != "payment_intent.succeeded":
            assert got[e[0]] == (None, False)
            continue
        key = (e[1], e[4].replace(second=0))
        used[key] = used.get(key, 0) + 1
        assert got[e[0]] == (used[key], used[key] > 5), e


def test_running_sum_of_nulls(spark, many_blocks):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None)], "k string, o int, v int")
    blocks = ordered.ordered_blocks(df, ["k"], ["o"])
    got = ordered.running_sum(ordered.Part(blocks, ["k"], ["o"]), {"s": F.col("v")}).orderBy("o").collect()
    assert [r.s for r in got] == [0, 5, 5]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    many = spark.range(400).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END k")
    one = spark.createDataFrame([("hot", 1), ("k4", 2), ("k5", 3), ("none", 4)], "k string, v int")
    got = skew.spread_join(many, one, ["k"], how)
    want = many.join(one, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_spread_join_splits_the_hot_key(spark):
    """Adaptive execution cuts the partition of a hot key into several tasks."""
    many = spark.range(200_000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 'hot' ELSE concat('k', id % 999) END AS k")
    one = spark.range(999).selectExpr("concat('k', id) AS k", "id AS v").union(spark.sql("SELECT 'hot', 1L"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    many = many.repartition(8)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = skew.spread_join(many, one, ["k"], "left")
        placed = joined.groupBy("k", F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    parts = [r["count"] for r in placed if r["k"] == "hot"]
    assert len(parts) > 1 and sum(parts) == 140_000


def test_fan_out_left_equals_plain_join(spark):
    one = spark.createDataFrame([("hot",), ("k1",), ("alone",), (None,)], "k string")
    many = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 'hot' ELSE concat('k', id % 3) END k", "id v")
    got, want = skew.fan_out_left(one, many, "k"), one.join(many, "k", "left")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_live_features_compute_the_device_flag_once(spark, df, events, many_blocks, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), features.device_switch

    def counted(flag):
        seen.add(1)
        return flag

    count = F.udf(counted, "int").asNondeterministic()
    monkeypatch.setattr(features, "device_switch", lambda rows: plain(rows).withColumn(
        "device_switch_flag", count("device_switch_flag")))
    risk = spark.createDataFrame([("hot", 0.5)], "merchant_id string, score double")
    assert len(features.live_features(df, risk).collect()) == len(events)
    assert seen.value == len(events)


def test_exits_are_made_without_structs(df, events):
    """One step number per row, no lambda over an array of structs, which runs outside generated code."""
    steps = features._with_exits(df, {"a": 60, "b": 300}, "merchant_id", "received_at", "event_id")
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "struct" not in plan
    got = {(r.event_id, r._at): r for r in steps.collect()}
    assert steps.count() == len(got) == 3 * len(events)
    first = min(r._at for r in got.values() if r.event_id == "e001")
    entry, out = got["e001", first], got["e001", first + 300_000_001]
    assert (entry._row, entry._d_a, entry._d_b, entry.amount_cents) == (True, 1, 1, events[1][3])
    assert (out._row, out._d_a, out._d_b, out.amount_cents, out.merchant_id) == (False, 0, -1, None, events[1][1])


def test_blocks_are_summed_up_once(df, events, many_blocks, monkeypatch):
    """Moments and trailing counts of one ordering share one stored row per key and block."""
    stored = []

    def kept(rows, name):
        stored.append((name, written(rows, name)))
        return stored[-1][1]

    monkeypatch.setattr(ordered, "written", kept)
    assert features.velocity_and_zscore(df).count() == len(events)
    assert [name for name, _ in stored] == ["blocks", "per-block"]
    assert stored[1][1].count() == stored[0][1].select("merchant_id", "_block").distinct().count()
