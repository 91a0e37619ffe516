"""The log-structured store: few runs over many batches, whole versions for readers, expiry and reruns."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from centflow.sources import files
from centflow.sources.expiring_store import ExpiringStore

T0 = datetime(2026, 3, 23)


def at(minutes):
    return F.lit(T0 + timedelta(minutes=minutes))


def store(path, minutes, ttl=3600, grace=0):
    return ExpiringStore(path, {"k": "string"}, {"v": "long"}, ttl, at(minutes), fan_in=4, grace_seconds=grace)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v long")


def held(spark, path, minutes, **more):
    return {r.k: r.v for r in store(path, minutes, **more).read(spark).collect()}


def data_files(path):
    return [f for _, _, names in os.walk(f"{path}/runs") for f in names if f.startswith("part-")]


def test_runs_stay_few_and_values_right(spark, folder):
    """Fifty batches of one minute with a TTL of twenty."""
    want, most = {}, 0
    for n in range(50):
        rows = [(f"k{n % 7}", n), (f"own{n}", n)]
        store(folder, n, ttl=20 * 60).upsert(frame(spark, *rows).coalesce(1), n)
        want |= {k: (v, n) for k, v in rows}
        most = max(most, len(data_files(folder)))
        if n % 10 == 9:
            assert held(spark, folder, n, ttl=20 * 60) == {k: v for k, (v, m) in want.items() if n - m < 20}
    version = store(folder, 49).version(spark)
    assert len(version.runs) <= 3 * 4 and most <= 40
    assert len(files.names(spark, f"{folder}/manifest")) <= 2
    assert {r.name for r in version.runs} == set(files.names(spark, f"{folder}/runs")) - set(version.retired)


def test_readers_keep_their_version_while_runs_are_merged(spark, folder):
    for n in range(3):
        store(folder, n, grace=3600).upsert(frame(spark, ("a", n), (f"b{n}", n)), n)
    reader = store(folder, 3, grace=3600).read(spark)
    for n in range(3, 9):
        store(folder, n, grace=3600).upsert(frame(spark, ("a", n)), n)
    assert {r.k: r.v for r in reader.collect()} == {"a": 2, "b0": 0, "b1": 1, "b2": 2}
    assert held(spark, folder, 9, grace=3600) == {"a": 8, "b0": 0, "b1": 1, "b2": 2}
    # long after, the runs given up are gone
    for n in range(70, 72):
        store(folder, n, grace=3600).upsert(frame(spark, ("c", n)), n)
    version = store(folder, 72).version(spark)
    assert not [r for r in version.runs if r.newest < 9]


def test_a_batch_that_runs_again_replaces_itself(spark, folder):
    for n, v in ((0, 1), (1, 2), (1, 3)):
        store(folder, 0).upsert(frame(spark, ("a", v)), n)
    assert held(spark, folder, 0) == {"a": 3}
    for n in (2, 3, 4):
        store(folder, 0).upsert(frame(spark, ("b", n)), n)
    store(folder, 0).upsert(frame(spark, ("b", 9)), 4)      # merged meanwhile: the later version counts
    assert held(spark, folder, 0) == {"a": 3, "b": 9}


def test_broken_writes_are_not_seen_and_removed(spark, folder):
    store(folder, 0).upsert(frame(spark, ("a", 1)), 0)
    frame(spark, ("x", 1)).write.parquet(f"{folder}/runs/0-000000000000-broken")
    assert held(spark, folder, 0) == {"a": 1}
    store(folder, 1).upsert(frame(spark, ("a", 2)), 1)
    assert "0-000000000000-broken" not in files.names(spark, f"{folder}/runs")


def test_empty_store_empty_batch_and_null_keys(spark, folder):
    assert store(folder, 0).read(spark).columns == ["k", "v", "expires_at"] and held(spark, folder, 0) == {}
    store(folder, 0).upsert(frame(spark), 0)
    store(folder, 1).upsert(frame(spark, (None, 5), (None, 5), ("a", None)), 1)
    assert held(spark, folder, 1) == {None: 5, "a": None}
    assert held(spark, folder, 61) == {}


def test_publish_once(spark, folder):
    files.publish_text(spark, f"{folder}/m/1.json", "é")
    assert files.read_text(spark, f"{folder}/m/1.json") == "é"
    with pytest.raises(FileExistsError):
        files.publish_text(spark, f"{folder}/m/1.json", "other")
    assert files.read_text(spark, f"{folder}/m/1.json") == "é"
