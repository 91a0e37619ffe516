"""Appends by an index of keys: the same rows as an anti join with the whole table, but few files read."""

import os
import random

import pytest

from centflow.sources import key_index as ki

KEYS = ["tx", "kind"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "tx string, kind string, amount long")


def rows_of(lo, hi):
    return [(f"t{n:06d}", kind, n) for n in range(lo, hi) for kind in ("DEBIT", "CREDIT")]


def stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).collect()), key=repr)


@pytest.fixture
def history(spark, many_blocks, folder):
    """A table of three appends, each of several files."""
    path = f"{folder}/table"
    for n in range(3):
        ki.idempotent_append(frame(spark, rows_of(1000 * n, 1000 * n + 1000)), path, KEYS)
    return path


def test_reads_only_files_that_may_hold_a_key(spark, history):
    files = ki.table_files(spark, history)
    assert len(files) == 12
    done = ki.idempotent_append(frame(spark, rows_of(3000, 3010)), history, KEYS)
    assert done.files == 12 and done.read == []          # later keys: no append's range meets them
    done = ki.idempotent_append(frame(spark, [("t002500", "DEBIT", 1), ("t002500x", "DEBIT", 2)]), history, KEYS)
    assert len(done.read) == 1
    assert stored(spark, history) == sorted(rows_of(0, 3010) + [("t002500x", "DEBIT", 2)], key=repr)


def test_the_file_read_is_the_one_that_holds_the_key(spark, history):
    for n in random.Random(2).sample(range(3000), 3):
        done = ki.idempotent_append(frame(spark, [(f"t{n:06d}", "CREDIT", 7)]), history, KEYS)
        holding = spark.read.parquet(history).where(f"tx = 't{n:06d}' and kind = 'CREDIT'").select("_metadata.file_path").collect()
        assert {ki._plain(r[0]) for r in holding} <= set(done.read) and len(holding) == 1 and len(done.read) <= 2


def test_replay_and_overlap(spark, history):
    before = stored(spark, history)
    ki.idempotent_append(frame(spark, rows_of(900, 2100)), history, KEYS)
    assert stored(spark, history) == before
    ki.idempotent_append(frame(spark, rows_of(2990, 3005)), history, KEYS)
    assert stored(spark, history) == sorted(rows_of(0, 3005), key=repr)


def test_filters_reject_most_other_keys(spark, history):
    """Keys inside all ranges that no file holds."""
    files = ki.table_files(spark, history)
    others = frame(spark, [(f"t{n:06d}y", "DEBIT", 0) for n in range(0, 3000, 60)])
    assert len(ki.may_hold(others, history, KEYS, files)) <= 4


def test_files_of_plain_appends_and_of_a_lost_index(spark, folder):
    path = f"{folder}/table"
    frame(spark, rows_of(0, 50)).write.parquet(path)
    assert not os.path.exists(f"{path}/{ki.INDEX}")
    ki.idempotent_append(frame(spark, rows_of(40, 60)), path, KEYS)
    frame(spark, rows_of(60, 70)).write.mode("append").parquet(path)
    ki.idempotent_append(frame(spark, rows_of(55, 80)), path, KEYS)
    assert stored(spark, path) == sorted(rows_of(0, 80), key=repr)
    assert spark.read.parquet(path).columns == ["tx", "kind", "amount"]


def test_words_without_a_file_row_are_redone(spark, folder):
    """A call that broke off after the words were stored."""
    path = f"{folder}/table"
    ki.idempotent_append(frame(spark, rows_of(0, 20)), path, KEYS)
    words = spark.read.parquet(f"{path}/{ki.INDEX}/words").drop("part")
    words.write.parquet(f"{path}/{ki.INDEX}/words/part=broken")
    ki.idempotent_append(frame(spark, rows_of(10, 30)), path, KEYS)
    assert stored(spark, path) == sorted(rows_of(0, 30), key=repr)


def test_nulls_repeated_keys_and_empty_batches(spark, folder):
    path = f"{folder}/table"
    rows = [(None, "DEBIT", 1), ("a", None, 2), ("b", "DEBIT", 3), ("b", "DEBIT", 3)]
    ki.idempotent_append(frame(spark, rows), path, KEYS)
    ki.idempotent_append(frame(spark, rows + [("c", "DEBIT", 4)]), path, KEYS)
    ki.idempotent_append(frame(spark, []), path, KEYS)
    ki.idempotent_append(frame(spark, [(None, None, 9)]), path, KEYS)
    assert stored(spark, path) == sorted([*rows, *rows[:2], ("c", "DEBIT", 4), (None, None, 9)], key=repr)


def test_slots_are_leading_bits(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(-1,), (0,), (1 << 62,), (-(1 << 63),)], "h long").select(
        *(ki._slot(F.col("h"), F.lit(b)) for b in (0, 1, 2, 24))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, (1 << 24) - 1), (0, 0, 0, 0), (0, 0, 1, 1 << 22), (0, 1, 2, 1 << 23)]
