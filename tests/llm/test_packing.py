"""Packing against item-by-item best fit and the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from centflow.llm import packing
from centflow.session import written
from compare import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def item_by_item(lengths, capacity):
    """The rooms that best fit decreasing leaves, one item at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30)))))
def test_plan_is_best_fit_decreasing(given_):
    capacity, counts = given_
    kinds = packing.best_fit(counts, capacity)
    rooms = [capacity - sum(length * times for length, times in content) for n, content in kinds for _ in range(n)]
    assert sorted(rooms) == item_by_item([x for x, n in counts.items() for _ in range(n)], capacity)
    assert len(kinds) <= 3 * len(counts)
    held = {}
    for n, content in kinds:
        for length, times in content:
            held[length] = held.get(length, 0) + n * times
    assert held == counts


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), min_size=1))))
def test_buckets_hold_every_rank_once(given_):
    capacity, counts = given_
    plan = packing.slots(packing.best_fit(counts, capacity))
    widths, dealt = packing._dealt(plan)
    width = dict(zip(widths["length"].to_pylist(), widths["_width"].to_pylist()))
    assert dealt.num_rows <= 3 * len(plan)
    rows = dealt.to_pylist()
    for length, n in counts.items():
        for rank in range(n):
            met = [r for r in rows if r["length"] == length and r["_bucket"] == rank // width[length] and r["_first"] <= rank < r["_stop"]]
            assert len(met) == 1


def test_plan_does_not_grow_with_the_items():
    few = packing.best_fit({n: 10 for n in range(1, 1025)}, 1024)
    many = packing.best_fit({n: 10**9 + n for n in range(1, 1025)}, 1024)
    assert max(len(few), len(many)) <= 3 * 1024


def test_lengths_beyond_the_capacity():
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, 8)


def checked(rows, texts, capacity=1024):
    """Whether pieces cover the ids of ``texts`` (id and text pairs) and lie in sequences without gaps."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = []
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected.append((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:5]) for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == len(item_by_item([r["length"] for r in rows], capacity))
    return held


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = entry.queries()["op12_packing"](spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    held = checked(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    total = sum(r["length"] for r in rows)
    assert len(held) <= -(-total // 1024) * 1.02 + 1


def test_edge_rows_and_sequences(spark, edge, many_blocks):
    pieces = written(packing.pieces(edge, PATH, 1024, 2).withColumns(
        {"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()}), "pieces")
    packed = packing.pack(pieces.drop("ids"), ["doc_id", "piece", "row"], 1024)
    rows = packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row").collect()
    checked(rows, [(r["doc_id"], r["text"]) for r in edge.collect()])
    ids = {r["row"]: r["ids"] for r in pieces.collect()}
    for s in packing.sequences(pieces, packed, "row").collect():
        own = sorted((r for r in rows if r["sequence_id"] == s["sequence_id"]), key=lambda r: r["offset"])
        assert bytes(s["ids"]) == b"".join(bytes(ids[r["row"]]) for r in own)
        assert s["lengths"] == [r["length"] for r in own]


def test_hot_length_and_equal_rows(spark, frame, many_blocks):
    docs = frame([(7, "same words")] * 400 + [(i, "other words here") for i in range(50)])
    pieces = written(packing.pieces(docs, PATH, 16, 2).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows = packing.pack(pieces.drop("ids"), ["doc_id", "piece", "row"], 16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 450
    assert len({r["sequence_id"] for r in rows}) == len(item_by_item([r["length"] for r in rows], 16))


def test_empty_table(spark, edge):
    pieces = written(packing.pieces(edge.limit(0), PATH, 1024, 2), "pieces")
    assert packing.pack(pieces.drop("ids"), ["doc_id", "piece"], 1024).collect() == []
