"""Packing of token sequences into rows of a fixed capacity by best fit over a histogram of lengths.

Best fit decreasing puts the longest item first, each into the sequence with the least room that still takes it.
Items of one length are alike to it, so it runs over the counts of the lengths: sequences with the same content are
one kind with a number, and a length is put into the kinds in order of their room. A length splits at most one kind
of each of its two steps (kinds with room, new sequences), so there are at most 3 kinds per length and the plan's
size depends on the capacity alone, never on the number of documents. Only the histogram (at most ``capacity``
numbers) reaches the driver.

The plan gives, for each length and kind, an interval of ranks, the first sequence and a place in it. Items are
ranked within their length (``ranks.ranked``: a length that most items have spans many tasks) and take the slot of
their rank: a join by length and rank. The plan is dealt into buckets of ranks, at most two a row, so that an item
meets about two rows; it is broadcast because of its bound.

Defined results: a null text is empty, and an empty text is the end id alone; a text longer than the capacity is cut
into pieces of the capacity, of which the first may be shorter; rows with equal or null ids are documents of their
own, equal rows take slots in any order; an empty table gives no rows. Texts of any length are encoded whole.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from centflow.llm.batches import slices
from centflow.llm.bpe import encoder
from centflow.llm.ranks import ranked

#: Pieces of one Arrow batch that leaves a task.
PIECES = 1_000

#: One kind of sequence: how many there are, and (length, times) of what each holds.
Kind = tuple[int, tuple[tuple[int, int], ...]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(doc_id, piece int, start long, length long, ids binary) of every document's ids and its end id.

    ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the document's ids before the piece.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids, sizes = model.encode(batch.column("text"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), sizes + 1
            times = -(-sizes // capacity)
            last = np.cumsum(times)
            number = np.arange(last[-1] if len(last) else 0) - np.repeat(last - times, times)
            # all pieces but the first are full, so what is left over stands in front
            over = np.repeat((times * capacity - sizes), times)
            start = np.maximum(number * capacity - over, 0)
            length = (number + 1) * capacity - over - start
            ends = np.concatenate([[0], np.cumsum(length)])
            rows_of, names = np.repeat(np.arange(len(times)), times), batch.column("doc_id")
            for a in range(0, len(number), PIECES):
                b = min(a + PIECES, len(number))
                data = ids[ends[a]:ends[b]].tobytes()
                bounds = ((ends[a:b + 1] - ends[a]) * 4).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows_of[a:b])), pa.array(number[a:b], pa.int32()), pa.array(start[a:b], pa.int64()),
                     pa.array(length[a:b], pa.int64()), binary], ["doc_id", "piece", "start", "length", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """The kinds of sequences that best fit decreasing makes of ``counts[length]`` items of each length."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    by_room: list[list[Kind]] = [[] for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        # rooms of at least ``length`` in rising order; what is put back has less room and is not met again
        for room in range(length, capacity):
            while by_room[room] and left:
                left = _put(by_room, by_room[room].pop(), room, length, left)
        if left:
            rest = _put(by_room, (-(-left // (capacity // length)), ()), capacity, length, left)
            assert not rest
    return [kind for kinds in by_room for kind in kinds]


def _put(by_room: list[list[Kind]], kind: Kind, room: int, length: int, left: int) -> int:
    """Fill the sequences of a kind with up to ``left`` items of a length; return how many items are left."""
    sequences, content = kind
    times = room // length
    full = min(sequences, left // times)
    if full:
        by_room[room - times * length].append((full, (*content, (length, times))))
    left -= full * times
    sequences -= full
    if sequences and left:
        # fewer than ``times`` items are left: they share one sequence
        by_room[room - left * length].append((1, (*content, (length, left))))
        sequences, left = sequences - 1, 0
    if sequences:
        by_room[room].append((sequences, content))
    return left


def slots(kinds: list[Kind]) -> np.ndarray:
    """Rows (length, first rank, rank after the last, items per sequence, first sequence, offset) of a plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for number, content in kinds:
        offset = 0
        for length, times in content:
            first = used.get(length, 0)
            used[length] = first + number * times
            out.append((length, first, used[length], times, sequence, offset))
            offset += length * times
        sequence += number
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _dealt(plan: np.ndarray) -> tuple[pa.Table, pa.Table]:
    """The widths of the buckets of each length, and the plan's rows in every bucket that they meet."""
    lengths, at, rows = np.unique(plan[:, 0], return_inverse=True, return_counts=True)
    counts = np.zeros(len(lengths), np.int64)
    np.maximum.at(counts, at, plan[:, 2])
    widths = -(-counts // rows)
    low, high = plan[:, 1] // widths[at], (plan[:, 2] - 1) // widths[at]
    times = high - low + 1
    copies = np.repeat(np.arange(len(plan)), times)
    bucket = low[copies] + np.arange(len(copies)) - np.repeat(np.cumsum(times) - times, times)
    names = ["length", "_first", "_stop", "_times", "_sequence", "_offset"]
    columns = {name: plan[copies, i] for i, name in enumerate(names)}
    return pa.table({"length": lengths, "_width": widths}), pa.table({**columns, "_bucket": bucket})


def pack(items: DataFrame, order: list[str], capacity: int, length: str = "length") -> DataFrame:
    """``items`` (a stored, narrow table) with sequence_id long (gapless from 0) and offset long.

    Within a length, items take their slots in ``order``; a sequence holds its items without gaps from offset 0.
    """
    spark = items.sparkSession
    counts = {r[length]: r["n"] for r in items.groupBy(length).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    widths, plan = _dealt(slots(best_fit(counts, capacity)))
    # at most ``capacity`` rows, and a bounded number for each pair of lengths
    widths, plan = (F.broadcast(spark.createDataFrame(t).withColumnRenamed("length", "_length")) for t in (widths, plan))
    rank = ranked(items, [length], order, "_rank").join(widths, F.col(length) == F.col("_length")).drop("_length")
    met = rank.join(plan, (F.col(length) == F.col("_length")) & (F.expr("_rank div _width") == F.col("_bucket"))
                    & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_stop")))
    number = F.col("_rank") - F.col("_first")
    return met.select(
        *items.columns, (F.col("_sequence") + F.expr("(_rank - _first) div _times")).alias("sequence_id"),
        (F.col("_offset") + number % F.col("_times") * F.col(length)).alias("offset"))


def sequences(parts: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """(sequence_id, ids binary, lengths array<long>) of all sequences: ``parts`` (key, ids) in their places."""
    placed = packed.select(key, "sequence_id", "offset", "length").join(parts.select(key, "ids"), key)
    row = F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("rows")
    joined = F.aggregate("rows", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"]))
    return placed.groupBy("sequence_id").agg(row).select("sequence_id", joined.alias("ids"), F.col("rows.length").alias("lengths"))
