"""Helpers for Arrow batches of texts inside tasks: bounded slices, words, units and a bounded cache."""

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The C library of this process.
_C = ctypes.CDLL(None)
#: Bytes of text that one step of a task works on; a longer single text is a step of its own.
SLICE_BYTES = 4 << 20
#: Bytes and rows of an Arrow batch between Spark and a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
#: About what a cached piece takes besides its characters and ids: a string, its place in the table, two numbers.
PIECE_BYTES = 170


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its folder."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch of texts or sets takes in an executor and its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(text_bytes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()
    _trim()


def _trim() -> None:
    """Give freed memory back at the end of a task: the worker lives on and the next stage may need it elsewhere."""
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def filled(texts: pa.Array) -> pa.Array:
    """Texts without nulls, as one string array."""
    return pc.fill_null(texts.cast(pa.string()), "")


def strings(values: pa.Array) -> list[str]:
    """Python strings of an array without nulls, faster than by scalars."""
    return values.to_numpy(zero_copy_only=False).tolist()


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts: code of each word, the distinct words, words per text."""
    texts = filled(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.diff(before[offsets])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ... in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total)


class PieceCache:
    """Token ids of pieces of text seen before in this Python worker, at most about ``limit`` bytes of them.

    A call that finds it full starts anew, and the pieces of one call may exceed the limit.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 96 << 20) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = self.bytes = 0

    def _add(self, pieces: list[str]) -> None:
        ids, lengths = self.encode(pieces)
        n = len(self.at)
        while n + len(pieces) > len(self.lengths):
            self.lengths, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.lengths[n:n + len(pieces)] = lengths
        self.starts[n:n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.bytes += PIECE_BYTES * len(pieces) + sum(map(len, pieces)) + 4 * len(ids)
        self.at.update(zip(pieces, range(n, n + len(pieces))))

    def look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each (distinct) piece in ``ids``; valid until the next call."""
        if self.bytes > self.limit:
            self._clear()
        if missing := [p for p in pieces if p not in self.at]:
            self._add(missing)
        rows = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        return self.starts[rows], self.lengths[rows]

    def expand(self, codes: np.ndarray, pieces: list[str], per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and ids per text, for texts made of ``pieces[codes]``."""
        starts, lengths = self.look_up(pieces)
        each = lengths[codes]
        before = np.concatenate([[0], np.cumsum(each)])
        ends = np.concatenate([[0], np.cumsum(per_text)])
        return self.ids[gather(starts[codes], each)], np.diff(before[ends])


def with_columns(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in columns.items())])


def as_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive stretches of ``values``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
