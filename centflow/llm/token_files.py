"""Token-id files: concatenated ids with Elias-Fano coded document bounds and ids.

A file holds, one after the other: the token ids of its documents (16 or 32 bits each, little endian), the
Elias-Fano code of the n + 1 document bounds, the Elias-Fano code of the sorted document ids, and a footer of
fixed size. An Elias-Fano code of n values up to u takes about n * (2 + log2(u / n)) bits; a sample of the
position of every 256th set bit lets ``select`` find a value without a table of 64-bit bounds.
"""

import struct
from typing import BinaryIO

import numpy as np

MAGIC = b"TOKF0001"
_FOOTER = struct.Struct("<qqqqqq8s")
_HEAD = struct.Struct("<qqqq")
SAMPLE = 256
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers >= 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"),
                   ones[::SAMPLE].astype(np.uint32 if not n or ones[-1] < 1 << 32 else np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, by the sampled position before it and the set bits after that."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += int(_ONES[self.high[byte] & ((1 << (at % 8)) - 1)])
        step = 64
        while True:
            counts = np.cumsum(_ONES[self.high[byte:byte + step]], dtype=np.int64)
            k = int(np.searchsorted(counts, left, side="right"))
            if k < len(counts):
                break
            left, byte = left - int(counts[-1]), byte + step
        inside = left - (int(counts[k - 1]) if k else 0)
        bit = int(np.flatnonzero(np.unpackbits(self.high[byte + k:byte + k + 1], bitorder="little"))[inside])
        return ((byte + k) * 8 + bit - i) << self.low_bits | self._low(i, 1)[0]

    def _low(self, start: int, count: int) -> np.ndarray:
        first, last = start * self.low_bits, (start + count) * self.low_bits
        bits = np.unpackbits(self.low[first // 8:(last + 7) // 8], bitorder="little")[first % 8:][:last - first]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop - 1, decoded from the sampled position before the first."""
        if start >= stop:
            return np.zeros(0, np.int64)
        block = start // SAMPLE
        at = int(self.samples[block])
        end = (stop - 1) // SAMPLE + 1
        limit = int(self.samples[end]) if end < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8:(limit + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[at % 8:]) + at
        ones = ones[start - block * SAMPLE:stop - block * SAMPLE]
        return (ones - np.arange(start, stop)) << self.low_bits | self._low(start, stop - start)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low_bits, len(self.high), self.samples.itemsize)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, bits, n_high, wide = _HEAD.unpack_from(data)
        low_end = _HEAD.size + (n * bits + 7) // 8
        low = np.frombuffer(data[_HEAD.size:low_end], np.uint8)
        high = np.frombuffer(data[low_end:low_end + n_high], np.uint8)
        return cls(n, bits, low, high, np.frombuffer(data[low_end + n_high:], f"<u{wide}"))


class Writer:
    """Writes documents in ascending order of id; ids go out as they come, bounds with ``close``."""

    def __init__(self, out: BinaryIO, vocabulary: int) -> None:
        self.out, self.kind = out, np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        self.nulls += len(doc_ids) - len(known)
        self.doc_ids.append(known)
        self.lengths.append(lengths.astype(np.int64))
        self.out.write(ids.astype(self.kind).tobytes())

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        lengths = np.concatenate([np.zeros(1, np.int64), *self.lengths])
        known = np.concatenate([np.zeros(0, np.int64), *self.doc_ids])
        least = int(known[0]) if len(known) else 0
        bounds = EliasFano.build(np.cumsum(lengths)).to_bytes()
        names = EliasFano.build(known - least).to_bytes()
        n_ids = int(lengths.sum())
        self.out.write(bounds + names)
        self.out.write(_FOOTER.pack(n_ids * self.kind.itemsize, len(bounds), len(names), self.kind.itemsize,
                                    self.nulls, least, MAGIC))
        return len(lengths) - 1, n_ids


class Reader:
    """Random and sequential access to the documents of a file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        *numbers, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        n_bytes, n_bounds, n_names, self.wide, self.nulls, self.least = numbers
        self.bounds = EliasFano.from_bytes(self._read(n_bytes, n_bounds))
        self.names = EliasFano.from_bytes(self._read(n_bytes + n_bounds, n_names))
        self.n_docs = self.bounds.n - 1

    def _read(self, start: int, count: int) -> bytes:
        self.source.seek(start)
        return self.source.read(count)

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        """Ids of documents by position; documents without an id come first."""
        known = self.names.values(max(0, start - self.nulls), max(0, stop - self.nulls)) + self.least
        return [None] * max(0, min(stop, self.nulls) - start) + known.tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self._read(first * self.wide, (last - first) * self.wide), f"<u{self.wide}")
