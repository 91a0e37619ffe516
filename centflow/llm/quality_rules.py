"""Reject documents by counts of words and lines and by how well they compress.

Compression bands: the zstandard ratio (compressed to plain bytes) of the whole text and of each of its chunks must
lie in a band that depends on the length. Chunks are the fewest equal parts of at most ``CHUNK`` bytes, so every byte
of a text is in one, and those of a text of several are longer than half of that. Below it text repeats itself, above it text is
noise such as keys or encoded files; limits are wider for short texts, where a frame's header weighs more. A text
is rejected if its whole ratio is outside its band, or more than ``BAD_SHARE`` of its chunks are outside theirs.

Defined results: a null or empty text has all counts 0 and fails the base rule; rows are independent, so repeated
rows, ties, null ids and further columns do not matter; an empty table gives no rows. Texts are measured whole.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from centflow.llm.batches import filled, slices, words

SYMBOLS = "#*$%&|<>"
CHUNK, BAD_SHARE, LEVEL = 4096, 0.2, 3


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of at least ``size`` bytes."""

    size: int
    low: float
    high: float


#: Prose of any language lies between 0.30 and 0.75 from a few hundred bytes on; the limits leave a margin. From 2 KB on
#: prose of the test tables stays below 0.53, and base64 is at 0.76 or more.
BANDS = [Band(0, 0.0, np.inf), Band(128, 0.35, 1.10), Band(512, 0.30, 0.90), Band(2048, 0.25, 0.72),
         Band(8192, 0.22, 0.72), Band(65536, 0.18, 0.72)]


def in_band(sizes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    band = np.searchsorted([b.size for b in BANDS], sizes, side="right") - 1
    ratio = packed / np.maximum(sizes, 1)
    return (ratio >= np.array([b.low for b in BANDS])[band]) & (ratio <= np.array([b.high for b in BANDS])[band])


def compresses_well(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside their band, and the verdict."""
    if not text:
        return 0.0, 0.0, True
    whole = len(zstd.compress(text))
    n = -(-len(text) // CHUNK)
    view, cuts = memoryview(text), [len(text) * i // n for i in range(n + 1)]
    chunks = [len(zstd.compress(view[i:j])) for i, j in zip(cuts, cuts[1:])] if n > 1 else [whole]
    bad = float(np.mean(~in_band(np.diff(cuts), np.array(chunks))))
    good = bool(in_band(np.array([len(text)]), np.array([whole]))[0]) and bad <= BAD_SHARE
    return whole / len(text), bad, good


def _repeated(doc: np.ndarray, codes: np.ndarray, n_codes: int) -> np.ndarray:
    """Per word, whether a 3-word window that covers it occurs twice or more in the text."""
    n = len(codes) - 2
    out = np.zeros(len(codes), bool)
    if n <= 0:
        return out
    inside = np.flatnonzero(doc[:n] == doc[2:])
    if n_codes < 1 << 21:
        window = (codes[inside] << 42) | (codes[inside + 1] << 21) | codes[inside + 2]
    else:
        pairs = np.unique(codes[inside] * n_codes + codes[inside + 1], return_inverse=True)[1]
        window = np.unique(pairs * n_codes + codes[inside + 2], return_inverse=True)[1]
    order = np.lexsort((window, doc[inside]))
    same = (window[order][1:] == window[order][:-1]) & (doc[inside][order][1:] == doc[inside][order][:-1])
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    coded = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype(np.int64)
    wordy = some[codes]
    doc, codes = doc[wordy], codes[wordy]
    firsts = np.unique(doc * len(some) + codes) // max(1, len(some))
    return np.bincount(doc, minlength=len(texts)) - np.bincount(firsts, minlength=len(texts))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rule and the method's verdict for a batch of texts."""
    texts = filled(texts)
    codes, distinct, n_words = words(texts)
    doc = np.repeat(np.arange(len(texts)), n_words)
    repeated = _repeated(doc, codes, len(distinct))
    sizes = pc.utf8_length(distinct).to_numpy()[codes]
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    found = [compresses_well(t, zstd) for t in texts.cast(pa.binary()).to_pylist()]
    n_repeat = np.bincount(doc, weights=repeated, minlength=len(texts)).astype(np.int64)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64),
        "n_symbols": pc.count_substring_regex(texts, f"[{SYMBOLS}]").to_numpy().astype(np.int64),
        "n_dup_lines": _duplicate_lines(texts).astype(np.int64), "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & np.array([f[2] for f in found], bool),
        "ratio": np.array([f[0] for f in found], float), "bad_chunks": np.array([f[1] for f in found], float),
    }


_OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, ratio double, bad_chunks double")


def measure(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, ratio, bad_chunks) of every row."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = measures(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in found.items()})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def keep(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            yield batch.filter(pa.array(measures(batch.column(text_column))["kept"]))

    return df.mapInArrow(run, df.schema)
