"""Encode and decode documents with a public byte-level BPE tokenizer.

Texts are cut into the tokenizer's pieces, all texts of a batch together where they are of ASCII and Latin letters,
by its pattern where not, and pieces are encoded by ``prefix_bpe``; distinct pieces of a batch once, and those
in the worker's bounded cache not again. The ids equal those of the tokenizers library without truncation, padding or added special tokens; the
text of a special token gets its id.

Defined results: a null text is empty; an empty text has no ids; rows are independent, so repeated rows, null
and repeated ids and further columns do not matter. Texts of any length are encoded whole.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from centflow.llm.batches import PieceCache, as_lists, filled, slices, strings, with_columns
from centflow.llm.prefix_bpe import PrefixBpe

#: Fixed value: how byte-level tokenizers of this kind split a text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SLICE = 4 << 20
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
_models: dict[str, "Encoder"] = {}


def _byte_classes() -> np.ndarray:
    """Classes of the bytes of ASCII and of the letters U+00C0 to U+017F, which begin with C3, C4 or C5."""
    classes = np.full(256, _UNKNOWN, np.uint8)
    classes[:0x80] = _OTHER
    classes[[0x20, *range(0x09, 0x0E)]] = _SPACE
    classes[0x30:0x3A] = _DIGIT
    classes[0x41:0x5B] = classes[0x61:0x7B] = classes[0x80:0xC0] = classes[0xC3:0xC6] = _LETTER
    return classes


_CLASSES = _byte_classes()
_SHORT = np.isin(np.arange(256), list(b"stmd"))


def _next(values: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([values[by:], np.zeros(by, values.dtype)])[:len(values)]


def piece_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where PIECES begin in texts put one after the other, and per byte whether its text has other characters.

    A run of white space before a visible character is one piece without its last character, which is a piece
    of its own unless it is a space, and then it begins the next piece.
    """
    kind = _CLASSES[data]
    first = np.zeros(len(data), bool)
    first[starts[starts < len(data)]] = True
    before = np.concatenate([[_UNKNOWN], kind[:-1]])
    space, after_space = kind == _SPACE, np.concatenate([[False], data[:-1] == 0x20])
    visible_next = _next(~space & ~first, 1)
    begins = first | np.where(space, (before != _SPACE) | visible_next, (kind != before) & ~after_space)
    one, two = _next(data, 1), _next(data, 2)
    quote = (data == 0x27) & begins & (first | ~after_space)
    short = quote & _SHORT[one] & ~_next(first, 1)
    long = quote & (((one == 0x6C) & (two == 0x6C)) | (((one == 0x72) | (one == 0x76)) & (two == 0x65)))
    long &= ~_next(first, 1) & ~_next(first, 2)
    begins[np.flatnonzero(short | long) + 1] = False
    ends = np.concatenate([np.flatnonzero(short) + 2, np.flatnonzero(long) + 3])
    begins[ends[ends < len(data)]] = True
    sign = (data == 0xC3) & ((one == 0x97) | (one == 0xB7))
    return begins, (kind == _UNKNOWN) | sign


class Encoder:
    """A tokenizer file with the cache of one Python worker."""

    def __init__(self, path: str) -> None:
        self.bpe = PrefixBpe(path)
        self.cache = PieceCache(self._encode_pieces)
        names = sorted(self.bpe.special, key=len, reverse=True)
        self.special = "|".join(map(regex.escape, names))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = self.bpe.encode_pieces([b"" if p in self.bpe.special else p.encode() for p in pieces])
        special = [i for i, p in enumerate(pieces) if p in self.bpe.special]
        ends = np.cumsum(lengths)[special]
        lengths[special] = 1
        return np.insert(ids, ends, [self.bpe.special[pieces[i]] for i in special]), lengths

    def _sizes(self, text: str) -> list[int]:
        """Bytes of each piece of any text; a special token is a piece, what lies between is a text of its own."""
        parts = regex.split(f"({self.special})", text) if self.special else [text]
        pieces = [p for part in parts for p in ([part] if part in self.bpe.special else PIECES.findall(part))]
        return [len(p.encode()) for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and ids per text."""
        texts = filled(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = (offsets - offsets[0]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begins, other = piece_starts(data, offsets[:-1])
        slow = np.diff(np.concatenate([[0], np.cumsum(other)])[offsets]) > 0
        if self.special:
            slow |= pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(slow).tolist():
            begins[offsets[i]:offsets[i + 1]] = False
            begins[offsets[i] + np.cumsum([0, *self._sizes(texts[i].as_py())][:-1], dtype=np.int64)] = True
        bounds = np.append(np.flatnonzero(begins), len(data))
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)),
                                             pa.py_buffer(data)).dictionary_encode()
        return self.cache.expand(pieces.indices.to_numpy().astype(np.int64), strings(pieces.dictionary),
                                 np.diff(np.searchsorted(bounds, offsets)))


def encoder(path: str) -> Encoder:
    if path not in _models:
        _models[path] = Encoder(path)
    return _models[path]


def round_trip(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row: its ids, and the text that the ids decode to."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, "text", SLICE):
            ids, lengths = model.encode(batch.column("text"))
            flat, ends = ids.tolist(), np.cumsum(lengths).tolist()
            decoded = [model.bpe.decode(flat[e - n:e]) for e, n in zip(ends, lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), as_lists(ids, lengths, pa.int32()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(both, f"doc_id {kind}, ids array<int>, decoded string")


def with_ids(df: DataFrame, path: str, text_column: str = "text", to: str = "token_ids") -> DataFrame:
    """All rows and columns, with the ids in a column ``to`` (in place of an equally named one)."""
    df = df.drop(to)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, text_column, SLICE):
            lists = as_lists(*model.encode(batch.column(text_column)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, to])

    return df.mapInArrow(encode, with_columns(df.schema, **{to: T.ArrayType(T.IntegerType())}))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``round_trip``."""
    return documents.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
