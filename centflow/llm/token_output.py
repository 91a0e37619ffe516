"""Write documents as files of token ids and read them back.

Every document's whole text is encoded with a public tokenizer of the tokenizers library and ends with an end
id. Documents are range-partitioned by id; each task sorts its range and writes one file (see ``token_files``)
to a shared folder, so files in the order of their shards hold all documents in ascending order of id.

Defined results: a null or empty text is the end id alone; a null id sorts first; rows with equal ids follow
each other in the order of their texts' checksums and each is a document; an empty table gives no rows. Only the
named columns are read, so further columns do not matter. A task that runs again writes a new file, and only the
files of finished tasks are in the manifest.
"""

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from centflow.llm.batches import PieceCache, as_lists, gather, slices, strings, words
from centflow.llm.token_files import Reader, Writer

END_ID = 2
#: A word of its own in any text; it separates pieces that are encoded in one call.
_SEPARATOR = "\x01"
#: Marks that begin none of the tokenizer's contractions, so that they are a word after letters.
_MARKS = frozenset(".,;:!?")
#: Fixed value: the words of such tokenizers.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_caches: dict[str, PieceCache] = {}


def word_cache(path: str) -> PieceCache:
    """The worker's cache of encoded words; white space separates words in these tokenizers."""
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        mark = tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        words_only, ends_word = _for_words(tokenizer), _word_ends(tokenizer)

        def ids_of(texts: list[str], by: Tokenizer = tokenizer) -> np.ndarray:
            found = by.encode_batch_fast(texts, add_special_tokens=False)
            return np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in found)])

        def plain(piece: str) -> bool:
            return _SEPARATOR not in piece and not any(s in piece for s in special)

        def any_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if len(mark) != 1 or not all(map(plain, pieces)):
                each = [e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
                return np.array([i for ids in each for i in ids], np.int32), np.array([len(i) for i in each], np.int64)
            ids = ids_of([f" {_SEPARATOR} ".join(pieces[i:i + 256]) + f" {_SEPARATOR}" for i in range(0, len(pieces), 256)])
            ends = np.flatnonzero(ids == mark[0])
            return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces of plain words are told apart by the tokens that end words."""
            if words_only is None:
                return any_pieces(pieces)
            split = list(map(_plain_words, pieces))
            simple = [s for s in split if s]
            words_in = np.array([0 if not s else 2 if " " in s else 1 for s in split], np.int64)
            counted = np.flatnonzero(words_in)
            ids = ids_of([" ".join(simple[i:i + 512]) for i in range(0, len(simple), 512)], words_only)
            ends = np.flatnonzero(ends_word[ids])
            last = np.cumsum(words_in[counted])
            if len(ends) != (last[-1] if len(last) else 0):
                return any_pieces(pieces)
            lengths = np.zeros(len(pieces), np.int64)
            lengths[counted] = np.diff(ends[last - 1], prepend=-1)
            if len(simple) == len(pieces):
                return ids, lengths
            rest = np.flatnonzero(words_in == 0)
            more, lengths[rest] = any_pieces([pieces[i] for i in rest])
            order = np.empty(lengths.sum(), np.int32)
            starts = np.cumsum(lengths) - lengths
            order[gather(starts[counted], lengths[counted])] = ids
            order[gather(starts[rest], lengths[rest])] = more
            return order, lengths

        _caches[path] = PieceCache(encode)
    return _caches[path]


def _word_ends(tokenizer) -> np.ndarray:
    """Of each id, whether its token ends a word."""
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(1 + max(vocabulary.values()), bool)
    if suffix:
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


def _for_words(tokenizer):
    """The same model for plain words in lower case, without the steps that would not change these; None if the
    tokenizer's steps are not the known ones.
    """
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer.to_str())
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]
            or steps[0]["pattern"] != {"Regex": _PATTERN} or spec["model"].get("end_of_word_suffix") is None):
        return None
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
    return Tokenizer.from_str(json.dumps(spec))


def _plain_words(piece: str) -> str:
    """A piece of letters, or of letters and one mark, in lower case as words with a space between; else nothing.

    The letters are those up to U+017F, which have no other composed form.
    """
    if piece.isalpha():
        lower = piece.lower()
        return lower if piece.isascii() or max(piece) <= "\u017f" and lower.isalpha() else ""
    start = piece[:-1]
    if piece[-1:] in _MARKS and start.isalpha() and (word := _plain_words(start)):
        return f"{word} {piece[-1]}"
    return ""


def encoded(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each text followed by the end id, and ids per text."""
    codes, distinct, per_text = words(texts)
    ids, lengths = word_cache(path).expand(codes, strings(distinct), per_text)
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def write_token_files(df: DataFrame, folder: str, path: str, vocabulary: int, id_column: str = "doc_id",
                      text_column: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the files; returns the manifest (shard int, file string, n_docs long, n_ids long)."""
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.crc32("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out = writer = None
        for batch in slices(batches, "text"):
            if writer is None:
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                writer = Writer(out, vocabulary)
            ids, lengths = encoded(batch.column("text"), path, end_id)
            writer.add(batch.column("id").to_pylist(), ids, lengths)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [f"{folder}/{name}"],
                "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()),
            })

    return ranged.mapInArrow(write, "shard int, file string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, with_ids: bool = True, ids_at_once: int = 1 << 21) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of a stored manifest.

    ``start`` counts the ids of all documents before; it needs one running sum over the files, one small row each.
    ``ids_crc32`` is taken of the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    dealt = based.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.select(["file", "base"]).to_pylist()):
            store, path = fs.FileSystem.from_uri(row["file"])
            with store.open_input_file(path) as source:
                reader, first = Reader(source), 0
                while first < reader.n_docs:
                    bounds = reader.bounds.values(first, min(first + 4096, reader.n_docs) + 1)
                    count = max(1, int(np.searchsorted(bounds, bounds[0] + ids_at_once, side="right")) - 1)
                    bounds = bounds[:count + 1]
                    ids = reader.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    at = bounds - bounds[0]
                    columns = {
                        "doc_id": pa.array(reader.doc_ids(first, first + count), pa.int64()),
                        "start": pa.array(bounds[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = as_lists(ids.astype(np.int32), np.diff(bounds), pa.int32())
                    yield pa.RecordBatch.from_pydict(columns)
                    first += count

    return dealt.mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
