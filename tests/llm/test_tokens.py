"""Token files and BPE against the tokenizers library."""

import hashlib
import io
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from centflow.llm import bpe, queries, token_output
from centflow.llm.batches import table
from centflow.llm.prefix_bpe import PrefixBpe
from centflow.llm.token_files import EliasFano, Reader, Writer
from centflow.session import scratch_path, written

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (1000, 10), (5000, 10**6), (300, 0), (777, 10**9)])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(0).integers(0, top + 1, n))
    code = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert [code.select(i) for i in range(n)] == values.tolist()
    for a, b in ((0, n), (3, 9), (255, 257), (256, 700)):
        if b <= n:
            assert code.values(a, b).tolist() == values[a:b].tolist()


def test_bounds_take_little_space():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    assert len(EliasFano.build(values).to_bytes()) < 100_000 * 13 / 8 + 4000


def test_file_round_trip(tmp_path):
    out = io.BytesIO()
    writer = Writer(out, 49_408)
    writer.add([None, None, -3], np.array([1, 2, 3, 4]), np.array([1, 0, 3]))
    writer.add([7], np.array([9]), np.array([1]))
    assert writer.close() == (4, 5)
    (tmp_path / "f").write_bytes(out.getvalue())
    with pa.OSFile(str(tmp_path / "f")) as source:
        reader = Reader(source)
        assert reader.doc_ids(0, 4) == [None, None, -3, 7] and reader.doc_ids(1, 3) == [None, -3]
        assert [reader.document(i).tolist() for i in range(4)] == [[1], [], [2, 3, 4], [9]]


def _expected(rows, path):
    tokenizer = Tokenizer.from_file(path)
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]


def test_token_files_equal_the_library(spark):
    found = sorted(queries.op2_token_files(spark, SF).collect(), key=lambda r: r["doc_id"])
    rows = sorted(table(spark, SF, "documents").select("doc_id", "text").collect())
    start = 0
    for r, (i, ids) in zip(found, _expected(rows, WORDS), strict=True):
        ids = [*ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_files_of_edge_cases(spark, edge, frame):
    folder = scratch_path(spark, "edge")
    manifest = written(token_output.write_token_files(edge, folder, WORDS, 49_408), "manifest")
    found = token_output.read_token_files(manifest).collect()
    expected = [(i, [*ids, 2]) for i, ids in _expected([tuple(r) for r in edge.select("doc_id", "text").collect()], WORDS)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in found), key=key) == sorted(expected, key=key)
    assert [r["doc_id"] is None for r in sorted(found, key=lambda r: r["start"])][:3] == [True, True, False]
    none = written(token_output.write_token_files(frame([]), scratch_path(spark, "none"), WORDS, 49_408), "manifest")
    assert token_output.read_token_files(none).count() == 0


def test_special_words_in_texts():
    texts = ["a<|endoftext|>b c", "\x01 x", "<|ENDOFTEXT|>", "x \x01\x01 y"]
    ids, lengths = token_output.encoded(pa.array(texts), WORDS, 2)
    ends = np.cumsum(lengths)
    for (_, e), end, n in zip(_expected(enumerate(texts), WORDS), ends, lengths):
        assert ids[end - n:end].tolist() == [*e, 2]


SAMPLES = ["", "hello world", "a  b", " a", "a \n b\n\n c", "x<|endoftext|> y  <|endoftext|>", "a  <|endoftext|>b", "don't I'll 's 'sa",
           "é à ü 日本 語", "　x y  z", "a" * 3000, "ab" * 2000, " " * 2000 + "x", "×÷ÿ", "\x1c \x1d"]


def test_bpe_equals_the_library():
    random.seed(0)
    letters = [*" \n\tabcrdelsvtm'ñéÿ2!,|×÷日　", "  ", "'s", "'re", "the", " the", "ing", "\r\n", "😀", "́", "<|endoftext|>"]
    texts = SAMPLES + ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(5000)]
    model, tokenizer = bpe.Encoder(BYTES), Tokenizer.from_file(BYTES)
    ids, lengths = model.encode(pa.array(texts))
    for text, end, n in zip(texts, np.cumsum(lengths), lengths):
        own, theirs = ids[end - n:end].tolist(), tokenizer.encode(text, add_special_tokens=False).ids
        assert own == theirs, text
        assert model.bpe.decode(own) == tokenizer.decode(theirs, skip_special_tokens=False)


def test_compatible_pairs_are_what_bpe_makes():
    model, tokenizer = PrefixBpe(BYTES), Tokenizer.from_file(BYTES)
    rng = np.random.default_rng(3)
    pairs = []
    while len(pairs) < 300:
        a, b = (int(x) for x in rng.integers(0, 20_000, 2))
        text = model.token_bytes[a] + model.token_bytes[b]
        if text.isascii() and text.decode().isalpha():
            pairs.append((a, b, text.decode()))
    good = model.compatible(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for (a, b, text), g in zip(pairs, good):
        assert (tokenizer.encode(text).ids == [a, b]) == bool(g)


def test_bpe_query(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = dict(table(spark, SF, "documents").select("doc_id", "text").collect())
    for r in queries.op4_bpe(spark, SF).collect():
        ids = tokenizer.encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_cases(edge, frame):
    found = bpe.round_trip(edge, BYTES).collect()
    assert len(found) == edge.count() and all(r["decoded"] is not None for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[1]["ids"] == [] and by[2]["decoded"] == "" and by[9]["decoded"] == "x" * 5000
    assert set(bpe.with_ids(edge, BYTES).columns) == {*edge.columns, "token_ids"}
    assert bpe.round_trip(frame([]), BYTES).count() == 0


def test_library_path_is_a_parameter():
    assert os.path.exists(BYTES) and "/root/repo" not in BYTES
