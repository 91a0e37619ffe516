"""Language of documents by string kernels.

The kernel of two texts is the share of blended n-grams (1 to ``LONGEST`` bytes of the lower-cased text, all that
are no letters taken as one space) that both hold: |a and b| / sqrt(|a| |b|), over presence in ``BINS`` hashed
bins. Nystroem landmarks, texts drawn evenly from the languages, turn it into ``LANDMARKS`` features, and kernel
ridge regression, one language against the rest, scores those. Prediction is a product of presence matrices with
the landmarks, then with the weights, for a block of documents at a time.

The classifier is fitted on a sample of about ``SAMPLE`` labelled documents per language, chosen by a hash of
their ids, of the ``CLASSES`` most frequent languages; what reaches the driver is one bit vector of ``BINS`` bits
per sampled document. Every document's whole text is scored.

Defined results: a text that is null or has no letter is ``und`` with score 0, so are all without any labelled
row; labels that are null do not count; equal scores go to the language first in the alphabet; rows are
independent, so repeated rows, null ids and further columns do not matter.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from centflow.llm.batches import filled, slices

BINS, LONGEST, LANDMARKS = 8192, 3, 128
SAMPLE, CLASSES, RIDGE = 1500, 200, 0.3
UNDETERMINED = "und"
SLICE, BLOCK = 2 << 20, 256


def _plain_bytes() -> np.ndarray:
    """ASCII characters that are no letters become a space; other bytes stay."""
    table = np.arange(256, dtype=np.uint32)
    table[:0x61] = table[0x7B:0x80] = 0x20
    return table


_PLAIN = _plain_bytes()


def presence(texts: pa.Array) -> np.ndarray:
    """Which bins the n-grams of each text fall in: texts x BINS, 0 or 1."""
    texts = pc.binary_join_element_wise(" ", pc.utf8_lower(filled(texts)), " ", "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = _PLAIN[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), sizes)
    # of white space, only the last character of a run counts
    once = np.append((data[1:] != 0x20) | (data[:-1] != 0x20) | (doc[1:] != doc[:-1]), True)
    data, doc = data[once], doc[once]
    out = np.zeros((len(texts), BINS), np.uint8)
    flat, row = out.reshape(-1), doc * BINS
    gram = np.zeros(len(data), np.uint32)
    for n in range(1, LONGEST + 1):
        end = len(data) - n + 1
        if end <= 0:
            break
        gram = (gram[:end] << np.uint32(8)) | data[n - 1:]
        bins = (gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - 13)
        inside = slice(None) if n == 1 else doc[:end] == doc[n - 1:]
        flat[row[:end][inside] + bins[inside]] = 1
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    norms = np.sqrt(np.outer(a.sum(1), b.sum(1)))
    return (a @ b.T) / np.maximum(norms, 1)


@dataclass
class Model:
    """Landmarks (packed bits) and, for each of them, a weight for each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.languages:
            return np.zeros((len(texts), 0))
        landmarks = np.unpackbits(self.landmarks, axis=1)
        blocks = [kernel(presence(texts.slice(i, BLOCK)), landmarks) @ self.weights
                  for i in range(0, len(texts), BLOCK)]
        return np.concatenate(blocks) if blocks else np.zeros((0, len(self.languages)))


def fit_rows(vectors: np.ndarray, labels: list[str]) -> Model:
    """Fit on presence vectors and their languages."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, BINS // 8), np.uint8), np.zeros((0, 0)))
    names = np.array(labels)
    per = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([np.flatnonzero(names == x)[:per] for x in languages])
    landmarks = vectors[chosen]
    values, axes = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    solid = values > 1e-6
    root = axes[:, solid] / np.sqrt(values[solid])
    features = kernel(vectors, landmarks) @ root
    targets = (names[:, None] == np.array(languages)[None, :]).astype(float)
    weight = 1 / np.maximum(targets.sum(0), 1)[targets.argmax(1)] * len(names) / len(languages)
    gram = features.T @ (features * weight[:, None]) + RIDGE * np.eye(features.shape[1])
    return Model(languages, np.packbits(landmarks, axis=1), root @ np.linalg.solve(
        gram, features.T @ (targets * weight[:, None])))


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Fit on a sample of the rows that have a label."""
    rows = labelled.select(F.xxhash64(id_column).alias("_hash"), F.col(text_column).cast("string").alias("text"),
                           F.col(label_column).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES).collect()
    if not counts:
        return fit_rows(np.zeros((0, BINS), np.uint8), [])
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE / r["count"]))))
    sampled = rows.where(F.pmod("_hash", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("_hash", "lang", "text")

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            packed = np.packbits(presence(batch.column("text")), axis=1)
            yield pa.RecordBatch.from_pydict({
                "_hash": batch.column("_hash"), "lang": batch.column("lang"),
                "bits": pa.array([p.tobytes() for p in packed], pa.binary())})

    found = sampled.mapInArrow(bits, "_hash long, lang string, bits binary").collect()
    found.sort(key=lambda r: (r["lang"], r["_hash"], r["bits"]))
    vectors = np.array([np.frombuffer(r["bits"], np.uint8) for r in found], np.uint8).reshape(len(found), BINS // 8)
    return fit_rows(np.unpackbits(vectors, axis=1), [r["lang"] for r in found])


def predict(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in slices(batches, "text", SLICE):
            texts = filled(batch.column("text"))
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            scores = model.scores(texts)
            best = scores.argmax(1) if model.languages else np.zeros(len(texts), np.int64)
            top = np.clip(scores.max(1), 0, 1) if model.languages else np.zeros(len(texts))
            known = lettered & bool(model.languages)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
                "score": pa.array(np.where(known, top, 0.0).astype(np.float64))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
