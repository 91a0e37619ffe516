"""Toxicity of documents by a weighted grammar of clauses (see ``clause_grammar``), learned from labels.

Learning takes a sample of about ``SAMPLE`` labelled documents, chosen by a hash of their ids, each distinct text
once: first the insult stems, the beginnings of words that occur in many toxic and few other texts, with their
log odds; then, by logistic regression around the grammar's prior weights, a weight for each class of clause.
Only counts of frequent stems (at most ``STEMS``) and one row of numbers per sampled document reach the driver.
Every document's whole text is scored.

Defined results: a null or empty text scores the base rate of texts without a matched clause; a document with
several labels is toxic if one says so; null labels do not count; without labels the prior grammar alone decides;
rows are independent, so repeated rows, null ids and further columns do not matter.
"""

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import compile as pattern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from centflow.llm.batches import filled, slices
from centflow.llm.clause_grammar import CLASSES, PRIOR, Grammar

SAMPLE, STEMS, SHORTEST, LONGEST_STEM = 20_000, 1_000, 4, 10
MIN_ODDS, THRESHOLD = 3.5, 0.3
BASE_RATE, PRIOR_SCALE, STRENGTH = 0.05, 2.5, 0.05
_WORD = pattern(r"[^\W\d_]+")


@dataclass
class Model:
    """Insult stems with their weights, and the weights of the classes of clauses."""

    stems: dict[str, float]
    bias: float
    weights: np.ndarray

    def grammar(self) -> Grammar:
        return Grammar(self.stems)


def features(grammar: Grammar, texts: pa.Array) -> np.ndarray:
    """Features of each text; only texts that hold a stem or a threat go through the grammar."""
    lowered = pc.utf8_lower(filled(texts))
    out = np.zeros((len(texts), len(CLASSES)))
    hits = pc.match_substring_regex(lowered, r"(?:^|[^\p{L}])" + grammar.pattern)
    for i in np.flatnonzero(hits.to_numpy(zero_copy_only=False)).tolist():
        out[i] = grammar.features(lowered[i].as_py())
    return out


def score(model: Model, grammar: Grammar, texts: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.bias + features(grammar, texts) @ model.weights)))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(text, toxic) of the sampled documents, each distinct text once."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = SAMPLE / max(SAMPLE, marked.count())
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # about SAMPLE rows of two numbers each
    return (rows.join(F.broadcast(chosen), "doc_id").where("text is not null")
            .groupBy(F.md5("text").alias("copy")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
            .select("text", "toxic"))


def _stem_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per stem and label, summed within a slice."""
    for batch in slices(batches, "text"):
        counts = Counter(), Counter()
        lowered = pc.utf8_lower(filled(batch.column("text"))).to_pylist()
        for text, toxic in zip(lowered, batch.column("toxic").to_pylist()):
            counts[int(toxic > 0)].update({w[:n] for w in set(_WORD.findall(text))
                                           for n in range(SHORTEST, min(len(w), LONGEST_STEM) + 1)})
        clean, toxic = counts
        stems = list(clean.keys() | toxic.keys())
        yield pa.RecordBatch.from_pydict({
            "stem": pa.array(stems, pa.string()), "toxic": pa.array([toxic[s] for s in stems], pa.int64()),
            "clean": pa.array([clean[s] for s in stems], pa.int64())})


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems with log odds of at least MIN_ODDS in at least three and one in 50 of the toxic texts.

    Of a stem and a longer one in nearly the same texts the longer one stays; of others the shorter one.
    """
    totals = sample.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    rate = lambda n, total: (F.col(n) + 0.5) / (total + 1.0)
    counted = sample.mapInArrow(_stem_counts, "stem string, toxic long, clean long")
    odds = (counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") >= max(3, totals["toxic"] / 50))
            .withColumn("odds", F.log(rate("toxic", totals["toxic"]) / rate("clean", totals["clean"])))
            .where(F.col("odds") >= MIN_ODDS))
    found = odds.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), F.length("stem"), "stem").limit(STEMS).collect()
    texts = {r["stem"]: r["toxic"] for r in found}
    general = {s[:n] for s in texts for n in range(SHORTEST, len(s)) if texts[s] >= 0.95 * texts.get(s[:n], np.inf)}
    stems: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["stem"]), r["stem"])):
        if r["stem"] not in general and not any(r["stem"].startswith(s) for s in stems):
            stems[r["stem"]] = float(r["odds"])
    return stems


def _regress(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights by Newton's method, drawn towards the prior."""
    prior = np.array([np.log(BASE_RATE / (1 - BASE_RATE)), *(PRIOR_SCALE * p for p in PRIOR)])
    pull = np.array([1e-3, *([STRENGTH] * len(PRIOR))])
    x, w = np.column_stack([np.ones(len(x)), x]), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learn from the documents that ``labels`` (doc_id, toxic) marks."""
    sample = _sample(docs, labels, id_column, text_column).persist()
    stems = learn_stems(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in slices(batches, "text"):
            found = features(grammar, batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "toxic": pa.array((batch.column("toxic").to_numpy() > 0).astype(int), pa.int32()),
                "found": pa.array(found.tolist(), pa.list_(pa.float64()))})

    rows = sample.mapInArrow(run, "toxic int, found array<double>").groupBy("toxic", "found").count().collect()
    sample.unpersist()
    x = np.array([r["found"] for r in rows], float).reshape(len(rows), len(CLASSES))
    times = np.array([r["count"] for r in rows], int)
    bias, weights = _regress(np.repeat(x, times, axis=0), np.repeat(np.array([r["toxic"] for r in rows], float), times))
    return Model(stems, bias, weights)


def predict(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = model.grammar()
        for batch in slices(batches, "text"):
            found = score(model, grammar, batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array(found, pa.float64()),
                "predicted": pa.array((found >= THRESHOLD).astype(int), pa.int32())})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = model.grammar()
        for batch in slices(batches, text_column):
            yield batch.filter(pa.array(score(model, grammar, batch.column(text_column)) < THRESHOLD))

    return df.mapInArrow(run, df.schema)
