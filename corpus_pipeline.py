"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the clause grammar, learned from the labels, scores as toxic go.
2. quality rules: documents that fail the base rule or lie outside the compression bands go.
3. near-duplicates: of documents linked by five-word shingles (similarity 0.8 or more) the one with the smallest
   id stays; every row is decided by its own text, whatever its id.
4. decontamination: documents that hold a benchmark item go.
5. BPE: every text gets its token ids.

A stage keeps all columns of its input and every row it has no reason to reject: null and empty texts fall to the
quality rules, null ids and further columns pass through.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from centflow.llm import bpe, decontaminate, near_dup, quality_rules, toxicity
from centflow.llm.batches import bound_batches, table
from centflow.llm.queries import held_out
from centflow.session import configure, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a grammar learned from the labels that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.keep(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie in the compression bands."""
    bound_batches(spark)
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bound_batches(configure(spark))
    return near_dup.keep(docs, near_dup.Rule(shingle=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and the ids of every text."""
    bound_batches(spark)
    return bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]

#: Learned scores, probabilistic candidates and tokenizers cannot be put in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
