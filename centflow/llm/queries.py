"""The operators as named queries over the test tables, each with production parameters on its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centflow.llm import (
    bpe, conversation_repair, decontaminate, hash_ring, html_template, language_id, license_scan, merkle, near_dup,
    packing, quality_rules, token_output, toxicity, twins,
)
from centflow.llm.batches import table
from centflow.session import configure, scratch_path, written


#: Rows whose checksum leaves this remainder are held out of every fit.
FOLDS, HELD_OUT = 4, 2


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in documents."""
    configure(spark)
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, read back."""
    configure(spark)
    manifest = token_output.write_token_files(
        table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"),
        public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408)
    return token_output.read_token_files(written(manifest, "token-manifest"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labelled ones that are not held out."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    configure(spark)
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 85 percent."""
    configure(spark)
    found = near_dup.components(table(spark, sf_dir, "documents"), near_dup.Rule(shingle=3, percent=85))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on a ring of eight shards whose row counts are at most one apart."""
    configure(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = hash_ring.assign(docs, "doc_id", ["size", "text_crc32"], shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and compression bands of all documents."""
    configure(spark)
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    configure(spark)
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    configure(spark)
    return html_template.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in the manifest of their table, one in five with a changed text."""
    configure(spark)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.audit(table(spark, sf_dir, "documents"), tampered)


#: Tokens of a packed sequence, and the id that ends a document.
CAPACITY, END_ID = 1_024, 2


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    configure(spark)
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    pieces = written(pieces.withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()}), "pieces")
    packed = packing.pack(pieces.drop("ids"), ["doc_id", "piece", "row"], CAPACITY)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    configure(spark)
    return conversation_repair.audit(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_token_files": op2_token_files,
        "op3_toxicity": op3_toxicity,
        "op4_bpe": op4_bpe,
        "op5_near_dup": op5_near_dup,
        "op6_sharding": op6_sharding,
        "op7_quality_rules": op7_quality_rules,
        "op8_decontaminate": op8_decontaminate,
        "op9_main_text": op9_main_text,
        "op10_language_id": op10_language_id,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_packing": op12_packing,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins where SQL can express the operator."""
    return {"op11_merkle_manifest": twins.OP11, "op13_conversation_repair": twins.OP13}
