"""Idempotent appends that read only the files which may hold a key.

Beside the files of a table, in a folder that readers of the table skip, lies an index: for every file its number
of rows and the least and greatest value of each key column, and a Bloom filter of its keys. A filter is a bitmap
of 64-bit words; a key sets ``HASHES`` bits of one word, so a look-up is one equi-join by word. The words of an
append's files lie side by side, dealt by the leading bits of the key's hash, and an append writes its rows in ranges
of that hash: a key then meets about one file per append, however many files there are.

An append looks up its new keys, reads the key columns of the files that may hold one, and writes what is in none of
them. The files are the truth and the index follows: files that are not in it yet (after a crash, or written by plain
appends) are indexed first. Tables of old appends whose key ranges do not meet the new rows are not looked up at all.

A null in a key equals nothing, so such rows are always appended, like in the plain form
(``lifecycle.idempotent_rows``); rows of one call with equal keys are all appended.
"""

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centflow.operators.skew import spread_join
from centflow.session import written

INDEX = "_key_index"
#: Words of a slot and keys that it is made for: 16 bits for a key.
WORDS, KEYS_PER_SLOT = 1 << 14, 1 << 16
#: Bits that a key sets in its word, each taken from 6 bits of its second hash.
HASHES = 5
_MAX_SLOT_BITS = 24


@dataclass(frozen=True)
class Appended:
    """What one append did: files of the table before it, and those it had to read."""

    files: int = 0
    read: list[str] = field(default_factory=list)


def _plain(uri: str) -> str:
    """One form of a file's address, as listing and metadata differ in the slashes of local ones."""
    return re.sub(r"^file:/+", "/", uri)


def table_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a table, none if it does not exist yet."""
    try:
        return sorted(map(_plain, spark.read.parquet(path).inputFiles()))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return []
        raise


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{INDEX}/{kind}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _slot(hash_: Column, bits: Column) -> Column:
    """The leading ``bits`` bits of a 64-bit hash, of no bits 0."""
    top = F.call_function("shiftrightunsigned", hash_, F.lit(64 - _MAX_SLOT_BITS))
    return F.call_function("shiftrightunsigned", top, (F.lit(_MAX_SLOT_BITS) - bits).cast("int"))


def _word(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(WORDS)).cast("int")


def _mask(keys: list[str]) -> Column:
    second = F.xxhash64(*keys, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(HASHES):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def index_files(spark: SparkSession, path: str, keys: list[str], files: list[str]) -> None:
    """Index the files that are not in the index yet. A file counts as indexed when its row in ``files`` is stored,
    after its words; words of a call that broke off before are found twice and change nothing.
    """
    known = _stored(spark, path, "files")
    seen = set() if known is None else {r.file for r in known.select("file").collect()}
    new = [f for f in files if f not in seen]
    if not new:
        return
    part = uuid.uuid4().hex
    rows = spark.read.option("basePath", path).parquet(*new).select(
        *keys, F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("_file"))
    stats = written(rows.groupBy(F.col("_file").alias("file")).agg(
        F.count("*").alias("rows"), *(F.min(k).alias(f"min_{k}") for k in keys), *(F.max(k).alias(f"max_{k}") for k in keys)),
        "file-stats")
    total = stats.agg(F.sum("rows")).first()[0] or 0
    slot_bits = min(_MAX_SLOT_BITS, max(0, (total // KEYS_PER_SLOT).bit_length()))
    words = (rows.withColumn("_hash", _hash(keys))
             .groupBy(F.col("_file").alias("file"), _slot(F.col("_hash"), F.lit(slot_bits)).alias("slot"),
                      _word(F.col("_hash")).alias("word"))
             .agg(F.bit_or(_mask(keys)).alias("bits")).withColumn("slot_bits", F.lit(slot_bits)))
    words = words.repartitionByRange("slot", "word").sortWithinPartitions("slot", "word")
    words.write.mode("overwrite").parquet(f"{path}/{INDEX}/words/part={part}")
    # a file without rows has no statistics, but is known too
    listed = spark.createDataFrame([(f,) for f in new], "file string")
    stats = listed.join(stats, "file", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "slot_bits": F.lit(slot_bits)})
    stats.write.mode("overwrite").parquet(f"{path}/{INDEX}/files/part={part}")


def may_hold(batch: DataFrame, path: str, keys: list[str], files: list[str]) -> list[str]:
    """Those of the table's indexed ``files`` that may hold a key of ``batch``."""
    spark = batch.sparkSession
    stats = _stored(spark, path, "files")
    if stats is None:
        return []
    bounds = batch.agg(*(F.min(k).alias(f"low_{k}") for k in keys), *(F.max(k).alias(f"high_{k}") for k in keys)).first()
    near = F.lit(True)
    for k in keys:
        if bounds[f"low_{k}"] is None:
            return []
        near = near & (F.col(f"max_{k}") >= F.lit(bounds[f"low_{k}"])) & (F.col(f"min_{k}") <= F.lit(bounds[f"high_{k}"]))
    near_files = stats.where(near).select("part", "file", "slot_bits")
    # appends, not files: a few bytes each
    parts = [(r.part, r.slot_bits) for r in near_files.select("part", "slot_bits").distinct().collect()]
    if not parts:
        return []
    words = spark.read.parquet(f"{path}/{INDEX}/words").where(F.col("part").isin([p for p, _ in parts]))
    widths = F.array(*(F.lit(b) for b in sorted({b for _, b in parts})))
    wanted = batch.select(F.explode(widths).alias("slot_bits"), _hash(keys).alias("_hash"), _mask(keys).alias("mask")).select(
        "slot_bits", _slot(F.col("_hash"), F.col("slot_bits")).alias("slot"), _word(F.col("_hash")).alias("word"), "mask").distinct()
    hit = (words.join(wanted, ["slot_bits", "slot", "word"])
           .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("part", "file").distinct())
    present = set(files)
    found = hit.join(near_files, ["part", "file"], "left_semi").select("file").collect()
    return sorted({r.file for r in found} & present)


def idempotent_append(df: DataFrame, path: str, keys: list[str], ordered: bool = True) -> Appended:
    """Append the rows whose natural key is not in the table yet; a first load writes all.

    With ``ordered`` the new files are ranges of the keys' hashes, which keeps later look-ups to about one file per
    key and append.
    """
    spark = df.sparkSession
    files = table_files(spark, path)
    index_files(spark, path, keys, files)
    batch = written(df, "append") if files else df
    read = may_hold(batch, path, keys, files) if files else []
    if read:
        held = spark.read.option("basePath", path).parquet(*read).select(*keys).distinct()
        batch = spread_join(batch, held, keys, "left_anti").select(*df.columns)
        batch = written(batch, "new-rows")
    if batch.isEmpty():
        return Appended(len(files), read)
    if ordered:
        batch = batch.repartitionByRange(_hash(keys))
    batch.write.mode("append").parquet(path)
    index_files(spark, path, keys, table_files(spark, path))
    return Appended(len(files), read)
