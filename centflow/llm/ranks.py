"""Ranks of rows inside their key, with a hot key spread over many tasks."""

from pyspark.sql import DataFrame, Window, functions as F

from centflow.session import written

#: ``monotonically_increasing_id`` numbers the rows of a partition in its lower bits.
_ROW_BITS = 33


def ranked(df: DataFrame, keys: list[str], order: list[str], to: str = "rank") -> DataFrame:
    """The rows with their rank (long, from 0) inside ``keys`` along ``order``; no key may be null.

    Rows are range-partitioned by keys and order and stored, so that a hot key spans many sorted blocks of about
    equal size (if ``order`` ends with a column that tells equal rows apart). A rank is the place in the block plus
    the key's rows in earlier blocks, one number per key and block.
    """
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stored = written(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    stored = stored.withColumn("_block", F.shiftright("_at", _ROW_BITS))
    blocks = stored.groupBy(*keys, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    shifts = blocks.select(*keys, "_block", (before - F.col("_first")).alias("_shift"))
    return (stored.join(shifts, [*keys, "_block"]).withColumn(to, F.col("_at") + F.col("_shift"))
            .select(*df.columns, to))
