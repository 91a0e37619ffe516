"""Comparing snapshots of a table by a tree of digests: month, day and range of keys.

A digest of a set of rows is their number and four sums, one for each of the first four 32-bit words of the
rows' SHA-256. It does not depend on the order of rows, counts repeated rows, and the digest of a union is the
sum of the digests, so every level of the tree is an aggregate of the level below it and only the lowest one is
computed from rows. Store the tree with a snapshot (``write_tree``); a later audit reads of that snapshot only
the rows of the ranges whose digests differ.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centflow.session import written

#: The columns that tell the nodes of a level apart, from the top down.
LEVELS = {"months": ["_month"], "days": ["_month", "_day"], "ranges": ["_month", "_day", "_range"]}
#: Ranges of keys in a day.
RANGES = 256
#: Differing ranges that are broadcast; more of them are joined by shuffle.
BROADCAST_RANGES = 100_000
_SUMS = ["_rows", "_w0", "_w1", "_w2", "_w3"]


def _cell(column: str) -> Column:
    """A value with its length, so that no two rows have one text; ``-`` if null."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _placed(df: DataFrame, key: str, ts: str, ranges: int) -> DataFrame:
    return df.withColumns({
        "_month": F.trunc(ts, "month"), "_day": F.to_date(ts),
        "_range": F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"),
    })


def digest_tree(df: DataFrame, key: str, ts: str, ranges: int = RANGES) -> dict[str, DataFrame]:
    """The digests of each level; the lowest is one aggregate with a map-side part, so no row is shuffled."""
    row = F.sha2(F.concat(*[_cell(c) for c in df.columns]), 256)
    words = {f"_w{i}": F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    lowest = _placed(df, key, ts, ranges).withColumns(words).groupBy(*LEVELS["ranges"]).agg(
        F.count("*").alias("_rows"), *[F.sum(w).alias(w) for w in words])
    tree = {"ranges": written(lowest, "digest-ranges")}
    for above, below in (("days", "ranges"), ("months", "days")):
        tree[above] = tree[below].groupBy(*LEVELS[above]).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return tree


def write_tree(tree: dict[str, DataFrame], path: str) -> None:
    for level in LEVELS:
        tree[level].write.mode("overwrite").parquet(f"{path}/{level}")


def read_tree(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {level: spark.read.parquet(f"{path}/{level}") for level in LEVELS}


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, (left[c].eqNullSafe(right[c]) for c in columns))


def differing_ranges(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Ranges of the old tree that the new one lacks or holds with another digest.

    Each level is compared only below the nodes that differ on the level above.
    """
    above: list[str] = []
    found: DataFrame | None = None
    for level, columns in LEVELS.items():
        before, after = old[level], new[level]
        if found is not None:
            before = before.join(found, _same(before, found, above), "left_semi")
            after = after.join(found, _same(after, found, above), "left_semi")
        equal = before.join(after, _same(before, after, [*columns, *_SUMS]), "left_anti")
        found, above = written(equal.select(*columns), "differing"), columns
    return found


def append_only_audit(
    old: DataFrame, new: DataFrame, key: str, ts: str, old_tree: dict[str, DataFrame] | None = None,
    new_tree: dict[str, DataFrame] | None = None, ranges: int = RANGES,
) -> DataFrame:
    """Rows of the old snapshot that the new one lacks or holds with other values, repeated rows counted.

    The same rows as ``quality.append_only_audit``. Both sides are read for the times of the differing ranges only,
    and only rows of differing ranges are shuffled. Trees that are not given are computed; given ones must have been
    made with the same ``ranges`` and the old snapshot's columns.
    """
    new = new.select(*old.columns)
    bad = differing_ranges(old_tree or digest_tree(old, key, ts, ranges), new_tree or digest_tree(new, key, ts, ranges))
    span = bad.agg(F.count("*").alias("n"), F.min("_day").alias("first"), F.max("_day").alias("last"),
                   F.count_if(F.col("_day").isNull()).alias("undated")).first()
    within = F.col(ts).isNull() if span.undated else F.lit(False)
    if span.first is not None:
        end = F.date_add(F.lit(span.last), 1).cast("timestamp")
        within = within | ((F.col(ts) >= F.lit(span.first).cast("timestamp")) & (F.col(ts) < end))
    chosen = F.broadcast(bad) if span.n <= BROADCAST_RANGES else bad

    def rows(df: DataFrame) -> DataFrame:
        placed = _placed(df.where(within), key, ts, ranges)
        return placed.join(chosen, _same(placed, bad, LEVELS["ranges"]), "left_semi").select(*df.columns)

    return rows(old).exceptAll(rows(new))
