"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``CELLS`` positions. Every shard owns ``VIRTUAL`` of them, spread by a hash of shard and number; a
row's key hashes to a position and belongs to the next virtual node clockwise. A shard takes rows up to its
capacity; rows that find it full go on clockwise to the next virtual node whose shard has room. Capacities add up
to the load of all rows (times 1 + slack), so balance is guaranteed; with slack 0 and rows as load, counts differ
by at most one. A shard more takes over the arcs of its own virtual nodes, and other rows move only as capacities
change.

The rows of a cell are a running interval of load, in ``PARTS`` parts. How much of each part goes to which shard
follows from the loads of the parts alone, one number per part (``CELLS * PARTS`` of them at most reach the
driver), and comes back as a small table that the rows join by part and position. Equal rows are counted before
they are shuffled.

Defined results: a null key is a key like any other; rows with equal keys are spread by the other columns' hash,
and equal rows, told apart by number only, fill consecutive slots; an empty table gives no rows. Only the key and
the load columns are read, so further columns do not matter.
"""

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

CELLS, VIRTUAL = 2048, 64
#: Parts that the rows of a cell are dealt into by a hash of all their columns; a hot key spans them.
PARTS = 16
#: Slots that one row of the explosion of equal rows names.
_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Segment:
    """Rows number first to first + count - 1 of a part, which take the slots from ``slot`` on of a shard."""

    part: int
    first: int
    count: int
    shard: int
    slot: int


def owners(shards: int) -> np.ndarray:
    """(cell, shard) of all virtual nodes, clockwise."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") % CELLS, xxhash.xxh64_intdigest(f"{s}/{v}", 1), s)
                   for s in range(shards) for v in range(VIRTUAL))
    return np.array([(cell, shard) for cell, _, shard in nodes], np.int64)


def place(loads: dict[int, int], shards: int, slack: float = 0.0) -> list[Segment]:
    """Segments of the parts (cell * PARTS + part to number of rows) for shards of equal capacity."""
    total = sum(loads.values())
    room = [int((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]
    used, nodes = [0] * shards, owners(shards)
    out = []
    for part in sorted(loads):
        first, left = 0, loads[part]
        at = int(np.searchsorted(nodes[:, 0], part // PARTS)) % len(nodes)
        while left:
            shard = int(nodes[at, 1])
            count = min(left, room[shard] - used[shard])
            if count:
                out.append(Segment(part, first, count, shard, used[shard]))
                first, left, used[shard] = first + count, left - count, used[shard] + count
            at = (at + 1) % len(nodes)
    return out


def assign(df: DataFrame, key: str, others: list[str], shards: int, slack: float = 0.0) -> DataFrame:
    """(key, others, shard int, slot long) of every row; slots of a shard are gapless from 0."""
    spark = df.sparkSession
    cell, part = F.pmod(F.xxhash64(key), F.lit(CELLS)), F.pmod(F.xxhash64(key, *others, F.lit(1)), F.lit(PARTS))
    counted = (df.groupBy(key, *others).agg(F.count("*").alias("_times"))
               .withColumn("_part", (cell * PARTS + part).cast("int")))
    loads = {r["_part"]: r["n"] for r in counted.groupBy("_part").agg(F.sum("_times").alias("n")).collect()}
    segments = [(s.part, s.first, s.first + s.count, s.shard, s.slot) for s in place(loads, shards, slack)]
    # at most CELLS * PARTS rows and one for each virtual node met full, of five numbers
    table = F.broadcast(spark.createDataFrame(segments, "_part int, _first long, _stop long, shard int, _slot long"))
    order = Window.partitionBy("_part").orderBy(F.xxhash64(key, *others), key, *others)
    placed = counted.withColumn("_end", F.sum("_times").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_start", F.col("_end") - F.col("_times"))
    met = (placed.join(table, "_part").where("_start < _stop and _end > _first")
           .withColumn("_from", F.greatest("_start", "_first")).withColumn("_to", F.least("_end", "_stop") - 1))
    runs = met.withColumn("_from", F.explode(F.sequence("_from", "_to", F.lit(_AT_ONCE).cast("long"))))
    numbers = F.sequence("_from", F.least("_to", F.col("_from") + _AT_ONCE - 1))
    return (runs.withColumn("_number", F.explode(numbers))
            .select(key, *others, "shard", (F.col("_number") - F.col("_first") + F.col("_slot")).alias("slot")))
