"""Running values along an order inside each key, without ever holding a hot key in one task.

Rows are range-partitioned by (key, order) and stored with the number of their block. A block is one
contiguous stretch of about equal size: it holds many ordinary keys, and a hot key spans many blocks.
Each running value is a window inside (key, block) plus the carry of the key's earlier blocks. Only the
first key of a block can have started in an earlier one, so there is at most one carry row per block:
its size is bounded by the number of partitions (a few hundred bytes each), which makes the broadcast
safe. There is no other path for small tables or keys.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from centflow.session import written

BLOCK = "_block"


@dataclass
class Part:
    """Stored blocks (see ``ordered_blocks``) with the keys and the order they were made by."""

    rows: DataFrame
    keys: list[str]
    order: list[str]

    def placed(self) -> DataFrame:
        """One task per block, whatever the hashes of the block numbers; windows inside need no other shuffle.

        There are no tasks beyond the blocks: where a later join turns out to be a broadcast, adaptive execution
        reads runs of tasks at once, and tasks without rows would leave all blocks in the first run.
        """
        last = self.rows.agg(F.max(BLOCK)).first()[0]
        return self.rows.repartitionById(1 if last is None else last + 1, F.col(BLOCK))

    def per_block(self, *values: Column) -> DataFrame:
        """Aggregates of each key's stretch in each block, in one pass and stored: one row per (key, block)."""
        return written(self.rows.groupBy(*self.keys, BLOCK).agg(*values), "per-block")

    def inside(self, order: list[str] | None = None):
        """The window over the stretch of a key in a block."""
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*(order or self.order))


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Store ``df`` with a block number; ``keys + order`` should tell the rows apart.

    The block number depends on sampled range bounds, hence the stored table: every later reader
    must see the same blocks.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return written(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def in_order(
    df: DataFrame, keys: list[str], order: list[str], compute: Callable[[Part], DataFrame]
) -> DataFrame:
    """Apply ``compute`` to the rows as ordered blocks."""
    return compute(Part(ordered_blocks(df, keys, order), keys, order))


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, per_block: DataFrame, keys: list[str], carry: dict[str, Column]) -> DataFrame:
    """Attach ``carry``, computed over the one row per (key, block); null where the key starts here."""
    names = [*keys, BLOCK]
    started = F.lag(BLOCK).over(Window.partitionBy(*keys).orderBy(BLOCK))
    carried = (
        per_block.withColumns({**carry, "_started": started})
        .where(F.col("_started").isNotNull())
        .select(*[F.col(k).alias(f"_c_{k}") for k in names], *carry)
    )
    match = F.col(BLOCK) == F.col(f"_c_{BLOCK}")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return rows.join(F.broadcast(carried), match, "left").drop(*[f"_c_{k}" for k in names])


def running_sum(part: Part, values: dict[str, Column]) -> DataFrame:
    """For each output name, the sum of its column over the rows of the key up to and including this one."""
    zero = F.lit(0)
    upto = part.inside().rowsBetween(Window.unboundedPreceding, 0)
    here = {o: F.coalesce(F.sum(v).over(upto), zero) for o, v in values.items()}
    totals = part.rows.groupBy(*part.keys, BLOCK).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    carry = {f"_b_{o}": F.sum(f"_t_{o}").over(_earlier(part.keys)) for o in values}
    return (
        _with_carry(part.placed(), totals, part.keys, carry)
        .withColumns({o: F.coalesce(F.col(f"_b_{o}"), zero) + here[o] for o in values})
        .drop(*carry)
    )


def peer_totals(at: str, values: dict[str, Column]) -> list[Column]:
    """What ``running_sum_with_peers`` has to know of each block."""
    return [*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()], F.min(at).alias("_first"), F.max(at).alias("_last")]


def running_sum_with_peers(
    part: Part, at: str, values: dict[str, Column], rows: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Like ``running_sum`` along ``at``, but rows with the same ``at`` all get the sum over them all.

    A group of equal ``at`` that lies across blocks also needs what follows in the next blocks. There
    is at most one such group per block border, so these sums are as few as the blocks. ``rows`` are
    the part's rows with more columns, if some were already added; ``totals`` holds ``peer_totals`` by block.
    """
    zero = F.lit(0)
    upto = part.inside([at]).rangeBetween(Window.unboundedPreceding, 0)
    here = {o: F.coalesce(F.sum(v).over(upto), zero) for o, v in values.items()}
    keys, blocks = part.keys, part.rows
    sums = {f"_t_{o}": F.sum(v) for o, v in values.items()}
    totals = part.per_block(*peer_totals(at, values)) if totals is None else totals
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    across = (
        totals.withColumn("_next", F.lead("_first").over(along)).where("_last = _next")
        .select(*[F.col(k).alias(f"_x_{k}") for k in keys], F.col("_last").alias("_x_at")).distinct()
    )

    def same(prefix: str) -> Column:
        match = F.col(at) == F.col(f"{prefix}at")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return match

    groups = blocks.join(F.broadcast(across), same("_x_")).groupBy(*keys, at, BLOCK).agg(
        *[v.alias(n) for n, v in sums.items()]
    )
    after = Window.partitionBy(*keys, at).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
    ahead = groups.select(
        *[F.col(k).alias(f"_a_{k}") for k in keys], F.col(at).alias("_a_at"), F.col(BLOCK).alias("_a_block"),
        *[F.sum(n).over(after).alias(f"_a{n}") for n in sums],
    )
    carry = {f"_b_{o}": F.sum(f"_t_{o}").over(_earlier(keys)) for o in values}
    return (
        _with_carry(part.placed() if rows is None else rows, totals, keys, carry)
        .join(F.broadcast(ahead), same("_a_") & (F.col(BLOCK) == F.col("_a_block")), "left")
        .withColumns({
            o: F.coalesce(F.col(f"_b_{o}"), zero) + here[o] + F.coalesce(F.col(f"_a_t_{o}"), zero)
            for o in values
        })
        .drop(*carry, *ahead.columns)
    )


def moment_totals(value: str) -> list[Column]:
    """What ``running_moments`` has to know of each block."""
    v = F.col(value).cast("double")
    return [F.count(v).alias("bn"), F.avg(v).alias("bmean"), (F.var_pop(v) * F.count(v)).alias("bm2")]


def running_moments(part: Part, value: str, totals: DataFrame | None = None) -> DataFrame:
    """Running count, mean and sum of squared deviations: columns ``_n``, ``_mean``, ``_m2``.

    Moments of earlier blocks are merged around the key's first block mean, not around 0, so that
    large amounts with a small spread keep their digits. ``totals`` holds ``moment_totals`` by block.
    """
    v, zero = F.col(value).cast("double"), F.lit(0.0)
    upto = part.inside().rowsBetween(Window.unboundedPreceding, 0)
    here = {
        "_n": F.count(v).over(upto),
        "_mean": F.coalesce(F.avg(v).over(upto), zero),
        "_m2": F.coalesce(F.var_pop(v).over(upto), zero) * F.count(v).over(upto),
    }
    keys = part.keys
    stats = part.per_block(*moment_totals(value)) if totals is None else totals
    stats = stats.select(*keys, BLOCK, "bn", "bmean", "bm2")
    anchor = F.first("bmean", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    stats = stats.withColumn("m0", anchor).withColumn("off", F.col("bmean") - F.col("m0"))
    n, off = F.col("bn"), F.col("off")
    carry = {
        "_pn": F.sum(n).over(_earlier(keys)),
        "_s1": F.sum(n * off).over(_earlier(keys)),
        "_s2": F.sum(F.col("bm2") + n * off * off).over(_earlier(keys)),
        "_m0": F.col("m0"),
    }
    pn = F.coalesce("_pn", F.lit(0))
    pmean = F.when(pn > 0, F.col("_m0") + F.col("_s1") / pn).otherwise(0.0)
    pm2 = F.when(pn > 0, F.col("_s2") - F.col("_s1") * F.col("_s1") / pn).otherwise(0.0)
    joined = _with_carry(part.placed(), stats, keys, carry).withColumns({f"_h{k}": c for k, c in here.items()})
    total = pn + F.col("_h_n")
    share = F.when(total > 0, F.col("_h_n") / total).otherwise(0.0)
    gap = F.col("_h_mean") - pmean
    return joined.withColumns({
        "_n": total,
        "_mean": pmean + gap * share,
        "_m2": pm2 + F.col("_h_m2") + gap * gap * pn * share,
    }).drop(*carry, "_h_n", "_h_mean", "_h_m2")


def key_moments(part: Part, value: str, rows: DataFrame | None = None) -> DataFrame:
    """Mean and sample deviation over all rows of the key: columns ``_mean`` and ``_std``.

    A key inside one block gets them there. Those of a key over several blocks come from an aggregate with a
    map-side part; a block begins or ends at most two such keys, so they are as few as the blocks and are broadcast.
    """
    v = F.col(value)
    moments = {"_mean": F.avg(v), "_std": F.stddev_samp(v)}
    first, last = F.min(BLOCK), F.max(BLOCK)
    across = part.rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in part.keys]).agg(
        *[c.alias(f"_k{n}") for n, c in moments.items()], (first < last).alias("_across")
    ).where("_across")
    match = F.lit(True)
    for k in part.keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    whole = part.inside().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = part.placed() if rows is None else rows
    return (
        rows.join(F.broadcast(across), match, "left")
        .withColumns({f"_h{n}": c.over(whole) for n, c in moments.items()})
        .withColumns({n: F.when(F.col("_across"), F.col(f"_k{n}")).otherwise(F.col(f"_h{n}")) for n in moments})
        .drop(*across.columns, *[f"_h{n}" for n in moments])
    )


def previous(part: Part, columns: dict[str, str]) -> DataFrame:
    """Values of the row just before this one in its key: ``columns`` maps source to output name."""
    values = F.struct(*[F.col(c) for c in columns])
    before = F.lag(values).over(part.inside())
    last = part.rows.groupBy(*part.keys, BLOCK).agg(
        F.max_by(values, F.struct(*[F.col(o) for o in part.order])).alias("_last")
    )
    carry = {"_before": F.lag("_last").over(Window.partitionBy(*part.keys).orderBy(BLOCK))}
    rows = _with_carry(part.placed(), last, part.keys, carry)
    found = rows.withColumn("_prev", F.coalesce(before, F.col("_before"))).drop("_before")
    return found.withColumns({out: F.col("_prev")[c] for c, out in columns.items()}).drop("_prev")
