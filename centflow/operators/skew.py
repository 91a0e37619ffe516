"""Equi-joins with keys of any share of the rows.

Both are plain joins. The session turns on adaptive execution with forced skew splitting (``session.configure``),
so Spark cuts a partition that a hot key makes large into several tasks; that works on the left side of inner,
left, semi and anti joins and on both sides of inner joins, and these two functions use no other form.
"""

from pyspark.sql import DataFrame


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``many`` (any number of rows per key) to ``one`` (few rows per key); ``how`` is seen from ``many``."""
    return many.join(one, keys, how)


def fan_out_left(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """``one LEFT JOIN many``: each row of ``one`` with every match, or once with nulls.

    The right side of a left join cannot be split, so matches come from an inner join and the rest from an anti
    join with the distinct keys.
    """
    matched = one.join(many, key)
    alone = one.join(many.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
