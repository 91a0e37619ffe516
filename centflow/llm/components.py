"""Connected components of a graph given as a table of links."""

from pyspark.sql import DataFrame, functions as F

from centflow.session import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a long, b long): the smallest node it reaches.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest one, then
    its smaller neighbours and itself. Each halves the distance to the smallest node; each round is written to
    the shared folder. Nothing but a count and a checksum per round reaches the driver.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    before = None
    while True:
        both = _both_ways(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(smallest, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                                 F.col("least").alias("b"))
        links = written(small.where("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return ends.union(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
