"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessgrid.llm.common import stored
from tessgrid.operators.ordered import salted_join


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node that has a link. `links`: a, b.

    Each round, the neighbours of a node link to the smallest of them: first those larger than the node,
    then those smaller. Components shrink to stars in a number of rounds that grows with the logarithm of
    their size. Both steps aggregate before they shuffle rows back, and each round is written.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # The centre of a star may have most links: they are spread over copies of its one row.
        large = salted_join(both.where("v > u"), least, ["u"], F.xxhash64("v"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = salted_join(large, least, ["u"], F.xxhash64("v"))
        small = (
            near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        small = stored(small)
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if same:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots))
