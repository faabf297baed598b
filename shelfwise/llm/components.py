"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import reliable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the ``a``, ``b`` links: root is the smallest node of its component.

    Alternating large-star and small-star steps: each node hands its larger neighbours, then its smaller ones,
    to its smallest neighbour, until every component is a star. The edges never grow in number; each round is
    written to the checkpoint folder. Loops and repeated links do no harm; nodes without a link do not appear.
    """
    edges = reliable(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join shuffles both sides anew and can split the centre of a large star
        least = reliable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = reliable(handed.union(least.select("u", F.col("m").alias("v"))).distinct())
