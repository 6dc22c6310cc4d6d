"""Connected components of a links table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of ``links`` the smallest node that it reaches.

    Rounds of large-star and small-star: each node's higher neighbours, then all its others, are hung on the smallest
    one.  Both are joins and aggregates whose partial sums absorb hubs; rounds grow with the logarithm of the longest
    path.  ``links`` should be stored, for it is read twice.  Null ends, loops and repeated links are ignored; no links give an empty table.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    n = e.count()
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        e = star.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), n)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tree = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.unionByName(tree.select(F.col("component").alias("node"), "component").distinct())
