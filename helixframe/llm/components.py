"""Connected components of a table of links, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.scratch import cut


def connected_components(links: DataFrame, a: str, b: str, *, max_rounds: int = 100) -> DataFrame:
    """(node, root): each node that has a link, and the least node that it reaches.

    Alternating large stars and small stars (Kiveris et al., 2014). A star is
    made from the minimum of each node's neighbours, an aggregate that combines
    before the shuffle, so that a node with links to a third of all others
    weighs no more than another. Each round is written to the shared folder.
    Nulls and self-links are no links.
    """
    a, b = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = cut(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(now)
    size = 2 * mark[0]
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large", rows=size)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small", rows=size)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"links have not settled in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
