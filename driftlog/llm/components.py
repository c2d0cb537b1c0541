"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.session import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b", tag: str = "components") -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    Null ends and links of a node with itself are ignored; repeated links count once; no links give an
    empty result. Each round is written to the shared folder, so lineage stays short, and removed once the next
    stands; the result is a written table too. Minima are aggregated before the shuffle; the joins have plain
    exchanges on both sides, which adaptive execution can split at a hub.
    """
    edges = written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        tag,
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = written(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(small.select("u", "m")).distinct(), tag
        )
        discard(edges, large)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), tag)
    discard(edges)
    return found
