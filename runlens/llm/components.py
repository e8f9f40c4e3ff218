"""Connected components over a table of links, by alternating large and small
stars (Kiveris et al. 2014).  Every round is joins and map-side combined
minima over (node, node) rows.  Nothing is gathered on the driver but one
count and one checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): each row of ``edges`` with the least v of its u.  The minima
    are written first: joined straight to the aggregate, a hub's rows would
    have to stay together; so both sides are plain shuffles, of which adaptive
    execution splits the hub's, or the minima are small enough to be sent."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")
    return edges.join(least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``: the smallest node reachable.
    Links with a null end or from a node to itself are ignored; repeated
    links do no harm; an empty table gives an empty table."""
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_minimum(both).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = _with_minimum(large)
        edges = cut(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
