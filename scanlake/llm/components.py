"""Connected components of a link table, for links that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanlake.scale import stable


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Alternating large-star and small-star rounds: every round hangs the neighbours of a node on the smallest of them, so
    the number of rounds grows with the logarithm of a chain's length and the number of links never grows. Each
    round is written to the reliable checkpoint folder. Nodes without a link are not listed. Null ends are left out.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v and v is not null").distinct()
    e = stable(e)
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stable(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
