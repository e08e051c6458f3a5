"""Connected components by alternating large and small stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can reach.

    Self-loops, repeated edges and edges with a null end are left out, and so
    are nodes without another edge. Each round hooks neighbours to the
    smallest node that they know of (Kiveris et al. 2014); a logarithmic
    number of rounds suffices. Minima are pre-aggregated, so a node with very
    many neighbours costs one row for each task; rounds end in a scratch table.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    pairs, before = scratch(pairs, "edges"), None
    while True:
        at = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if at[0] == 0 or tuple(at) == before:
            break
        before = tuple(at)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = scratch(small.unionByName(lower.withColumnRenamed("m", "v")).distinct(), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
