"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is its smallest node.

    Alternates large-star and small-star contraction until the edges no longer
    change, which takes a number of rounds logarithmic in the longest path
    rather than one round per hop. Each round is two aggregations with
    map-side minimum and two joins on the node, whose hot side (the centre of
    a star) adaptive execution may split. Nulls, loops and repeated edges are
    ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = stored(e.where("_a is not null and _b is not null and hi <> lo").select("hi", "lo").distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).unionAll(e.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, e = e, stored(small.unionAll(root.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        dropped(last)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
