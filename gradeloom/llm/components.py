"""Connected components of a link table, without any part of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) for the nodes of ``links`` (a, b).

    Alternates large-star and small-star: each round hooks the neighbours of a node to the smallest of them, so chains shorten
    geometrically and the table never has more rows than links. Rounds end when nothing moves. Duplicate links and self links
    change nothing; an empty table gives an empty result.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: the neighbours above a node go to the smallest node around it
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
                      .where("u <> v").distinct())
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame):
    """Size and order-free sums of hashes: two rounds with the same mark hold the same links."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first()
