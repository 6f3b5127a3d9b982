"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links at most (3 MB or so) that one task works on without any shuffle; more are spread over the cluster.
ONE_TASK_LINKS = 200_000


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(u, v) links in any direction -> (node, component) with the smallest node reachable, for nodes with links.

    Large-star links each larger neighbour to the smallest of a node's neighbourhood, small-star each smaller one; the
    rounds, logarithmic in practice, end when the links no longer change and every node hangs on its component's
    smallest. Minima are aggregated before the shuffle and written, so that a node with very many links is a join that
    Spark can split. Nothing but counts comes to the driver.
    """
    loops = F.col("u") != F.col("v")
    edges = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(loops).distinct(), f"{name}-0")
    state, step = _state(edges), 0
    while state[0]:
        step += 1
        # the rounds add no links: small-star makes one of each, large-star at most
        few = state[0] <= ONE_TASK_LINKS
        edges = edges.coalesce(1) if few else edges
        keep = (lambda df, _: df) if few else (lambda df, part: scratch.write(df, f"{name}-{step}-{part}"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if few else both
        nearest = keep(_nearest(both).select("u", F.least("u", "m").alias("m")), "near")
        large = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large")
        nearest = keep(_nearest(large), "small-near")
        small = large.join(nearest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(nearest.select("u", F.col("m").alias("v")))
        edges = scratch.write((small.coalesce(1) if few else small).distinct(), f"{name}-{step}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
