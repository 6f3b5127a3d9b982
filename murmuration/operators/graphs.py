"""Graph algorithms over networks: components, ranks, distances, and parts that keep neighbours together.

Each runs in rounds. keep(df, name) writes a round's table and returns it, which cuts lineage; rounds read what is written.
Tables with a row for each node or link are joined by shuffles: their files are small enough for Spark to broadcast them, which
would send all their rows to the driver in every round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .network import Network, few, shuffled

Keep = Callable[[DataFrame, str], DataFrame]


def _both_ways(network: Network) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return network.edges.filter("src != dst").select(ends.alias("e")).select("e.*").distinct()


def connected_components(network: Network, keep: Keep) -> DataFrame:
    """(id, component): the smallest id that is reachable along edges in any direction, for every node.

    Each round takes the least label among a node's neighbours and then the label of that label, so that long paths halve.
    The least label is aggregated before the shuffle, so a node with very many links is one row for each task.
    """
    links = keep(_both_ways(network), "links")
    labels, level = keep(network.nodes.select("id", F.col("id").alias("component")), "labels0"), 0
    while True:
        level += 1
        told = links.join(shuffled(labels.withColumnRenamed("id", "other")), "other").groupBy("id").agg(F.min("component").alias("near"))
        nearer = labels.join(shuffled(told), "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        # where a label's own node has a smaller one, that counts
        of = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = nearer.join(shuffled(of), "component", "left").select("id", "was", F.least("component", F.coalesce("root", "component")).alias("component"))
        new = keep(new, f"labels{level}")
        labels = new.select("id", "component")
        if new.filter("was != component").isEmpty():
            return labels


def page_ranks(network: Network, rounds: int, keep: Keep, damping: float = 0.85) -> DataFrame:
    """(id, rank) after some rounds from equal ranks; the ranks of nodes without a way out are spread over all nodes."""
    links = network.neighbours().select("id", "other")
    degrees = links.groupBy("id").agg(F.count("*").alias("out"))
    links = keep(links, "links")
    nodes = keep(network.nodes.select("id").join(shuffled(degrees), "id", "left"), "degrees")
    n = nodes.count()
    ranks = nodes.select("id", "out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(1, rounds + 1):
        lost = ranks.filter("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        sent = links.join(shuffled(ranks.filter("out IS NOT NULL").select("id", (F.col("rank") / F.col("out")).alias("part"))), "id")
        got = sent.groupBy(F.col("other").alias("id")).agg(F.sum("part").alias("got"))
        spread = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))
        ranks = keep(nodes.join(shuffled(got), "id", "left").join(F.broadcast(lost), how="cross").select("id", "out", spread.alias("rank")), f"ranks{k}")
    return ranks.select("id", "rank")


def distances(network: Network, seeds: DataFrame, keep: Keep, weight: str | None = None) -> DataFrame:
    """(id, distance) of the nodes that seeds (id) reach along neighbours; an edge counts its weight, 0 or more, or 1.

    Only nodes whose distance fell in the last round tell their neighbours, each round.
    """
    length = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if network.directed:
        links = network.edges.select(F.col("src").alias("from_id"), F.col("dst").alias("id"), length.alias("length"))
    else:
        links = network.incident().select(F.col("id").alias("from_id"), F.col("other").alias("id"), length.alias("length"))
    links = keep(links, "links")
    best = keep(seeds.select("id").distinct().withColumns({"distance": F.lit(0.0), "fell": F.lit(True)}), "distances0")
    level = 0
    while n := (front := best.filter("fell")).count():
        level += 1
        told = links.join(few(front.select(F.col("id").alias("from_id"), "distance"), n), "from_id")
        told = told.groupBy("id").agg(F.min(F.col("distance") + F.col("length")).alias("new"))
        both = best.select("id", "distance").join(shuffled(told), "id", "full")
        fell = F.col("distance").isNull() | F.coalesce(F.col("new") < F.col("distance"), F.lit(False))
        best = keep(both.select("id", F.least("distance", "new").alias("distance"), fell.alias("fell")), f"distances{level}")
    return best.select("id", "distance")


def near_parts(network: Network, n: int, keep: Keep, rounds: int = 5) -> DataFrame:
    """(id, part): parts whose sizes differ by one at most and that cut few edges, in place of a partitioner's search.

    Labels spread for some rounds, each node taking the commonest one around it (the smallest of equally common ones);
    nodes are then put in order of label and id and cut into n runs of equal length. Communities so stay together, but for
    those that a cut divides. Ranks come from counts by range, so no task sorts all nodes.
    """
    links = keep(_both_ways(network), "links")
    labels = keep(network.nodes.select("id", F.col("id").alias("label")), "near0")
    for k in range(1, rounds + 1):
        votes = links.join(shuffled(labels.withColumnRenamed("id", "other")), "other").groupBy("id", "label").agg(F.count("*").alias("votes"))
        most = votes.groupBy("id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("most"))
        labels = keep(labels.join(shuffled(most), "id", "left").select("id", F.coalesce("most", "label").alias("label")), f"near{k}")
    ranges = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = labels.repartitionByRange(ranges, "label", "id").sortWithinPartitions("label", "id")
    placed = keep(placed.select("id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")), "near-order")
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"), F.min("place").alias("first"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range", "first", before.alias("before"))
    total = placed.count()
    rank = F.col("before") + F.col("place") - F.col("first")
    return placed.join(F.broadcast(starts), "range").select("id", F.floor(rank * n / max(total, 1)).cast("int").alias("part"))
