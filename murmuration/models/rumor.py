"""A rumor that spreads along a network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..operators.network import Network


def spread(network: Network, informed: DataFrame, tick: int, probability: float, seed: int | None = None) -> DataFrame:
    """Ids that hear the rumor in this tick: each link from an informed to another node tells it with `probability`.

    Those informed when the tick began are the ones who tell. Links of a well-connected node are spread by their other end.
    """
    return _heard(_links(network), informed, tick, probability, seed)


def _links(network: Network) -> DataFrame:
    return network.neighbours().select(F.col("id").alias("teller"), F.col("other").alias("id"))


def _heard(links: DataFrame, informed: DataFrame, tick: int, probability: float, seed: int | None) -> DataFrame:
    told = links.join(informed.select(F.col("id").alias("teller")), "teller")
    heard = told.filter(uniform(F.col("teller") * 1000003 + F.col("id"), tick, 0, seed) <= probability)
    return heard.select("id").distinct().join(informed.select("id"), "id", "left_anti")


def run(network: Network, seeds: DataFrame, ticks: int, probability: float, seed: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, tick when informed) and the log (tick, total and new spreaders), tick 0 being the seeds.

    keep writes the links once and what each tick adds; ticks then read links that lie by teller.
    """
    links = _links(network)
    if keep:
        links = keep(links.repartition("teller"), "links")
    informed = seeds.select("id").distinct().withColumn("tick", F.lit(0))
    for tick in range(1, ticks + 1):
        new = _heard(links, informed, tick, probability, seed).withColumn("tick", F.lit(tick))
        informed = informed.unionByName(keep(new, f"rumor{tick}") if keep else new)
    return informed, counts(informed, ticks)


def counts(informed: DataFrame, ticks: int) -> DataFrame:
    """Total and new spreaders of each tick; ticks without news have their row too."""
    new = informed.groupBy("tick").agg(F.count("*").alias("new_rumor_spreaders"))
    all_ticks = informed.sparkSession.range(ticks + 1).select(F.col("id").cast("int").alias("tick"))
    a, b = all_ticks.alias("a"), new.alias("b")
    # a row for each tick on either side
    joined = a.join(F.broadcast(b), F.col("b.tick") <= F.col("a.tick"), "left")
    total = F.coalesce(F.sum("b.new_rumor_spreaders"), F.lit(0)).alias("total_rumor_spreaders")
    now = F.coalesce(F.sum(F.when(F.col("b.tick") == F.col("a.tick"), F.col("b.new_rumor_spreaders"))), F.lit(0)).alias("new_rumor_spreaders")
    return joined.groupBy(F.col("a.tick").alias("tick")).agg(total, now)
