"""Agents that walk diagonally and count whom they meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.geometry import BorderType, BoundingBox, bordered
from ..operators.population import UID
from ..operators.space import colocations

LOG = ["tick", "total", "min", "max"]


def walk(locations: DataFrame, tick: int, box: BoundingBox, seed: int | None = None) -> DataFrame:
    """One step of -1 or 1 along x and along y, inside sticky borders. Nothing is shuffled."""
    step = lambda k: F.when(uniform("seq", tick, k, seed) < 0.5, -1).otherwise(1)
    moved = bordered(box, BorderType.STICKY, x=F.col("x") + step(0), y=F.col("y") + step(1), z=F.lit(0))
    return locations.select(*UID, "seq", *moved)


def meetings(locations: DataFrame, tick: int) -> DataFrame:
    """The tick's log row. min and max start from 0, as the counters do, so the logged min is 0."""
    others = colocations(locations).agg(F.sum("others").alias("total"), F.min("others").alias("low"), F.max("others").alias("high"))
    return others.select(
        F.lit(float(tick)).alias("tick"), F.coalesce("total", F.lit(0)).alias("total"), F.least(F.lit(0), "low").alias("min"), F.greatest(F.lit(0), "high").alias("max")
    )


def run(locations: DataFrame, ticks: int, box: BoundingBox, seed: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """(locations, log) after `ticks` steps, tick 0 logged too. keep writes the state each `every` ticks, to cut lineage."""
    log = meetings(locations, 0)
    for tick in range(1, ticks + 1):
        locations = walk(locations, tick, box, seed)
        if keep and tick % every == 0:
            locations = keep(locations, f"walk{tick}")
        log = log.unionByName(meetings(locations, tick))
    return locations, log
