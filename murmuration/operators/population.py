"""Typed agent populations as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw

UID = ["id", "type", "uid_rank"]


def agent_rows(df: DataFrame, id: str, type: Column | int, rank: Column | int = 0, seq: Column | None = None) -> DataFrame:
    """Rows with a uid; a negative type is an error when the row is computed. seq orders agents by insertion."""
    kind = type if isinstance(type, Column) else F.lit(type)
    checked = F.when(kind < 0, F.raise_error(F.lit("an agent's type is 0 or more")).cast("int")).otherwise(kind)
    key = F.col(id).cast("long")
    rank = (rank if isinstance(rank, Column) else F.lit(rank)).cast("int").alias("uid_rank")
    return df.select(key.alias("id"), checked.cast("int").alias("type"), rank, (key if seq is None else seq.cast("long")).alias("seq"))


class Population:
    """Agents of all types: uid (id, type, uid_rank), insertion order seq, and any state columns.

    A tile column stands for the place that owns an agent. Projections are registered by name.
    """

    def __init__(self, agents: DataFrame):
        self.df = agents
        self.projections: dict[str, object] = {}
        self.layers: list[object] = []

    def _with(self, agents: DataFrame) -> Population:
        out = Population(agents)
        out.projections, out.layers = dict(self.projections), list(self.layers)
        return out

    def add(self, rows: DataFrame) -> Population:
        """Set semantics: a row whose uid is there already changes nothing. Projections with add() get the new agents too."""
        new = rows.dropDuplicates(UID).join(self.df.select(*UID), UID, "left_anti")
        out = self._with(self.df.unionByName(new, allowMissingColumns=True))
        out.projections = {k: p.add(new) if hasattr(p, "add") else p for k, p in out.projections.items()}
        return out

    def remove(self, uids: DataFrame) -> Population:
        """Without the given agents; projections that offer remove() lose them too."""
        out = self._with(self.df.join(uids.select(*UID), UID, "left_anti"))
        out.projections = {k: p.remove(uids) if hasattr(p, "remove") else p for k, p in out.projections.items()}
        return out

    def agents(self, agent_type: int | None = None, count: int | None = None, shuffle: bool = False, seed: int | None = None, tick: int = 0) -> DataFrame:
        """Agents in insertion order, or in an order drawn from (seed, tick, id); the first `count` of them if given."""
        df = self.df
        if agent_type is not None:
            if not self.contains_type(agent_type):
                raise KeyError(agent_type)
            df = df.filter(F.col("type") == agent_type)
        # ids repeat across types: seq tells them apart
        df = df.orderBy(draw("seq", tick, 0, seed), "seq") if shuffle else df.orderBy("seq")
        return df if count is None else df.limit(count)

    def agent(self, uid: tuple[int, int, int]) -> DataFrame:
        """The agent with this uid: one row or none."""
        return self.df.filter(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(UID, uid, strict=True))))

    def ghost_agent(self, uid: tuple[int, int, int], tile: int) -> DataFrame:
        """The agent with this uid if another tile owns it."""
        return self.agent(uid).filter(F.col("tile") != tile)

    def contains_type(self, agent_type: int) -> bool:
        return not self.df.filter(F.col("type") == agent_type).isEmpty()

    def sizes(self) -> DataFrame:
        """(type, n) for each type, and for all under type -1, in one pass."""
        counts = self.df.groupingSets([["type"], []], "type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        return counts.select(F.when(F.col("g") == 1, -1).otherwise(F.col("type")).alias("type"), "n")

    def size(self, agent_types: list[int] | None = None) -> dict[int, int]:
        """Counts by type; of all agents under -1 if no types are named. A type never seen is a KeyError."""
        counts = {r.type: r.n for r in self.sizes().collect()}  # a row for each type
        return {t: counts[t] for t in agent_types} if agent_types else {-1: counts.get(-1, 0)}

    def add_projection(self, name: str, projection: object) -> None:
        """Registers a projection under a free name; the agents that it lacks are added to it."""
        if name in self.projections:
            raise ValueError(f"there is a projection {name} already")
        self.projections[name] = projection.add(self.df) if hasattr(projection, "add") else projection

    def get_projection(self, name: str) -> object:
        return self.projections[name]

    def add_value_layer(self, layer: object) -> None:
        self.layers.append(layer)

    def request_agents(self, requests: DataFrame) -> DataFrame:
        """(tile that asks, the agent's row) for each request; those for unknown agents give nothing."""
        return requests.select(F.col("tile").alias("asking_tile"), *UID).join(self.df, UID)

    def move_agents(self, moves: DataFrame) -> Population:
        """Owners changed to the tiles that moves (uid, tile) name."""
        new = moves.select(*UID, F.col("tile").alias("new_tile"))
        moved = self.df.join(new, UID, "left").withColumn("tile", F.coalesce("new_tile", "tile")).drop("new_tile")
        return self._with(moved)

    def synchronize(self, tile: Column) -> Population:
        """Owners recomputed from the agents' rows, as a location's tile."""
        return self._with(self.df.withColumn("tile", tile))

    def synchronize_with(self, name: str) -> tuple[Population, dict[str, DataFrame]]:
        """Owners recomputed from the locations of a registered space, and what tiles then see of each other.

        Agents that are not placed keep their owner. The second result has the halo of every projection and value layer
        that has a tiling, by name; layers are named layer0, layer1 and so on.
        """
        owners = self.projections[name].tiles().filter("x IS NOT NULL").select(*UID, F.col("tile").alias("new_tile"))
        moved = self.df.join(owners, UID, "left").withColumn("tile", F.coalesce("new_tile", "tile")).drop("new_tile")
        named = self.projections | {f"layer{k}": layer for k, layer in enumerate(self.layers)}
        halos = {k: p.halo() for k, p in named.items() if getattr(p, "tiling", None) is not None}
        return self._with(moved), halos

    def changes(self, before: DataFrame, columns: list[str]) -> DataFrame:
        """Agents whose state differs from that in an earlier table, or who are new in it: what an update has to send."""
        old = before.select(*UID, F.struct(*columns).alias("_old"))
        both = self.df.join(old, UID, "left")
        return both.filter(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")

    def update(self, states: DataFrame) -> Population:
        """State columns of the agents that states (uid and some columns) names, replaced by those there; others stay."""
        named = [c for c in states.columns if c not in UID]
        new = states.select(*UID, F.lit(True).alias("_told"), *(F.col(c).alias(f"_new_{c}") for c in named))
        both = self.df.join(new, UID, "left")
        state = {c: F.when(F.col("_told"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in named}
        return self._with(both.withColumns(state).select(*self.df.columns))

    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views for SQL: agents, and per projection its tables, named <prefix><projection>_<table>; their names."""
        tables = {"agents": self.df}
        for name, p in self.projections.items():
            tables |= {f"{name}_{t}": getattr(p, t) for t in ("locations", "nodes", "edges") if hasattr(p, t)}
        tables |= {f"layer{k}_cells": layer.cells for k, layer in enumerate(self.layers)}
        for name, df in tables.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in tables]

    def migrations(self, tile: Column) -> DataFrame:
        """Agents whose owner changes: uid, tile, new_tile."""
        return self.df.withColumn("new_tile", tile).filter("new_tile != tile").select(*UID, "tile", "new_tile")
