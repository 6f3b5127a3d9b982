"""Discrete grids and continuous spaces over agents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.geometry import AXES, BorderType, BoundingBox, OccupancyType, Tiling, bordered
from .population import UID

CELL = list(AXES)


@dataclass(frozen=True)
class Space:
    """Locations: uid, seq, x, y, z (null while unplaced) and arrival_seq, which orders the agents of one point."""

    locations: DataFrame
    box: BoundingBox
    border: BorderType = BorderType.STICKY
    occupancy: OccupancyType = OccupancyType.MULTIPLE
    continuous: bool = False
    tiling: Tiling | None = None
    buffer_size: int = 0

    def add(self, agents: DataFrame) -> Space:
        """Members without a location; those who are members stay as they are."""
        kind = "double" if self.continuous else "long"
        new = agents.select(*UID, "seq").join(self.locations.select(*UID), UID, "left_anti")
        new = new.select("*", *(F.lit(None).cast(kind).alias(c) for c in CELL), F.lit(None).cast("long").alias("arrival_seq"))
        return replace(self, locations=self.locations.unionByName(new))

    def remove(self, uids: DataFrame) -> Space:
        return replace(self, locations=self.locations.join(uids.select(*UID), UID, "left_anti"))

    def missing(self, uids: DataFrame) -> DataFrame:
        """Those of the given agents who are no members: what a strict move has to refuse."""
        return uids.select(*UID).join(self.locations.select(*UID), UID, "left_anti")

    def contains(self, uids: DataFrame) -> DataFrame:
        """Those of the given agents who are members, placed or not."""
        return uids.join(self.locations.select(*UID), UID, "left_semi")

    def location(self, uids: DataFrame) -> DataFrame:
        """Locations of the given agents; null for those unplaced or unknown."""
        return uids.join(self.locations.select(*UID, *CELL), UID, "left")

    def transform(self, x="x", y="y", z="z") -> list[Column]:
        return bordered(self.box, self.border, self.continuous, x, y, z)

    def move(self, moves: DataFrame, stamp: int = 1, strict: bool = False) -> Space:
        """Agents at the points that moves (uid, x, y, z) name, borders applied.

        Moves of agents who are no members do nothing, or are a KeyError at once if strict.

        All moves see the locations as they were. A new arrival gets arrival_seq from stamp, which must grow from one
        phase to the next; who moves in place keeps theirs. With single occupancy, a point that is taken stays closed in
        this phase even if its agent leaves, the one with the smallest seq gets a free point, and others stay.
        """
        if strict and (stranger := self.missing(moves).head()):
            raise KeyError(tuple(stranger))
        to = moves.select(*UID, *self.transform()).select(*UID, *(F.col(c).alias(f"to_{c}") for c in CELL))
        old, new = F.struct(*CELL), F.struct(*(F.col(f"to_{c}").alias(c) for c in CELL))
        both = self.locations.join(to, UID, "left")
        goes = F.col("to_x").isNotNull() & ~old.eqNullSafe(new)
        if self.occupancy == OccupancyType.SINGLE:
            taken = self.locations.filter("x IS NOT NULL").select(*(F.col(c).alias(f"to_{c}") for c in CELL), F.lit(True).alias("taken")).distinct()
            wishes = both.filter(goes)
            first = wishes.groupBy(*(f"to_{c}" for c in CELL)).agg(F.min("seq").alias("winner"))
            open_ = first.join(taken, [f"to_{c}" for c in CELL], "left_anti")
            both = both.join(open_, [f"to_{c}" for c in CELL], "left")
            goes = goes & (F.col("winner") == F.col("seq"))
        goes = F.coalesce(goes, F.lit(False))
        arrived = F.lit(stamp).cast("long") * F.lit(1 << 40) + F.col("seq")
        moved = [F.when(goes, F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) for c in CELL]
        out = both.select(*UID, "seq", *moved, F.when(goes, arrived).otherwise(F.col("arrival_seq")).alias("arrival_seq"))
        return replace(self, locations=out)

    def first_occupants(self, agent_type: int | None = None) -> DataFrame:
        """The earliest arrival of each occupied point."""
        there = self.locations.filter("x IS NOT NULL")
        there = there if agent_type is None else there.filter(F.col("type") == agent_type)
        first = F.min_by(F.struct(*UID), F.struct("arrival_seq", "seq")).alias("first")
        return there.groupBy(*CELL).agg(first).select(*CELL, *(F.col(f"first.{c}").alias(c) for c in UID))

    def occupants(self, points: DataFrame | None = None) -> DataFrame:
        """Agents at the given points (all occupied ones if none), with their place in order of arrival.

        The order within a point takes a window over it; use first_occupants() or num_agents() where they do.
        """
        from pyspark.sql import Window

        there = self.locations.filter("x IS NOT NULL")
        there = there if points is None else there.join(points.select(*CELL).distinct(), CELL)
        place = F.row_number().over(Window.partitionBy(*CELL).orderBy("arrival_seq", "seq")) - 1
        return there.select(*CELL, *UID, place.alias("place"))

    def num_agents(self, points: DataFrame | None = None, agent_type: int | None = None) -> DataFrame:
        """Agents at each point, of one type if given; points given but empty count 0."""
        there = self.locations.filter("x IS NOT NULL")
        chosen = F.lit(True) if agent_type is None else F.col("type") == agent_type
        counts = there.groupBy(*CELL).agg(F.count_if(chosen).alias("n"))
        if points is None:
            return counts
        return points.select(*CELL).join(counts, CELL, "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def within(self, box: BoundingBox) -> DataFrame:
        return self.locations.filter(box.contains())

    def within_many(self, boxes: DataFrame, bin_size: int) -> DataFrame:
        """(box_id, agent's row) for boxes (box_id, xmin, xextent, ymin, yextent), by an equi-join on grid bins.

        Each box is listed under the bins that it touches, each point under its own; the exact test follows. A bin should
        be about as large as a box.
        """
        def bins(low: str, extent: str) -> Column:
            first, last = F.floor(F.col(low) / bin_size), F.floor((F.col(low) + F.col(extent) - 1) / bin_size)
            return F.when(F.col(extent) > 0, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))

        listed = boxes.withColumn("bx", F.explode(bins("xmin", "xextent"))).withColumn("by", F.explode(bins("ymin", "yextent")))
        points = self.locations.withColumn("bx", F.floor(F.col("x") / bin_size)).withColumn("by", F.floor(F.col("y") / bin_size))
        inside = F.expr("x >= xmin AND x < xmin + xextent AND y >= ymin AND y < ymin + yextent")
        return points.join(listed, ["bx", "by"]).filter(inside).drop("bx", "by", "xmin", "xextent", "ymin", "yextent")

    def random_points(self, agents: DataFrame, tick: int = 0, seed: int | None = None) -> DataFrame:
        """A point of the whole box for each agent, drawn from (seed, tick, seq): whole cells, or any point if continuous."""
        out = []
        for k, (c, (mn, extent)) in enumerate(zip(CELL, self.box.axes, strict=True)):
            at = uniform("seq", tick, k, seed) * extent
            out.append((at + mn if self.continuous else F.floor(at) + mn).cast("double" if self.continuous else "long").alias(c))
        return agents.select(*UID, *out)

    def random_tile_points(self, agents: DataFrame, tick: int = 0, seed: int | None = None) -> DataFrame:
        """A point for each agent inside the tile that owns it (column tile), drawn from (seed, tick, seq).

        The tiles, a row each, are broadcast. Low ends and extents come from the tiling, so the draw is one expression.
        """
        tiles = self.tiling.tiles(agents.sparkSession)
        out = []
        for k, c in enumerate(CELL):
            at = uniform("seq", tick, k, seed) * F.col(f"{c}extent")
            out.append(((at if self.continuous else F.floor(at)) + F.col(f"{c}min")).cast("double" if self.continuous else "long").alias(c))
        return agents.join(F.broadcast(tiles), "tile").select(*UID, "tile", *out)

    def tiles(self) -> DataFrame:
        """Locations with their tile."""
        return self.locations.withColumn("tile", self.tiling.tile_of())

    def halo(self, buffer_size: int | None = None) -> DataFrame:
        """Copies of agents near a tile's sides, for each tile beside it: dst_tile, uid, x, y, z.

        The strips, at most 26 rows a tile, are broadcast; candidates meet them by tile.
        """
        width = self.buffer_size if buffer_size is None else buffer_size
        strips = self.tiling.strips(self.locations.sparkSession, width)
        near = F.expr("x >= xmin AND x < xmax") & (F.lit(self.box.num_dims < 2) | F.expr("y >= ymin AND y < ymax"))
        near = near & (F.lit(self.box.num_dims < 3) | F.expr("z >= zmin AND z < zmax"))
        joined = self.tiles().join(F.broadcast(strips), F.col("tile") == F.col("src_tile")).filter(near)
        return joined.select("src_tile", "dst_tile", *UID, *CELL)


def colocations(locations: DataFrame) -> DataFrame:
    """For each agent, the others at its point. Counts are aggregated first, so a crowded point is one row of the join."""
    counts = locations.groupBy(*CELL).agg(F.count("*").alias("here"))
    return locations.join(counts, CELL).select(*UID, *CELL, (F.col("here") - 1).alias("others"))
