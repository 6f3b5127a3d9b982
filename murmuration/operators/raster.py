"""Value layers: rasters as cell tables (x, y, z, value)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.geometry import AXES, BorderType, BoundingBox, Tiling, bordered, neighbours

CELL = list(AXES)


def cell_numbers(spark: SparkSession, box: BoundingBox) -> DataFrame:
    """Every cell of a box with its number, x fastest."""
    nx, ny, nz = (max(1, e) for _, e in box.axes)
    n = F.col("id")
    return spark.range(nx * ny * nz).select(
        (n % nx + box.xmin).alias("x"),
        (F.floor(n / nx) % ny + (box.ymin if box.num_dims > 1 else 0)).alias("y"),
        (F.floor(n / (nx * ny)) + (box.zmin if box.num_dims > 2 else 0)).alias("z"),
        n.alias("number"),
    )


@dataclass(frozen=True)
class ValueLayer:
    cells: DataFrame
    box: BoundingBox
    border: BorderType = BorderType.STICKY
    tiling: Tiling | None = None

    @classmethod
    def create(cls, spark: SparkSession, box: BoundingBox, border: BorderType = BorderType.STICKY, init: float | str = 0.0, seed: int | None = None, dtype: str = "double") -> ValueLayer:
        """All cells at init, or at draws from [0, 1) by (seed, cell) if init is 'random'; values are of Spark's type dtype."""
        value = uniform("number", 0, 0, seed) if init == "random" else F.lit(float(init))
        return cls(cell_numbers(spark, box).select(*CELL, value.cast(dtype).alias("value")), box, border)

    def _inside(self, points: DataFrame) -> DataFrame:
        """The points with at_x, at_y, at_z: the cells that the borders make of them."""
        moved = bordered(self.box, self.border)
        return points.select("*", *(c.alias(f"at_{name}") for c, name in zip(moved, AXES, strict=True)))

    def get(self, points: DataFrame) -> DataFrame:
        """points with the value of the cell that each one falls on."""
        there = self.cells.select(*(F.col(c).alias(f"at_{c}") for c in CELL), "value")
        return self._inside(points).join(there, [f"at_{c}" for c in CELL], "left").drop(*(f"at_{c}" for c in CELL))

    def rows(self) -> DataFrame:
        """An array view: (y, z, values), one row for each line of cells along x, in order; it has to fit in a task."""
        cells = F.array_sort(F.collect_list(F.struct("x", "value")))
        return self.cells.groupBy("y", "z").agg(F.transform(cells, lambda c: c.value).alias("values"))

    def set(self, updates: DataFrame) -> ValueLayer:
        """Cells set to `value` of updates (x, y, z, value, seq); of several for a cell, that with the largest seq holds."""
        last = self._inside(updates).groupBy(*(F.col(f"at_{c}").alias(c) for c in CELL)).agg(F.max_by("value", "seq").alias("new"))
        cells = self.cells.join(last, CELL, "left").select(*CELL, F.coalesce("new", "value").alias("value"))
        return replace(self, cells=cells)

    def neighbourhoods(self, points: DataFrame) -> DataFrame:
        """The Moore neighbourhood of each point, in order: the point, ordinal, the neighbour's place and value.

        The point itself is not brought inside first.
        """
        around = neighbours(self.box.inclusive, self.border == BorderType.PERIODIC)
        listed = points.select(*(F.col(c).alias(f"of_{c}") for c in CELL), F.explode(around).alias("n")).select("of_x", "of_y", "of_z", "n.*")
        return listed.join(self.cells, CELL, "left")

    def halo(self, width: int = 1) -> DataFrame:
        """Cells near a tile's sides, for each tile beside it."""
        strips = self.tiling.strips(self.cells.sparkSession, width)
        near = F.expr("x >= xmin AND x < xmax") & (F.lit(self.box.num_dims < 2) | F.expr("y >= ymin AND y < ymax"))
        cells = self.cells.withColumn("tile", self.tiling.tile_of())
        return cells.join(F.broadcast(strips), F.col("tile") == F.col("src_tile")).filter(near).select("src_tile", "dst_tile", *CELL, "value")

    def diffuse(self, rate: float = 0.1, digits: int | None = None) -> ValueLayer:
        """One explicit step of diffusion over the four side neighbours (two in one dimension, six in three).

        Each cell sends its value to its neighbours and takes rate * (sum of neighbours - count * own); sticky edges have
        no neighbour outside, so the sum over all cells stays. One aggregation: a cell's contributions are added up before
        the shuffle.
        """
        dims, lit = self.box.num_dims, F.lit
        sent = []
        for axis in range(dims):
            lo, extent = self.box.axes[axis]
            for step in (-1, 1):
                there = [F.col(c) for c in CELL]
                moved = there[axis] + step
                if self.border == BorderType.PERIODIC:
                    there[axis] = lit(lo) + F.pmod(moved - lo, lit(extent))
                    inside: Column = lit(True)
                else:
                    there[axis] = moved
                    inside = moved.between(lo, lo + extent - 1)
                # what goes to a neighbour, and what the same pair takes from this cell
                sent.append(F.when(inside, F.struct(*(c.cast("long").alias(n) for c, n in zip(there, CELL, strict=True)), (F.col("value") * rate).alias("part"))))
        own = F.struct(*(F.col(c).cast("long").alias(c) for c in CELL), (F.col("value") * (1 - rate * F.size(F.filter(F.array(*sent), lambda s: s.isNotNull())))).alias("part"))
        parts = self.cells.select(F.explode(F.array(own, *sent)).alias("s")).filter("s IS NOT NULL").select("s.*")
        total = F.sum("part")
        return replace(self, cells=parts.groupBy(*CELL).agg((total if digits is None else F.round(total, digits)).alias("value")))


@dataclass(frozen=True)
class ReadWriteLayer:
    """Two layers: reads see one, writes go to the other, until they are swapped."""

    read: ValueLayer
    write: ValueLayer

    def get(self, points: DataFrame) -> DataFrame:
        return self.read.get(points)

    def neighbourhoods(self, points: DataFrame) -> DataFrame:
        return self.read.neighbourhoods(points)

    def rows(self) -> DataFrame:
        """An array view: (y, z, values), one row for each line of cells along x, in order; it has to fit in a task."""
        cells = F.array_sort(F.collect_list(F.struct("x", "value")))
        return self.cells.groupBy("y", "z").agg(F.transform(cells, lambda c: c.value).alias("values"))

    def set(self, updates: DataFrame) -> ReadWriteLayer:
        return replace(self, write=self.write.set(updates))

    def swap(self) -> ReadWriteLayer:
        return ReadWriteLayer(self.write, self.read)
