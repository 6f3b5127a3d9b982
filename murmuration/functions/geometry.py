"""Boxes, borders, neighbourhoods and tilings as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: How far inside its upper edge a clipped continuous point stays.
CONTINUOUS_EDGE = 1e-8


class BorderType(IntEnum):
    STICKY = 0
    PERIODIC = 1


class OccupancyType(IntEnum):
    MULTIPLE = 0
    SINGLE = 1


@dataclass(frozen=True)
class BoundingBox:
    """Half-open box; an extent of 0 means that the dimension is not there."""

    xmin: int
    xextent: int
    ymin: int = 0
    yextent: int = 0
    zmin: int = 0
    zextent: int = 0

    @property
    def axes(self) -> list[tuple[int, int]]:
        return [(self.xmin, self.xextent), (self.ymin, self.yextent), (self.zmin, self.zextent)]

    @property
    def num_dims(self) -> int:
        if self.xextent <= 0:
            raise ValueError("a box has an extent along x at least")
        return 3 if self.zextent > 0 else 2 if self.yextent > 0 else 1

    def contains(self, x="x", y="y", z="z") -> Column:
        """Whether a point lies inside; dimensions that the box lacks do not count."""
        points = [F.col(c) if isinstance(c, str) else c for c in (x, y, z)]
        tests = [(p >= mn) & (p < mn + ext) for p, (mn, ext) in list(zip(points, self.axes, strict=True))[: self.num_dims]]
        return reduce(lambda a, b: a & b, tests)

    @property
    def inclusive(self) -> list[tuple[int, int]]:
        """(least, greatest) cell of each dimension."""
        return [(mn, mn + ext - 1) for mn, ext in self.axes[: self.num_dims]]


def _sticky(c: Column, mn, extent, edge) -> Column:
    return F.greatest(F.lit(mn), F.least(F.lit(mn + extent - edge), c))


def _periodic(c: Column, mn, extent) -> Column:
    # the remainder keeps the sign of its dividend, as C's fmod does; pmod differs for tiny negative doubles
    rest = (c - mn) % extent
    return F.when(rest < 0, rest + (mn + extent)).otherwise(rest + mn)


def bordered(box: BoundingBox, border: BorderType, continuous: bool = False, x="x", y="y", z="z") -> list[Column]:
    """The point (x, y, z) brought into the box, named x, y, z.

    Sticky borders clip every axis, so that a missing dimension collapses to its minimum; periodic ones wrap the axes that
    the box has and set the others to 0.
    """
    kind = "double" if continuous else "long"
    out = []
    for name, c, (mn, extent) in zip(AXES, (x, y, z), box.axes, strict=True):
        c = F.col(c) if isinstance(c, str) else c
        if border == BorderType.STICKY:
            moved = _sticky(c, mn, extent, CONTINUOUS_EDGE if continuous else 1)
        else:
            moved = _periodic(c, mn, extent) if extent > 0 else F.lit(0)
        out.append(moved.cast(kind).alias(name))
    return out


def neighbours(limits: list[tuple[int, int]], periodic: bool, top_first: bool = False) -> Column:
    """An array of (ordinal, x, y, z) for the Moore neighbourhood of (x, y, z), the point included.

    limits: (least, greatest) cell along each dimension, both inclusive. x varies fastest, then y, then z; top_first lists
    the largest y first. Sticky neighbourhoods leave out what lies outside; periodic ones wrap it and keep doubles, which
    come up where an extent is under 3.
    """
    dims = len(limits)
    rising, falling = (-1, 0, 1), (1, 0, -1)
    steps = product(rising if dims > 2 else (0,), (falling if top_first else rising) if dims > 1 else (0,), rising)
    cells = []
    for k, (dz, dy, dx) in enumerate(steps):
        point = [F.col(c) + d for c, d in zip(AXES, (dx, dy, dz), strict=True)][:dims]
        if periodic:
            point = [F.lit(lo) + F.pmod(p - lo, F.lit(hi - lo + 1)) for p, (lo, hi) in zip(point, limits, strict=True)]
            inside = F.lit(True)
        else:
            inside = reduce(lambda a, b: a & b, (p.between(lo, hi) for p, (lo, hi) in zip(point, limits, strict=True)))
        point += [F.lit(0)] * (3 - dims)
        cells.append((inside, F.struct(F.lit(k).alias("ordinal"), *(p.cast("long").alias(c) for p, c in zip(point, AXES, strict=True)))))
    if periodic:
        return F.array(*(c for _, c in cells))
    return F.filter(F.array(*(F.when(inside, c) for inside, c in cells)), lambda c: c.isNotNull())


# --- tiles -------------------------------------------------------------------------------------------------------


def dims_create(n: int, dims: int) -> tuple[int, ...]:
    """n as a product of dims factors, as near each other as can be, the largest first."""

    def splits(rest: int, k: int, most: int):
        if k == 1:
            if rest <= most:
                yield (rest,)
            return
        for f in range(min(rest, most), 0, -1):
            if rest % f == 0:
                for more in splits(rest // f, k - 1, f):
                    yield (f, *more)

    return min(splits(n, dims, n), key=lambda s: (s[0] - s[-1], s))


@dataclass(frozen=True)
class Tiling:
    """A box cut into a grid of tiles, numbered with the last dimension fastest; low tiles take the remainders."""

    box: BoundingBox
    shape: tuple[int, ...]
    periodic: bool = False

    @classmethod
    def balanced(cls, box: BoundingBox, n: int, periodic: bool = False) -> Tiling:
        return cls(box, dims_create(n, box.num_dims), periodic)

    def __post_init__(self):
        if len(self.shape) != self.box.num_dims or prod(self.shape) < 1:
            raise ValueError(f"{self.shape} does not fit a box of {self.box.num_dims} dimensions")

    @property
    def size(self) -> int:
        return prod(self.shape)

    def coordinates(self, tile: int) -> tuple[int, ...]:
        out = []
        for n in reversed(self.shape):
            tile, c = divmod(tile, n)
            out.append(c)
        return tuple(reversed(out))

    def number(self, coordinates) -> int:
        out = 0
        for c, n in zip(coordinates, self.shape, strict=True):
            out = out * n + c
        return out

    def bounds(self, tile: int) -> BoundingBox:
        sides = []
        for (mn, extent), n, c in zip(self.box.axes, self.shape, self.coordinates(tile), strict=False):
            base, more = divmod(extent, n)
            sides += [mn + base * c + min(c, more), base + (c < more)]
        return BoundingBox(*sides)

    def tile_of(self, x="x", y="y", z="z") -> Column:
        """The tile that holds a point of the box, in closed form."""
        number = F.lit(0)
        for c, (mn, extent), n in zip((x, y, z), self.box.axes, self.shape, strict=False):
            base, more = divmod(extent, n)
            at = F.floor((F.col(c) if isinstance(c, str) else c) - mn)
            wide = more * (base + 1)
            place = F.when(at < wide, F.floor(at / (base + 1))).otherwise(more + F.floor((at - wide) / max(1, base)))
            number = number * n + place
        return number.cast("int")

    def neighbours(self, tile: int) -> list[tuple[int, tuple[int, ...]]]:
        """(tile, step) for the tiles around one; wrapped and with repeats if periodic."""
        here, out = self.coordinates(tile), []
        for step in product((-1, 0, 1), repeat=len(self.shape)):
            there = [c + s for c, s in zip(here, step, strict=True)]
            if not any(step):
                continue
            if self.periodic:
                there = [c % n for c, n in zip(there, self.shape, strict=True)]
            elif any(not 0 <= c < n for c, n in zip(there, self.shape, strict=True)):
                continue
            if (number := self.number(there)) != tile or self.periodic:
                out.append((number, step))
        return out

    def strip(self, tile: int, step: tuple[int, ...], width: int) -> BoundingBox:
        """The part of a tile within `width` of the side, edge or corner that faces `step`."""
        sides = []
        for (mn, extent), s in zip(self.bounds(tile).axes, step, strict=False):
            sides += [(mn + extent - width) if s == 1 else mn, width if s else extent]
        return BoundingBox(*sides)

    def tiles(self, spark: SparkSession) -> DataFrame:
        """tile and its bounds: a row for each tile."""
        rows = [(t, *(v for side in self.bounds(t).axes for v in side)) for t in range(self.size)]
        return spark.createDataFrame(rows, "tile int, xmin long, xextent long, ymin long, yextent long, zmin long, zextent long")

    def neighbour_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, n) for t in range(self.size) for n, _ in self.neighbours(t)]
        return spark.createDataFrame(rows, "tile int, neighbour int")

    def strips(self, spark: SparkSession, width: int) -> DataFrame:
        """What each tile sends to each neighbour: (src_tile, dst_tile, low and high ends), at most 26 rows a tile."""
        rows = []
        for t in range(self.size):
            for n, step in self.neighbours(t):
                ends = [v for mn, extent in self.strip(t, step, width).axes for v in (mn, mn + extent)]
                rows.append((t, n, *ends))
        return spark.createDataFrame(rows, "src_tile int, dst_tile int, xmin long, xmax long, ymin long, ymax long, zmin long, zmax long")

    def buffered(self, tile: int, width: int) -> BoundingBox:
        """A tile's bounds, grown by `width` where there is a neighbour to hear from."""
        sides = []
        for (mn, extent), c, n in zip(self.bounds(tile).axes, self.coordinates(tile), self.shape, strict=False):
            low = width if self.periodic or c > 0 else 0
            high = width if self.periodic or c < n - 1 else 0
            sides += [mn - low, extent + low + high]
        return BoundingBox(*sides)
