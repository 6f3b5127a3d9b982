"""What runs tile by tile in Python, with copies from the tiles around: agents' own steps, and stencils on rasters.

These are for behaviour that columns cannot express. A task holds one tile and its halo, so tiles should be small: a
tiling may have far more of them than there are tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BorderType, Tiling
from .population import UID
from .raster import CELL, ValueLayer
from .space import Space

Step = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def step_agents(space: Space, step: Step, schema: str, state: DataFrame | None = None, buffer_size: int | None = None) -> DataFrame:
    """The rows that step(own, around) gives for each tile's agents.

    own has a tile's agents with uid, seq, x, y, z and the columns of state (by uid); around has those of other tiles within
    buffer_size of its sides. All tiles see the state as it was. Agents that are not placed take no part. Rows are shuffled
    once, by tile, with the copies of those near a side.
    """
    tiling, width = space.tiling, space.buffer_size if buffer_size is None else buffer_size
    rows = space.tiles().filter("x IS NOT NULL")
    if state is not None:
        rows = rows.join(state, UID, "left")
    strips = F.broadcast(tiling.strips(rows.sparkSession, width)).select(
        F.col("src_tile").alias("tile"), "dst_tile", *(F.col(f"{c}{end}").alias(f"_{c}{end}") for c in CELL for end in ("min", "max"))
    )
    near = F.lit(True)
    for c in CELL[: space.box.num_dims]:
        near = near & (F.col(c) >= F.col(f"_{c}min")) & (F.col(c) < F.col(f"_{c}max"))
    own = rows.withColumn("_ghost", F.lit(False))
    copies = rows.join(strips, "tile").filter(near).withColumns({"tile": F.col("dst_tile"), "_ghost": F.lit(True)}).select(*own.columns)
    if tiling.periodic:  # a tile may be beside another one on several sides
        copies = copies.dropDuplicates(["tile", *UID])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ghost = rows.pop("_ghost")
        return step(rows[~ghost].reset_index(drop=True), rows[ghost].reset_index(drop=True))

    return own.unionByName(copies).groupBy("tile").applyInPandas(run, schema)


_TILE = "tile int, values array<double>"
_PART = "tile int, sx int, sy int, values array<double>"


def _packed(rows: pd.DataFrame, tiling: Tiling) -> pd.DataFrame:
    """One row for a tile's cells, x fastest."""
    tile = int(rows["tile"].iat[0])
    (x0, nx), (y0, ny), _ = tiling.bounds(tile).axes
    out = np.zeros((max(1, ny), nx))
    out[rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0] = rows["value"].to_numpy()
    return pd.DataFrame({"tile": [tile], "values": [out.reshape(-1)]})


def _dealt(batches: Iterator[pd.DataFrame], tiling: Tiling, width: int) -> Iterator[pd.DataFrame]:
    """Every tile as it is, and its strips for the tiles around, with the side on which they lie there."""
    for rows in batches:
        out = []
        for tile, values in zip(rows["tile"], rows["values"], strict=True):
            (_, nx), (_, ny), _ = tiling.bounds(tile).axes
            whole = np.asarray(values).reshape(max(1, ny), nx)
            out.append((tile, 0, 0, values))
            cut = {-1: slice(0, width), 0: slice(None), 1: slice(-width, None)}
            for there, step in tiling.neighbours(tile):
                sx, sy = step[0], step[1] if len(step) > 1 else 0
                out.append((there, -sx, -sy, whole[cut[sy], cut[sx]].reshape(-1)))
        yield pd.DataFrame(out, columns=["tile", "sx", "sy", "values"])


def _diffused(rows: pd.DataFrame, tiling: Tiling, width: int, rate: float) -> pd.DataFrame:
    """A tile after `width` steps, from its cells and those around it up to as far away; cells outside the box count nothing."""
    tile = int(rows["tile"].iat[0])
    (_, nx), (_, ny), _ = tiling.bounds(tile).axes
    flat, ny = tiling.box.num_dims == 1, max(1, ny)
    pad = 0 if flat else width
    values, there = np.zeros((ny + 2 * pad, nx + 2 * width)), np.zeros((ny + 2 * pad, nx + 2 * width))
    place = lambda s, n, w: {-1: slice(0, w), 0: slice(w, w + n), 1: slice(w + n, None)}[s]
    for sx, sy, part in zip(rows["sx"], rows["sy"], rows["values"], strict=True):
        at = (place(sy, ny, pad), place(sx, nx, width))
        values[at] = np.asarray(part).reshape(values[at].shape)
        there[at] = 1
    sides = [(0, 1), (0, -1)] + ([] if flat else [(1, 0), (-1, 0)])

    def beside(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        out = np.zeros_like(a)
        to = (slice(max(0, dy), a.shape[0] + min(0, dy)), slice(max(0, dx), a.shape[1] + min(0, dx)))
        of = (slice(max(0, -dy), a.shape[0] + min(0, -dy)), slice(max(0, -dx), a.shape[1] + min(0, -dx)))
        out[to] = a[of]
        return out

    count = sum(beside(there, *s) for s in sides)
    for _ in range(width):
        values = there * (values + rate * (sum(beside(values, *s) for s in sides) - count * values))
    return pd.DataFrame({"tile": [tile], "values": [values[place(0, ny, pad), place(0, nx, width)].reshape(-1)]})


def diffuse_tiles(layer: ValueLayer, steps: int, tiling: Tiling, rate: float = 0.1, at_once: int = 4, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> ValueLayer:
    """A layer of one or two dimensions after `steps` of ValueLayer.diffuse(), tile by tile.

    A tile is one row. at_once steps take one exchange: each tile gets strips of that width from those around it and works
    out what lies near its sides for itself. So a step moves 1 / at_once of the raster, as packed arrays, where the column
    form moves five rows a cell. Tiles must be at least at_once wide; values may differ from the column form in the last
    bits, as sums are taken in another order. keep writes the tiles after each exchange, to cut lineage.
    """
    if layer.box.num_dims > 2 or tiling.periodic != (layer.border == BorderType.PERIODIC):
        raise ValueError("tiles are for one or two dimensions, and wrap if and only if the layer does")
    if min(b for t in range(tiling.size) for _, b in tiling.bounds(t).axes[: layer.box.num_dims]) < at_once:
        raise ValueError(f"a tile is less than {at_once} cells wide")
    cells = layer.cells.withColumn("tile", tiling.tile_of()).select("tile", "x", "y", F.col("value").cast("double").alias("value"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return _packed(rows, tiling)

    def diffuse(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return _diffused(rows, tiling, width, rate)

        return run

    tiles, done = cells.groupBy("tile").applyInPandas(pack, _TILE), 0
    while done < steps:
        now = min(at_once, steps - done)
        dealt = tiles.mapInPandas(partial(_dealt, tiling=tiling, width=now), _PART)
        tiles = dealt.groupBy("tile").applyInPandas(diffuse(now), _TILE)
        done += now
        tiles = keep(tiles, f"tiles{done}") if keep else tiles
    bounds = F.broadcast(tiling.tiles(layer.cells.sparkSession))
    out = tiles.join(bounds, "tile").select("xmin", "xextent", "ymin", F.posexplode("values").alias("n", "value"))
    place = [(F.col("xmin") + F.col("n") % F.col("xextent")).alias("x"), (F.col("ymin") + F.floor(F.col("n") / F.col("xextent"))).alias("y"), F.lit(0).cast("long").alias("z")]
    return ValueLayer(out.select(*place, "value"), layer.box, layer.border, layer.tiling)
