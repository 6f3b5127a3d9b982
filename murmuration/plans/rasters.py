"""Queries on value layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..functions.geometry import BorderType, BoundingBox, Tiling
from ..models import diffusion
from ..operators.raster import ReadWriteLayer, ValueLayer
from ..operators.tiles import diffuse_tiles
from ..sources.scratch import Scratch
from .catalog import query
from .views import RASTER, Views, with_views

_NEAR = "(VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 0, 0), (5, 1, 0), (6, -1, 1), (7, 0, 1), (8, 1, 1)) o(k, dx, dy)"


@query("layer_init", f"SELECT x, y, CAST(0 AS BIGINT) AS z, round({uniform_sql('y * 50 + x', 0, 0)}, 9) AS value FROM range(50) a(x), range(7) b(y)")
def _(v: Views):
    return ValueLayer.create(v.spark, RASTER, init="random").cells.withColumn("value", F.round("value", 9))


@query("layer_get", with_views("SELECT id, type, c.value FROM raw_points p JOIN cells c ON c.x = greatest(0, least(49, p.x)) AND c.y = greatest(0, least(6, p.y))", "raw_points", "cells"))
def _(v: Views):
    return v.layer().get(v.raw_points()).select("id", "type", "value")


@query("layer_set", with_views(", u AS (SELECT greatest(0, least(49, x)) AS x, greatest(0, least(6, y)) AS y, arg_max(id * 1.0, seq) AS value FROM raw_points GROUP BY 1, 2) SELECT c.x, c.y, coalesce(u.value, c.value) AS value FROM cells c LEFT JOIN u USING (x, y)", "raw_points", "cells"))
def _(v: Views):
    updates = v.raw_points().select("x", "y", "z", F.col("id").cast("double").alias("value"), "seq")
    return v.layer().set(updates).cells.select("x", "y", "value")


def _near_sql(periodic: bool) -> str:
    if periodic:
        place = "((p.x + o.dx) % 50 + 50) % 50 AS nx, ((p.y + o.dy) % 7 + 7) % 7 AS ny"
        return with_views(f", n AS (SELECT p.x, p.y, o.k AS ordinal, {place} FROM cells p, {_NEAR}) SELECT n.x, n.y, n.ordinal, nx, ny, c.value FROM n JOIN cells c ON c.x = nx AND c.y = ny", "cells")
    return with_views(f"SELECT p.x, p.y, o.k AS ordinal, c.x AS nx, c.y AS ny, c.value FROM cells p, {_NEAR}, cells c WHERE c.x = p.x + o.dx AND c.y = p.y + o.dy", "cells")


def _near(border: BorderType):
    def run(v: Views):
        layer = v.layer(border)
        near = layer.neighbourhoods(layer.cells)
        return near.select(F.col("of_x").alias("x"), F.col("of_y").alias("y"), "ordinal", F.col("x").alias("nx"), F.col("y").alias("ny"), "value")

    return run


query("layer_nghs", _near_sql(False))(_near(BorderType.STICKY))
query("layer_nghs_periodic", _near_sql(True))(_near(BorderType.PERIODIC))


@query("layer_rw_swap", with_views("SELECT x, y, value AS before, value * 2 AS after FROM cells", "cells"))
def _(v: Views):
    layer = v.layer()
    double = ReadWriteLayer(layer, layer).set(layer.cells.select("x", "y", "z", (F.col("value") * 2).alias("value"), F.lit(0).alias("seq")))
    before = double.get(layer.cells.select("x", "y", "z")).withColumnRenamed("value", "before")
    after = double.swap().get(layer.cells.select("x", "y", "z")).withColumnRenamed("value", "after")
    return before.join(after, ["x", "y", "z"]).select("x", "y", "before", "after")


@query("layer_halo", with_views(", t AS (SELECT *, (x // 25) AS tile FROM cells) SELECT tile AS src_tile, 1 - tile AS dst_tile, x, y, value FROM t WHERE x IN (23, 24) AND tile = 0 OR x IN (25, 26) AND tile = 1", "cells"))
def _(v: Views):
    layer = v.layer()
    layer = ValueLayer(layer.cells, RASTER, tiling=Tiling(RASTER, (2, 1)))
    return layer.halo(2).select("src_tile", "dst_tile", "x", "y", "value")


def diffusion_sql(steps: int, periodic: bool, rate: float = 0.1) -> str:
    """`steps` unrolled steps over the cells, the last named s<steps>."""
    sides = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy)"
    body = ", s0 AS (SELECT x, y, value FROM cells)"
    for k in range(1, steps + 1):
        place = "c.x = ((p.x + o.dx) % 50 + 50) % 50 AND c.y = ((p.y + o.dy) % 7 + 7) % 7" if periodic else "c.x = p.x + o.dx AND c.y = p.y + o.dy"
        body += f", s{k} AS (SELECT p.x, p.y, p.value + {rate} * sum(c.value - p.value) AS value FROM s{k - 1} p, {sides}, s{k - 1} c WHERE {place} GROUP BY p.x, p.y, p.value)"
    return with_views(body + f" SELECT x, y, round(value, 6) AS value FROM s{steps}", "cells")


for _name, _border, _steps in (("layer_diffuse_sticky", BorderType.STICKY, 1), ("layer_diffuse_periodic", BorderType.PERIODIC, 1), ("model_diffusion_k", BorderType.STICKY, 3)):

    @query(_name, diffusion_sql(_steps, _border == BorderType.PERIODIC))
    def _(v: Views, border=_border, steps=_steps):
        return diffusion.run(v.layer(border), steps).cells.select("x", "y", F.round("value", 6).alias("value"))


@query("tile_buffered_bounds", "SELECT * FROM (VALUES (0, 0, 32, 0, 42), (1, 0, 32, 38, 44), (2, 0, 32, 78, 42), (3, 28, 34, 0, 42), (4, 28, 34, 38, 44), (5, 28, 34, 78, 42), (6, 58, 32, 0, 42), (7, 58, 32, 38, 44), (8, 58, 32, 78, 42)) t(tile, xmin, xextent, ymin, yextent)")
def _(v: Views):
    tiling = Tiling.balanced(BoundingBox(0, 90, 0, 120), 9)
    rows = [(t, *(n for side in tiling.buffered(t, 2).axes[:2] for n in side)) for t in range(tiling.size)]
    return v.spark.createDataFrame(rows, "tile int, xmin long, xextent long, ymin long, yextent long")


@query("layer_diffuse_tiles", diffusion_sql(3, False))
def _(v: Views):
    tiles = Tiling(RASTER, (4, 2))
    return diffuse_tiles(v.layer(), 3, tiles, at_once=2, keep=Scratch(v.spark, "tiles").write).cells.select("x", "y", F.round("value", 6).alias("value"))


@query("layer_diffuse_tiles_periodic", diffusion_sql(3, True))
def _(v: Views):
    tiles = Tiling(RASTER, (3, 1), periodic=True)
    return diffuse_tiles(v.layer(BorderType.PERIODIC), 3, tiles, at_once=3).cells.select("x", "y", F.round("value", 6).alias("value"))


@query("layer_rows", with_views("SELECT y, z, string_agg(CAST(value AS BIGINT), ',' ORDER BY x) AS listed FROM cells GROUP BY 1, 2", "cells"))
def _(v: Views):
    return v.layer().rows().select("y", "z", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("listed"))


@query("layer_dtype", "SELECT x, y, CAST(7 AS INT) AS value FROM range(50) a(x), range(7) b(y)")
def _(v: Views):
    return ValueLayer.create(v.spark, RASTER, init=7.9, dtype="int").cells.select("x", "y", "value")


@query("layer_rw_nghs", with_views(f"SELECT p.x, p.y, o.k AS ordinal, c.value AS before, c.value + 1 AS after FROM cells p, {_NEAR}, cells c WHERE c.x = p.x + o.dx AND c.y = p.y + o.dy", "cells"))
def _(v: Views):
    layer = v.layer()
    points = layer.cells.select("x", "y", "z")
    double = ReadWriteLayer(layer, layer).set(layer.cells.select("x", "y", "z", (F.col("value") + 1).alias("value"), F.lit(0).alias("seq")))
    shown = lambda d, name: d.neighbourhoods(points).select(F.col("of_x").alias("x"), F.col("of_y").alias("y"), "ordinal", F.col("value").alias(name))
    return shown(double, "before").join(shown(double.swap(), "after"), ["x", "y", "ordinal"])
