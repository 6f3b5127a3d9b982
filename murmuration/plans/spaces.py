"""Queries on borders, neighbourhoods, tiles, grids and continuous spaces."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from ..functions.draws import draw_array, uniform_sql
from ..functions.geometry import BorderType, BoundingBox, OccupancyType, Tiling, bordered, neighbours
from ..models.zombies import limits
from ..operators.population import UID
from ..operators.space import Space
from ..operators.tiles import step_agents
from .catalog import query
from .populations import STRIPS_CTE, TILE_SQL, TILES_CTE
from .views import GRID, PLANE, TILES, Views, periodic_sql, sticky_sql, with_views

_UID = "id, type, uid_rank"


@query("border_sticky_grid", with_views(f"SELECT {_UID}, {sticky_sql('x', 0, 40)} AS x, {sticky_sql('y', 0, 25)} AS y, CAST(0 AS BIGINT) AS z FROM raw_points", "raw_points"))
def _(v: Views):
    return v.raw_points().select(*UID, *bordered(GRID, BorderType.STICKY))


@query("border_periodic_grid", with_views(f"SELECT {_UID}, {periodic_sql('x', 0, 40)} AS x, {periodic_sql('y', 0, 25)} AS y, CAST(0 AS BIGINT) AS z FROM raw_points", "raw_points"))
def _(v: Views):
    return v.raw_points().select(*UID, *bordered(GRID, BorderType.PERIODIC))


@query("border_sticky_cont", with_views(f"SELECT {_UID}, round({sticky_sql('x', 0, 400, 1e-8)}, 9) AS x, round({sticky_sql('y', 0, 120, 1e-8)}, 9) AS y FROM plane_points", "plane_points"))
def _(v: Views):
    x, y, _ = bordered(PLANE, BorderType.STICKY, True)
    return v.plane_points().select(*UID, F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query("border_periodic_cont", with_views(f"SELECT {_UID}, round({periodic_sql('(x - 200)', 0, 400)}, 6) AS x, round({periodic_sql('(y - 60)', 0, 120)}, 6) AS y FROM plane_points", "plane_points"))
def _(v: Views):
    x, y, _ = bordered(PLANE, BorderType.PERIODIC, True, F.col("x") - 200, F.col("y") - 60, "z")
    return v.plane_points().select(*UID, F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_BOX3 = [(0, 39), (0, 24), (0, 3)]


def _neighbours_sql(dims: int, periodic: bool, lims: list[tuple[int, int]], top_first: bool = False) -> str:
    ys = (1, 0, -1) if top_first else (-1, 0, 1)
    steps = product((-1, 0, 1) if dims > 2 else (0,), ys if dims > 1 else (0,), (-1, 0, 1))
    values = ", ".join(f"({k}, {dx}, {dy}, {dz})" for k, (dz, dy, dx) in enumerate(steps))
    axes = list(zip(("x", "y", "z"), lims, strict=False))[:dims]
    place = {c: f"CAST({periodic_sql(f'(p.{c} + o.d{c})', lo, hi - lo + 1) if periodic else f'p.{c} + o.d{c}'} AS BIGINT)" for c, (lo, hi) in axes}
    test = "" if periodic else " WHERE " + " AND ".join(f"p.{c} + o.d{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in axes)
    shown = ", ".join(f"{place.get(c, 'CAST(0 AS BIGINT)')} AS n{c}" for c in "xyz")
    points = "SELECT id, type, x, y, id % 4 AS z FROM locs"
    return with_views(f"SELECT p.id, p.type, o.k AS ordinal, {shown} FROM ({points}) p, (VALUES {values}) o(k, dx, dy, dz){test}", "locs")


def _neighbours(dims: int, periodic: bool, lims=None, top_first: bool = False):
    def run(v: Views):
        points = v.space().locations.select("id", "type", "x", "y", (F.col("id") % 4).alias("z"))
        listed = points.select("id", "type", F.explode(neighbours((lims or _BOX3)[:dims], periodic, top_first)).alias("n"))
        return listed.select("id", "type", "n.ordinal", *(F.col(f"n.{c}").alias(f"n{c}") for c in "xyz"))

    return run


for _dims in (1, 2, 3):
    for _periodic in (False, True):
        query(f"nghs_{_dims}d_{'periodic' if _periodic else 'sticky'}", _neighbours_sql(_dims, _periodic, _BOX3))(_neighbours(_dims, _periodic))
query("nghs_top_row_first", _neighbours_sql(2, False, limits(GRID), True))(_neighbours(2, False, limits(GRID), True))

_TILES_SQL = TILES_CTE


@query("tile_bounds", f"WITH {_TILES_SQL} SELECT tile, xmin, xextent, ymin, yextent, 0 AS zmin, 0 AS zextent FROM tiles")
def _(v: Views):
    return TILES.tiles(v.spark)


@query("tile_assignment", with_views(f"SELECT {_UID}, CAST({TILE_SQL} AS INT) AS tile FROM locs", "locs"))
def _(v: Views):
    return v.space().tiles().select(*UID, "tile")


@query("tile_neighbours", f"WITH {_TILES_SQL} SELECT a.tile, b.tile AS neighbour FROM tiles a, tiles b WHERE abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.tile <> b.tile")
def _(v: Views):
    return TILES.neighbour_table(v.spark)


_STRIPS_SQL = STRIPS_CTE


@query("halo_strips", f"WITH {_TILES_SQL}, {_STRIPS_SQL} SELECT src_tile, dst_tile, xmin, xmax, ymin, ymax FROM strips")
def _(v: Views):
    return TILES.strips(v.spark, 2).drop("zmin", "zmax")


@query("halo_exchange", with_views(f", {_TILES_SQL}, {_STRIPS_SQL}, t AS (SELECT *, CAST({TILE_SQL} AS INT) AS tile FROM locs) SELECT s.src_tile, s.dst_tile, {', '.join('t.' + c for c in _UID.split(', '))}, t.x, t.y, t.z FROM t JOIN strips s ON t.tile = s.src_tile AND t.x >= s.xmin AND t.x < s.xmax AND t.y >= s.ymin AND t.y < s.ymax", "locs"))
def _(v: Views):
    return v.space().halo()


@query("halo_reference_counts", with_views(f", {_TILES_SQL}, {_STRIPS_SQL}, t AS (SELECT *, CAST({TILE_SQL} AS INT) AS tile FROM locs) SELECT t.id, t.type, t.uid_rank, count(*) AS n FROM t JOIN strips s ON t.tile = s.src_tile AND t.x >= s.xmin AND t.x < s.xmax AND t.y >= s.ymin AND t.y < s.ymax GROUP BY 1, 2, 3", "locs"))
def _(v: Views):
    return v.space().halo().groupBy(*UID).agg(F.count("*").alias("n"))


@query("box_contains", with_views("SELECT id, type, x >= 50 AND x < 150 AND y >= 20 AND y < 70 AS inside FROM plane", "plane"))
def _(v: Views):
    return v.plane().locations.select("id", "type", BoundingBox(50, 100, 20, 50).contains().alias("inside"))


@query("within_box", with_views("SELECT id, type FROM plane WHERE x >= 50 AND x < 150 AND y >= 20 AND y < 70", "plane"))
def _(v: Views):
    return v.plane().within(BoundingBox(50, 100, 20, 50)).select("id", "type")


@query("within_many_boxes", with_views(", boxes AS (SELECT n_nationkey AS box_id, (n_nationkey * 37) % 380 AS xmin, 20 AS xextent, (n_nationkey * 11) % 100 AS ymin, 20 AS yextent FROM nation) SELECT b.box_id, count(p.id) AS n FROM boxes b LEFT JOIN plane p ON p.x >= b.xmin AND p.x < b.xmin + b.xextent AND p.y >= b.ymin AND p.y < b.ymin + b.yextent GROUP BY 1", "plane"))
def _(v: Views):
    key = F.col("n_nationkey")
    boxes = v.table("nation").select(key.alias("box_id"), (key * 37 % 380).alias("xmin"), F.lit(20).alias("xextent"), (key * 11 % 100).alias("ymin"), F.lit(20).alias("yextent"))
    counts = v.plane().within_many(boxes, 20).groupBy("box_id").agg(F.count("*").alias("n"))
    return boxes.select("box_id").join(counts, "box_id", "left").select("box_id", F.coalesce("n", F.lit(0)).alias("n"))


def _moved(border: BorderType):
    def run(v: Views):
        moves = v.agents().select(*UID, (F.col("id") % 50 - 5).alias("x"), (F.col("id") % 31 - 3).alias("y"), F.lit(0).alias("z"))
        return v.space(border).move(moves).locations.select(*UID, "x", "y")

    return run


query("grid_move_sticky", with_views(f"SELECT {_UID}, {sticky_sql('(id % 50 - 5)', 0, 40)} AS x, {sticky_sql('(id % 31 - 3)', 0, 25)} AS y FROM agents", "agents"))(_moved(BorderType.STICKY))
query("grid_move_periodic", with_views(f"SELECT {_UID}, {periodic_sql('(id % 50 - 5)', 0, 40)} AS x, {periodic_sql('(id % 31 - 3)', 0, 25)} AS y FROM agents", "agents"))(_moved(BorderType.PERIODIC))


@query("grid_move_arrival", with_views(", m AS (SELECT *, greatest(0, least(39, x + id % 3 - 1)) AS x2 FROM locs) SELECT id, type, uid_rank, x2 AS x, y, CASE WHEN x2 <> x THEN 5 * 1099511627776 + seq ELSE arrival_seq END AS arrival_seq FROM m", "locs"))
def _(v: Views):
    space = v.space()
    moves = space.locations.select(*UID, (F.col("x") + F.col("id") % 3 - 1).alias("x"), "y", "z")
    return space.move(moves, stamp=5).locations.select(*UID, "x", "y", "arrival_seq")


@query("cspace_move", with_views(f"SELECT {_UID}, round({sticky_sql('(x * 1.1 - 10)', 0, 400, 1e-8)}, 6) AS x, round({sticky_sql('(y * 1.2 - 10)', 0, 120, 1e-8)}, 6) AS y FROM plane", "plane"))
def _(v: Views):
    space = v.plane()
    moves = space.locations.select(*UID, (F.col("x") * 1.1 - 10).alias("x"), (F.col("y") * 1.2 - 10).alias("y"), "z")
    return space.move(moves).locations.select(*UID, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "grid_move_single_occ",
    with_views(
        """, firsts AS (SELECT x, y, min(seq) AS seq FROM locs GROUP BY 1, 2), single AS (SELECT l.* FROM locs l JOIN firsts f ON l.seq = f.seq),
        wish AS (SELECT *, greatest(0, least(39, x + id % 3 - 1)) AS tx, greatest(0, least(24, y + id % 2)) AS ty FROM single),
        won AS (SELECT tx, ty, min(seq) AS seq FROM wish w WHERE (tx, ty) <> (x, y) AND NOT EXISTS (SELECT 1 FROM single s WHERE s.x = w.tx AND s.y = w.ty) GROUP BY 1, 2)
        SELECT w.id, w.type, w.uid_rank, CASE WHEN won.seq IS NULL THEN w.x ELSE w.tx END AS x, CASE WHEN won.seq IS NULL THEN w.y ELSE w.ty END AS y FROM wish w LEFT JOIN won ON w.seq = won.seq""",
        "locs",
    ),
)
def _(v: Views):
    locations = v.space().locations
    firsts = locations.groupBy("x", "y").agg(F.min("seq").alias("seq")).select("seq")
    space = Space(locations.join(firsts, "seq"), GRID, BorderType.STICKY, OccupancyType.SINGLE)
    moves = space.locations.select(*UID, (F.col("x") + F.col("id") % 3 - 1).alias("x"), (F.col("y") + F.col("id") % 2).alias("y"), "z")
    return space.move(moves).locations.select(*UID, "x", "y")


@query("space_add_unplaced", with_views(f"SELECT {_UID}, CASE WHEN id % 2 = 0 THEN x END AS x FROM locs", "locs"))
def _(v: Views):
    space = v.space()
    half = Space(space.locations.filter("id % 2 = 0"), GRID)
    return half.add(v.agents()).locations.select(*UID, "x")


@query("space_remove", with_views(f"SELECT {_UID}, x, y FROM locs WHERE id % 4 <> 1", "locs"))
def _(v: Views):
    return v.space().remove(v.agents().filter("id % 4 = 1")).locations.select(*UID, "x", "y")


@query("space_contains", with_views(f"SELECT {_UID} FROM agents WHERE type = 0", "agents"))
def _(v: Views):
    members = Space(v.space().locations.filter("type = 0"), GRID)
    return members.contains(v.agents().select(*UID))


@query("space_location", with_views("SELECT a.id, a.type, a.uid_rank, l.x, l.y, l.z FROM agents a LEFT JOIN (SELECT * FROM locs WHERE type = 0) l USING (id, type, uid_rank)", "locs"))
def _(v: Views):
    return Space(v.space().locations.filter("type = 0"), GRID).location(v.agents().select(*UID))


@query("occupants", with_views(f"SELECT x, y, z, {_UID}, CAST(row_number() OVER (PARTITION BY x, y, z ORDER BY arrival_seq, seq) - 1 AS INT) AS place FROM locs", "locs"))
def _(v: Views):
    return v.space().occupants()


@query("first_occupant", with_views(f"SELECT x, y, z, {_UID} FROM locs QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY arrival_seq, seq) = 1", "locs"))
def _(v: Views):
    return v.space().first_occupants()


_POINTS = "points AS (SELECT x, y, CAST(0 AS BIGINT) AS z FROM range(40) a(x), range(25) b(y))"


def _all_points(v: Views):
    n = F.col("id")
    return v.spark.range(1000).select((n % 40).alias("x"), F.floor(n / 40).alias("y"), F.lit(0).cast("long").alias("z"))


@query("num_agents", with_views(f", {_POINTS} SELECT p.x, p.y, p.z, count(l.id) AS n FROM points p LEFT JOIN locs l USING (x, y) GROUP BY 1, 2, 3", "locs"))
def _(v: Views):
    return v.space().num_agents(_all_points(v))


@query("num_agents_by_type", with_views(f", {_POINTS} SELECT p.x, p.y, p.z, count(l.id) FILTER (l.type = 1) AS n FROM points p LEFT JOIN locs l USING (x, y) GROUP BY 1, 2, 3", "locs"))
def _(v: Views):
    return v.space().num_agents(_all_points(v), 1)


@query("cspace_halo", with_views(", t AS (SELECT *, CASE WHEN x < 200 THEN 0 ELSE 1 END AS tile FROM plane) SELECT tile AS src_tile, 1 - tile AS dst_tile, id, type, uid_rank, round(x, 6) AS x, round(y, 6) AS y FROM t WHERE x >= 195 AND x < 205", "plane"))
def _(v: Views):
    space = replace(v.plane(), tiling=Tiling(PLANE, (2, 1)), buffer_size=5)
    return space.halo().select("src_tile", "dst_tile", *UID, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("cspace_random_pt", with_views(f"SELECT id, type, uid_rank, round({uniform_sql('seq', 3, 0)} * 400, 6) AS x, round({uniform_sql('seq', 3, 1)} * 120, 6) AS y FROM plane_points", "plane_points"))
def _(v: Views):
    return v.plane().random_points(v.plane_points(), 3).select(*UID, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("grid_within_box", with_views(f"SELECT {_UID}, x, y FROM locs WHERE x >= 5 AND x < 25 AND y >= 3 AND y < 13", "locs"))
def _(v: Views):
    return v.space().within(BoundingBox(5, 20, 3, 10)).select(*UID, "x", "y")


@query("space_missing", with_views(f"SELECT {_UID} FROM agents WHERE type = 1", "agents"))
def _(v: Views):
    return Space(v.space().locations.filter("type = 0"), GRID).missing(v.agents())


@query("tile_step_walk", with_views(f"SELECT {_UID}, {sticky_sql(f'x + CASE WHEN {uniform_sql("seq", 1, 0)} < 0.5 THEN -1 ELSE 1 END', 0, 40)} AS x, {sticky_sql(f'y + CASE WHEN {uniform_sql("seq", 1, 1)} < 0.5 THEN -1 ELSE 1 END', 0, 25)} AS y FROM locs", "locs"))
def _(v: Views):
    """The walk's step as a Python function of a tile's agents; the same as the column form's."""

    def step(own, around):
        for k, (c, most) in enumerate((("x", 39), ("y", 24))):
            drawn = draw_array(own["seq"].to_numpy(), 1, k)
            own[c] = (own[c] + (drawn >= 0.5) * 2 - 1).clip(0, most)
        return own[[*UID, "x", "y"]]

    return step_agents(v.space(), step, "id long, type int, uid_rank int, x long, y long")


@query("tile_step_neighbours", with_views(", c AS (SELECT x, y, count(*) AS n FROM locs GROUP BY 1, 2) SELECT l.id, l.type, l.uid_rank, CAST(sum(c.n) AS BIGINT) - 1 AS near FROM locs l JOIN c ON abs(l.x - c.x) <= 1 AND abs(l.y - c.y) <= 1 GROUP BY 1, 2, 3", "locs"))
def _(v: Views):
    """Others in the nine cells around each agent, over the tiles' sides."""

    def step(own, around):
        cells = np.zeros((GRID.xextent + 2, GRID.yextent + 2), int)
        for rows in (own, around):
            np.add.at(cells, (rows["x"].to_numpy() + 1, rows["y"].to_numpy() + 1), 1)
        near = sum(cells[own["x"] + 1 + dx, own["y"] + 1 + dy] for dx in (-1, 0, 1) for dy in (-1, 0, 1))
        return own[UID].assign(near=near - 1)

    return step_agents(v.space(), step, "id long, type int, uid_rank int, near long", buffer_size=1)


@query("tile_accessors", f"WITH {_TILES_SQL} SELECT tile, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, tile AS number, 8 AS size FROM tiles")
def _(v: Views):
    rows = [(t, *TILES.coordinates(t), TILES.number(TILES.coordinates(t)), TILES.size) for t in range(TILES.size)]
    return v.spark.createDataFrame(rows, "tile int, cx int, cy int, number int, size int")


@query("box_dims", "SELECT n_nationkey AS key, CAST(1 + (n_nationkey % 2) + (n_nationkey % 2) * (n_nationkey % 3 // 2) AS INT) AS dims FROM nation")
def _(v: Views):
    """Boxes by nation: those of odd keys have a second side, some of these a third."""
    rows = []
    for r in v.table("nation").select("n_nationkey").collect():  # a row for each nation
        k = r.n_nationkey
        sides = [0, 9, 0, 5 * (k % 2), 0, 7 * (k % 2) * (k % 3 // 2)]
        rows.append((k, BoundingBox(*sides).num_dims))
    return v.spark.createDataFrame(rows, "key int, dims int")
