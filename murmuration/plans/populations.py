"""Queries on populations: lookups, counts, set changes, migration, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import _mixed, _spread, _Text, choice, draw_sql, integers, shuffled, uniform, uniform_sql
from ..functions.geometry import BorderType
from ..operators.network import Network
from ..operators.population import UID, Population
from ..operators.space import Space
from .catalog import query
from .views import GRID, TILES, Views, with_views

_ROW = "id, type, uid_rank, seq"
TILES_CTE = """tiles AS (SELECT CAST(cx * 2 + cy AS INT) AS tile, cx, cy, cx * 10 AS xmin, CAST(10 AS BIGINT) AS xextent,
    CASE cy WHEN 0 THEN 0 ELSE 13 END AS ymin, CASE cy WHEN 0 THEN 13 ELSE 12 END AS yextent FROM range(4) a(cx), range(2) b(cy))"""
STRIPS_CTE = """strips AS (SELECT a.tile AS src_tile, b.tile AS dst_tile,
    CASE WHEN b.cx > a.cx THEN a.xmin + a.xextent - 2 ELSE a.xmin END AS xmin, CASE WHEN b.cx < a.cx THEN a.xmin + 2 ELSE a.xmin + a.xextent END AS xmax,
    CASE WHEN b.cy > a.cy THEN a.ymin + a.yextent - 2 ELSE a.ymin END AS ymin, CASE WHEN b.cy < a.cy THEN a.ymin + 2 ELSE a.ymin + a.yextent END AS ymax
    FROM tiles a, tiles b WHERE abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.tile <> b.tile)"""
TILE_SQL = """(CASE WHEN x < 40 THEN x // 10 ELSE 3 END) * 2 + (CASE WHEN y < 13 THEN 0 ELSE 1 END)"""


@query("agent_rows", with_views(f"SELECT {_ROW} FROM agents", "agents"))
def _(v: Views):
    return v.agents()


@query("agent_type_invalid", with_views("SELECT type < 0 AS invalid, count(*) AS n FROM agents GROUP BY 1", "agents"))
def _(v: Views):
    return v.agents().groupBy((F.col("type") < 0).alias("invalid")).agg(F.count("*").alias("n"))


@query("agent_filter_type", with_views(f"SELECT {_ROW}, tile FROM population WHERE type = 1", "population"))
def _(v: Views):
    return v.population().agents(1)


@query("agent_limit_insertion", with_views(f"SELECT {_ROW}, tile FROM population ORDER BY seq LIMIT 25", "population"))
def _(v: Views):
    return v.population().agents(count=25)


@query("agent_shuffle_topk", with_views(f"SELECT {_ROW}, tile FROM population WHERE type = 0 ORDER BY {draw_sql('seq', 0, 0)}, seq LIMIT 20", "population"))
def _(v: Views):
    return v.population().agents(0, 20, shuffle=True)


@query("agent_lookup", with_views(f"SELECT {_ROW}, tile FROM population WHERE id = 7 AND type = 1 AND uid_rank = 3", "population"))
def _(v: Views):
    return v.population().agent((7, 1, 3))


@query("context_ghost_lookup", with_views(f"SELECT {_ROW}, tile FROM population WHERE id = 7 AND type = 1 AND uid_rank = 3 AND tile <> 2", "population"))
def _(v: Views):
    return v.population().ghost_agent((7, 1, 3), 2)


@query("context_size", with_views("SELECT type, count(*) AS n FROM agents GROUP BY type", "agents"))
def _(v: Views):
    return v.population().sizes().filter("type >= 0")


@query("context_size_total", with_views("SELECT coalesce(type, -1) AS type, count(*) AS n FROM agents GROUP BY GROUPING SETS ((type), ())", "agents"))
def _(v: Views):
    return v.population().sizes()


@query("context_contains_type", with_views("SELECT t AS type, EXISTS (SELECT 1 FROM agents a WHERE a.type = t) AS there FROM (VALUES (0), (1), (2)) q(t)", "agents"))
def _(v: Views):
    asked = v.spark.createDataFrame([(0,), (1,), (2,)], "type int")
    there = v.agents().select("type").distinct().withColumn("there", F.lit(True))
    return asked.join(there, "type", "left").select("type", F.coalesce("there", F.lit(False)).alias("there"))


@query("context_remove", with_views(f"SELECT {_ROW}, tile FROM population WHERE NOT (type = 0 AND id % 3 = 0)", "population"))
def _(v: Views):
    return v.population().remove(v.agents().filter("type = 0 AND id % 3 = 0")).df


@query("context_add", with_views(f", new AS (SELECT id + (CASE WHEN id % 2 = 0 THEN 5000000 ELSE 0 END) AS id, type, uid_rank, seq + (CASE WHEN id % 2 = 0 THEN 5000000 ELSE 0 END) AS seq FROM agents) SELECT {_ROW} FROM agents UNION SELECT {_ROW} FROM new WHERE id >= 5000000", "agents"))
def _(v: Views):
    shift = F.when(F.col("id") % 2 == 0, 5_000_000).otherwise(0)
    new = v.agents().withColumns({"id": F.col("id") + shift, "seq": F.col("seq") + shift})
    return Population(v.agents()).add(new).df


@query("context_request", with_views(f"SELECT (p.tile + 1) % 8 AS asking_tile, {', '.join('p.' + c for c in _ROW.split(', '))}, p.tile FROM population p", "population"))
def _(v: Views):
    """Each agent is asked for by the tile after its own, and so is one that nobody owns."""
    p = v.population()
    asked = p.df.select(((F.col("tile") + 1) % 8).alias("tile"), *UID)
    nobody = p.df.select(((F.col("tile") + 1) % 8).alias("tile"), (F.col("id") + 9_000_000).alias("id"), "type", "uid_rank")
    return p.request_agents(asked.unionByName(nobody))


@query("context_move_tiles", with_views(f"SELECT {_ROW}, CASE WHEN id % 5 = 0 THEN (tile + 3) % 8 ELSE tile END AS tile FROM population", "population"))
def _(v: Views):
    p = v.population()
    return p.move_agents(p.df.filter("id % 5 = 0").select(*UID, ((F.col("tile") + 3) % 8).alias("tile"))).df


@query("synchronize_tiles", with_views(f"SELECT {_ROW}, CAST({TILE_SQL} AS INT) AS tile FROM locs", "locs"))
def _(v: Views):
    space = v.space()
    return Population(space.locations).synchronize(TILES.tile_of()).df.select(*UID, "seq", "tile")


_SHIFTED_SQL = TILE_SQL.replace("x ", "x2 ").replace("y ", "y2 ")


@query(
    "migration_report",
    with_views(
        f", moved AS (SELECT *, greatest(0, least(39, x + id % 7 - 3)) AS x2, greatest(0, least(24, y + id % 5 - 2)) AS y2 FROM locs),"
        f" t AS (SELECT *, CAST({TILE_SQL} AS INT) AS tile, CAST({_SHIFTED_SQL} AS INT) AS new_tile FROM moved) SELECT id, type, uid_rank, tile, new_tile FROM t WHERE tile <> new_tile",
        "locs",
    ),
)
def _(v: Views):
    space = v.space()
    moves = space.locations.select(*UID, (F.col("x") + F.col("id") % 7 - 3).alias("x"), (F.col("y") + F.col("id") % 5 - 2).alias("y"), "z")
    owners = space.tiles().select(*UID, "tile")
    return Population(space.move(moves).locations.join(owners, UID)).migrations(TILES.tile_of())


@query("uniform_draws", with_views(f"SELECT {_ROW.replace(', seq', '')}, round({uniform_sql('seq', 3, 1)}, 9) AS u FROM agents", "agents"))
def _(v: Views):
    return v.agents().select(*UID, F.round(uniform("seq", 3, 1), 9).alias("u"))


@query("direction_draws", with_views(f"SELECT id, type, CASE WHEN {uniform_sql('seq', 1, 0)} < 0.5 THEN -1 ELSE 1 END AS dx, CASE WHEN {uniform_sql('seq', 1, 1)} < 0.5 THEN -1 ELSE 1 END AS dy FROM agents", "agents"))
def _(v: Views):
    step = lambda k: F.when(uniform("seq", 1, k) < 0.5, -1).otherwise(1)
    return v.agents().select("id", "type", step(0).alias("dx"), step(1).alias("dy"))


@query("random_local_pt", with_views(f"SELECT id, type, uid_rank, CAST(floor({uniform_sql('seq', 0, 0)} * 40) AS BIGINT) AS x, CAST(floor({uniform_sql('seq', 0, 1)} * 25) AS BIGINT) AS y FROM agents", "agents"))
def _(v: Views):
    return v.space(BorderType.STICKY).random_points(v.agents()).select(*UID, "x", "y")


@query("set_union", with_views("SELECT id FROM agents WHERE type = 0 UNION ALL SELECT id FROM agents WHERE type = 1", "agents"))
def _(v: Views):
    a = v.agents()
    return a.filter("type = 0").select("id").unionAll(a.filter("type = 1").select("id"))


@query("set_distinct", with_views("SELECT DISTINCT id % 100 AS id FROM agents", "agents"))
def _(v: Views):
    return v.agents().select((F.col("id") % 100).alias("id")).distinct()


@query("set_except", with_views("SELECT id FROM agents WHERE type = 0 EXCEPT SELECT id FROM agents WHERE type = 1", "agents"))
def _(v: Views):
    a = v.agents()
    return a.filter("type = 0").select("id").subtract(a.filter("type = 1").select("id"))


@query("set_intersect", with_views("SELECT id FROM agents WHERE type = 0 INTERSECT SELECT id FROM agents WHERE type = 1", "agents"))
def _(v: Views):
    a = v.agents()
    return a.filter("type = 0").select("id").intersect(a.filter("type = 1").select("id"))


@query("context_add_projections", with_views(", m AS (SELECT * FROM agents WHERE type = 0 OR id % 3 = 0 UNION ALL SELECT id + 5000000, 2, uid_rank, seq + 5000000 FROM agents WHERE type = 1) SELECT m.id, m.type, m.uid_rank, l.x, l.y FROM m LEFT JOIN (SELECT * FROM locs WHERE type = 0) l USING (id, type, uid_rank)", "locs"))
def _(v: Views):
    first = Population(v.agents().filter("type = 0 OR id % 3 = 0"))
    # placed members of type 0: those that the space lacks are added when it is registered, new agents when they come
    first.add_projection("grid", Space(v.space().locations.filter("type = 0"), GRID))
    new = v.agents().filter("type = 1").select((F.col("id") + 5_000_000).alias("id"), F.lit(2).alias("type"), "uid_rank", (F.col("seq") + 5_000_000).alias("seq"))
    return first.add(new).get_projection("grid").locations.select(*UID, "x", "y")


@query("context_remove_network", with_views("SELECT 'edge' AS kind, src AS a, dst AS b FROM ring WHERE src % 3 <> 0 AND dst % 3 <> 0 AND src IN (SELECT c_custkey FROM customer) AND dst IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'node', id, 0 FROM agents WHERE type = 0 AND id % 3 <> 0", "agents", "ring"))
def _(v: Views):
    customers = v.agents().filter("type = 0")
    known = customers.select("id")
    edges = v.ring().edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    people = Population(customers)
    people.add_projection("friends", Network.create(customers.select(*UID).limit(0), edges.select("src", "dst"), True).remove_nodes(known).add(customers))
    people.projections["friends"] = people.get_projection("friends").add_edges(edges.select("src", "dst"))
    left = people.remove(customers.filter("id % 3 = 0")).get_projection("friends")
    edges = left.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return edges.unionByName(left.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(0).alias("b")))


@query("synchronize_projections", with_views(f", {TILES_CTE}, {STRIPS_CTE} SELECT t.tile, s.dst_tile, t.id, t.type, t.uid_rank, t.x, t.y FROM tiled t JOIN strips s ON t.tile = s.src_tile AND t.x >= s.xmin AND t.x < s.xmax AND t.y >= s.ymin AND t.y < s.ymax", "tiled"))
def _(v: Views):
    people = v.population()
    people.add_projection("grid", v.space())
    moved, halos = people.synchronize_with("grid")
    return halos["grid"].join(moved.df.select(*UID, "tile"), UID).select("tile", "dst_tile", *UID, "x", "y")


@query("agent_changes", with_views("SELECT id, type, uid_rank, (tile + 3) % 8 AS tile FROM population WHERE id % 5 = 0", "population"))
def _(v: Views):
    p = v.population()
    moved = p.move_agents(p.df.filter("id % 5 = 0").select(*UID, ((F.col("tile") + 3) % 8).alias("tile")))
    return moved.changes(p.df, ["tile"]).select(*UID, "tile")


@query("agent_update", with_views("SELECT id, type, uid_rank, CASE WHEN id % 4 = 1 THEN NULL ELSE tile END AS tile FROM population", "population"))
def _(v: Views):
    p = v.population()
    return p.update(p.df.filter("id % 4 = 1").select(*UID, F.lit(None).cast("int").alias("tile"))).df.select(*UID, "tile")


@query("agent_views", with_views("SELECT a.type, l.y, count(*) AS n FROM agents a JOIN locs l USING (id, type, uid_rank) GROUP BY 1, 2", "locs"))
def _(v: Views):
    people = Population(v.agents())
    people.add_projection("grid", v.space())
    people.register_views("murmuration_")
    return v.spark.sql("SELECT a.type, l.y, count(*) AS n FROM murmuration_agents a JOIN murmuration_grid_locations l USING (id, type, uid_rank) GROUP BY 1, 2")


@query("integer_draws", with_views(f"SELECT {_ROW}, CAST(floor({uniform_sql('seq', 2, 5)} * 7) AS BIGINT) - 3 AS n FROM agents", "agents"))
def _(v: Views):
    return v.agents().select("*", integers(-3, 4, "seq", 2, 5).alias("n"))


@query("choice_draws", with_views(f"SELECT {_ROW}, ['a', 'b', 'c'][CAST(floor({uniform_sql('seq', 4, 6)} * 3) AS INT) + 1] AS chosen FROM agents", "agents"))
def _(v: Views):
    return v.agents().select("*", choice(F.array(*map(F.lit, "abc")), "seq", 4, 6).alias("chosen"))


def _shuffled_sql() -> str:
    first, then = _Text(f"({draw_sql('seq', 1, 7)})"), _spread(_Text("CAST(i AS BIGINT)"))
    return with_views(f"SELECT id, type, string_agg(x, '' ORDER BY d, i) AS shuffled FROM (SELECT *, {_mixed(first + then)} AS d FROM agents, (VALUES (0, 'p'), (1, 'q'), (2, 'r'), (3, 's')) o(i, x)) GROUP BY 1, 2", "agents")


@query("shuffled_draws", _shuffled_sql())
def _(v: Views):
    items = F.array(*map(F.lit, "pqrs"))
    return v.agents().select("id", "type", F.array_join(shuffled(items, "seq", 1, 7), "").alias("shuffled"))


@query("random_tile_pt", with_views(f", {TILES_CTE} SELECT p.id, p.type, p.uid_rank, p.tile, CAST(floor({uniform_sql('p.seq', 0, 0)} * t.xextent) + t.xmin AS BIGINT) AS x, CAST(floor({uniform_sql('p.seq', 0, 1)} * t.yextent) + t.ymin AS BIGINT) AS y FROM population p JOIN tiles t USING (tile)", "population"))
def _(v: Views):
    return v.space().random_tile_points(v.population().df).select(*UID, "tile", "x", "y")
