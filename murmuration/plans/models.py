"""Queries that run the example models for a few ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql, uniform_sql
from ..models import random_walk, rumor, zombies
from ..operators.network import Network
from ..sources.scratch import Scratch
from .catalog import query
from .views import GRID, ZOMBIE_GRID, Views, sticky_sql, with_views


def _walk_sql(ticks: int) -> str:
    body = ", w0 AS (SELECT seq, x, y FROM locs)"
    for t in range(1, ticks + 1):
        step = lambda k: f"CASE WHEN {uniform_sql('seq', t, k)} < 0.5 THEN -1 ELSE 1 END"  # noqa: E731, B023
        body += f", w{t} AS (SELECT seq, {sticky_sql(f'x + {step(0)}', 0, 40)} AS x, {sticky_sql(f'y + {step(1)}', 0, 25)} AS y FROM w{t - 1})"
    rows = " UNION ALL ".join(
        f"SELECT CAST({t} AS DOUBLE) AS tick, CAST(sum(n) AS BIGINT) AS total, least(0, min(n)) AS min, greatest(0, max(n)) AS max FROM (SELECT count(*) OVER (PARTITION BY x, y) - 1 AS n FROM w{t})"
        for t in range(ticks + 1)
    )
    return with_views(f"{body} {rows}", "locs")


@query("model_walk_k", _walk_sql(3))
def _(v: Views):
    return random_walk.run(v.space().locations, 3, GRID)[1]


def _rumor_sql(ticks: int, probability: float) -> str:
    body = ", links AS (SELECT src AS a, dst AS b FROM ring UNION SELECT dst, src FROM ring), i0 AS (SELECT DISTINCT c_custkey AS id, 0 AS tick FROM customer WHERE c_custkey IN (1, 2, 3, 4, 5))"
    for t in range(1, ticks + 1):
        body += f", i{t} AS (SELECT * FROM i{t - 1} UNION ALL SELECT DISTINCT b, {t} FROM links JOIN i{t - 1} ON a = id WHERE {uniform_sql('a * 1000003 + b', t, 0)} <= {probability} AND b NOT IN (SELECT id FROM i{t - 1}))"
    return with_views(f"{body} SELECT t.t AS tick, count(*) AS total_rumor_spreaders, count(*) FILTER (i.tick = t.t) AS new_rumor_spreaders FROM i{ticks} i JOIN range({ticks + 1}) t(t) ON i.tick <= t.t GROUP BY 1", "ring")


for _name, _probability in (("model_rumor_p1", 1.0), ("model_rumor_p", 0.4)):

    @query(_name, _rumor_sql(3, _probability))
    def _(v: Views, probability=_probability):
        ring = v.ring()
        network = Network.create(ring.nodes, ring.edges, False)
        seeds = v.table("customer").filter("c_custkey IN (1, 2, 3, 4, 5)").select(F.col("c_custkey").alias("id"))
        return rumor.run(network, seeds, 3, probability, keep=Scratch(v.spark, "rumor").write)[1]


def _zombies_sql(ticks: int) -> str:
    """Unrolled ticks; each phase is an expression over the one before."""
    cell = f"{sticky_sql('CAST(floor({x}) AS BIGINT)', 0, 40)} AS cx, {sticky_sql('CAST(floor({y}) AS BIGINT)', 0, 25)} AS cy"
    point = f"{sticky_sql('{x}', 0, 40, 1e-8)} AS x, {sticky_sql('{y}', 0, 25, 1e-8)} AS y"
    first = {"x": "px", "y": "py"}
    body = f""", z0 AS (SELECT type, seq, {point.format(**first)}, {cell.format(**first)}, false AS infected, 0 AS duration, seq AS arrival
        FROM (SELECT *, x + (id % 10) / 10.0::DOUBLE AS px, y + (id % 7) / 7.0::DOUBLE AS py FROM locs))"""
    around = "(VALUES (0, -1, 1), (1, 0, 1), (2, 1, 1), (3, -1, 0), (4, 0, 0), (5, 1, 0), (6, -1, -1), (7, 0, -1), (8, 1, -1)) o(k, dx, dy)"

    def move(out: str, state: str, movers: str, others: str, most: bool, number: int, length: float, tick: int, phase: int) -> str:
        order = f"coalesce(n.n, 0) {'DESC' if most else 'ASC'}, d {'DESC' if most else 'ASC'}, k {'DESC' if most else 'ASC'}"
        to = {c: f"CASE WHEN g.gx IS NOT NULL AND (g.gx <> s.cx OR g.gy <> s.cy) THEN s.{c} + (g.g{c} - s.c{c}) * {length} ELSE s.{c} END" for c in "xy"}
        return f""", {out}_n AS (SELECT cx, cy, count(*) AS n FROM {state} WHERE {others} GROUP BY 1, 2),
        {out}_c AS (SELECT m.seq, o.k, m.cx + o.dx AS gx, m.cy + o.dy AS gy, {draw_sql('m.seq * 9 + o.k', tick, number)} AS d FROM {state} m, {around}
            WHERE {movers} AND m.cx + o.dx BETWEEN 0 AND 40 AND m.cy + o.dy BETWEEN 0 AND 25),
        {out}_g AS (SELECT c.seq, gx, gy, coalesce(n.n, 0) AS n, d, k FROM {out}_c c LEFT JOIN {out}_n n ON n.cx = gx AND n.cy = gy
            QUALIFY row_number() OVER (PARTITION BY c.seq ORDER BY {order}) = 1),
        {out}_m AS (SELECT s.type, s.seq, s.cx AS ox, s.cy AS oy, s.infected, s.duration, s.arrival, g.gx IS NOT NULL AND (g.gx <> s.cx OR g.gy <> s.cy) AS goes,
            {to['x']} AS nx, {to['y']} AS ny FROM {state} s LEFT JOIN {out}_g g ON s.seq = g.seq),
        {out}_p AS (SELECT *, {point.format(x='nx', y='ny')}, CASE WHEN goes THEN {cell.format(x='nx', y='ny').replace(' AS cx,', ' ELSE ox END AS cx, CASE WHEN goes THEN').replace(' AS cy', ' ELSE oy END AS cy')} FROM {out}_m),
        {out} AS (SELECT type, seq, x, y, cx, cy, infected, duration, CASE WHEN cx <> ox OR cy <> oy THEN {(2 * tick + phase) << 40} + seq ELSE arrival END AS arrival FROM {out}_p)"""

    for t in range(1, ticks + 1):
        body += move(f"a{t}", f"z{t - 1}", "m.type = 1", "type = 0", True, 1, 0.25, t, 0)
        body += f""", b{t}_f AS (SELECT arg_min(seq, arrival) AS seq FROM a{t} WHERE type = 0 AND (cx, cy) IN (SELECT (cx, cy) FROM a{t} WHERE type = 1) GROUP BY cx, cy),
        b{t} AS (SELECT type, seq, x, y, cx, cy, infected OR seq IN (SELECT seq FROM b{t}_f) AS infected,
            duration + (CASE WHEN type = 0 AND (infected OR seq IN (SELECT seq FROM b{t}_f)) THEN 1 ELSE 0 END) AS duration, arrival FROM a{t})"""
        body += move(f"z{t}", f"b{t}", "m.type = 0 AND m.duration < 10", "type = 1", False, 2, 0.5, t, 1)
    return with_views(f"{body} SELECT type, seq, round(x, 6) AS x, round(y, 6) AS y, cx, cy, infected, duration FROM z{ticks}", "locs")


@query("model_zombies_k", _zombies_sql(2))
def _(v: Views):
    points = v.space().locations.withColumns({"x": F.col("x") + (F.col("id") % 10) / 10.0, "y": F.col("y") + (F.col("id") % 7) / 7.0})
    state, _ = zombies.run(zombies.initial(points, ZOMBIE_GRID), 2, ZOMBIE_GRID, keep=Scratch(v.spark, "zombies").write)
    return state.select("type", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cx", "cy", "infected", "duration")


def _zombies_log_sql(ticks: int) -> str:
    """Counts of each tick before it is run, over the unrolled ticks."""
    rows = " UNION ALL ".join(f"SELECT {t} AS tick, count(*) FILTER (type = 0) AS humans, count(*) FILTER (type = 1) AS zombies FROM z{t - 1}" for t in range(1, ticks + 1))
    return _zombies_sql(ticks).rsplit(" SELECT type, seq, round(x, 6)", 1)[0] + " " + rows


@query("model_zombies_log", _zombies_log_sql(3))
def _(v: Views):
    points = v.space().locations.withColumns({"x": F.col("x") + (F.col("id") % 10) / 10.0, "y": F.col("y") + (F.col("id") % 7) / 7.0})
    return zombies.run(zombies.initial(points, ZOMBIE_GRID), 3, ZOMBIE_GRID, keep=Scratch(v.spark, "zombies").write)[1]


@query("model_zombies_turned")
def _(v: Views):
    """Twelve ticks, so that the first bitten have turned; without a twin, as the unrolled SQL takes too long."""
    points = v.space().locations.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    return zombies.run(zombies.initial(points, ZOMBIE_GRID), 12, ZOMBIE_GRID, keep=Scratch(v.spark, "zombies").write)[1]
