"""Agent-shaped views of the star-schema tables, as DataFrames and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import BorderType, BoundingBox, Tiling
from ..operators.network import Network, dealt, parts_for, shuffled
from ..operators.population import UID, Population, agent_rows
from ..operators.raster import ValueLayer
from ..operators.space import Space
from ..sources.workers import importable

GRID = BoundingBox(0, 40, 0, 25)
PLANE = BoundingBox(0, 400, 0, 120)
RASTER = BoundingBox(0, 50, 0, 7)
TILES = Tiling(GRID, (4, 2))
ZOMBIE_GRID = BoundingBox(0, 40, 0, 25)


class Views:
    """The views over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        importable(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def agents(self) -> DataFrame:
        """Customers (type 0) and suppliers (type 1)."""
        kinds = (("customer", "c_custkey", 0), ("supplier", "s_suppkey", 1))
        parts = [
            agent_rows(self.table(t), key, kind, (F.col(key) % 4).cast("int"), F.col(key) + kind * 1_000_000_000) for t, key, kind in kinds
        ]
        return parts[0].unionByName(parts[1])

    def population(self) -> Population:
        return Population(self.agents().withColumn("tile", (F.col("id") % 8).cast("int")))

    def raw_points(self) -> DataFrame:
        """A point for each agent, some outside the grid on either side."""
        x, y = (F.col("id") * 7 + F.col("type") * 3) % 61 - 10, (F.col("id") * 13 + F.col("type") * 5) % 47 - 10
        return self.agents().select("*", x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("z"))

    def space(self, border: BorderType = BorderType.STICKY) -> Space:
        space = Space(self.raw_points(), GRID, border, tiling=TILES, buffer_size=2)
        arrival = ((F.col("id") * 31) % 1009 * 10_000_000_000 + F.col("seq")).alias("arrival_seq")
        return Space(self.raw_points().select(*UID, "seq", *space.transform(), arrival), GRID, border, tiling=TILES, buffer_size=2)

    def plane_points(self) -> DataFrame:
        """A point of the plane for each event; some lie outside."""
        kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
        rows = agent_rows(self.table("events"), "event_id", kind).drop("seq")
        xy = self.table("events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("user_id") + F.col("value") / 1000).alias("y"))
        return rows.join(xy, "id").select(*UID, F.col("id").alias("seq"), "x", "y", F.lit(0.0).alias("z"))

    def plane(self) -> Space:
        space = Space(self.plane_points(), PLANE, BorderType.STICKY, continuous=True)
        return Space(self.plane_points().select(*UID, "seq", *space.transform(), F.col("seq").alias("arrival_seq")), PLANE, BorderType.STICKY, continuous=True)

    def bipartite(self) -> Network:
        """Customers and the suppliers of their orders; w counts the lines. Suppliers' ids are negative."""
        orders, lines = self.table("orders").select("o_orderkey", "o_custkey"), self.table("lineitem").select("l_orderkey", "l_suppkey")
        parts = parts_for(self.spark, lines.count())
        lines = dealt(orders, parts, "o_orderkey").join(shuffled(dealt(lines, parts, "l_orderkey")), F.col("o_orderkey") == F.col("l_orderkey"))
        customer, supplier = F.col("o_custkey"), -F.col("l_suppkey") - 1
        ends = lines.select(F.least(customer, supplier).alias("src"), F.greatest(customer, supplier).alias("dst"))
        # canonical and without repeats, as Network.create() would make them
        edges = dealt(ends, parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
        return Network(self.nodes(), edges, False, parts).with_ends()

    def nodes(self) -> DataFrame:
        return self.agents().select(F.when(F.col("type") == 0, F.col("id")).otherwise(-F.col("id") - 1).alias("id"), "type")

    def ring(self) -> Network:
        """Two links from each customer to others, by arithmetic on the key."""
        customers = self.table("customer")
        n = customers.count()
        key = F.col("c_custkey")
        ends = F.explode(F.array((key * 31 + 17) % n, (key * 7 + 3) % n))
        edges = customers.select(key.alias("src"), ends.alias("dst")).filter("src != dst").distinct()
        return Network.create(customers.select(key.alias("id")), edges, True)

    def layer(self, border: BorderType = BorderType.STICKY) -> ValueLayer:
        """Lines by quantity and number."""
        cells = self.table("lineitem").groupBy((F.col("l_quantity").cast("long") - 1).alias("x"), (F.col("l_linenumber").cast("long") - 1).alias("y")).agg(F.count("*").cast("double").alias("value"))
        empty = ValueLayer.create(self.spark, RASTER, border)
        filled = empty.cells.drop("value").join(cells, ["x", "y"], "left").select("x", "y", "z", F.coalesce("value", F.lit(0.0)).alias("value"))
        return ValueLayer(filled, RASTER, border)

    def schedule(self) -> DataFrame:
        """Events as scheduled ones: the hour is the tick, the type sets the priority class."""
        kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 3).otherwise(2)
        hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - F.lit(473352)
        return self.table("events").select(hours.alias("at"), F.col("event_id").alias("order_idx"), kind.alias("priority_type"), F.col("value").alias("priority"))

    def tick_log(self) -> DataFrame:
        day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
        return self.table("events").select(day.alias("tick"), (F.col("user_id") % 4).cast("int").alias("uid_rank"), F.col("event_id").alias("seq"), F.col("value").alias("v"))


def sticky_sql(c: str, low: float, extent: float, edge: float = 1) -> str:
    return f"greatest({low}, least({low + extent - edge!r}, {c}))"


def periodic_sql(c: str, low: int, extent: int) -> str:
    return f"CASE WHEN ({c} - {low}) % {extent} < 0 THEN ({c} - {low}) % {extent} + {low + extent} ELSE ({c} - {low}) % {extent} + {low} END"


_CTES = {
    "agents": """SELECT c_custkey AS id, 0 AS type, CAST(c_custkey % 4 AS INT) AS uid_rank, c_custkey AS seq FROM customer
        UNION ALL SELECT s_suppkey, 1, CAST(s_suppkey % 4 AS INT), s_suppkey + 1000000000 FROM supplier""",
    "population": "SELECT *, CAST(id % 8 AS INT) AS tile FROM agents",
    "raw_points": "SELECT *, (id * 7 + type * 3) % 61 - 10 AS x, (id * 13 + type * 5) % 47 - 10 AS y, CAST(0 AS BIGINT) AS z FROM agents",
    "locs": f"""SELECT id, type, uid_rank, seq, {sticky_sql('x', 0, 40)} AS x, {sticky_sql('y', 0, 25)} AS y, CAST(0 AS BIGINT) AS z,
        (id * 31) % 1009 * 10000000000 + seq AS arrival_seq FROM raw_points""",
    "plane_points": """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS type, 0 AS uid_rank,
        event_id AS seq, value AS x, user_id + value / 1000 AS y, CAST(0 AS DOUBLE) AS z FROM events""",
    "plane": f"""SELECT id, type, uid_rank, seq, {sticky_sql('x', 0, 400, 1e-8)} AS x, {sticky_sql('y', 0, 120, 1e-8)} AS y FROM plane_points""",
    "tiled": """SELECT *, CAST((CASE WHEN x < 40 THEN x // 10 ELSE 3 END) * 2 + (CASE WHEN y < 13 THEN 0 ELSE 1 END) AS INT) AS tile FROM locs""",
    "bip_edges": """SELECT o_custkey AS src, -l_suppkey - 1 AS dst, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "bip": "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, w FROM bip_edges",
    "nodes": "SELECT CASE WHEN type = 0 THEN id ELSE -id - 1 END AS id, type FROM agents",
    "ring": """SELECT DISTINCT c_custkey AS src, e AS dst FROM (SELECT c_custkey, unnest([(c_custkey * 31 + 17) % n, (c_custkey * 7 + 3) % n]) AS e
        FROM customer, (SELECT count(*) AS n FROM customer)) WHERE c_custkey <> e""",
    "cells": """SELECT g.x, g.y, CAST(0 AS BIGINT) AS z, coalesce(c.n, 0)::DOUBLE AS value
        FROM (SELECT x, y FROM range(50) a(x), range(7) b(y)) g
        LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) - 1 AS x, l_linenumber - 1 AS y, count(*) AS n FROM lineitem GROUP BY 1, 2) c USING (x, y)""",
    "sched": """SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) - 473352 AS "at", event_id AS order_idx,
        CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 ELSE 2 END AS priority_type, value AS priority FROM events""",
    "ticklog": "SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS tick, CAST(user_id % 4 AS INT) AS uid_rank, event_id AS seq, value AS v FROM events",
}
_NEEDS = {"population": ["agents"], "raw_points": ["agents"], "locs": ["raw_points"], "tiled": ["locs"], "plane": ["plane_points"], "bip": ["bip_edges"], "nodes": ["agents"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """body after the expressions that it names and those that they build on. body may go on with more after a comma."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    ctes = ", ".join(f"{n} AS ({_CTES[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{'' if body.lstrip().startswith(',') else ' '}{body}"
