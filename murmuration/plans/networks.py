"""Queries on networks and graph files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql, uniform, uniform_sql
from ..operators import graphs
from ..operators.network import Network
from ..sources.graph_file import network_lines, parse_lines, read_network, write_network
from ..sources.scratch import Scratch
from .catalog import query
from .views import TILES, Views, with_views


@query("net_nodes", with_views("SELECT id, type FROM nodes", "nodes"))
def _(v: Views):
    return v.bipartite().nodes.select("id", "type")


@query("net_counts", with_views("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM bip) AS edge_count", "nodes", "bip"))
def _(v: Views):
    return v.bipartite().counts()


_ENDS = "SELECT src AS id, dst AS other FROM bip UNION ALL SELECT dst, src FROM bip WHERE src <> dst"


@query("net_degree_undirected", with_views(f"SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN ({_ENDS}) e ON n.id = e.id GROUP BY 1", "nodes", "bip"))
def _(v: Views):
    return v.bipartite().degrees()


@query("net_degree_directed", with_views("SELECT c.c_custkey AS id, count(e.id) AS degree FROM customer c LEFT JOIN (SELECT src AS id FROM ring UNION ALL SELECT dst FROM ring) e ON c.c_custkey = e.id GROUP BY 1 UNION SELECT 0, count(*) FROM ring WHERE src = 0 OR dst = 0 HAVING count(*) > 0", "ring"))
def _(v: Views):
    return v.ring().degrees()


@query("net_incident", with_views("SELECT src AS id, dst AS other, true AS outgoing, w FROM bip UNION ALL SELECT dst, src, false, w FROM bip WHERE src <> dst", "bip"))
def _(v: Views):
    return v.bipartite().incident()


@query("net_neighbours", with_views(f"SELECT id, other FROM ({_ENDS})", "bip"))
def _(v: Views):
    return v.bipartite().neighbours()


@query("net_successors", with_views("SELECT src AS id, dst AS other FROM ring", "ring"))
def _(v: Views):
    return v.ring().successors()


@query("net_predecessors", with_views("SELECT dst AS id, src AS other FROM ring", "ring"))
def _(v: Views):
    return v.ring().predecessors()


@query("net_contains_edge", with_views("SELECT q.dst AS src, q.src AS dst, EXISTS (SELECT 1 FROM bip b WHERE b.src = least(q.src, q.dst) AND b.dst = greatest(q.src, q.dst)) AS found FROM (SELECT src, dst - (CASE WHEN dst % 3 = 0 THEN 100000 ELSE 0 END) AS dst FROM bip_edges) q", "bip"))
def _(v: Views):
    e = v.bipartite().edges
    # asked the other way round, a part of them for ends that are not there
    customer, supplier = F.greatest("src", "dst"), F.least("src", "dst")
    asked = e.select((supplier - F.when(supplier % 3 == 0, 100_000).otherwise(0)).alias("src"), customer.alias("dst"))
    return v.bipartite().contains_edges(asked)


@query("net_has_edge", with_views("SELECT n.id, n.id IN (SELECT src FROM bip UNION SELECT dst FROM bip) AS has FROM nodes n", "nodes", "bip"))
def _(v: Views):
    return v.bipartite().degrees().select("id", (F.col("degree") > 0).alias("has"))


@query("net_add_edge", with_views(", new AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, w FROM (SELECT src, CASE WHEN src % 2 = 0 THEN dst ELSE dst - 500000 END AS dst, w + 1000 AS w FROM bip_edges WHERE src % 5 < 2)) SELECT coalesce(n.src, b.src) AS src, coalesce(n.dst, b.dst) AS dst, coalesce(n.w, b.w) AS w FROM bip b FULL JOIN new n ON b.src = n.src AND b.dst = n.dst", "bip"))
def _(v: Views):
    net = v.bipartite()
    customer, supplier = F.greatest("src", "dst"), F.least("src", "dst")
    new = net.edges.select(customer.alias("src"), F.when(customer % 2 == 0, supplier).otherwise(supplier - 500_000).alias("dst"), (F.col("w") + 1000).alias("w"))
    return net.add_edges(new.filter("src % 5 < 2")).edges


@query("net_update_edge", with_views("SELECT src, dst, CASE WHEN dst % 4 = 0 THEN w * 10 ELSE w END AS w FROM bip", "bip"))
def _(v: Views):
    net = v.bipartite()
    return net.update_edges(net.edges.filter("dst % 4 = 0").withColumn("w", F.col("w") * 10)).edges


@query("net_remove_edge", with_views("SELECT src, dst, w FROM bip WHERE dst % 4 <> 0", "bip"))
def _(v: Views):
    net = v.bipartite()
    return net.remove_edges(net.edges.filter("dst % 4 = 0")).edges


@query("net_missing_edge", with_views("SELECT src - 700000 AS src, dst FROM bip WHERE dst % 4 = 0", "bip"))
def _(v: Views):
    """All edges are asked for, a quarter of them with an end that is not there."""
    net = v.bipartite()
    shift = F.when(F.col("dst") % 4 == 0, 700_000).otherwise(0)
    return net.missing_edges(net.edges.select((F.col("src") - shift).alias("src"), "dst"))


@query("net_remove_node", with_views("SELECT src, dst, w FROM bip WHERE NOT (dst % 10 = 0)", "bip"))
def _(v: Views):
    return v.bipartite().remove_nodes(v.table("customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"))).edges


@query("net_add_nodes", with_views("SELECT id, type FROM nodes UNION ALL SELECT id + 9000000, 2 FROM nodes WHERE id % 2 = 0 AND id > 0", "nodes"))
def _(v: Views):
    net = Network(v.nodes(), v.bipartite().edges)
    new = v.nodes().select(F.when((F.col("id") % 2 == 0) & (F.col("id") > 0), F.col("id") + 9_000_000).otherwise(F.col("id")).alias("id"), F.lit(2).alias("type"))
    return net.add_nodes(new).nodes


@query("net_clear_edges", with_views("SELECT (SELECT count(*) FROM nodes) AS nodes, 0 AS edges", "nodes"))
def _(v: Views):
    net = v.bipartite().clear_edges()
    return net.nodes.agg(F.count("*").alias("nodes")).join(net.edges.agg(F.count("*").alias("edges")), how="cross")


_RINGNODES = "ringnodes AS (SELECT c_custkey AS id FROM customer UNION SELECT src FROM ring UNION SELECT dst FROM ring)"


@query("net_partition_random", with_views(f", {_RINGNODES} SELECT id, CAST((row_number() OVER (ORDER BY {draw_sql('id', 0, 0)}, id) - 1) % 3 AS INT) AS part FROM ringnodes", "ring"))
def _(v: Views):
    return v.ring().random_parts(3)


@query("net_edge_cut", with_views(", l AS (SELECT id, CAST((CASE WHEN x < 40 THEN x // 10 ELSE 3 END) * 2 + (CASE WHEN y < 13 THEN 0 ELSE 1 END) AS INT) AS tile FROM locs WHERE type = 0) SELECT e.src, e.dst, a.tile AS src_part, b.tile AS dst_part FROM ring e JOIN l a ON e.src = a.id JOIN l b ON e.dst = b.id WHERE a.tile <> b.tile", "ring", "locs"))
def _(v: Views):
    tiles = v.space().locations.filter("type = 0").select("id", TILES.tile_of().alias("tile"))
    return v.ring().cut("tile", tiles)


@query("net_write_lines", with_views(f", {_RINGNODES}, p AS (SELECT id, CAST((row_number() OVER (ORDER BY {draw_sql('id', 0, 0)}, id) - 1) % 3 AS INT) AS part FROM ringnodes) SELECT 'ring 1' AS line UNION ALL SELECT 'EDGES' UNION ALL SELECT concat_ws(' ', id, 0, part) FROM p UNION ALL SELECT concat_ws(' ', src, dst) FROM ring", "ring"))
def _(v: Views):
    net = v.ring()
    return network_lines("ring", net, net.random_parts(3)).select("line")


@query("net_read_parse", with_views("SELECT src AS u, dst AS v, CAST(w AS VARCHAR) AS weight FROM bip", "bip"))
def _(v: Views):
    net = v.bipartite()
    edges = net.edges.select("src", "dst", F.create_map(F.lit("weight"), F.col("w").cast("string")).alias("attrs"))
    lines = network_lines("orders", Network(net.nodes.select("id"), edges), net.random_parts(3))
    numbered = lines.select((F.col("section") * 1_000_000_000_000).alias("line_no"), "line")
    return parse_lines(numbered)[2].select("u", "v", F.element_at("attrs", "weight").alias("weight"))


@query("net_bfs", with_views(""", n AS (SELECT count(*) AS most FROM customer),
    b AS (SELECT 1 AS id, 0 AS level UNION SELECT r.dst, level + 1 FROM b JOIN ring r ON r.src = b.id, n WHERE level < most)
    SELECT id, min(level) AS level FROM b GROUP BY id""", "ring", recursive=True))  # fmt: skip
def _(v: Views):
    """From node 1, over every level: no path is longer than there are nodes."""
    scratch = Scratch(v.spark, "bfs")
    return v.ring().reached(v.spark.createDataFrame([(1,)], "id long"), keep=scratch.write)


@query("bernoulli_edges", with_views(f"SELECT src, dst FROM ring WHERE {uniform_sql('src * 1000003 + dst', 1, 0)} <= 0.3", "ring"))
def _(v: Views):
    return v.ring().edges.filter(uniform(F.col("src") * 1000003 + F.col("dst"), 1, 0) <= 0.3)


@query("net_add_edge_directed", with_views(", new AS (SELECT src, CASE WHEN src % 2 = 0 THEN dst ELSE dst + 100000 END AS dst, src * 1.0 AS w FROM ring) SELECT coalesce(n.src, r.src) AS src, coalesce(n.dst, r.dst) AS dst, coalesce(n.w, 0.0)::DOUBLE AS w FROM ring r FULL JOIN new n ON r.src = n.src AND r.dst = n.dst", "ring"))
def _(v: Views):
    ring = v.ring()
    net = Network(ring.nodes, ring.edges.withColumn("w", F.lit(0.0)), True)
    new = ring.edges.select("src", F.when(F.col("src") % 2 == 0, F.col("dst")).otherwise(F.col("dst") + 100_000).alias("dst"), F.col("src").cast("double").alias("w"))
    return net.add_edges(new).edges


@query("net_missing_node", with_views("SELECT id + 7000000 AS id FROM nodes WHERE id > 0", "nodes"))
def _(v: Views):
    asked = v.nodes().select(F.when(F.col("id") > 0, F.col("id") + 7_000_000).otherwise(F.col("id")).alias("id"))
    return Network(v.nodes(), v.bipartite().edges).missing_nodes(asked)


@query("net_read_file", with_views("SELECT 'orders' AS name, false AS directed, src AS u, dst AS v, CAST(w AS VARCHAR) AS weight, CAST(n.type AS INT) AS src_type FROM bip JOIN nodes n ON n.id = bip.src", "bip", "nodes"))
def _(v: Views):
    """A graph file written to the shared folder and read from it: header, nodes with types, edges with attributes."""
    net, path = v.bipartite(), f"{Scratch(v.spark, 'graph').root}/file"
    edges = net.edges.select("src", "dst", F.create_map(F.lit("weight"), F.col("w").cast("string")).alias("attrs"))
    write_network("orders", Network(v.nodes().select("id", "type"), edges, parts=net.parts), path, 3)
    name, back = read_network(v.spark, path, lambda nodes: nodes.select("id", F.col("type").alias("kind")))
    both = back.edges.join(back.nodes, F.col("src") == F.col("id"))
    return both.select(F.lit(name).alias("name"), F.lit(back.directed).alias("directed"), F.col("src").alias("u"), F.col("dst").alias("v"), F.element_at("attrs", "weight").alias("weight"), F.col("kind").alias("src_type"))


_COMPONENTS_SQL = f""", {_RINGNODES}, links AS (SELECT src AS a, dst AS b FROM ring WHERE src % 7 = dst % 7 UNION SELECT dst, src FROM ring WHERE src % 7 = dst % 7),
    r AS (SELECT id AS x, id AS y FROM ringnodes UNION SELECT r.x, l.b FROM r JOIN links l ON r.y = l.a) SELECT x AS id, min(y) AS component FROM r GROUP BY x"""


@query("net_components", with_views(_COMPONENTS_SQL, "ring", recursive=True))
def _(v: Views):
    ring = v.ring()
    return graphs.connected_components(Network(ring.nodes, ring.edges.filter("src % 7 = dst % 7"), True), Scratch(v.spark, "components").write)


def _page_rank_sql(rounds: int) -> str:
    body = f", {_RINGNODES}, deg AS (SELECT src, count(*) AS o FROM ring GROUP BY 1), nn AS (SELECT count(*) AS n FROM ringnodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM ringnodes, nn)"
    for k in range(1, rounds + 1):
        body += f""", g{k} AS (SELECT dst AS id, sum(rank / o) AS got FROM ring JOIN deg USING (src) JOIN r{k - 1} ON id = src GROUP BY 1),
            l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT src FROM deg)),
            r{k} AS (SELECT i.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank FROM ringnodes i LEFT JOIN g{k} g ON g.id = i.id, nn, l{k})"""
    return with_views(f"{body} SELECT id, round(rank * 1000, 9) AS rank FROM r{rounds}", "ring")


@query("net_page_rank", _page_rank_sql(4))
def _(v: Views):
    ranks = graphs.page_ranks(v.ring(), 4, Scratch(v.spark, "ranks").write)
    return ranks.select("id", F.round(F.col("rank") * 1000, 9).alias("rank"))


@query("net_distances", with_views(""", e AS (SELECT src, dst, 1 + (src * 3 + dst) % 5 AS w FROM ring),
    b AS (SELECT 1 AS id, 0 AS d UNION SELECT e.dst, b.d + e.w FROM b JOIN e ON e.src = b.id WHERE b.d + e.w <= 100)
    SELECT id, CAST(min(d) AS DOUBLE) AS distance FROM b GROUP BY id""", "ring", recursive=True))  # fmt: skip
def _(v: Views):
    ring = v.ring()
    weighted = Network(ring.nodes, ring.edges.withColumn("w", 1 + (F.col("src") * 3 + F.col("dst")) % 5), True)
    return graphs.distances(weighted, v.spark.createDataFrame([(1,)], "id long"), Scratch(v.spark, "distances").write, "w")


@query("net_partition_near", with_views(f", {_RINGNODES}, c AS (SELECT count(*) AS n FROM ringnodes) SELECT CAST(p AS INT) AS part, (n * (p + 1) + 2) // 3 - (n * p + 2) // 3 AS n FROM c, range(3) t(p)", "ring"))
def _(v: Views):
    """Sizes of the parts; the tests look at what they cut."""
    return graphs.near_parts(v.ring(), 3, Scratch(v.spark, "near").write).groupBy("part").agg(F.count("*").alias("n"))
