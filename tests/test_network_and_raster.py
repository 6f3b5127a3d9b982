import pytest
from pyspark.sql import functions as F

from murmuration.functions.geometry import BorderType, BoundingBox, Tiling
from murmuration.models import diffusion
from murmuration.operators import graphs
from murmuration.operators.network import Network
from murmuration.operators.raster import ReadWriteLayer, ValueLayer
from murmuration.operators.tiles import diffuse_tiles
from murmuration.sources.graph_file import parse_lines, read_network, write_network

EDGE = "src long, dst long, w double"


def net(spark, edges, directed=False, nodes=()):
    return Network.create(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, EDGE), directed)


def degrees(n):
    return {r.id: r.degree for r in n.degrees().collect()}


def test_degrees(spark):
    directed = net(spark, [(5, 6, 1.0), (4, 5, 1.0)], True)
    assert degrees(directed) == {5: 2, 4: 1, 6: 1}
    assert degrees(net(spark, [(5, 6, 1.0), (6, 5, 2.0), (4, 4, 1.0)], nodes=[9])) == {5: 1, 6: 1, 4: 1, 9: 0}


def test_edges_are_merged_updated_and_removed(spark):
    n = net(spark, [(1, 2, 1.0), (2, 3, 2.0)])
    new = spark.createDataFrame([(2, 1, 9.0, 0), (1, 2, None, 1), (3, 7, 4.0, 2)], EDGE + ", k int")
    n = n.add_edges(new, "k")
    assert {tuple(r) for r in n.edges.collect()} == {(1, 2, 9.0), (2, 3, 2.0), (3, 7, 4.0)} and n.nodes.count() == 4
    n = n.update_edges(spark.createDataFrame([(3, 2, 5.0), (8, 9, 1.0)], EDGE))
    assert {tuple(r) for r in n.edges.collect()} == {(1, 2, 9.0), (2, 3, 5.0), (3, 7, 4.0)}
    asked = spark.createDataFrame([(2, 1, 0.0), (1, 7, 0.0)], EDGE)
    assert {tuple(r) for r in n.contains_edges(asked).collect()} == {(2, 1, True), (1, 7, False)} and n.missing_edges(asked).count() == 1
    assert n.remove_edges(asked).edges.count() == 2 and n.clear_edges().edges.count() == 0
    assert n.remove_nodes(spark.createDataFrame([(2,)], "id long")).edges.count() == 1


def test_neighbours_and_search(spark):
    n = net(spark, [(1, 2, 0.0), (1, 3, 0.0), (3, 4, 0.0)], True)
    assert {(r.id, r.other) for r in n.successors().collect()} == {(1, 2), (1, 3), (3, 4)}
    assert {(r.id, r.other) for r in n.predecessors().collect()} == {(2, 1), (3, 1), (4, 3)}
    keep = lambda df, _: spark.createDataFrame(df.collect(), df.schema)
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.level for r in n.reached(seeds, keep=keep).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r.id: r.level for r in n.reached(seeds, 1, keep=keep).collect()} == {1: 0, 2: 1, 3: 1}


def test_registered_search_reaches_every_level(spark, tmp_path):
    from murmuration.plans.catalog import QUERIES
    from murmuration.plans.views import Views

    spark.range(1, 301).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    nexts = {}
    for r in Views(spark, str(tmp_path)).ring().edges.collect():
        nexts.setdefault(r.src, []).append(r.dst)
    levels, front = {1: 0}, [1]
    while front:
        front = [b for a in front for b in nexts.get(a, []) if levels.setdefault(b, levels[a] + 1) == levels[a] + 1]
        front = list(dict.fromkeys(b for b in front if b not in levels or levels[b] == max(levels.values())))
    got = {r.id: r.level for r in QUERIES["net_bfs"](spark, str(tmp_path)).collect()}
    assert got == levels and max(levels.values()) > 6


def test_parts_are_even(spark):
    n = net(spark, [(i, i + 1, 0.0) for i in range(59)])
    for k, sizes in ((3, [20, 20, 20]), (7, [8, 8, 8, 9, 9, 9, 9])):
        assert sorted(r["count"] for r in n.random_parts(k).groupBy("part").count().collect()) == sizes


LINES = """friends 0
1 0 0 {"mood": "calm", "at": {"x": [1, 2]}}
2 0 0 {"mood": "a } b { c"}
3 0 1 {"mood": 41}
4 1 1
EDGES
1 2 {"since": 1987}
3 1 {"since": 2003}

4 2"""


def as_lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


def test_graph_lines(spark):
    header, nodes, edges = parse_lines(as_lines(spark, LINES))
    assert tuple(header.first()) == ("friends", False)
    rows = [(r.id, r.type, r.rank, r.attrs) for r in nodes.orderBy("id").collect()]
    assert rows[0][3] == {"mood": "calm", "at": '{"x":[1,2]}'} and rows[1][3] == {"mood": "a } b { c"}
    assert rows[2:] == [(3, 0, 1, {"mood": "41"}), (4, 1, 1, None)]
    assert {(r.u, r.v): r.attrs for r in edges.collect()} == {(1, 2): {"since": "1987"}, (3, 1): {"since": "2003"}, (4, 2): None}


@pytest.mark.parametrize("bad", ["friends\n1 0 0\nEDGES", "f x\n1 0 0\nEDGES", "f 1\n1 0\nEDGES", "f 1\n1 0 0\nEDGES\n1", "f 1\n1 0 0 {x\nEDGES"])
def test_malformed_lines(spark, bad):
    with pytest.raises(Exception, match="not a"):
        for df in parse_lines(as_lines(spark, bad)):
            df.collect()


def test_graph_file_round_trip(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text(LINES)
    name, n = read_network(spark, str(source))
    assert name == "friends" and not n.directed
    write_network(name, n, str(tmp_path / "out"), 2)
    again, m = read_network(spark, str(tmp_path / "out"))
    key = lambda r: (r.src, r.dst, str(r.attrs))
    assert again == name and sorted(map(key, n.edges.collect())) == sorted(map(key, m.edges.collect()))
    assert {(r.id, r.type): r.attrs for r in m.nodes.collect()} == {(r.id, r.type): r.attrs for r in n.nodes.select("id", "type", "attrs").collect()}
    with pytest.raises(ValueError):
        write_network(name, n, str(tmp_path / "no"), 2, "metis")
    source.write_text(LINES + "\n4 77")
    with pytest.raises(ValueError, match="77"):
        read_network(spark, str(source))


def test_agent_type_attribute(spark, tmp_path):
    nodes = spark.createDataFrame([(1, {"agent_type": "3", "a": "x"}), (2, None)], "id long, attrs map<string,string>")
    write_network("t", Network(nodes, spark.createDataFrame([(1, 2)], "src long, dst long"), True), str(tmp_path / "out"), 1)
    _, n = read_network(spark, str(tmp_path / "out"))
    assert {(r.id, r.type, str(r.attrs)) for r in n.nodes.collect()} == {(1, 3, "{'a': 'x'}"), (2, 0, "None")}


def test_graph_file_of_many_splits(spark, tmp_path):
    source = tmp_path / "in.txt"
    nodes = "\n".join(f'{i} 0 0 {{"n": {i}}}' for i in range(3000))
    source.write_text(f"big 1\n{nodes}\nEDGES\n" + "\n".join(f"{i} {(i * 7 + 1) % 3000}" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        name, n = read_network(spark, str(source), lambda nodes: nodes.select("id", F.element_at("attrs", "n").alias("n")))
        assert (name, n.directed, n.edges.count()) == ("big", True, 3000)
        assert n.nodes.filter("id = n").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_graph_file_of_many_parts(spark, tmp_path):
    edges = [(i, (i * 7 + 1) % 3000, 1.0) for i in range(3000)]
    n = net(spark, edges, True, range(3000))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        write_network("big", n, str(tmp_path / "out"), 2)
        parts = sorted((tmp_path / "out").glob("part-*"))
        lines = [x for p in parts for x in p.read_text().splitlines()]
        assert lines[0] == "big 1" and lines[3001] == "EDGES" and len(lines) == 6002
        assert [int(x.split()[0]) for x in lines[1:3001]] == list(range(3000)) and lines[3002:] == [f"{a} {b}" for a, b, _ in edges]
        assert len(parts) > 3 and max(len(p.read_text().splitlines()) for p in parts) < 3000
        name, m = read_network(spark, str(tmp_path / "out"))
        assert (name, m.directed, m.nodes.count()) == ("big", True, 3000)
        assert sorted((r.src, r.dst) for r in m.edges.collect()) == [(a, b) for a, b, _ in edges]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_parts_are_read_in_order_of_name(spark, tmp_path):
    """Spark reads the largest file first."""
    (tmp_path / "part-0").write_text("parts 1\n1 0 0\n")
    (tmp_path / "part-1").write_text("2 0 0\n3 0 0\nEDGES\n" + "1 2\n2 3\n" + "3 1\n" * 50)
    name, n = read_network(spark, str(tmp_path))
    assert name == "parts" and {(r.src, r.dst) for r in n.edges.collect()} == {(1, 2), (2, 3), (3, 1)} and n.nodes.count() == 3


def test_strict_changes(spark):
    n = net(spark, [(1, 2, 1.0), (2, 3, 2.0)])
    other, there = spark.createDataFrame([(2, 1, 7.0), (1, 3, 7.0)], EDGE), spark.createDataFrame([(2, 1, 7.0)], EDGE)
    for change in (n.update_edges, n.remove_edges):
        with pytest.raises(KeyError):
            change(other, strict=True)
        assert change(there, strict=True).edges.count() in (1, 2)
    with pytest.raises(KeyError):
        n.remove_nodes(spark.createDataFrame([(9,)], "id long"), strict=True)
    # without an order, the greatest value of repeated edges counts, whatever the partitions
    repeated = spark.createDataFrame([(1, 2, float(k)) for k in range(9)], EDGE).repartition(4)
    assert {tuple(r) for r in n.add_edges(repeated).edges.collect()} == {(1, 2, 8.0), (2, 3, 2.0)}


def test_graph_algorithms(spark):
    import random

    rng = random.Random(5)
    keep = lambda df, _: spark.createDataFrame(df.collect(), df.schema)
    # four groups with many links inside, few between, and a path
    edges = {(min(a, b), max(a, b)) for g in range(4) for _ in range(60) for a, b in [rng.sample(range(g * 15, g * 15 + 15), 2)]}
    edges |= {(3, 20), (21, 40)} | {(100 + i, 101 + i) for i in range(30)}
    n = net(spark, [(a, b, float(a % 4 + 1)) for a, b in edges], nodes=[500])
    label = {i: i for e in edges for i in e} | {500: 500}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in graphs.connected_components(n, keep).collect()} == label
    reached = {r.id: r.distance for r in graphs.distances(n, spark.createDataFrame([(3,)], "id long"), keep, "w").collect()}
    far = {3: 0.0}
    for _ in range(70):
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x in far and far[x] + a % 4 + 1 < far.get(y, 1e9):
                    far[y] = far[x] + a % 4 + 1
    assert reached == far
    ranks = {r.id: r.rank for r in graphs.page_ranks(n, 3, keep).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[500] == min(ranks.values())
    parts = {r.id: r.part for r in graphs.near_parts(n, 4, keep).collect()}
    sizes = [list(parts.values()).count(k) for k in range(4)]
    assert sorted(parts) == sorted(label) and max(sizes) - min(sizes) <= 1
    dealt = {r.id: r.part for r in n.random_parts(4).collect()}
    cut = lambda p: sum(p[a] != p[b] for a, b in edges)
    assert cut(parts) < cut(dealt) / 2


def test_edges_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    from murmuration.plans.catalog import QUERIES

    monkeypatch.setattr("murmuration.operators.network.PART_ROWS", 100, raising=False)
    n = F.col("id")
    tables = {
        "customer": spark.range(40).select(n.alias("c_custkey")),
        "supplier": spark.range(10).select(n.alias("s_suppkey")),
        "orders": spark.range(500).select(n.alias("o_orderkey"), (n * 7 % 40).alias("o_custkey")),
        "lineitem": spark.range(2000).select((n % 500).alias("l_orderkey"), (n * 3 % 11 % 10).alias("l_suppkey")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    w = {}
    for k in range(2000):
        pair = (-(k * 3 % 11 % 10) - 1, k % 500 * 7 % 40)
        w[pair] = w.get(pair, 0) + 1
    for (s, c), lines in [*w.items()]:
        if c % 5 < 2:
            w[(s if c % 2 == 0 else s - 500_000, c)] = lines + 1000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = QUERIES["net_add_edge"](spark, str(tmp_path))
        assert edges.rdd.getNumPartitions() == 20
        assert {(r.src, r.dst): r.w for r in edges.collect()} == w
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tables_of_nodes_are_not_broadcast(spark):
    from murmuration.sources.scratch import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    network, plans, scratch = Network.create(edges.select(F.col("src").alias("id")), edges, True), [], Scratch(spark, "test")

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.write(df, f"{name}-{len(plans)}")

    graphs.connected_components(network, keep)
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)
    graphs.near_parts(network, 2, keep)
    assert not any("BroadcastHashJoin" in p for p in plans)


# --- rasters ---

POINT = "x long, y long, z long"


@pytest.mark.parametrize("border", list(BorderType))
def test_tiles_diffuse_as_columns_do(spark, border):
    box, periodic = BoundingBox(-3, 23, 5, 17), border == BorderType.PERIODIC
    layer = ValueLayer.create(spark, box, border, "random")
    expected = {(r.x, r.y): r.value for r in diffusion.run(layer, 5, 0.2).cells.collect()}
    for shape, at_once in (((4, 3), 2), ((1, 2), 5), ((1, 1), 3)):
        got = diffuse_tiles(layer, 5, Tiling(box, shape, periodic), 0.2, at_once).cells.collect()
        assert {(r.x, r.y): round(r.value, 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}
    line = ValueLayer.create(spark, BoundingBox(0, 30), border, "random")
    expected = {r.x: round(r.value, 9) for r in diffusion.run(line, 4).cells.collect()}
    got = diffuse_tiles(line, 4, Tiling(line.box, (3,), periodic), at_once=4).cells.collect()
    assert {r.x: round(r.value, 9) for r in got} == expected
    with pytest.raises(ValueError):
        diffuse_tiles(layer, 5, Tiling(box, (9, 9), periodic), at_once=4)


def test_layer_wraps(spark):
    box = BoundingBox(15, 20, 0, 30, -1, 11)
    layer = ValueLayer.create(spark, box, BorderType.PERIODIC)
    updates = spark.createDataFrame([(14, -2, -3, 5.0, 0), (14, -2, -3, 12.0, 1), (36, 32, 14, 7.0, 0)], POINT + ", value double, seq int")
    layer = layer.set(updates)
    got = layer.get(spark.createDataFrame([(34, 28, 8), (16, 2, 3), (20, 5, 0)], POINT))
    assert sorted(r.value for r in got.collect()) == [0.0, 7.0, 12.0]


def test_neighbourhood_values(spark):
    layer = ValueLayer.create(spark, BoundingBox(0, 3, 0, 3))
    layer = ValueLayer(layer.cells.withColumn("value", F.col("y") * 3.0 + F.col("x")), layer.box)
    around = layer.neighbourhoods(spark.createDataFrame([(0, 0, 0)], POINT))
    assert [r.value for r in around.orderBy("ordinal").collect()] == [0.0, 1.0, 3.0, 4.0]


def test_read_and_write_layers(spark):
    layer = ValueLayer.create(spark, BoundingBox(0, 4), init=1.0)
    both = ReadWriteLayer(layer, layer).set(spark.createDataFrame([(2, 0, 0, 9.0, 0)], POINT + ", value double, seq int"))
    at = spark.createDataFrame([(2, 0, 0)], POINT)
    assert both.get(at).first().value == 1.0 and both.swap().get(at).first().value == 9.0
    assert both.neighbourhoods(at).count() == 3


@pytest.mark.parametrize("border", list(BorderType))
@pytest.mark.parametrize("box", [BoundingBox(0, 6), BoundingBox(0, 5, 0, 4), BoundingBox(0, 3, 0, 3, 0, 3)])
def test_diffusion_conserves(spark, border, box):
    layer = ValueLayer.create(spark, box, border, "random")
    before = layer.cells.agg(F.sum("value")).first()[0]
    after = layer.diffuse().diffuse()
    assert abs(after.cells.agg(F.sum("value")).first()[0] - before) < 1e-9 and after.cells.count() == layer.cells.count()


def test_diffusion_of_an_impulse(spark):
    layer = ValueLayer.create(spark, BoundingBox(0, 5, 0, 5))
    layer = layer.set(spark.createDataFrame([(2, 2, 0, 1.0, 0)], POINT + ", value double, seq int")).diffuse(0.1)
    got = {(r.x, r.y): round(r.value, 9) for r in layer.cells.collect() if r.value}
    assert got == {(2, 2): 0.6, (1, 2): 0.1, (3, 2): 0.1, (2, 1): 0.1, (2, 3): 0.1}


def test_layer_halo(spark):
    box = BoundingBox(0, 8, 0, 2)
    layer = ValueLayer(ValueLayer.create(spark, box).cells, box, tiling=Tiling(box, (2, 1)))
    assert {(r.dst_tile, r.x) for r in layer.halo(1).collect()} == {(1, 3), (0, 4)}
