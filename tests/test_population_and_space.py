import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from murmuration.functions import draws
from murmuration.functions.geometry import BorderType, BoundingBox, OccupancyType, Tiling
from murmuration.operators.network import Network
from murmuration.operators.population import Population, agent_rows
from murmuration.operators.space import Space, colocations

ROW = "id long, type int, uid_rank int, seq long, tile int"
PLACED = "id long, type int, uid_rank int, seq long, x long, y long, z long, arrival_seq long"


@pytest.fixture
def three(spark):
    return Population(spark.createDataFrame([(1, 1, 0, 0, 0), (2, 1, 0, 1, 1), (2, 0, 0, 2, 1)], ROW))


def ids(df):
    return [r.id for r in df.collect()]


def test_sizes(three, spark):
    assert three.size() == {-1: 3} and three.size([0, 1]) == {0: 1, 1: 2}
    assert three.remove(spark.createDataFrame([(1, 1, 0)], "id long, type int, uid_rank int")).size([0, 1]) == {0: 1, 1: 1}
    with pytest.raises(KeyError):
        three.size([7])


def test_agents_in_order_and_shuffled(spark):
    p = Population(spark.createDataFrame([(i, i % 2, 0, i, 0) for i in range(10)], ROW).repartition(3))
    assert ids(p.agents()) == list(range(10)) and ids(p.agents(0, 4)) == [0, 2, 4, 6]
    shuffled = ids(p.agents(shuffle=True))
    assert sorted(shuffled) == list(range(10)) and shuffled != list(range(10)) and shuffled == ids(p.agents(shuffle=True))
    assert ids(p.agents(count=3, shuffle=True)) == shuffled[:3]
    with pytest.raises(KeyError):
        p.agents(5)


def test_membership(three, spark):
    assert ids(three.agent((2, 0, 0))) == [2] and three.agent((9, 9, 9)).isEmpty()
    assert three.ghost_agent((2, 0, 0), 1).isEmpty() and not three.ghost_agent((2, 0, 0), 0).isEmpty()
    again = three.add(spark.createDataFrame([(1, 1, 0, 9, 5), (8, 0, 0, 10, 5), (8, 0, 0, 10, 5)], ROW))
    assert again.size([0, 1]) == {0: 2, 1: 2}
    assert three.contains_type(1) and not three.contains_type(3)


def test_negative_type_is_refused(spark):
    with pytest.raises(Exception, match="type is 0 or more"):
        agent_rows(spark.range(1), "id", -1).collect()


def test_projections(three):
    three.add_projection("grid", object())
    with pytest.raises(ValueError):
        three.add_projection("grid", object())
    with pytest.raises(KeyError):
        three.get_projection("none")


def test_owners(three, spark):
    asked = spark.createDataFrame([(4, 2, 0, 0), (5, 2, 0, 0), (4, 99, 0, 0)], "tile int, id long, type int, uid_rank int")
    assert sorted(r.asking_tile for r in three.request_agents(asked).collect()) == [4, 5]
    moved = three.move_agents(spark.createDataFrame([(1, 1, 0, 7)], "id long, type int, uid_rank int, tile int"))
    assert {(r.id, r.type): r.tile for r in moved.df.collect()} == {(1, 1): 7, (2, 1): 1, (2, 0): 1}
    assert [tuple(r)[3:] for r in three.migrations(F.lit(1)).collect()] == [(0, 1)]


BOX = BoundingBox(0, 10, 0, 10)


def space(spark, rows, **kind):
    return Space(spark.createDataFrame([(i, 0, 0, i, *(p or (None, None, None)), a) for i, p, a in rows], PLACED), BOX, **kind)


def moves(spark, rows):
    return spark.createDataFrame([(i, 0, 0, *p) for i, p in rows], "id long, type int, uid_rank int, x long, y long, z long")


def test_first_occupant_and_moves_in_place(spark):
    s = space(spark, [(1, None, None), (2, None, None)])
    s = s.move(moves(spark, [(1, (3, 3, 0))]), 1).move(moves(spark, [(2, (3, 3, 0))]), 2)
    assert [tuple(r) for r in s.first_occupants().collect()] == [(3, 3, 0, 1, 0, 0)]
    s = s.move(moves(spark, [(1, (3, 3, 0))]), 3)
    assert [r.id for r in s.occupants().orderBy("place").collect()] == [1, 2]
    s = s.move(moves(spark, [(1, (4, 3, 0))]), 4).move(moves(spark, [(1, (3, 3, 0))]), 5)
    assert [r.id for r in s.occupants().orderBy("place").collect()] == [2, 1]


def test_single_occupancy(spark):
    s = space(spark, [(1, (0, 0, 0), 0), (2, (1, 0, 0), 1), (3, (2, 0, 0), 2)], occupancy=OccupancyType.SINGLE)
    s = s.move(moves(spark, [(1, (1, 0, 0)), (2, (5, 5, 0)), (3, (5, 5, 0))]))
    assert {r.id: (r.x, r.y) for r in s.locations.collect()} == {1: (0, 0), 2: (5, 5), 3: (2, 0)}


def test_add_remove_contains(spark):
    s = space(spark, [(1, (0, 0, 0), 0)])
    s = s.add(spark.createDataFrame([(1, 0, 0, 1), (9, 0, 0, 9)], "id long, type int, uid_rank int, seq long"))
    uids = spark.createDataFrame([(1, 0, 0), (9, 0, 0), (5, 0, 0)], "id long, type int, uid_rank int")
    assert {r.id: r.x for r in s.location(uids).collect()} == {1: 0, 9: None, 5: None}
    assert sorted(ids(s.contains(uids))) == [1, 9] and ids(s.remove(uids.filter("id = 1")).locations) == [9]
    assert s.num_agents(moves(spark, [(0, (0, 0, 0)), (0, (1, 1, 0))]).select("x", "y", "z")).agg(F.sum("n")).first()[0] == 1


def test_boxes_against_brute_force(spark):
    rng = random.Random(1)
    points = [(i, (rng.randrange(10), rng.randrange(10), 0), i) for i in range(200)]
    boxes = [(k, rng.randrange(8), rng.randrange(0, 4), rng.randrange(8), rng.randrange(1, 4)) for k in range(25)]
    s = space(spark, points)
    found = s.within_many(spark.createDataFrame(boxes, "box_id int, xmin int, xextent int, ymin int, yextent int"), 3)
    expected = {(k, i) for k, x0, xe, y0, ye in boxes for i, (x, y, _), _ in points if x0 <= x < x0 + xe and y0 <= y < y0 + ye}
    assert {(r.box_id, r.id) for r in found.collect()} == expected and found.count() == len(expected)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    one = BoundingBox(2, 3, 1, 4)
    assert {r.id for r in s.within(one).collect()} == {i for i, (x, y, _), _ in points if 2 <= x < 5 and 1 <= y < 5}


def test_halo_is_what_lies_near_other_tiles(spark):
    tiling = Tiling(BOX, (2, 2))
    points = [(10 * x + y, (x, y, 0), 0) for x in range(10) for y in range(10)]
    s = space(spark, points, tiling=tiling, buffer_size=2)
    expected = set()
    for t in range(4):
        own, wide = tiling.bounds(t), tiling.buffered(t, 2)
        for i, (x, y, _), _ in points:
            inside = lambda b: b.xmin <= x < b.xmin + b.xextent and b.ymin <= y < b.ymin + b.yextent  # noqa: E731, B023
            if inside(wide) and not inside(own):
                expected.add((t, i))
    assert {(r.dst_tile, r.id) for r in s.halo().collect()} == expected


def test_colocations(spark):
    s = space(spark, [(1, (0, 0, 0), 0), (2, (0, 0, 0), 1), (3, (5, 0, 0), 2)])
    assert {r.id: r.others for r in colocations(s.locations).collect()} == {1: 1, 2: 1, 3: 0}


def test_random_points_stay_inside(spark):
    s = space(spark, [(i, None, None) for i in range(100)])
    for continuous in (False, True):
        got = Space(s.locations, BOX, continuous=continuous).random_points(s.locations).collect()
        assert all(0 <= r.x < 10 and 0 <= r.y < 10 for r in got) and len({(r.x, r.y) for r in got}) > 20


def test_periodic_move(spark):
    s = space(spark, [(1, (0, 0, 0), 0)], border=BorderType.PERIODIC).move(moves(spark, [(1, (-1, 12, 5))]))
    assert tuple(s.locations.first())[4:7] == (9, 2, 0)


def test_projections_follow(spark):
    people = Population(spark.createDataFrame([(1, 0, 0, 0, 0), (2, 0, 0, 1, 0)], ROW))
    space = Space(spark.createDataFrame([(1, 0, 0, 0, 3, 0, 0, 0)], PLACED), BoundingBox(0, 10, 0, 0), tiling=Tiling(BoundingBox(0, 10), (2,)), buffer_size=2)
    people.add_projection("line", replace(space, box=BoundingBox(0, 10)))
    people.add_projection("net", Network.create(spark.createDataFrame([], "id long"), spark.createDataFrame([(1, 2)], "src long, dst long")))
    # what a projection lacks is added when it is registered, and new agents when they come
    assert sorted(ids(people.get_projection("line").locations)) == [1, 2]
    people = people.add(spark.createDataFrame([(5, 0, 0, 9, 1)], ROW))
    assert sorted(ids(people.get_projection("line").locations)) == [1, 2, 5] == sorted(ids(people.get_projection("net").nodes))
    gone = people.remove(spark.createDataFrame([(1, 0, 0)], "id long, type int, uid_rank int"))
    assert sorted(ids(gone.get_projection("net").nodes)) == [2, 5] and gone.get_projection("net").edges.count() == 0
    moved, halos = people.synchronize_with("line")
    assert {r.id: r.tile for r in moved.df.collect()} == {1: 0, 2: 0, 5: 1} and [(r.id, r.dst_tile) for r in halos["line"].collect()] == [(1, 1)]
    with pytest.raises(KeyError):
        people.get_projection("line").move(spark.createDataFrame([(77, 0, 0, 1, 0, 0)], "id long, type int, uid_rank int, x long, y long, z long"), strict=True)


def test_changes_and_updates(spark, three):
    told = three.update(spark.createDataFrame([(2, 0, 0, None)], "id long, type int, uid_rank int, tile int"))
    assert sorted((r.id, r.type, r.tile) for r in told.df.filter("tile IS NOT NULL").collect()) == [(1, 1, 0), (2, 1, 1)]
    assert [(r.id, r.type) for r in told.changes(three.df, ["tile"]).collect()] == [(2, 0)]
    assert three.changes(three.df, ["tile", "seq"]).count() == 0


def test_random_points_of_a_tile(spark):
    tiling = Tiling(BoundingBox(2, 20, -4, 9), (3, 2))
    agents = spark.range(300).selectExpr("id", "0 AS type", "0 AS uid_rank", "id AS seq", "CAST(id % 6 AS INT) AS tile")
    for continuous in (False, True):
        space = Space(None, tiling.box, continuous=continuous, tiling=tiling)
        got = space.random_tile_points(agents, 3)
        assert got.count() == 300 and got.filter(tiling.tile_of() != F.col("tile")).count() == 0


def test_no_two_streams_of_draws_meet(spark):
    """Draws of many (seed, tick, number): as few coincide, at any shift of the agents, as chance gives."""
    import numpy as np

    agents = np.arange(2000)
    streams = [draws.draw_array(agents, t, n, s) for t in range(12) for n in range(4) for s in (1, 2, 33, 1104, 42)]
    every = np.round(np.concatenate(streams) * draws.MODULUS).astype(np.int64)
    chance = len(every) ** 2 / 2 / draws.MODULUS
    assert len(every) - len(np.unique(every)) < 2 * chance + 50
    assert abs(np.mean(every) / draws.MODULUS - 0.5) < 0.005
    # the array form is the column form
    column = spark.range(50).select(draws.uniform("id", 3, 1, 7)).collect()
    assert [r[0] for r in column] == list(draws.draw_array(np.arange(50), 3, 1, 7))


def test_engine_seed(spark, tmp_path):
    from murmuration.sources.files import read_parameters

    first = lambda: spark.range(9).select(draws.uniform("id", 1, 0)).collect()
    before = first()
    (tmp_path / "p.yaml").write_text("random.seed: 7\n")
    try:
        read_parameters(str(tmp_path / "p.yaml"))
        assert draws.engine_seed() == 7 and first() != before
        assert spark.range(9).select(draws.uniform("id", 1, 0, 42)).collect() == before
        assert draws.init() > 10**9
    finally:
        draws.init(42)
    got = spark.range(200).select(draws.integers(-2, 3, "id", 0, 0).alias("n"), draws.choice(F.array(F.lit(4), F.lit(9)), "id", 0, 1).alias("c")).collect()
    assert {r.n for r in got} == {-2, -1, 0, 1, 2} and {r.c for r in got} == {4, 9}
