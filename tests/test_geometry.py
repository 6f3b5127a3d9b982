import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuration.functions.draws import MODULUS, draw, draw_sql
from murmuration.functions.geometry import BorderType, BoundingBox, Tiling, bordered, dims_create, neighbours


def at(spark, points, box, border, continuous=False):
    kind = "double" if continuous else "long"
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], f"k int, x {kind}, y {kind}, z {kind}")
    return [tuple(r)[1:] for r in df.select("k", *bordered(box, border, continuous)).orderBy("k").collect()]


BOX = BoundingBox(0, 20, 0, 25, -1, 5)


def test_sticky_grid(spark):
    assert at(spark, [(2, 15, 3), (-1, -2, -3), (25, 40, 33)], BOX, BorderType.STICKY) == [(2, 15, 3), (0, 0, -1), (19, 24, 3)]


def test_periodic_grid(spark):
    assert at(spark, [(2, 15, 3), (-1, -2, -3), (25, 40, 34)], BOX, BorderType.PERIODIC) == [(2, 15, 3), (19, 23, 2), (5, 15, -1)]


def test_sticky_continuous(spark):
    assert at(spark, [(8.0, 200.0, 0.0)], BoundingBox(0, 20, 0, 40), BorderType.STICKY, True)[0][:2] == (8.0, 39.99999999)


def test_periodic_continuous_follows_the_remainder_of_c(spark):
    # a tiny negative number wraps onto the upper edge itself
    assert at(spark, [(-1e-17, -0.5, 7.0)], BoundingBox(0, 20, 0, 40), BorderType.PERIODIC, True) == [(20.0, 39.5, 0.0)]


def near(spark, point, limits, periodic=False, top_first=False):
    df = spark.createDataFrame([point], "x long, y long, z long")
    return [tuple(r)[1:] for r in df.select(F.explode(neighbours(limits, periodic, top_first)).alias("n")).select("n.*").orderBy("ordinal").collect()]


def test_neighbours(spark):
    line = lambda x, lo, hi, periodic=False: [p[0] for p in near(spark, (x, 0, 0), [(lo, hi)], periodic)]
    assert [line(4, 0, 9), line(0, 0, 9), line(9, 0, 9), line(4, 5, 9)] == [[3, 4, 5], [0, 1], [8, 9], [5]]
    assert [line(0, 0, 9, True), line(9, 0, 9, True), line(0, 0, 1, True)] == [[9, 0, 1], [8, 9, 0], [1, 0, 1]]
    flat = near(spark, (0, 0, 0), [(0, 9), (-2, 12)])
    assert [p[0] for p in flat] == [0, 1, 0, 1, 0, 1] and [p[1] for p in flat] == [-1, -1, 0, 0, 1, 1]
    flat = near(spark, (0, 12, 0), [(0, 9), (-2, 12)], True)
    assert [p[0] for p in flat] == [9, 0, 1] * 3 and [p[1] for p in flat] == [11] * 3 + [12] * 3 + [-2] * 3
    assert len(near(spark, (1, 1, 1), [(0, 5)] * 3)) == 27
    assert [p[1] for p in near(spark, (3, 3, 0), [(0, 9), (0, 9)], top_first=True)] == [4] * 3 + [3] * 3 + [2] * 3


def test_contains_is_half_open(spark):
    df = spark.createDataFrame([(0, 0, 0), (20, 0, 0), (19, 24, 3), (19, 24, 4)], "x int, y int, z int")
    assert [r[0] for r in df.select(BOX.contains()).collect()] == [True, False, True, False]
    assert BoundingBox(0, 1).num_dims == 1
    with pytest.raises(ValueError):
        _ = BoundingBox(0, 0).num_dims


def test_tilings():
    assert dims_create(9, 2) == (3, 3) and dims_create(8, 2) == (4, 2) and dims_create(12, 3) == (3, 2, 2) and dims_create(7, 1) == (7,)
    nine = Tiling.balanced(BoundingBox(0, 90, 0, 120), 9)
    assert [nine.bounds(t) for t in (0, 1, 3)] == [BoundingBox(0, 30, 0, 40), BoundingBox(0, 30, 40, 40), BoundingBox(30, 30, 0, 40)]
    assert Tiling.balanced(BoundingBox(0, 40, 0, 120), 8).bounds(7) == BoundingBox(30, 10, 60, 60)
    assert [t.xextent for t in map(Tiling(BoundingBox(0, 11), (4,)).bounds, range(4))] == [3, 3, 3, 2]
    with pytest.raises(ValueError):
        Tiling(BoundingBox(0, 10, 0, 10), (3,))


def test_strips_of_a_periodic_tiling():
    tiling = Tiling.balanced(BoundingBox(0, 90, 0, 120), 9, periodic=True)
    strips = {n: tiling.strip(0, step, 2) for n, step in tiling.neighbours(0)}
    ends = {n: (b.xmin, b.xmin + b.xextent, b.ymin, b.ymin + b.yextent) for n, b in strips.items()}
    assert ends == {
        8: (0, 2, 0, 2), 6: (0, 2, 0, 40), 7: (0, 2, 38, 40), 2: (0, 30, 0, 2), 1: (0, 30, 38, 40), 5: (28, 30, 0, 2), 3: (28, 30, 0, 40), 4: (28, 30, 38, 40),
    }


def test_buffered_bounds():
    sticky, wrapped = (Tiling.balanced(BoundingBox(0, 90, 0, 120), 9, p) for p in (False, True))
    assert sticky.buffered(0, 2) == BoundingBox(0, 32, 0, 42) and sticky.buffered(4, 2) == BoundingBox(28, 34, 38, 44)
    assert wrapped.buffered(0, 2) == BoundingBox(-2, 34, -2, 44)


def test_tile_of_agrees_with_bounds(spark):
    for box, shape in ((BoundingBox(-3, 17, 2, 11), (4, 3)), (BoundingBox(0, 5), (5,)), (BoundingBox(0, 7, 0, 5, 0, 4), (2, 3, 2))):
        tiling = Tiling(box, shape)
        cells = [(x, y, z) for x in range(box.xmin, box.xmin + box.xextent) for y in range(box.ymin, box.ymin + max(1, box.yextent)) for z in range(max(1, box.zextent))]
        df = spark.createDataFrame(cells, "x long, y long, z long")
        for x, y, z, tile in df.select("x", "y", "z", tiling.tile_of()).collect():
            own = tiling.bounds(tile)
            assert own.xmin <= x < own.xmin + own.xextent and (box.num_dims < 2 or own.ymin <= y < own.ymin + own.yextent) and (box.num_dims < 3 or own.zmin <= z < own.zmin + own.zextent)


@given(st.integers(1, 60), st.integers(1, 3))
def test_dims_multiply_to_the_number(n, dims):
    shape = dims_create(n, dims)
    product = 1
    for s in shape:
        product *= s
    assert product == n and list(shape) == sorted(shape, reverse=True)


def test_draws_are_the_same_in_sql_and_even(spark):
    df = spark.range(2000).select("id", draw("id", 7, 2).alias("d"), F.expr(draw_sql("id", 7, 2)).alias("s"))
    rows = df.collect()
    assert all(r.d == r.s and 0 <= r.d < MODULUS for r in rows)
    assert abs(sum(r.d for r in rows) / len(rows) / MODULUS - 0.5) < 0.03
