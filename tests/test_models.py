import pytest
from pyspark.sql import functions as F

from murmuration.functions.geometry import BoundingBox
from murmuration.models import random_walk, rumor, zombies
from murmuration.operators.network import Network
from murmuration.sources.checkpoint import Checkpoint
from murmuration.sources.scratch import Scratch, shared_dir

BOX = BoundingBox(0, 12, 0, 9)


@pytest.fixture
def walkers(spark):
    n = F.col("id")
    return spark.range(60).select("id", F.lit(0).alias("type"), F.lit(0).alias("uid_rank"), n.alias("seq"), (n % 12).alias("x"), (n % 9).alias("y"), F.lit(0).cast("long").alias("z"))


def test_walk(spark, walkers):
    after, log = random_walk.run(walkers, 4, BOX, keep=Scratch(spark, "test").write, every=2)
    before = {r.id: (r.x, r.y) for r in walkers.collect()}
    one = {r.id: (r.x, r.y) for r in random_walk.walk(walkers, 1, BOX).collect()}
    assert all(max(abs(a[0] - before[i][0]), abs(a[1] - before[i][1])) <= 1 for i, a in one.items())
    cells = after.groupBy("x", "y").count().collect()
    rows = log.orderBy("tick").collect()
    assert [r.tick for r in rows] == [0.0, 1.0, 2.0, 3.0, 4.0] and all(r["min"] == 0 for r in rows)
    assert rows[-1].total == sum(r["count"] * (r["count"] - 1) for r in cells) and after.count() == 60


def test_restored_run_goes_on_the_same(spark, walkers, tmp_path):
    whole, _ = random_walk.run(walkers, 6, BOX)
    half = walkers
    for tick in range(1, 4):
        half = random_walk.walk(half, tick, BOX)
    from murmuration.operators.population import Population

    c = Checkpoint(spark, str(tmp_path / "c"))
    c.save_agents(Population(half))
    c.commit()
    rest = Checkpoint.open(spark, str(tmp_path / "c")).restore_agents().df
    for tick in range(4, 7):
        rest = random_walk.walk(rest, tick, BOX)
    place = lambda df: {(r.id, r.x, r.y) for r in df.collect()}
    assert place(whole) == place(rest)


def test_results_do_not_depend_on_partitions(walkers):
    place = lambda df: {(r.id, r.x, r.y) for r in df.collect()}
    assert place(random_walk.walk(walkers.repartition(7), 3, BOX)) == place(random_walk.walk(walkers.coalesce(1), 3, BOX))


def test_rumor(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    network = Network.create(edges.select(F.col("src").alias("id")), edges)
    seeds = spark.createDataFrame([(0,)], "id long")
    informed, log = rumor.run(network, seeds, 5, 1.0, keep=Scratch(spark, "test").write)
    assert {r.id: r.tick for r in informed.collect()} == {i: i for i in range(6)}
    assert [tuple(r) for r in log.orderBy("tick").collect()] == [(t, t + 1, 1) for t in range(6)]
    _, log = rumor.run(network, seeds, 4, 0.0)
    assert [tuple(r) for r in log.orderBy("tick").collect()] == [(0, 1, 1)] + [(t, 1, 0) for t in range(1, 5)]


def test_zombies(spark):
    n = F.col("id")
    agents = spark.range(80).select("id", F.when(n < 70, 0).otherwise(1).alias("type"), F.lit(0).alias("uid_rank"), n.alias("seq"), (n % 12 + 0.3).alias("x"), (n % 9 + 0.6).alias("y"))
    start = zombies.initial(agents, BOX)
    state, log = zombies.run(start, 13, BOX, keep=Scratch(spark, "test").write)
    rows = log.orderBy("tick").collect()
    assert all(r.humans + r.zombies == 80 for r in rows)
    assert all(a.humans >= b.humans for a, b in zip(rows, rows[1:], strict=False)) and rows[-1].humans < 70
    for r in state.collect():
        assert 0 <= r.x < 12 and 0 <= r.y < 9 and 0 <= r.cx < 12 and 0 <= r.cy < 9
        assert r.duration < zombies.TICKS_TO_DIE if r.type == zombies.HUMAN else r.duration == 0


def test_zombies_of_one_part_are_dealt_out(spark):
    n = F.col("id")
    agents = spark.range(400).select("id", F.when(n < 350, 0).otherwise(1).alias("type"), F.lit(0).alias("uid_rank"), n.alias("seq"), (n % 12 + 0.3).alias("x"), (n % 9 + 0.6).alias("y"))
    start, rows = zombies.initial(agents, BOX).coalesce(1), {}

    def keep(df, name):
        out = Scratch(spark, "test").write(df, name)
        rows[name] = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
        return out

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state, log = zombies.run(start, 2, BOX, keep=keep)
        for name in ("chase1", "flee1", "chase2", "flee2"):
            assert sum(rows[name]) == 400 and max(rows[name]) < 200
        plain, plain_log = zombies.run(start, 2, BOX)
        assert sorted(state.collect()) == sorted(plain.collect()) and log.orderBy("tick").collect() == plain_log.orderBy("tick").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_scratch_reads_the_clusters_setting(spark):
    before = shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == before and shared_dir(spark) == before
    scratch = Scratch(spark, "test")
    assert scratch.write(spark.range(3), "a").count() == 3 and scratch.root.startswith(before)
    scratch.drop("a")
