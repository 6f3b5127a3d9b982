from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from murmuration.operators import schedule as sched
from murmuration.operators.logs import Logged, logged_fields, reduced, tabular
from murmuration.operators.network import Network
from murmuration.operators.population import Population
from murmuration.operators.schedule import EventType, PriorityType, Schedule
from murmuration.sources.checkpoint import Checkpoint
from murmuration.sources.files import append_log, arguments_parser, dump_parameters, free_path, read_log, read_parameters, write_log
from murmuration.streaming import events


def test_priorities():
    s, seen = Schedule(), []
    for i in range(10):
        s.once(1.0, lambda i=i: seen.append(20 + i), PriorityType.LAST)
    for name, priority in (("c", 3.0), ("a", 1.0), ("b", 2.0)):
        s.once(1.0, lambda name=name: seen.append(name), PriorityType.BY_PRIORITY, priority)
    for i in range(10):
        s.once(1.0, lambda i=i: seen.append(i), PriorityType.FIRST)
    s.execute()
    assert seen == [*range(10), "a", "b", "c", *range(20, 30)]


def test_random_ones_fall_between_priorities():
    places = {"d": set(), "e": set()}
    for seed in range(100):
        s, seen = Schedule(seed), []
        for name, priority in (("a", 1.0), ("b", 2.0), ("c", 3.0)):
            s.once(1.0, lambda name=name: seen.append(name), PriorityType.BY_PRIORITY, priority)
        for name in "de":
            s.once(1.0, lambda name=name: seen.append(name))
        s.execute()
        assert [x for x in seen if x in "abc"] == ["a", "b", "c"]
        for name in "de":
            places[name].add(seen.index(name))
    assert all(len(p) > 2 for p in places.values())


def test_repeating_and_stop():
    s, seen = Schedule(), []
    for name, priority in (("a", 1.0), ("b", 2.0), ("c", 3.0)):
        s.repeating(1.0, 0.4, lambda name=name: seen.append((name, s.tick)), PriorityType.BY_PRIORITY, priority)
    s.stop_at(2.0)
    s.at_end(lambda: seen.append("end"))
    s.execute()
    assert [x[0] for x in seen] == ["a", "b", "c"] * 3 + ["e"] and seen[6][1] == 1.0 + 0.4 + 0.4


def test_events_added_while_running():
    s, seen = Schedule(), []

    def first():
        seen.append("first")
        s.once(1.0, lambda: seen.append("same"), PriorityType.BY_PRIORITY, 1.5)
        s.once(0.5, lambda: seen.append("past"))
        s.once(2.0, lambda: seen.append("later"))

    s.once(1.0, first, PriorityType.FIRST)
    for name, priority in (("a", 1.0), ("b", 2.0)):
        s.once(1.0, lambda name=name: seen.append(name), PriorityType.BY_PRIORITY, priority)
    s.once(1.0, lambda: seen.append("last"), PriorityType.LAST)
    s.execute()
    assert seen == ["first", "a", "same", "b", "last", "later"]


def test_void_next_tick_and_runner(monkeypatch):
    s, seen = Schedule(), []
    assert s.next_tick() == -1
    event = s.repeating(1.0, 1.0, sched.bound_event(seen.append, 1))
    s.once(3.0, lambda: event.void())
    s.stop_at(5.0)
    assert s.next_tick() == 1.0
    s.execute()
    assert 2 <= len(seen) <= 3
    monkeypatch.setattr(sched, "_runner", None)
    with pytest.raises(RuntimeError):
        sched.runner()
    assert sched.init_schedule() is sched.runner()


def test_order_numbers_and_records():
    s = Schedule()
    events_ = [s.once(1.0, print), s.repeating(2.0, 1.0, print, metadata={"n": lambda: 5}), s.stop_at(9.0)]
    assert [e.order for e in events_] == [0, 1, 2]
    s.once(1.5, print).void()
    kept = s.records()
    assert [r["type"] for r in kept] == [EventType.ONE_TIME, EventType.REPEATING, EventType.STOP] and kept[1]["metadata"] == {"n": 5}


def test_event_tables(spark):
    rows = [(1, 0, 1, 0.0), (1, 1, 0, 0.0), (1, 2, 3, 2.0), (1, 3, 3, 1.0), (2, 4, 2, 0.0)]
    df = spark.createDataFrame(rows, "at int, order_idx int, priority_type int, priority double")
    keep = lambda df, _: spark.createDataFrame(df.collect(), df.schema)
    placed = events.placed(df, keep).filter("at = 1").orderBy("place").collect()
    assert [r.order_idx for r in placed] == [1, 3, 2, 0]
    assert events.next_tick(df).first().tick == 1 and events.next_tick(df.limit(0)).first().tick == -1
    assert events.current(df, 2).count() == 1 and events.until_stop(df, 1).count() == 4
    repeating = spark.createDataFrame([(7, 1.0, 0.4), (8, 9.0, 1.0)], "order_idx int, at double, interval double")
    assert [r.at for r in events.expand_repeating(spark, repeating, 2.0).orderBy("at").collect()] == [1.0, 1.4, 1.7999999999999998]


def test_streamed_ticks_equal_the_batch(spark, tmp_path):
    rows = spark.range(300).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    feed = events.start_feed(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    feed.awaitTermination()
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in events.tick_counts(rows).collect()}
    # the watermark keeps the newest ticks open
    assert done and done <= batch and len(batch - done) <= 9


@dataclass
class Counts:
    a: int
    b: float


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([(t, r, t * r, (t + 0.5) * r) for t in range(10) for r in range(4)], "tick int, uid_rank int, a int, b double")
    log = reduced(rows, logged_fields(Counts, "sum", {"a": "total", "b": None}))
    assert [tuple(r) for r in log.orderBy("tick").collect()] == [(t, t * 6, (t + 0.5) * 6) for t in range(10)]
    both = reduced(rows, [Logged("a", "min", "low"), Logged("a", "max", "high")]).orderBy("tick").collect()
    assert [(r.low, r.high) for r in both] == [(0, t * 3) for t in range(10)]
    with pytest.raises(ValueError):
        logged_fields(Counts, "sum", {"c": None})
    path = write_log(log, str(tmp_path / "log.csv"), ["tick"], ";")
    assert read_log(spark, path, "tick int, total int, b double", ";").count() == 10
    assert write_log(log, str(tmp_path / "log.csv"), ["tick"]).endswith("log_1.csv")
    for _ in range(2):
        append_log(log, str(tmp_path / "rows"))
    assert read_log(spark, str(tmp_path / "rows"), "tick int, total int, b double").count() == 20


def test_tabular(spark):
    rows = spark.createDataFrame([(r, i, r * i, str(r)) for r in range(3) for i in range(1, 10)], "uid_rank int, seq int, a int, c string").repartition(4)
    assert [tuple(x) for x in tabular(rows, ["a", "c"]).collect()] == [(r * i, str(r)) for r in range(3) for i in range(1, 10)]


def test_parameters(spark, tmp_path):
    source = tmp_path / "p.yaml"
    source.write_text("x: 4\ny: ffc\nrandom.seed: 6\n")
    assert read_parameters(str(source)) == {"x": 4, "y": "ffc", "random.seed": 6}
    got = read_parameters(str(source), '{"x": 201, "z": "Z"}')
    assert got == {"x": 201, "y": "ffc", "random.seed": 6, "z": "Z"}
    assert dump_parameters(spark, got, str(source)) == str(tmp_path / "p_1.yaml") and read_parameters(str(tmp_path / "p_1.yaml")) == got
    args = arguments_parser().parse_args(["a.yaml"])
    assert (args.parameters_file, args.parameters) == ("a.yaml", "{}")
    assert free_path(spark, str(tmp_path / "p.yaml")) == str(tmp_path / "p_2.yaml") and free_path(spark, str(tmp_path / "none")) == str(tmp_path / "none")


def test_checkpoint(spark, tmp_path):
    agents = spark.createDataFrame([(1, 0, 0, 0)], "id long, type int, uid_rank int, seq long")
    network = Network.create(agents.select("id"), spark.createDataFrame([(1, 2)], "src long, dst long"), True)
    s, seen = Schedule(), []
    s.tick = 2.0
    s.repeating(3.0, 1.0, print, PriorityType.FIRST, metadata={"name": "walk", "tag": "model"})
    s.once(4.0, print, metadata={"name": "skip", "tag": "model"})
    s.once(4.0, print, metadata={"name": "other", "tag": "log"})
    s.stop_at(5.0)
    c = Checkpoint(spark, str(tmp_path / "c"))
    c.save_random(7)
    c.save_agents(Population(agents))
    c.save_network("n", network)
    c.save_schedule(s)
    c.save("list", [1, 2])
    c.commit()

    back = Checkpoint.open(spark, str(tmp_path / "c"))
    assert back.restore_random() == 7 and back.restore("list", sum) == 3
    assert back.restore_agents().size() == {-1: 1}
    assert back.restore_network("n").directed and back.restore_network("n").edges.count() == 1
    again = Schedule()
    make = lambda meta: None if meta["name"] == "skip" else (lambda: seen.append((meta["name"], again.tick)))
    back.restore_schedule(again, make, tag="model", with_stop=True)
    assert again.tick == 2.0
    again.execute()
    assert seen == [("walk", 3.0), ("walk", 4.0), ("walk", 5.0)]
