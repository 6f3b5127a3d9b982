"""Queries on event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..operators.schedule import PriorityType, Schedule, bound_event, init_schedule
from ..sources.scratch import Scratch
from ..streaming import events as ev
from .catalog import query
from .views import Views, with_views

_PLACE = f"""row_number() OVER (PARTITION BY "at" ORDER BY CASE priority_type WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END,
    CASE priority_type WHEN 3 THEN priority WHEN 2 THEN {uniform_sql('order_idx', 0, 0)} * 500.0 + 0.0 ELSE 0 END, order_idx)"""


@query("event_order", with_views(f"SELECT \"at\", order_idx, CAST({_PLACE} AS INT) AS place FROM sched", "sched"))
def _(v: Views):
    return ev.placed(v.schedule(), Scratch(v.spark, "events").write, priority_range=(0.0, 500.0)).select("at", "order_idx", "place")


@query("event_next_tick", with_views("SELECT coalesce(min(\"at\"), -1) AS tick FROM sched", "sched"))
def _(v: Views):
    return ev.next_tick(v.schedule())


@query("event_heap_pop", with_views("SELECT \"at\", order_idx FROM sched WHERE \"at\" = (SELECT min(\"at\") FROM sched)", "sched"))
def _(v: Views):
    s = v.schedule()
    return s.join(F.broadcast(ev.next_tick(s)), s.at == F.col("tick"), "left_semi").select("at", "order_idx")


@query("event_drop_past", with_views("SELECT \"at\", order_idx FROM sched WHERE \"at\" >= 100", "sched"))
def _(v: Views):
    return ev.current(v.schedule(), 100).select("at", "order_idx")


@query("event_stop", with_views("SELECT \"at\", order_idx FROM sched WHERE \"at\" <= 200", "sched"))
def _(v: Views):
    return ev.until_stop(v.schedule(), 200).select("at", "order_idx")


@query("event_void", with_views("SELECT \"at\", order_idx FROM sched WHERE order_idx % 7 <> 0", "sched"))
def _(v: Views):
    s = v.schedule()
    return s.join(s.filter("order_idx % 7 = 0").select("order_idx"), "order_idx", "left_anti").select("at", "order_idx")


@query(
    "event_expand_repeating",
    with_views(
        """, e AS (SELECT order_idx, "at"::DOUBLE AS "at", 150.1::DOUBLE + (order_idx % 50) * 0.7::DOUBLE AS step FROM sched),
    r AS (SELECT order_idx, "at", step FROM e WHERE "at" <= 720 UNION ALL SELECT order_idx, "at" + step, step FROM r WHERE "at" + step <= 720)
    SELECT order_idx, round("at", 9) AS "at" FROM r""",
        "sched",
        recursive=True,
    ),
)
def _(v: Views):
    repeating = v.schedule().select("order_idx", F.col("at").cast("double").alias("at"), (F.lit(150.1) + F.col("order_idx") % 50 * 0.7).alias("interval"))
    return ev.expand_repeating(v.spark, repeating, 720.0).select("order_idx", F.round("at", 9).alias("at"))


@query("event_tick_counts", "SELECT date_trunc('hour', ts) AS \"at\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(v: Views):
    rows = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.tick_counts(rows).select(F.col("at").cast("timestamp_ntz").alias("at"), "event_type", "n", F.round("total", 4).alias("total"))


_REPEATING_SQL = """WITH RECURSIVE e AS (SELECT n_nationkey AS order_idx, 1.0::DOUBLE + n_nationkey * 0.1::DOUBLE AS "at", 0.4::DOUBLE + n_nationkey * 0.05::DOUBLE AS step FROM nation),
    r AS (SELECT order_idx, "at", step FROM e UNION ALL SELECT order_idx, "at" + step, step FROM r WHERE "at" + step <= {until})"""


def _nations(v: Views) -> list[int]:
    return [r.n_nationkey for r in v.table("nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # a row for each nation


@query("event_runner_loop", _REPEATING_SQL.format(until=6) + ' SELECT order_idx, round("at", 9) AS "at" FROM r')
def _(v: Views):
    """The driver's schedule, run to its stop: each call notes the tick that it sees."""
    runner, seen = init_schedule(), []
    for key in _nations(v):
        runner.repeating(1.0 + key * 0.1, 0.4 + key * 0.05, bound_event(lambda k: seen.append((k, round(runner.tick, 9))), key))
    runner.stop_at(6.0)
    runner.execute()
    return v.spark.createDataFrame(seen, "order_idx int, at double")


@query("event_end_order", "SELECT n_nationkey AS key, CAST(row_number() OVER (ORDER BY n_nationkey % 5, n_nationkey) AS INT) AS place, 2.0::DOUBLE AS \"at\" FROM nation WHERE n_nationkey % 6 <> 0")
def _(v: Views):
    """End events come after the last tick, in order of registration, but for those made void."""
    runner, seen = Schedule(), []
    runner.once(2.0, lambda: None)
    for key in sorted(_nations(v), key=lambda k: (k % 5, k)):
        event = runner.at_end(bound_event(lambda k: seen.append((k, len(seen) + 1, runner.tick)), key))
        if key % 6 == 0:
            event.void()
    runner.execute()
    return v.spark.createDataFrame(seen, "key int, place int, at double")


@query("event_during_tick", "SELECT n_nationkey AS key, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 25 + n_nationkey / 2 + 1 ELSE NULL END AS INT) AS place FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, CAST(n_nationkey + 1 AS INT) - 100 FROM nation")
def _(v: Views):
    """Events that a running tick adds to itself take their place among those that wait: last ones after all others."""
    runner, seen = Schedule(), []
    later = lambda k: seen.append((k, len(seen) + 1))

    def first(k):
        seen.append((k, len(seen) + 1 - 100))
        if k % 2 == 0:
            runner.once(1.0, bound_event(later, k), PriorityType.LAST)

    for key in _nations(v):
        runner.once(1.0, bound_event(first, key), PriorityType.FIRST)
    runner.execute()
    return v.spark.createDataFrame(seen, "key int, place int")


@query("event_sliding_counts", """WITH w AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS "at", value FROM events)
    SELECT "at", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")  # fmt: skip
def _(v: Views):
    rows = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.tick_counts(rows, tick="2 hours", slide="1 hour").select(F.col("at").cast("timestamp_ntz").alias("at"), "event_type", "n", F.round("total", 4).alias("total"))
