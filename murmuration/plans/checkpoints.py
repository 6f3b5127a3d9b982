"""Queries that save, restore and return what came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.population import UID
from ..operators.schedule import PriorityType, Schedule
from ..sources.checkpoint import Checkpoint
from ..sources.scratch import Scratch
from .catalog import query
from .views import Views, with_views


def _path(v: Views, name: str) -> str:
    return Scratch(v.spark, f"checkpoint-{name}").root


def _reopened(v: Views, checkpoint: Checkpoint) -> Checkpoint:
    checkpoint.commit()
    return Checkpoint.open(v.spark, checkpoint.path)


@query("ckpt_agents_roundtrip", with_views("SELECT id, type, uid_rank, seq, tile FROM population", "population"))
def _(v: Views):
    c = Checkpoint(v.spark, _path(v, "agents"))
    c.save_agents(v.population())
    return _reopened(v, c).restore_agents().df.select(*UID, "seq", "tile")


@query("ckpt_space_roundtrip", with_views("SELECT id, type, uid_rank, x, y, arrival_seq FROM locs", "locs"))
def _(v: Views):
    c, space = Checkpoint(v.spark, _path(v, "space")), v.space()
    c.save_space("grid", space)
    return _reopened(v, c).restore_space("grid", space).locations.select(*UID, "x", "y", "arrival_seq")


@query("ckpt_network_roundtrip", with_views("SELECT src, dst, w FROM bip", "bip"))
def _(v: Views):
    c = Checkpoint(v.spark, _path(v, "network"))
    c.save_network("orders", v.bipartite())
    return _reopened(v, c).restore_network("orders").edges


@query("ckpt_schedule_roundtrip", "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 'walk', true), (1, 1.5::DOUBLE, 'log', true), (3, 9.0::DOUBLE, 'stop', false)) t(order_idx, \"at\", name, restored)")
def _(v: Views):
    schedule = Schedule()
    schedule.repeating(1.0, 1.0, print, metadata={"name": "walk"})
    schedule.once(1.5, print, PriorityType.LAST, metadata={"name": "log"})
    schedule.once(2.0, print, metadata={"name": "gone"}).void()
    schedule.stop_at(9.0)
    c = Checkpoint(v.spark, _path(v, "schedule"))
    c.save_schedule(schedule)
    records = _reopened(v, c)._manifest["schedule"]["events"]
    again = Schedule()
    again.restore(records, 0.0, lambda meta: print)
    back = {r["order"] for r in again.records()}
    rows = [(r["order"], r["at"], r["metadata"].get("name", "stop"), r["order"] in back) for r in records]
    return v.spark.createDataFrame(rows, "order_idx int, at double, name string, restored boolean")


@query("ckpt_values_roundtrip", "SELECT 42 AS seed, 'abc' AS value")
def _(v: Views):
    c = Checkpoint(v.spark, _path(v, "values"))
    c.save_random(42)
    c.save("value", "abc")
    again = _reopened(v, c)
    return v.spark.range(1).select(F.lit(again.restore_random()).alias("seed"), F.lit(again.restore("value")).alias("value"))
