"""Queries on logs, co-locations and running totals."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators.logs import Logged, logged_fields, reduced, running, tabular
from ..operators.population import UID
from ..operators.space import colocations
from ..sources.files import LogSink, dump_parameters, read_parameters
from ..sources.scratch import Scratch
from .catalog import query
from .views import Views, with_views

for _op in ("sum", "min", "max"):

    @query(f"reduce_{_op}", with_views(f"SELECT tick, round({_op}(v), 4) AS v FROM ticklog GROUP BY tick", "ticklog"))
    def _(v: Views, op=_op):
        return reduced(v.tick_log(), [Logged("v", op, "v")]).select("tick", F.round("v", 4).alias("v"))


@query("reduce_multi", with_views("SELECT tick, count(v) AS n, round(sum(v), 4) AS total, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, max(uid_rank) AS rank FROM ticklog GROUP BY tick", "ticklog"))
def _(v: Views):
    columns = [Logged("v", "count", "n"), Logged("v", "sum", "total"), Logged("v", "min", "low"), Logged("v", "max", "high"), Logged("v", "avg", "mean"), Logged("uid_rank", "max", "rank")]
    return reduced(v.tick_log(), columns).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("tabular_log", with_views("SELECT tick, uid_rank, seq, v FROM ticklog", "ticklog"))
def _(v: Views):
    return tabular(v.tick_log(), ["tick", "uid_rank", "seq", "v"])


@query("running_total", with_views(", n AS (SELECT tick, count(*) AS new FROM ticklog GROUP BY tick) SELECT tick, new, CAST(sum(new) OVER (ORDER BY tick) AS BIGINT) AS total FROM n", "ticklog"))
def _(v: Views):
    # a row for each tick reaches the window
    new = v.tick_log().groupBy("tick").agg(F.count("*").alias("new"))
    return running(new, "new", "tick")


@query("accumulated_per_agent", with_views(", n AS (SELECT uid_rank, tick, count(*) AS n FROM ticklog GROUP BY 1, 2) SELECT uid_rank, tick, CAST(sum(n) OVER (PARTITION BY uid_rank ORDER BY tick) AS BIGINT) AS total FROM n", "ticklog"))
def _(v: Views):
    n = v.tick_log().groupBy("uid_rank", "tick").agg(F.count("*").alias("n"))
    return running(n, "n", "tick", ("uid_rank",)).select("uid_rank", "tick", "total")


@query("accumulated_by_user", "WITH n AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS tick, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, tick, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY tick) AS BIGINT) AS total FROM n")
def _(v: Views):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    n = v.table("events").groupBy("user_id", day.alias("tick")).agg(F.count("*").alias("n"))
    return running(n, "n", "tick", ("user_id",)).select("user_id", "tick", "total")


@query("colocation_count", with_views("SELECT id, type, uid_rank, x, y, count(*) OVER (PARTITION BY x, y) - 1 AS others FROM locs", "locs"))
def _(v: Views):
    return colocations(v.space().locations).select(*UID, "x", "y", "others")


@query("colocation_log", with_views(", c AS (SELECT count(*) OVER (PARTITION BY x, y) - 1 AS n FROM locs) SELECT CAST(0 AS DOUBLE) AS tick, CAST(sum(n) AS BIGINT) AS total, least(0, min(n)) AS min, greatest(0, max(n)) AS max FROM c", "locs"))
def _(v: Views):
    from ..models.random_walk import meetings

    return meetings(v.space().locations, 0)


@query("counts_by_type", with_views("SELECT x // 10 AS band, count(*) FILTER (type = 0) AS humans, count(*) FILTER (type = 1) AS zombies FROM locs GROUP BY 1", "locs"))
def _(v: Views):
    by = [F.count_if(F.col("type") == k).alias(n) for k, n in ((0, "humans"), (1, "zombies"))]
    return v.space().locations.groupBy(F.floor(F.col("x") / 10).alias("band")).agg(*by)


@query("last_arrival", with_views("SELECT x, y, id, type FROM locs QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY arrival_seq DESC, seq DESC) = 1", "locs"))
def _(v: Views):
    last = F.max_by(F.struct("id", "type"), F.struct("arrival_seq", "seq")).alias("a")
    return v.space().locations.groupBy("x", "y").agg(last).select("x", "y", "a.id", "a.type")


@query("cumulative_offsets", with_views(", n AS (SELECT uid_rank, count(*) AS n FROM agents GROUP BY 1) SELECT uid_rank, n, CAST(coalesce(sum(n) OVER (ORDER BY uid_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM n", "agents"))
def _(v: Views):
    n = v.agents().groupBy("uid_rank").agg(F.count("*").alias("n"))
    return running(n, "n", "uid_rank", name="before", before=True)


@query("reduce_any_all", with_views("SELECT tick, bool_or(v > 400) AS some, bool_and(v > 1) AS every FROM ticklog GROUP BY tick", "ticklog"))
def _(v: Views):
    rows = v.tick_log().withColumns({"high": F.col("v") > 400, "real": F.col("v") > 1})
    return reduced(rows, [Logged("high", "any", "some"), Logged("real", "all", "every")])


@query("reduce_bits", with_views("SELECT tick, bit_or(seq) AS any_bit, bit_and(seq) AS all_bits, bit_xor(seq) AS odd_bits FROM ticklog GROUP BY tick", "ticklog"))
def _(v: Views):
    return reduced(v.tick_log(), [Logged("seq", f"bit_{op}", name) for op, name in (("or", "any_bit"), ("and", "all_bits"), ("xor", "odd_bits"))])


@query("reduce_product", with_views("SELECT tick, uid_rank, round(product(1 + v / 100000), 6) AS grown FROM ticklog GROUP BY 1, 2", "ticklog"))
def _(v: Views):
    rows = v.tick_log().withColumn("factor", 1 + F.col("v") / 100_000).withColumn("at", F.struct("tick", "uid_rank"))
    return reduced(rows, [Logged("factor", "product", "grown")], "at").select("at.tick", "at.uid_rank", F.round("grown", 6).alias("grown"))


@dataclass
class _Counts:
    """What a model would count on each rank."""

    seq: int
    v: float
    uid_rank: int


@query("logger_fields", with_views("SELECT tick, CAST(max(seq) AS BIGINT) AS last, CAST(max(v) AS DOUBLE) AS v FROM ticklog GROUP BY tick", "ticklog"))
def _(v: Views):
    return reduced(v.tick_log(), logged_fields(_Counts, "max", {"seq": "last", "v": None}))


@query("log_sink_ticks", with_views(", t AS (SELECT tick, uid_rank, seq, round(v, 4) AS v FROM ticklog WHERE tick < 7) SELECT CAST(row_number() OVER (ORDER BY tick, uid_rank, seq) AS INT) AS line, tick, uid_rank, seq, v FROM t", "ticklog"))
def _(v: Views):
    """The first seven ticks, logged one by one with a buffer of three and read back in order."""
    sink = LogSink(v.spark, f"{Scratch(v.spark, 'log').root}/log.csv", ["uid_rank", "seq"], buffer_size=3)
    rows = v.tick_log().withColumn("v", F.round("v", 4))
    for tick in range(7):
        sink.log(rows.filter(F.col("tick") == tick))
    sink.close()
    lines = sink.read("tick int, uid_rank int, seq long, v double").collect()  # seven ticks of one log
    return v.spark.createDataFrame([(k, *r) for k, r in enumerate(lines, 1)], "line int, tick int, uid_rank int, seq long, v double")


@query("parameters_roundtrip", "SELECT 'walk' AS name, 9 AS ticks, 7 AS seed")
def _(v: Views):
    """Parameters written under a free name, beside one that is taken, and read back with an entry put over them."""
    path = f"{Scratch(v.spark, 'parameters').root}/p.yaml"
    dump_parameters(v.spark, {"name": "other"}, path)
    out = dump_parameters(v.spark, {"name": "walk", "ticks": 3, "seed": 7}, path)
    rows = v.spark.read.text(out).collect()
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # the driver's own copy, which only it reads
        f.write("\n".join(r.value for r in rows))
        f.flush()
        p = read_parameters(f.name, '{"ticks": 9}')
    return v.spark.createDataFrame([(p["name"], p["ticks"], p["seed"])], "name string, ticks int, seed int")


@query("reduce_own", with_views("SELECT tick, round(sqrt(sum(v * v)), 6) AS norm, max(v) - min(v) AS spread FROM ticklog GROUP BY tick", "ticklog"))
def _(v: Views):
    columns = [Logged("v", lambda c: F.round(F.sqrt(F.sum(c * c)), 6), "norm"), Logged("v", lambda c: F.max(c) - F.min(c), "spread")]
    return reduced(v.tick_log(), columns)
