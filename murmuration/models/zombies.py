"""Humans flee, zombies chase; a bite turns a human into a zombie after ten ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import with_draws
from ..functions.geometry import BorderType, BoundingBox, bordered, neighbours

HUMAN, ZOMBIE = 0, 1
ZOMBIE_STEP, HUMAN_STEP = 0.25, 0.5
TICKS_TO_DIE = 10
#: seq of a zombie that was a human: that of the human and this.
REBORN = 10**12
STATE = ["id", "type", "uid_rank", "seq", "x", "y", "cx", "cy", "infected", "duration", "arrival_seq"]


def limits(box: BoundingBox) -> list[tuple[int, int]]:
    """Greatest cells as the published model passes them: one past the last cell, always empty but a legal goal."""
    return [(box.xmin, box.xmin + box.xextent), (box.ymin, box.ymin + box.yextent)]


def initial(agents: DataFrame, box: BoundingBox) -> DataFrame:
    """State from agents (id, type, uid_rank, seq, x, y): cells, nobody infected, arrival in order of seq."""
    return _placed(agents, box).select(
        "id", "type", "uid_rank", "seq", "x", "y", "cx", "cy", F.lit(False).alias("infected"), F.lit(0).alias("duration"), F.col("seq").alias("arrival_seq")
    )


def _placed(df: DataFrame, box: BoundingBox) -> DataFrame:
    """x and y inside the space, and the grid cell of the point as it was before it was brought inside."""
    cell = bordered(box, BorderType.STICKY, False, F.floor("x"), F.floor("y"), F.lit(0))
    point = bordered(box, BorderType.STICKY, True, F.col("x"), F.col("y"), F.lit(0.0))
    return df.withColumns({"cx": cell[0], "cy": cell[1], "x": point[0], "y": point[1]})


def _goals(movers: DataFrame, others: DataFrame, most: bool, box: BoundingBox) -> DataFrame:
    """(cx, cy, goals): for cells of movers, the ordinals of the cells around with most, or fewest, of the others.

    Goals are found once a cell, not once a mover. Where movers flee, only cells beside the others are listed: a cell that is
    left out has none of them near, so that all cells around it are its goals.
    """
    counts = others.groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.count("*").alias("n"))
    around = neighbours(limits(box), False, top_first=True)
    cells = movers.select("cx", "cy").distinct() if most else _beside(counts, box)
    listed = cells.select("cx", "cy", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0).alias("z"))
    listed = listed.select("cx", "cy", F.explode(around).alias("c")).select("cx", "cy", "c.ordinal", "c.x", "c.y")
    counted = listed.join(counts, ["x", "y"], "left").select("cx", "cy", F.coalesce("n", F.lit(0)).alias("n"), F.col("ordinal").cast("long").alias("ordinal"))
    tied = counted.groupBy("cx", "cy", "n").agg(F.array_sort(F.collect_list("ordinal")).alias("goals"))  # nine at most to a cell
    best = (F.max_by if most else F.min_by)("goals", "n")
    return tied.groupBy("cx", "cy").agg(best.alias("goals"))


def _beside(counts: DataFrame, box: BoundingBox) -> DataFrame:
    """The cells around those that are counted, themselves included."""
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    near = counts.select("x", "y", steps.alias("s")).select((F.col("x") + F.col("s.dx")).alias("cx"), (F.col("y") + F.col("s.dy")).alias("cy"))
    (x0, x1), (y0, y1) = limits(box)
    return near.filter(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)).distinct()


def _with_goal(state: DataFrame, movers: Column, goals: DataFrame, most: bool, tick: int, draw_number: int, box: BoundingBox, seed: int | None) -> DataFrame:
    """The state with gx and gy: the cell that each mover heads for, null for others; ties fall to a draw.

    Goals lie by cell, so they are joined to the agents as these are: where they are few, no agent is shuffled.
    """
    near = state.join(goals, ["cx", "cy"], "left")
    steps = [(k % 3 - 1, 1 - k // 3) for k in range(9)]  # the top row first
    (x0, x1), (y0, y1) = limits(box)
    inside = [F.when((F.col("cx") + dx).between(x0, x1) & (F.col("cy") + dy).between(y0, y1), F.lit(k).cast("long")) for k, (dx, dy) in enumerate(steps)]
    interior = (F.col("cx") > x0) & (F.col("cx") < x1) & (F.col("cy") > y0) & (F.col("cy") < y1)
    every = F.when(interior, F.array(*(F.lit(k).cast("long") for k in range(9)))).otherwise(F.filter(F.array(*inside), lambda k: k.isNotNull()))
    near = near.withColumn("goals", F.when(movers, F.coalesce("goals", every)))
    # of a single goal there is nothing to draw
    drawn = with_draws(near, "drawn", F.when(F.size("goals") > 1, F.transform("goals", lambda k: F.col("seq") * 9 + k)), tick, draw_number, seed)
    best = F.array_max if most else F.array_min
    score = best(F.zip_with("drawn", "goals", lambda d, k: d * 16 + k)) % 16
    picked = drawn.withColumn("pick", F.coalesce(score, F.get("goals", F.lit(0))))
    gx, gy = F.col("cx") + F.col("pick") % 3 - 1, F.col("cy") + 1 - F.floor(F.col("pick") / 3)
    return picked.select(*STATE, gx.alias("gx"), gy.alias("gy"))


def _moved(both: DataFrame, length: float, tick: int, phase: int, box: BoundingBox) -> DataFrame:
    """Agents with goals (gx, gy) a part of the way to them; arrival is renewed where the cell changes."""
    goes = F.col("gx").isNotNull() & ((F.col("gx") != F.col("cx")) | (F.col("gy") != F.col("cy")))
    to = [F.when(goes, F.col(c) + (F.col(f"g{c}") - F.col(f"c{c}")) * length).otherwise(F.col(c)) for c in ("x", "y")]
    # who stays keeps point and cell: a clipped point's floor can differ from the cell it came from
    rest = [c for c in STATE if c not in ("x", "y", "cx", "cy")]
    old = [F.col("cx").alias("ox"), F.col("cy").alias("oy"), goes.alias("goes")]
    there = _placed(both.select(*rest, *old, to[0].alias("x"), to[1].alias("y")), box)
    new_x, new_y = F.when(F.col("goes"), F.col("cx")).otherwise(F.col("ox")), F.when(F.col("goes"), F.col("cy")).otherwise(F.col("oy"))
    there = there.withColumns({"cx": new_x, "cy": new_y})
    renewed = F.when((F.col("cx") != F.col("ox")) | (F.col("cy") != F.col("oy")), F.lit((2 * tick + phase) << 40) + F.col("seq")).otherwise(F.col("arrival_seq"))
    return there.withColumn("arrival_seq", renewed).select(*STATE)


def step(state: DataFrame, tick: int, box: BoundingBox, seed: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One tick: zombies move and infect, then humans fall, or move. Each phase sees the state that the one before left.

    keep(df, name) writes a table and returns it. What is kept by cell is then of a known size, so Spark broadcasts it to the
    agents where it is small, and shuffles both where it is not.
    """
    keep = keep or (lambda df, _: df)
    human, zombie = F.col("type") == HUMAN, F.col("type") == ZOMBIE
    goals = keep(_goals(state.filter(zombie), state.filter(human), True, box), f"prey{tick}")
    headed = _with_goal(state, zombie, goals, True, tick, 1, box, seed)
    state = keep(_moved(headed, ZOMBIE_STEP, tick, 0, box), f"chase{tick}")

    # only cells with a zombie matter to who is bitten: the humans elsewhere leave before any of them are ordered
    cells = state.filter(zombie).select("cx", "cy").distinct()
    first = state.filter(human).join(cells, ["cx", "cy"], "left_semi").groupBy("cx", "cy").agg(F.min_by("seq", F.struct("arrival_seq", "seq")).alias("seq"))
    bitten = keep(first.select("seq", F.lit(True).alias("bitten")), f"bitten{tick}")
    bitten = state.join(bitten, "seq", "left").withColumn("infected", F.col("infected") | F.coalesce("bitten", F.lit(False)))
    ill = human & F.col("infected")
    bitten = bitten.withColumn("duration", F.col("duration") + F.when(ill, 1).otherwise(0)).select(*STATE)

    alive = human & (F.col("duration") < TICKS_TO_DIE)
    # who is near zombies is the same for the bitten state: a bite moves nobody
    goals = keep(_goals(state.filter(human), state.filter(zombie), False, box), f"threats{tick}")
    moved = _moved(_with_goal(bitten, alive, goals, False, tick, 2, box, seed), HUMAN_STEP, tick, 1, box)
    dead = (F.col("type") == HUMAN) & (F.col("duration") >= TICKS_TO_DIE)
    changes = {
        "seq": F.when(dead, F.col("seq") + REBORN).otherwise(F.col("seq")),
        "id": F.when(dead, F.col("id") + REBORN).otherwise(F.col("id")),
        "infected": F.col("infected") & ~dead,
        "duration": F.when(dead, 0).otherwise(F.col("duration")),
        "type": F.when(dead, ZOMBIE).otherwise(F.col("type")),
    }
    return keep(moved.withColumns(changes).select(*STATE), f"flee{tick}")


def counts(state: DataFrame, tick: int) -> DataFrame:
    by = [F.count_if(F.col("type") == k).alias(n) for k, n in ((HUMAN, "humans"), (ZOMBIE, "zombies"))]
    return state.agg(*by).select(F.lit(tick).alias("tick"), "humans", "zombies")


def run(state: DataFrame, ticks: int, box: BoundingBox, seed: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, log): each tick is counted before it is run.

    A kept state stays in as many parts as it was written in, so agents are first dealt out: otherwise the parts of the file
    that they come from, which may be one, would set how many tasks have work in every tick.
    """
    state, log = keep(state.repartition("seq"), "start") if keep else state, None
    for tick in range(1, ticks + 1):
        row = counts(state, tick)
        log = row if log is None else log.unionByName(row)
        state = step(state, tick, box, seed, keep)
    return state, log
