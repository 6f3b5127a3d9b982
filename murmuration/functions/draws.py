"""Reproducible random draws: arithmetic on (seed, tick, agent, draw), the same in Spark and in any SQL engine."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647


def _mixed(key):
    """Two rounds of a multiplication and a square modulo a prime, all within 64 bits.

    The squares matter: without them draws of one agent, or of neighbouring ids, would differ by constants. Works on columns
    and, through _Text, on SQL text alike.
    """
    a = key % MODULUS * 48271 % MODULUS
    b = (a * a + 12345) % MODULUS
    c = (b * 69621 + a) % MODULUS
    return (c * c + b) % MODULUS


def _spread(x):
    """A first mix, one to one below half the modulus: sums of spread numbers do not line up as sums of the numbers would."""
    y = x % MODULUS * 16807 % MODULUS
    return (y * y + 977) % MODULUS


class _Text(str):
    """SQL text with the operators that the mixes need."""

    def _with(self, sign: str, other) -> _Text:
        return _Text(f"({self} {sign} {other})")

    def __mul__(self, other):
        return self._with("*", other)

    def __mod__(self, other):
        return self._with("%", other)

    def __add__(self, other):
        return self._with("+", other)


_engine_seed = 42


def init(seed: int | None = None) -> int:
    """Sets the seed of all draws that name none, from the clock if it is not given; returns it."""
    global _engine_seed
    _engine_seed = int(time.time()) if seed is None else int(seed)
    return _engine_seed


def engine_seed() -> int:
    return _engine_seed


def _key(agent, tick, number: int, seed: int | None):
    """Each part is mixed before the next is added, so that no stream of draws is another one shifted."""
    stream = _mixed(_mixed(_engine_seed if seed is None else seed) * 31 + number)
    return _spread(agent) + _mixed(_spread(tick) + stream)


def draw(agent: Column | str, tick: int | Column, number: int, seed: int | None = None) -> Column:
    """An integer in [0, MODULUS) for an agent id of zero or more. number tells the draws of one tick apart."""
    agent = (F.col(agent) if isinstance(agent, str) else agent).cast("long")
    tick = tick.cast("long") if isinstance(tick, Column) else tick
    return _mixed(_key(agent, tick, number, seed))


def with_draws(df: DataFrame, name: str, agents: Column, tick: int, number: int, seed: int | None = None) -> DataFrame:
    """df with an array of draw() for an array of agents.

    Inside lambdas nothing is evaluated once for several uses, so the steps of the mix, each used twice, are columns.
    """
    stream = _key(0, tick, number, seed) - _spread(0)
    out = df.withColumn("_a", F.transform(F.transform(agents, lambda x: x % MODULUS * 16807 % MODULUS), lambda y: ((y * y + 977) % MODULUS + stream) % MODULUS * 48271 % MODULUS))
    out = out.withColumn("_b", F.transform("_a", lambda a: (a * a + 12345) % MODULUS))
    out = out.withColumn("_c", F.zip_with("_b", "_a", lambda b, a: (b * 69621 + a) % MODULUS))
    return out.withColumn(name, F.zip_with("_c", "_b", lambda c, b: (c * c + b) % MODULUS)).drop("_a", "_b", "_c")


def uniform(agent: Column | str, tick: int | Column, number: int, seed: int | None = None) -> Column:
    """A number in [0, 1)."""
    return draw(agent, tick, number, seed) / F.lit(float(MODULUS))


def integers(low: int, high: int | Column, agent: Column | str, tick: int | Column, number: int, seed: int | None = None) -> Column:
    """An integer in [low, high)."""
    return (F.floor(uniform(agent, tick, number, seed) * (high - low)) + low).cast("long")


def choice(options: Column, agent: Column | str, tick: int | Column, number: int, seed: int | None = None) -> Column:
    """One element of an array; null of an empty one."""
    return F.get(options, integers(0, F.size(options), agent, tick, number, seed).cast("int"))


def shuffled(items: Column, agent: Column | str, tick: int | Column, number: int, seed: int | None = None) -> Column:
    """An array's elements in an order drawn for the agent: each place gets a draw of its own."""
    agent = (F.col(agent) if isinstance(agent, str) else agent).cast("long")
    drawn = F.transform(items, lambda x, i: F.struct(_mixed(draw(agent, tick, number, seed) + _spread(i.cast("long"))).alias("d"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(drawn), lambda s: s.x)


def draw_array(agents: np.ndarray, tick: int, number: int, seed: int | None = None) -> np.ndarray:
    """uniform() for an array of ids, where agents act in Python."""
    return _mixed(_key(agents.astype(np.int64), tick, number, seed)) / float(MODULUS)


def draw_sql(agent: str, tick: str | int, number: int, seed: int | None = None) -> str:
    """draw() as SQL text, for engines that share integer arithmetic."""
    tick = tick if isinstance(tick, int) else _Text(f"CAST({tick} AS BIGINT)")
    return str(_mixed(_key(_Text(f"CAST({agent} AS BIGINT)"), tick, number, seed)))


def uniform_sql(agent: str, tick: str | int, number: int, seed: int | None = None) -> str:
    return f"(({draw_sql(agent, tick, number, seed)}) / {float(MODULUS)})"
