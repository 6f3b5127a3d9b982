"""All registered queries and SQL twins, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "colocation_log"


def query(name: str, sql: str | None = None):
    """Registers a function of Views under a name, with its SQL twin."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


from . import aggregates, checkpoints, events, models, networks, populations, rasters, spaces  # noqa: E402, F401
