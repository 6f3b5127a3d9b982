"""Checkpoints: tables as Parquet folders, the rest as a JSON manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.network import Network
from ..operators.population import Population
from ..operators.schedule import Schedule
from ..operators.space import Space


class Checkpoint:
    """A folder with agents, spaces, networks and a manifest that holds the seed, the schedule and other values.

    Tables are written at once; the manifest, written by commit(), comes last and makes the checkpoint valid. Draws depend
    on (seed, tick, agent) alone, so the seed is all the state that random numbers have.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._manifest = spark, path.rstrip("/"), {}

    # -- saving --

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def save_random(self, seed: int) -> None:
        self._manifest["seed"] = seed

    def save_agents(self, population: Population) -> None:
        self._write(population.df, "agents")

    def save_space(self, name: str, space: Space) -> None:
        self._write(space.locations, f"space-{name}")

    def save_network(self, name: str, network: Network) -> None:
        self._write(network.nodes, f"network-{name}-nodes")
        self._write(network.edges, f"network-{name}-edges")
        self._manifest.setdefault("networks", {})[name] = network.directed

    def save_schedule(self, schedule: Schedule) -> None:
        self._manifest["schedule"] = {"tick": schedule.tick, "events": schedule.records()}

    def save(self, key: str, value) -> None:
        self._manifest.setdefault("values", {})[key] = value

    def commit(self) -> None:
        text = self.spark.createDataFrame([(json.dumps(self._manifest),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    # -- restoring --

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Checkpoint:
        out = cls(spark, path)
        out._manifest = json.loads(spark.read.text(f"{out.path}/manifest", wholetext=True).first()[0])
        return out

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def restore_random(self) -> int:
        return self._manifest["seed"]

    def restore_agents(self) -> Population:
        return Population(self._read("agents"))

    def restore_space(self, name: str, like: Space) -> Space:
        """The saved locations, order of arrival included, in a space with the box and borders of `like`."""
        return replace(like, locations=self._read(f"space-{name}"))

    def restore_network(self, name: str) -> Network:
        return Network(self._read(f"network-{name}-nodes"), self._read(f"network-{name}-edges"), self._manifest["networks"][name])

    def restore_schedule(self, schedule: Schedule, make: Callable[[dict], Callable | None], **options) -> None:
        saved = self._manifest["schedule"]
        schedule.restore(saved["events"], saved["tick"], make, **options)

    def restore(self, key: str, restorer: Callable | None = None, *args):
        value = self._manifest["values"][key]
        return restorer(value, *args) if restorer else value
