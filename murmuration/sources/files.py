"""File names, parameters and log files on the driver's side."""

from __future__ import annotations

import argparse
import json
from functools import reduce

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws


def _hadoop_path(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop_path(spark, path)
    return fs.exists(at)


def free_path(spark: SparkSession, path: str) -> str:
    """path, or with _1, _2, ... before its suffix, the first that is not taken on its file system."""
    stem, dot, suffix = path.rpartition(".")
    if not dot or "/" in suffix:
        stem, dot, suffix = path, "", ""
    out, k = path, 0
    while exists(spark, out):
        k += 1
        out = f"{stem}_{k}{dot}{suffix}"
    return out


def read_parameters(parameters_file: str, override: str = "") -> dict:
    """A YAML file's mapping, with the entries of a JSON object ('' for none) put over it.

    An entry random.seed becomes the seed of all draws that name none.
    """
    with open(parameters_file) as f:
        out = yaml.safe_load(f) or {}
    out |= json.loads(override) if override else {}
    if "random.seed" in out:
        draws.init(out["random.seed"])
    return out


def dump_parameters(spark: SparkSession, parameters: dict, path: str) -> str:
    """Writes parameters as YAML under a free name, which is returned."""
    out = free_path(spark, path)
    at, fs = _hadoop_path(spark, out)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(yaml.safe_dump(parameters).encode()))
    finally:
        stream.close()
    return out


def arguments_parser() -> argparse.ArgumentParser:
    """For a command line of two places; their names are fixed, as scripts read them from the result."""
    out = argparse.ArgumentParser(description="Runs a model.")
    for name, more in (("parameters_file", {"help": "YAML with the model's settings"}), ("parameters", {"nargs": "?", "default": "{}", "help": "JSON whose entries replace those of the file"})):
        out.add_argument(name, **more)
    return out


def write_log(log: DataFrame, path: str, order: list[str], delimiter: str = ",") -> str:
    """A log as one delimited file with a header, in order, in a folder under a free name, which is returned.

    For logs, a row for each tick; tables that grow with the agents are for append_log().
    """
    out = free_path(log.sparkSession, path)
    log.repartition(1).sortWithinPartitions(*order).write.csv(out, header=True, sep=delimiter)
    return out


class LogSink:
    """A log that grows tick by tick: rows are buffered for some ticks, then written as one more numbered batch.

    A batch is sorted by `order`, and batches are numbered in a column, so that read() gives all rows in the order in which
    they were logged, within a tick by rank as `order` says. The buffer holds plans, not rows.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str], buffer_size: int = 1000, delimiter: str = ","):
        self.spark, self.path, self.order, self.size, self.delimiter = spark, free_path(spark, path), order, buffer_size, delimiter
        self._waiting: list[DataFrame] = []
        self._batches = 0

    def log(self, rows: DataFrame) -> None:
        """Takes the rows of a tick."""
        self._waiting.append(rows)
        if len(self._waiting) >= self.size:
            self.write()

    def write(self) -> None:
        """Writes what waits."""
        if not self._waiting:
            return
        rows = reduce(DataFrame.unionByName, (r.withColumn("_at", F.lit(k)) for k, r in enumerate(self._waiting)))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, "_at", *self.order).sortWithinPartitions("_at", *self.order)
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).drop("_at")
        rows.write.csv(f"{self.path}/batch={self._batches}", header=True, sep=self.delimiter)
        self._waiting, self._batches = [], self._batches + 1

    def close(self) -> None:
        self.write()

    def read(self, schema: str) -> DataFrame:
        """All rows that were written, in order."""
        rows = self.spark.read.csv(self.path, header=True, schema=f"{schema}, _row long", sep=self.delimiter)
        return rows.orderBy("batch", "_row").drop("batch", "_row")


def append_log(log: DataFrame, path: str, delimiter: str = ",") -> None:
    """Adds rows to a folder of delimited files, written by all tasks."""
    log.write.mode("append").csv(path, header=True, sep=delimiter)


def read_log(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, sep=delimiter)
