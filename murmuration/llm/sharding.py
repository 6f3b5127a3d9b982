"""Contiguous shards of nearly equal size from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

_LOCAL = "doc_id long, size long, text_crc32 long, part int, before long, row long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, in a sorted partition, each row's place and the bytes before it. Holds one batch."""
    part, at, seen = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        ends = np.cumsum(size) + at
        rows = np.arange(seen, seen + len(size))
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(ends - size), pa.array(rows)],
            names=[*b.schema.names, "part", "before", "row"],
        )
        if len(size):
            at, seen = int(ends[-1]), seen + len(size)


def byte_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Documents in order of doc_id, cut into contiguous shards of nearly equal bytes.

    One range sort of (doc_id, size, checksum) gives ordered partitions, each of which numbers its own rows and bytes.
    Only the totals, one row for each partition, come to the driver; their prefix sums turn local places into global
    ones. A row belongs to the shard in which its middle byte lies, so shards differ by a row's size at most.

    Size is the text's UTF-8 bytes plus 1, a null text having none. Null ids come first. Rows with one id are ordered
    by size and checksum; rows equal in all three are interchangeable. An empty table gives no rows; where one text
    spans several targets, the shards between stay empty. Other columns are not read.

    Returns doc_id, size, text_crc32, shard, slot (place in the shard, from 0).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    keys = ("doc_id", "size", "text_crc32")
    ordered = narrow.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    # Written once: the range bounds come from a sample, and both passes below must see the same partitions.
    local = scratch.write(ordered.mapInArrow(_running, _LOCAL), "local")

    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    total = sum(r.bytes for r in totals)
    starts = zip(
        (r.part for r in totals),
        accumulate((r.bytes for r in totals), initial=0),
        accumulate((r.rows for r in totals), initial=0),
    )
    # One row for each partition of the sort, whatever the table's size.
    offsets = spark.createDataFrame(list(starts), "part int, bytes_before long, rows_before long")
    middle = 2 * (F.col("bytes_before") + F.col("before")) + F.col("size")
    placed = local.join(F.broadcast(offsets), "part").select(
        *keys,
        # in decimals: bytes times shards can pass 2^63 on very large tables
        F.floor(middle.cast("decimal(28,0)") * F.lit(n_shards) / F.lit(max(1, 2 * total)).cast("decimal(20,0)")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row")).alias("place"),
    )
    firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    first = F.element_at(F.array(*(F.lit(int(firsts.get(s, 0))) for s in range(n_shards))), F.col("shard") + 1)
    return placed.select(*keys, "shard", (F.col("place") - first).cast("long").alias("slot"))
