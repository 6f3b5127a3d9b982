"""What the text operators share: document input, unique keys, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from ..sources.workers import importable


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and the text as UTF-8 bytes (null: empty); other columns, whatever their names, stay out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch that a Python function turns into objects together.
ROWS_AT_ONCE = 256


def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS_AT_ONCE at most, views of those given: what a function makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


#: Bytes of rows, about, that Spark hands to a Python function at a time in a session of small_batches().
BATCH_BYTES = 1 << 20
_MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold about BATCH_BYTES, or one longer row; a smaller setting stays.

    Without it a batch is 10,000 rows, for texts tens of MB, which the executor holds beside its heap while it builds the
    batch, its worker once more, and neither gives back between tasks. Spark reads the setting when a query runs, which for
    a returned DataFrame is later; so it is not set back.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_MOST_BYTES))
    if now > BATCH_BYTES:
        spark.conf.set(_MOST_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table (a key and few numbers) that may be broadcast: 32 MB or so.
BROADCAST_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """A written narrow table, marked for broadcast if it has BROADCAST_ROWS at most, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text and key: a number that orders rows as their ids do and that no two rows share.

    That is the id itself, unless ids are null or repeat; then rows are written down and numbered in order.
    """
    source = texts(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = ids.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return source.withColumn("key", F.col("doc_id"))
    rows = scratch.write(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select("doc_id", "row").repartitionByRange(partitions(docs.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    numbered = scratch.write(numbered.withColumn("key", F.monotonically_increasing_id()).select("row", "key"), "numbered")
    return rows.join(numbered, "row").drop("row")
