"""Corpus preparation: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A stage leaves the session with small_batches().
"""

from __future__ import annotations

from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm.common import Scratch, importable, partitions, small_batches, small_or_shuffled, smaller, table
from murmuration.llm.decontaminate import contaminated
from murmuration.llm.exact_dedup import exact_groups
from murmuration.llm.language import LEAST_PER_GRAM, LEAST_SCORE, has_letter, identify, models, rejected
from murmuration.llm.near_dedup import near_groups
from murmuration.llm.pieces import encode_digests, public_model

#: Near copies share this Jaccard similarity of word shingles, in percent.
NEAR_PERCENT = 80


def _free(docs: DataFrame, name: str) -> str:
    """name, with as many bars before it as no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a number that no two rows share and that orders them as their ids do,
    nulls first.

    That is the id itself, unless ids are null or repeat; then rows are written down and numbered in order.
    """
    row, read = _free(docs, "row"), _free(docs, "read")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not ids.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    rows = scratch.write(docs.withColumn(read, F.monotonically_increasing_id()), "rows")
    order = rows.select("doc_id", read).repartitionByRange(partitions(docs.sparkSession), "doc_id", read).sortWithinPartitions("doc_id", read)
    numbered = scratch.write(order.withColumn(row, F.monotonically_increasing_id()).select(read, row), "numbered")
    return rows.join(numbered, read).drop(read), row


def _named(rows: DataFrame, row: str) -> DataFrame:
    """What the operators read, with the row's number as the id: a decision then names one row."""
    return rows.select(F.col(row).alias("doc_id"), "text")


def _without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """rows but for those whose number is a doc_id of dropped, a written table; without the number."""
    named = dropped.select(F.col("doc_id").alias(row))
    return rows.join(small_or_shuffled(named), row, "left_anti").select([c for c in rows.columns if c != row])


def _lettered(batches, at: int):
    for b in smaller(batches):
        yield b.filter(pa.array([has_letter(t) for t in b.column(at).cast(pa.string()).to_pylist()], pa.bool_()))


def _told(batches, model, at: int):
    for b in smaller(batches):
        yield b.filter(pa.array(~rejected(*model.value.predict(b.column(at).cast(pa.string()).to_pylist()))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Those without a letter go, those of which no language has half the posterior, and those whose grams would be four
    times likelier if drawn evenly than from the likeliest language. Without any label, documents with a letter stay. With the languages of
    one matrix the scan itself decides; more take identify(), whose decisions name rows.

    Null and empty texts go; texts of any length are read whole; rows with a null id, repeated rows and columns of any other
    name come through as they are; an empty table gives no rows.
    """
    importable(spark)
    small_batches(spark)
    learnt = models(docs)
    first, second = next(learnt, None), next(learnt, None)
    at = docs.columns.index("text")
    if first is None:
        return docs.mapInArrow(partial(_lettered, at=at), docs.schema)
    if second is None:
        return docs.mapInArrow(partial(_told, model=spark.sparkContext.broadcast(first), at=at), docs.schema)
    scratch = Scratch(spark, "stage-language")
    rows, row = _rows(docs, scratch)
    found = identify(_named(rows, row), chain([first, second], learnt))
    unknown = (F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE) | (F.col("per_gram") < LEAST_PER_GRAM)
    return _without(rows, row, scratch.write(found.filter(unknown).select("doc_id"), "dropped"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts, white space runs counting as one space.

    The row with the smallest id stays, one without an id before all others, and of rows with one id the first read. Null
    texts equal empty ones; long texts are compared whole; columns of any other name come through; an empty table gives
    no rows.
    """
    importable(spark)
    small_batches(spark)
    scratch = Scratch(spark, "stage-exact")
    rows, row = _rows(docs, scratch)
    return _without(rows, row, scratch.write(exact_groups(_named(rows, row)).filter("NOT kept").select("doc_id"), "dropped"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: word shingles of five with a Jaccard similarity of NEAR_PERCENT or more, or
    a chain of such links.

    The row with the smallest id stays, one without an id before all others, and of rows with one id the first read. Null,
    empty and blank texts have no shingles and all stay; long texts are read whole; columns of any other name come
    through; an empty table gives no rows.
    """
    importable(spark)
    small_batches(spark)
    scratch = Scratch(spark, "stage-near")
    rows, row = _rows(docs, scratch)
    return _without(rows, row, scratch.write(near_groups(_named(rows, row), NEAR_PERCENT).filter("NOT kept").select("doc_id"), "dropped"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold four fifths of the word shingles of a benchmark item.

    Each row is decided by its own text, with an id, without one or with another row's. Null and empty texts stay; long
    texts are searched whole; columns of any other name come through; an empty table gives no rows, an empty benchmark
    all of them.
    """
    small_batches(spark)
    scratch = Scratch(spark, "stage-leaks")
    rows, row = _rows(docs, scratch)
    found = contaminated(_named(rows, row), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(rows, row, scratch.write(found, "dropped"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each remaining document's ids, decoded text and source spans.

    A null text is encoded as an empty one, a long text whole; rows that share an id or have none have a row each; other
    columns are not read; an empty table gives no rows.
    """
    importable(spark)
    small_batches(spark)
    return encode_digests(docs, public_model())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's rows written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
        docs = done
    return docs


#: Not in SQL: the encoder and the language model have no SQL form. The tests hold run() against brute force.
ORACLE_SQL = None
