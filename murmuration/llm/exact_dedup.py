"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, texts
from .shingles import values

BLOCK_BYTES = 4096
#: Bytes of text whose blocks a task sends on together, about.
SLICE_BYTES = 1 << 22
#: A block is hot if more than one in so many blocks of the table equals it; so there are fewer hot ones than this.
HOT_SHARE = 2000

_OCCURRENCE = pa.struct([("uid", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("sha", pa.string())])
_BLOCKS = "block binary, name long, at array<struct<uid: long, doc_id: long, pos: int, n: int, sha: string>>"
_NAMED = "uid long, doc_id long, pos int, n int, sha string, name long"
_SPACE = b" \t\n\v\f\r"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + out + (b" " if text[-1] in _SPACE else b"")


def _blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK_BYTES] for k in range(0, max(1, len(text)), BLOCK_BYTES)]


def _number(block: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(block, digest_size=8).digest(), "little", signed=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each block's number occurs in a batch."""
    for b in batches:
        counts = Counter(_number(x) for text in values(b.column("text")) for x in _blocks(normalised(text)))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["number", "n"])


def _shown(batches: Iterator[pa.RecordBatch], numbers: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch that have one of the numbers, each once."""
    for b in batches:
        found = {x for text in values(b.column("text")) for x in _blocks(normalised(text)) if _number(x) in numbers}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["block"])


def _hot_blocks(source: DataFrame) -> list[bytes]:
    """Blocks that make up more than one in HOT_SHARE of all, in order: fewer than HOT_SHARE, 8 MB at most, but for those
    that share a number with one of them.

    Counts by a block's 64-bit number find them; the blocks themselves come in a second pass, if there are any.
    """
    counts = source.select("text").mapInArrow(_counted, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n")).limit(HOT_SHARE)
    every = counts.agg(F.sum("n").alias("total"))
    hot = most.join(F.broadcast(every), how="cross").filter(F.col("n") * HOT_SHARE > F.col("total")).filter("n > 1")
    numbers = frozenset(r.number for r in hot.collect())
    if not numbers:
        return []
    shown = source.select("text").mapInArrow(partial(_shown, numbers=numbers), "block binary").distinct()
    return sorted(bytes(r.block) for r in shown.collect())


def _cut(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """Blocks, every distinct one of SLICE_BYTES of text once with the list of its places. Hot ones have a name and no bytes."""

    def emitted(at: dict[bytes, list[tuple]]) -> pa.RecordBatch:
        names = [hot.value.get(x) for x in at]
        blocks = [x if name is None else None for x, name in zip(at, names, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array(names, pa.int64()), _lists(at.values())], names=["block", "name", "at"])

    for b in batches:
        at: dict[bytes, list[tuple]] = {}
        size = 0
        for uid, doc_id, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), values(b.column("text")), strict=True):
            text = normalised(text)
            blocks = _blocks(text)
            for pos, block in enumerate(blocks):
                sha = hashlib.sha256(text).hexdigest() if pos == 0 else None
                at.setdefault(block, []).append((uid, doc_id, pos, len(blocks), sha))
            size += len(text)
            if size >= SLICE_BYTES:
                yield emitted(at)
                at, size = {}, 0
        if at:
            yield emitted(at)


def _lists(groups) -> pa.ListArray:
    ends, flat = [0], []
    for g in groups:
        flat.extend(g)
        ends.append(len(flat))
    columns = zip(*flat, strict=True)
    fields = [pa.array(c, f.type) for c, f in zip(columns, _OCCURRENCE, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_OCCURRENCE)))


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for the runs of equal blocks in a sorted partition: its number, then the run's place. Holds one batch."""
    base, run, last = TaskContext.get().partitionId() << 40, -1, None
    for b in batches:
        blocks, lists = values(b.column("block")), b.column("at")
        names, counts = [], lists.value_lengths().to_pylist()
        for block, name in zip(blocks, b.column("name").to_pylist(), strict=True):
            if name is None and block != last:
                run, last = run + 1, block
            names.append(base + run if name is None else name)
        flat = lists.flatten()
        repeated = [name for name, k in zip(names, counts, strict=True) for _ in range(k)]
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(repeated, pa.int64())], names=["uid", "doc_id", "pos", "n", "sha", "name"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """The group of equal texts of every row; texts are compared after each white space run became one space.

    Fixed-size blocks are sorted and named by integers; then adjacent names are paired and the distinct pairs are named
    in turn, until each document has one name. Blocks and pairs are compared themselves, so that no hash decides:
    equal names mean equal texts. The text is shuffled once, but for blocks that a large share of the table has: these are
    known beforehand and named where they are read, so that no task gets all places of one.

    Texts of any length are read whole. Null text counts as empty; all empty texts are equal. Of rows with one text the smallest doc_id stays (null ids
    sort first); of rows that repeat the id as well, the first read. Empty tables give no rows; other columns are not
    read.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    spark = docs.sparkSession
    scratch, n_parts = Scratch(spark, "exact"), partitions(docs.sparkSession)
    source = texts(docs, F.monotonically_increasing_id().alias("uid"))
    hot = spark.sparkContext.broadcast({block: -2 - k for k, block in enumerate(_hot_blocks(source))})
    # -1 stands for no block; hot blocks are dealt to all parts, by the place of one of their documents, and sort before the others
    spread = F.when(F.col("name").isNotNull(), F.col("at")[0].uid)
    blocks = source.mapInArrow(partial(_cut, hot=hot), _BLOCKS).repartition(n_parts, "block", spread).sortWithinPartitions("block")
    names = scratch.write(blocks.mapInArrow(_name, _NAMED), "names")

    longest = names.agg(F.max("n")).first()[0] or 0
    level, current = 0, names.filter("n > 1").select("uid", "pos", "name")
    while longest > 1:
        pairs = current.groupBy("uid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        named = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        # Written: names depend on partition numbers; and a join of two shuffled tables can split a frequent pair.
        named = scratch.write(named, f"pairs{level}")
        current = scratch.write(pairs.join(named, ["a", "b"]).select("uid", "pos", "name"), f"level{level}")
        level, longest = level + 1, (longest + 1) // 2

    heads = names.filter("pos = 0").select("uid", "doc_id", "n", "sha", "name")
    whole = heads.filter("n = 1")
    if level:
        long = heads.filter("n > 1").drop("name").join(current.select("uid", "name"), "uid")
        whole = scratch.write(whole.unionByName(long), "whole")
        for name in ("names", *(f"{part}{k}" for k in range(level) for part in ("pairs", "level"))):
            scratch.drop(name)
    first = F.min(F.struct("doc_id", "uid")).alias("first")
    groups = whole.groupBy("n", "name").agg(first, F.count("*").alias("size")).filter("size > 1")
    groups = scratch.write(groups, "groups")
    joined = whole.join(groups, ["n", "name"], "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.uid") == F.col("uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
