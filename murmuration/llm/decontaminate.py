"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts
from .shingles import WORDS, shingle_hashes, slices, values, word_hashes

#: An item is found in a document that has this share of its shingles, in percent.
PERCENT = 80
#: Minima kept of an item whose set has 2^k to 2^(k+1) shingles: twice 2^(k+1), within these bounds.
LEAST_HASHES, MOST_HASHES = 32, 256
#: How far under the threshold an estimate may lie for the sets to be compared: an item at it is missed with a chance under
#: 1e-11, as 8 of 32 minima or more are asked for.
DEVIATIONS = 8
#: Shingles of items that one search holds in every task, about; a larger benchmark is searched for in several blocks.
BLOCK_SHINGLES = 1 << 21
_FILTER_BITS = 22
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(0, 1 << 64, MOST_HASHES, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, MOST_HASHES, np.uint64)

_ITEMS = "item_id long, width int, shingles array<long>"
_FOUND = "doc_id long, item_id long, n_item long, n_shared long"


@dataclass
class WidthIndex:
    """Items of one shingle width: their sets, and which shingles are minima of which items, how often."""

    ids: list[int | None]
    sets: list[np.ndarray]
    hashes: np.ndarray  # of each item, by its size class
    keys: np.ndarray  # sorted shingles that are a minimum
    first: np.ndarray  # of each key, where its items begin
    item: np.ndarray
    weight: np.ndarray
    filter: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int | None, np.ndarray]]) -> WidthIndex:
        keys, owners, weights, hashes = [], [], [], []
        for k, (_, s) in enumerate(items):
            n = int(np.clip(2 << len(s).bit_length(), LEAST_HASHES, MOST_HASHES))
            lowest = (s[:, None] * _MULTIPLY[:n] + _ADD[:n]).argmin(0)
            at, times = np.unique(lowest, return_counts=True)
            keys.append(s[at])
            owners.append(np.full(len(at), k))
            weights.append(times)
            hashes.append(n)
        keys, owners, weights = (np.concatenate(x) for x in (keys, owners, weights))
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[distinct >> np.uint64(64 - _FILTER_BITS)] = True
        return cls([i for i, _ in items], [s for _, s in items], np.array(hashes), distinct, np.append(first, len(keys)), owners[order], weights[order], bits)

    def find(self, words: np.ndarray, firsts: np.ndarray, width: int) -> Iterator[tuple[int, int | None, int, int]]:
        """(text, item id, item's size, shared) for the items whose containment passes, of texts given by their words."""
        shingles, starts = shingle_hashes(words, firsts, width)
        maybe = np.flatnonzero(self.filter[shingles >> np.uint64(64 - _FILTER_BITS)])
        place = np.searchsorted(self.keys, shingles[maybe])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == shingles[maybe]
        if not hit.any():
            return
        text = np.searchsorted(starts, maybe[hit], "right") - 1
        # a shingle counts once in a text
        pair = np.unique(text * len(self.keys) + place[hit])
        text, key = np.divmod(pair, len(self.keys))
        counts = self.first[key + 1] - self.first[key]
        at = np.repeat(self.first[key], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(text, counts) * len(self.ids) + self.item[at]
        both, where = np.unique(owner, return_inverse=True)
        hits = np.bincount(where, self.weight[at])
        text, item = np.divmod(both, len(self.ids))
        # the share of minima found estimates containment; DEVIATIONS standard deviations below the threshold stay
        n, p = self.hashes[item], PERCENT / 100
        likely = hits >= n * p - DEVIATIONS * np.sqrt(n * p * (1 - p))
        for t, k in zip(text[likely].tolist(), item[likely].tolist(), strict=True):
            own = self.sets[k]
            shared = int(np.isin(own, shingles[starts[t] : starts[t + 1]]).sum())
            if shared * 100 >= len(own) * PERCENT:
                yield t, self.ids[k], len(own), shared


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for item, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            words, firsts = word_hashes([text])
            if len(words):
                width = min(WORDS, len(words))
                rows.append((item, width, np.unique(shingle_hashes(words, firsts, width)[0]).view(np.int64)))
        if rows:
            ids, widths, sets = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "width", "shingles"])


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, at, rows = b.column("doc_id").to_pylist(), 0, []
        for part in slices(values(b.column("text"))):
            words, firsts = word_hashes(part)
            for width, of_width in index.value.items():
                rows += [(ids[at + t], *rest) for t, *rest in of_width.find(words, firsts, width)]
            at += len(part)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_item", "n_shared"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(document, item) pairs in which the document has PERCENT of the item's distinct 5-word shingles or more.

    Items are partitioned by the size of their shingle set; each size class has its own number of MinHash minima. A
    minimum of an item lies in a document with a chance equal to the item's containment, however long the document is,
    so the share of minima met in the whole document estimates containment, and what passes is verified on the full
    sets. Documents are only mapped over. The items' index is broadcast, in blocks of about BLOCK_SHINGLES.

    Documents without an id are found under a null doc_id, and texts of any length are searched whole. Words as in near_groups(); an item of fewer than five words is one run of that many words. Null, empty and blank
    texts match nothing. Repeated rows give repeated pairs, items with equal texts a pair each; an item without an id
    is found under a null item_id. Other columns are not read; an empty table on either side gives no rows.

    Returns doc_id, item_id, n_item (the item's shingles), n_shared.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "items")
    items = scratch.write(texts(benchmark.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(_items, _ITEMS), "items")
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_SHINGLES)
    source, out = texts(docs), None
    for block in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id").collect()
        by_width: dict[int, list] = {}
        for r in rows:
            by_width.setdefault(r.width, []).append((r.item_id, np.array(r.shingles, np.int64).view(np.uint64)))
        index = spark.sparkContext.broadcast({w: WidthIndex.build(rows) for w, rows in by_width.items()})
        found = source.mapInArrow(partial(_search, index=index), _FOUND)
        out = out.unionByName(found) if out is not None else found
    return out if out is not None else spark.createDataFrame([], _FOUND)
