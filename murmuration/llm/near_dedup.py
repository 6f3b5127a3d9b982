"""Near duplicates: MinHash banding, exact verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled, texts
from .components import components
from .shingles import shingle_sets, values

#: With 24 bands of 4 minima, a pair at similarity 0.85 is missed with a chance of 2e-8.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
_RNG = np.random.default_rng(97)
_MULTIPLY = _RNG.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, HASHES, np.uint64)
_ROWS_AT_ONCE = 2048

_SKETCH = "doc_id long, n long, digest binary, minima array<int>"
_BANDS = "band long, number int, rep long"
_SET = "doc_id long, shingles array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash (multiply, add, keep the high half) over a set, as 32-bit numbers."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _ROWS_AT_ONCE):
        np.minimum(out, (shingles[at : at + _ROWS_AT_ONCE, None] * _MULTIPLY + _ADD).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, flat = [], [], []
        for s in shingle_sets(values(b.column("text"))):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            flat.append(minima(s))
        ends = np.arange(0, HASHES * len(n) + 1, HASHES, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "n", "digest", "minima"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = b.column("minima").flatten().to_numpy().reshape(-1, BANDS, ROWS).astype(np.int64)
        keys = np.arange(BANDS, dtype=np.int64)[None, :]
        for j in range(ROWS):
            keys = (keys ^ values[:, :, j]) * np.int64(0x5851F42D4C957F2D) + np.int64(j + 1)
            keys ^= (keys >> 29) & np.int64(0x7FFFFFFFF)
        row = np.repeat(np.arange(b.num_rows), BANDS)
        number = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(number), b.column("rep").take(pa.array(row))], names=["band", "number", "rep"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(shingle_sets(values(b.column("text"))))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) pairs with the sizes of the intersection and the union of their full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    counted = both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return counted.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("either"))


def _linkable(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Classes that can have a link, with `common`: how many of their shingles some other candidate has too.

    A link shares percent / 100 of the larger set at least, and can only share common shingles. Near copies that were
    changed in many places, each in its own way, fail this at once, whatever the number of them.
    """
    shingles = sets.select("doc_id", F.explode("shingles").alias("s"))
    owners = shingles.groupBy("s").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).filter("rep = other")
    alone = owners.groupBy("rep").agg(F.count("*").alias("alone"))
    asked = classes.join(sets.select(F.col("doc_id").alias("rep")), "rep", "left_semi").join(alone, "rep", "left")
    counted = asked.select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"), "minima")
    return counted.filter(F.col("common") * 100 >= F.col("n") * percent)


def _least_equal(percent: int) -> int:
    """Equal minima that a pair needs before its sets are compared: six standard deviations below those at the threshold."""
    p = percent / 100
    return int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The component of near-equal texts of each row, over sets of 5-word shingles.

    Documents with one shingle set form a class, of which the smallest id stands for all. Classes that share a band of
    minima are candidates; those with too many shingles that no other candidate has leave. In each bucket all members are
    first compared with the smallest; that joins most copies, at a cost in proportion to the bucket. Then, in buckets that
    still hold several components, the pairs across components are compared too, if sizes, shared shingles, the triangle
    inequality over their distances from the bucket's smallest, and the number of equal minima allow a link. Each link is confirmed on the full sets, and none between different texts is left out
    but by the chance that BANDS states. Components come from large-star and small-star.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than five words has its whole sequence as
    one shingle; null, empty and blank texts have none and are linked with nothing, as are rows without an id. Texts of any
    length are read whole. Rows that
    share an id count as one document. Other columns are not read; an empty table gives no rows.

    Returns doc_id, n_shingles, component_id, kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    sketch = scratch.write(texts(docs).mapInArrow(_sketch, _SKETCH), "sketch")
    named = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.count("*").alias("size"))
    classes = scratch.write(classes, "classes")

    bands = scratch.write(classes.select("rep", "minima").mapInArrow(_bands, _BANDS), "bands")
    buckets = scratch.write(bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band"), "buckets")
    asked = scratch.write(bands.join(buckets, "band", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "asked")
    scratch.drop("bands")
    full = texts(docs).join(small_or_shuffled(asked), "doc_id", "left_semi").mapInArrow(_sets, _SET)
    sets = scratch.write(full, "sets")
    live = scratch.write(_linkable(classes, sets, percent), "live")
    for name in ("buckets", "asked"):
        scratch.drop(name)

    bands = scratch.write(live.select("rep", "minima").mapInArrow(_bands, _BANDS), "live-bands")
    buckets = bands.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    buckets = scratch.write(buckets.select("band", "pivot"), "live-buckets")
    members = scratch.write(bands.join(buckets, "band").select("band", "number", "pivot", "rep"), "members")
    for name in ("live-bands", "live-buckets"):
        scratch.drop(name)

    star = members.filter("pivot != rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = scratch.write(_verified(star, sets), "star")
    linked = F.col("shared") * 100 >= F.col("either") * percent
    links = star.filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = scratch.write(components(links, scratch, "star-components"), "known")

    # what each member of a bucket brings to the comparison across components
    far = star.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (1 - F.col("shared") / F.col("either")).alias("far"))
    placed = members.join(far, ["pivot", "rep"], "left").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("band", "number", "rep", F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("component", "rep").alias("component"))
    placed = scratch.write(placed, "placed")
    open_buckets = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    open_buckets = scratch.write(open_buckets.filter("low != high AND size > 2").select("band"), "open")
    waiting = placed.join(open_buckets, "band").join(live, "rep")
    waiting = scratch.write(waiting.select("band", "number", "rep", "far", "component", "n", "common", "minima"), "waiting")

    def side(suffix: str) -> DataFrame:
        return waiting.select("band", "number", *(F.col(c).alias(f"{c}_{suffix}") for c in ("rep", "far", "component", "n", "common", "minima")))

    left, right = side("a"), side("b").drop("number")
    left_number = F.col("number")
    same = F.zip_with("minima_a", "minima_b", lambda x, y: x == y)
    agree = F.size(F.filter(same, lambda x: x))
    whole_band = lambda j: F.forall(F.slice(same, j * ROWS + 1, F.lit(ROWS)), lambda x: x)
    # a pair comes out of the first of the bands that it shares
    later = F.when(left_number > 0, F.exists(F.sequence(F.lit(0), left_number - 1), whole_band)).otherwise(False)
    allowed = (
        (F.col("rep_a") < F.col("rep_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (F.least("common_a", "common_b") * 100 >= (F.col("n_a") + F.col("n_b") - F.least("common_a", "common_b")) * percent)
        & (F.abs(F.col("far_a") - F.col("far_b")) <= 1 - percent / 100 + 1e-9)
        & (agree >= _least_equal(percent))
        & ~later
    )
    across = left.join(right, (left.band == right.band) & allowed).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    across = scratch.write(across, "across")
    for name in ("members", "star", "placed", "open", "waiting", "live"):
        scratch.drop(name)
    more = _verified(across, sets).filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # the star's components stand in for its links
    trees = known.filter("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = scratch.write(components(trees.unionByName(more), scratch, "all-components"), "final")
    shared = scratch.write(classes.filter("size > 1").select("digest", "rep"), "shared")
    for name in ("sets", "across", "known", "classes"):
        scratch.drop(name)
    # a row without an id has no class
    rows = sketch.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(shared, "digest", "left")
    rows = rows.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node")).join(final, "node", "left")
    component = F.coalesce("component", "node")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
