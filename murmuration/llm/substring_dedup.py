"""Removal of repeated 100-byte strings: text cut at minimizers into shards, each with a suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, partitions, small_or_shuffled
from .shingles import values
from .suffix_array import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
#: Grams in a window of LENGTH bytes.
_GRAMS = LENGTH - GRAM + 1
SLICE_BYTES = 1 << 20
_PLACE_BITS = 21
#: Bytes of a shard's text, beyond which it takes no further group of strings with one minimizer.
SHARD_BYTES = 1 << 20
#: Strings of a group at most (1.4 MB); a larger one is not put together but cut into its windows.
GROUP_STRINGS = 1 << 13
_RNG = np.random.default_rng(32)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_STEP = _RNG.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)

_PLACES = "gram long, key long, n long"
_CUT = "gram long, string binary, at int, key long, start long, known boolean"
_SPANS = "key long, start long, stop long"
_WINDOWS = "window binary, key long, start long"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling (GRAM is a power of two)."""
    out, width, k = _BYTE[data], 1, 0
    while width < GRAM:
        out = out[: len(out) - width] * _STEP[k] + out[width:]
        width, k = 2 * width, k + 1
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(35))


def _minimizers(data: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Runs of windows with one minimizer: (text, first window, windows, gram hash, gram's place from the first window), for
    texts laid end to end.

    The minimizer of a window is its gram with the smallest hash, the leftmost of equal ones, so equal windows have it at
    the same place and with the same hash.
    """
    hashes = _gram_hashes(data)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= _GRAMS:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (_GRAMS - width)], least[_GRAMS - width :])
    place = (least & low).astype(np.int64)
    windows = size - LENGTH + 1
    begin = np.zeros(len(place) + 1, bool)
    begin[1:-1] = place[1:] != place[:-1]
    begin[first] = True
    inside = np.zeros(len(place) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + windows, -1)
    inside = np.cumsum(inside)[:-1] > 0
    # a run ends where the next begins or where the windows of its text end
    begin[first + windows] = True
    starts = np.flatnonzero(begin)
    stops = np.append(starts[1:], len(place))
    held = starts < len(place)
    starts, stops = starts[held], stops[held]
    held = inside[starts]
    starts, stops = starts[held], stops[held]
    text = np.searchsorted(first, starts, "right") - 1
    return text, starts, stops - starts, hashes[place[starts]].view(np.int64), place[starts] - starts


def _runs(batch: pa.RecordBatch):
    """For slices of a batch: (its bytes, rows, keys of rows, and what _minimizers() finds). Texts under LENGTH have none."""
    rows, size, parts = [], 0, []

    def slice_():
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(p) for p in parts])
        first = np.cumsum(lengths) - lengths
        return data, np.array(rows), first, _minimizers(data, first, lengths)

    for i, text in enumerate(values(batch.column("text"))):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE_BYTES):
            # a longer text in pieces that share LENGTH - 1 bytes, so that each window lies in one
            piece = text[at : at + SLICE_BYTES + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if parts and size + len(piece) > SLICE_BYTES:
                yield slice_()
                rows, size, parts = [], 0, []
            rows.append((i, at))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield slice_()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each minimizer occurs in each document."""
    for b in batches:
        keys = b.column("key").to_numpy()
        for _, rows, _, (text, _, _, gram, _) in _runs(b):
            pairs = np.stack([rows[text, 0], gram], 1)
            pairs = pairs[np.lexsort((gram, pairs[:, 0]))]
            new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)]) if len(pairs) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at, 1]), pa.array(keys[pairs[at, 0]]), pa.array(np.diff(np.append(at, len(pairs))))], names=["gram", "key", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of runs whose minimizer is shared: each distinct one of a batch with its first place.

    Its other places in the batch repeat it as a whole: they are known spans, and only (key, start, length) of them goes on.
    """
    for b in batches:
        keys, shared = b.column("key").to_numpy(), [np.sort(np.array(x, np.int64)) for x in b.column("grams").to_pylist()]
        first_place: dict[bytes, tuple] = {}
        known: list[tuple[int, int, int]] = []
        for data, rows, first, (text, start, windows, gram, at) in _runs(b):
            raw = data.tobytes()
            wanted = np.zeros(len(gram), bool)
            edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                wanted[a:z] = np.isin(gram[a:z], shared[rows[text[a], 0]])
            for t, s, w, g, o in zip(*(x[wanted].tolist() for x in (text, start, windows, gram, at)), strict=True):
                string = raw[s : s + w + LENGTH - 1]
                place = (int(keys[rows[t, 0]]), int(s - first[t] + rows[t, 1]))
                other = first_place.setdefault(string, (*place, g, o))
                if other[:2] != place:
                    if place < other[:2]:
                        first_place[string], place = (*place, g, o), other[:2]
                    known.append((*place, len(string)))
        strings = list(first_place)
        key, start, gram, at = zip(*first_place.values(), strict=True) if strings else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram, pa.int64()), pa.array(strings, pa.binary()), pa.array(at, pa.int32()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array([False] * len(strings))],
            names=["gram", "string", "at", "key", "start", "known"],
        )
        if known:
            key, start, size = zip(*known, strict=True)
            # for a known span the gram column holds the length
            yield pa.RecordBatch.from_arrays(
                [pa.array(size, pa.int64()), pa.nulls(len(known), pa.binary()), pa.nulls(len(known), pa.int32()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array([True] * len(known))],
                names=["gram", "string", "at", "key", "start", "known"],
            )


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((differ & -differ).bit_length() - 1) >> 3 if differ else n


def _furthest(parts: list[bytes]) -> list[int]:
    """For each part, the longest prefix that it shares with another."""
    out, order = [0] * len(parts), sorted(range(len(parts)), key=parts.__getitem__)
    for i, j in zip(order[:-1], order[1:], strict=True):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def shared_parts(strings: list[bytes], ats: list[int]) -> Iterator[tuple[int, int, int]]:
    """(string, begin, end): what strings with one minimizer, at the given places, can share with another of them.

    An equal window of two strings has the minimizer at one place, so it ends where their texts from the minimizer on
    part, and begins where those before it do, read backwards. Strings that share less than LENGTH in all are left out.
    """
    right = _furthest([s[at:] for s, at in zip(strings, ats, strict=True)])
    left = _furthest([s[:at][::-1] for s, at in zip(strings, ats, strict=True)])
    for i, (at, r, n) in enumerate(zip(ats, right, left, strict=True)):
        if r + n >= LENGTH:
            yield i, at - n, at + r


def repeated_windows(strings: list[bytes], places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans (key, start, stop) of the strings that are covered by windows of LENGTH bytes occurring at an earlier place too.

    A suffix array over all strings brings equal windows together; common prefixes of LENGTH or more part the groups.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    text = np.append(np.frombuffer(b"\0".join(strings), np.uint8).astype(np.int64) + 2, 0)
    begins = np.cumsum(sizes) - sizes
    text[begins[1:] - 1] = 1
    order = suffix_array(text, 258)
    prefix = common_prefixes(text, order)
    owner = np.searchsorted(begins, order, "right") - 1
    offset = order - begins[owner]
    whole = offset + LENGTH <= sizes[owner] - 1
    order, owner, offset, same = order[whole], owner[whole], offset[whole], prefix[order][whole] >= LENGTH
    if not len(order):
        return
    same[0] = False
    group = np.cumsum(~same)
    key = np.array([p[0] for p in places])[owner]
    start = np.array([p[1] for p in places])[owner] + offset
    by = np.lexsort((start, key, group))
    repeat = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    covered = np.sort(order[by[repeat]])
    if not len(covered):
        return
    edge = np.flatnonzero(np.diff(covered, prepend=-2) != 1)
    for a, z in zip(covered[edge].tolist(), covered[np.append(edge[1:], len(covered)) - 1].tolist(), strict=True):
        k = int(np.searchsorted(begins, a, "right")) - 1
        at = places[k][1] - int(begins[k])
        yield places[k][0], a + at, z + at + LENGTH


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows among strings sorted by minimizer, string and place. Holds a batch and a shard."""

    def emit(spans):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans, strict=True)], names=["key", "start", "stop"])

    gram, last, strings, ats, places, shard, shard_places, size, spans = None, None, [], [], [], [], [], 0, []

    def close_group():
        nonlocal size
        if len(strings) > 1:  # one string by itself repeats nothing
            for i, begin, end in shared_parts(strings, ats):
                shard.append(strings[i][begin:end])
                shard_places.append((places[i][0], places[i][1] + begin))
                size += end - begin
        strings.clear()
        ats.clear()
        places.clear()

    def close_shard():
        nonlocal size
        if shard:
            spans.extend(repeated_windows(shard, shard_places))
        shard.clear()
        shard_places.clear()
        size = 0

    for b in batches:
        for g, string, at, key, start in zip(*(b.column(c).to_pylist() for c in ("gram", "string", "at", "key", "start")), strict=True):
            if g != gram:
                close_group()
                if size >= SHARD_BYTES:
                    close_shard()
                gram, last = g, None
            if string == last:
                spans.append((key, start, start + len(string)))
            else:
                last = string
                strings.append(string)
                ats.append(at)
                places.append((key, start))
        if spans:
            yield emit(spans)
            spans.clear()
    close_group()
    close_shard()
    if spans:
        yield emit(spans)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest and the place of every window of strings."""
    for b in batches:
        digests, keys, starts = [], [], []
        for string, key, start in zip(*(b.column(c).to_pylist() for c in ("string", "key", "start")), strict=True):
            n = len(string) - LENGTH + 1
            digests += [hashlib.blake2b(string[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            keys += [key] * n
            starts += range(start, start + n)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64())], names=["window", "key", "start"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, kept = [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for span in sorted((s["start"], s["stop"]) for s in spans or ()):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            rest = b"".join(text[a:z] for (_, a), (z, _) in zip([(0, 0), *merged], [*merged, (len(text), 0)], strict=True))
            rows.append((len(text), len(text) - len(rest), len(merged)))
            kept.append(rest)
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _apply(batches):
        digests = pa.array([hashlib.sha256(t).hexdigest() for t in b.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], digests], names=[*b.schema.names[:4], "kept_sha256"])


def _parted(strings: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """strings of groups with GROUP_STRINGS at most, and those of larger groups, if there are any."""
    large = scratch.write(strings.groupBy("gram").count().filter(F.col("count") > GROUP_STRINGS).select("gram"), "large")
    if large.isEmpty():
        return strings, None
    # few, as each has more than GROUP_STRINGS rows
    large = small_or_shuffled(large)
    return strings.join(large, "gram", "left_anti"), strings.join(large, "gram", "left_semi")


def _repeated_by_window(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of the windows of strings that occur at an earlier place too, without putting a group together.

    Equal windows meet by their digest, and the first place of each is an aggregate; where one window is very frequent, the
    join with it can be split. A window lies in one run only, so each place comes once.
    """
    windows = scratch.write(strings.mapInArrow(_windows, _WINDOWS), "windows")
    firsts = windows.groupBy("window").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.write(firsts.filter("n > 1").select("window", "first"), "firsts")
    repeats = windows.join(firsts, "window").filter(F.struct("key", "start") != F.col("first"))
    return repeats.select("key", "start", (F.col("start") + LENGTH).alias("stop"))


def _repeated_spans(source: DataFrame, scratch: Scratch) -> DataFrame:
    spark = source.sparkSession
    places = scratch.write(source.select("key", "text").mapInArrow(_places, _PLACES), "places")
    often = scratch.write(places.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "often")
    wanted = places.join(often, "gram").groupBy("key").agg(F.collect_list("gram").alias("grams"))  # a document's, so bounded by its length
    wanted = scratch.write(wanted, "wanted")
    scratch.drop("places")
    cut = scratch.write(source.select("key", "text").join(wanted, "key").select("key", "text", "grams").mapInArrow(_cut, _CUT), "cut")
    strings, hot = _parted(cut.filter("NOT known").drop("known"), scratch)
    strings = strings.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "string", "key", "start")
    found = scratch.write(strings.mapInArrow(_spans, _SPANS), "spans")
    if hot is not None:
        found = found.unionByName(_repeated_by_window(hot, scratch))
    known = cut.filter("known").select("key", "start", (F.col("start") + F.col("gram")).alias("stop"))
    return found.unionByName(known)


def _with_spans(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "substrings")
    source = keyed(docs, scratch)
    spans = _repeated_spans(source, scratch).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return source.join(spans, "key", "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each document without the bytes that repeat an earlier string of LENGTH bytes, anywhere in the table.

    A byte goes if a LENGTH-byte string that covers it also starts earlier (in a smaller doc_id, or earlier in the same
    text); strings are judged on the input and may overlap, but never span documents.

    Equal strings have the same minimizer, so the text is cut into runs of windows with one minimizer. Runs whose
    minimizer occurs once repeat nothing and stay where they are. The others meet by minimizer; equal runs collapse, first
    in each batch, so that a frequent passage is sent once a batch. Shards of what then still shares a minimizer get a
    suffix array by induced sorting and permuted common prefixes, which bring equal windows together. A group of more than
    GROUP_STRINGS strings (a short frequent line, say, with other text around it each time) is cut again, into its windows,
    which meet by digest; so no task holds more than a batch, a group of that many strings and a shard.

    Texts of any length are read whole, in slices. Null text counts as empty; texts under LENGTH bytes stay. Null ids come first; rows that share an id follow each other
    as read. Other columns are not read; an empty table gives no rows.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).
    """
    return _with_spans(docs).mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats_digests(docs: DataFrame) -> DataFrame:
    """remove_repeats() with the SHA-256 of the remaining bytes in their place."""
    return _with_spans(docs).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
