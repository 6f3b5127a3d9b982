"""Word shingles as 64-bit fingerprints, for whole batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
#: Bytes worked on at a time; a task needs about 60 times that.
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(0, 1 << 64, WORDS, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [_geometric(_BASE, size), _geometric(_BASE_INVERSE, size)]
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the first word of each text (with the count at the end).

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash is the sum of random
    numbers for its bytes, weighted by powers of an odd base, from prefix sums over the whole batch.
    """
    joined = b"\n".join(t.lower() for t in texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    word = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends_of_text)])


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words inside each text, in order, and the first of each text.

    A text with fewer words, but some, has the one run of all its words.
    """
    counts = np.diff(firsts)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    runs = np.zeros(len(words), np.uint64)
    for j in range(width):
        runs += padded[j : j + len(words)] * _PLACE[j]
    # runs that would leave their text go, but for the first of a short text, which is summed anew
    left = np.repeat(firsts[1:], counts) - np.arange(len(words))
    keep = left >= width
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        a, n = firsts[i], int(counts[i])
        runs[a : a + 1] = (words[a : a + n] * _PLACE[:n]).sum(dtype=np.uint64) + _SHORT[n : n + 1]
        keep[a] = True
    per_text = np.maximum(counts - width + 1, np.minimum(counts, 1))
    return mix(runs[keep]), np.concatenate([[0], np.cumsum(per_text)])


def slices(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of whole texts of SLICE_BYTES at most, or one longer text, taken from texts as needed."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) + 1 > SLICE_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def values(column) -> Iterator[bytes]:
    """The values of an Arrow column one by one: a batch is not turned into Python objects as a whole."""
    return (v.as_py() for v in column)


def shingle_sets(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for part in slices(texts):
        hashes, firsts = shingle_hashes(*word_hashes(part))
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            one = np.sort(hashes[a:b])
            yield one[np.concatenate([[True], one[1:] != one[:-1]])] if b > a else one
