"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S-type); the last symbol, smaller than all, is S-type."""
    n = len(text)
    up = np.ones(n, bool)
    differ = np.flatnonzero(text[:-1] != text[1:])
    if len(differ):
        # within a run of equal symbols the type is that of the run's last place
        decide = differ[np.searchsorted(differ, np.arange(n - 1))]
        up[:-1] = text[decide] < text[decide + 1]
    return up


def _leftmost(up: np.ndarray) -> np.ndarray:
    """Places of the leftmost S-type suffixes of each run."""
    return np.flatnonzero(up[1:] & ~up[:-1]) + 1


def _induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from seeds (leftmost S-type places in order).

    L-type suffixes are placed from the left, each by the one that follows it, then S-type ones from the right. A
    bucket (one symbol) is worked through in waves: what a wave places in its own bucket makes the next wave; the rest goes,
    in order, to buckets still to come. So the work in each wave is on whole arrays.
    """
    n, n_symbols = len(text), len(starts) - 1
    order = np.full(n, -1, np.int64)
    before = np.concatenate([[0], text[:-1]])
    seed_ends = np.searchsorted(text[seeds], np.arange(n_symbols + 1)) if len(seeds) else np.zeros(n_symbols + 1, np.int64)
    head = starts[:-1].copy()

    def spread(places: np.ndarray, symbols: np.ndarray, cursor: np.ndarray, step: int) -> None:
        by = np.argsort(symbols, kind="stable")
        places, symbols = places[by], symbols[by]
        edge = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        counts = np.diff(np.append(edge, len(symbols)))
        rank = np.arange(len(symbols)) - np.repeat(edge, counts)
        order[cursor[symbols] + step * rank] = places
        cursor[symbols[edge]] += step * counts

    for c in range(n_symbols):
        done = starts[c]
        while done < head[c]:
            wave = order[done : head[c]]
            done = head[c]
            induced = wave[wave > 0] - 1
            induced = induced[~up[induced]]
            if len(induced):
                spread(induced, before[induced + 1], head, 1)
        # the seeds of this symbol follow its L-type suffixes, and induce only larger symbols
        own = seeds[seed_ends[c] : seed_ends[c + 1]]
        induced = own[own > 0] - 1
        if len(induced):
            spread(induced, before[induced + 1], head, 1)
    tail = starts[1:] - 1
    for c in range(n_symbols - 1, -1, -1):
        done = starts[c + 1] - 1
        while done > tail[c]:
            wave = order[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            induced = wave[wave > 0] - 1
            induced = induced[up[induced]]
            if len(induced):
                spread(induced, before[induced + 1], tail, -1)
        wave = order[starts[c] : head[c]][::-1]
        induced = wave[wave > 0] - 1
        induced = induced[up[induced]]
        if len(induced):
            spread(induced, before[induced + 1], tail, -1)
    order[0] = n - 1
    return order


def _induce_stepwise(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """_induce() one suffix at a time, for reduced texts, whose many symbols make buckets tiny."""
    s, small, order = text.tolist(), up.tolist(), [-1] * len(text)
    tail = (starts[1:] - 1).tolist()
    for p in reversed(seeds.tolist()):
        order[tail[s[p]]] = p
        tail[s[p]] -= 1
    head = starts[:-1].tolist()
    for p in order:
        if p > 0 and not small[p - 1]:
            p -= 1
            order[head[s[p]]] = p
            head[s[p]] += 1
    tail = (starts[1:] - 1).tolist()
    for i in range(len(order) - 1, -1, -1):
        p = order[i]
        if p > 0 and small[p - 1]:
            p -= 1
            order[tail[s[p]]] = p
            tail[s[p]] -= 1
    order[0] = len(s) - 1
    return np.array(order, np.int64)


def suffix_array(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array of non-negative integers whose last one, 0, occurs nowhere else.

    Suffixes are classified; the leftmost S-type substrings are sorted by inducing and named by rank; where names repeat,
    the text of names is sorted by the same procedure; the order of all suffixes is then induced.
    """
    text = text.astype(np.int64)
    if len(text) == 1:
        return np.zeros(1, np.int64)
    up = _types(text)
    marks = _leftmost(up)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
    induce = _induce if n_symbols <= 4096 and len(text) > 16 * n_symbols else _induce_stepwise
    is_mark = np.zeros(len(text), bool)
    is_mark[marks] = True
    first = induce(text, up, marks[np.argsort(text[marks], kind="stable")], starts)
    ranked = first[is_mark[first]]
    names = _names(text, ranked, marks)
    at = np.searchsorted(marks, ranked)
    reduced = np.empty(len(marks), np.int64)
    reduced[at] = names
    order = suffix_array(reduced, int(names[-1]) + 1) if names[-1] + 1 < len(marks) else np.argsort(reduced)
    return induce(text, up, marks[order], starts)


def _names(text: np.ndarray, ranked: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost S-type substrings (to the next mark, inclusive) given in sorted order."""
    ends = np.append(marks[1:], len(text) - 1)[np.searchsorted(marks, ranked)]
    length = ends - ranked + 1
    new = np.ones(len(ranked), bool)
    new[1:] = length[1:] != length[:-1]
    open_ = np.flatnonzero(~new)
    depth = 0
    while len(open_):
        differ = text[ranked[open_] + depth] != text[ranked[open_ - 1] + depth]
        new[open_[differ]] = True
        depth += 1
        open_ = open_[~differ & (length[open_] > depth)]
    return np.cumsum(new) - 1


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted longest common prefixes: for each place of the text, that of its suffix and the one before it in order.

    A place whose preceding symbol equals that of its neighbour's has one less than the place before; only the other
    places, the irreducible ones, are compared symbol by symbol.
    """
    n = len(text)
    neighbour = np.empty(n, np.int64)
    neighbour[order[1:]] = order[:-1]
    neighbour[order[0]] = -1
    places = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = places[1:][neighbour[1:] > 0]
    reducible[inner] = (text[inner - 1] == text[neighbour[inner] - 1]) & (neighbour[inner - 1] >= 0)
    out = np.zeros(n, np.int64)
    active = places[~reducible & (neighbour >= 0)]
    while len(active):
        a, b = active + out[active], neighbour[active] + out[active]
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[text[a] == text[b]]
        out[active] += 1
    # along a run of reducible places, place + prefix is constant
    last = np.maximum.accumulate(np.where(reducible, 0, places))
    return out[last] + last - places
