"""Exact, near, substring and line dedup against brute force, and their odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from murmuration.llm.components import components
from murmuration.llm.common import Scratch
from murmuration.llm.exact_dedup import exact_groups, normalised
from murmuration.llm import line_dedup
from murmuration.llm.line_dedup import dedup_lines
from murmuration.llm.near_dedup import near_groups
from murmuration.llm.shingles import shingle_sets
from murmuration.llm.substring_dedup import remove_repeats, remove_repeats_digests
from murmuration.llm.suffix_array import _induce, _induce_stepwise, common_prefixes, suffix_array

from .conftest import LONG, ODD, documents


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_normalised_is_the_rule():
    for t in ("", " ", "a", " a  b\n", "\x0b\x0c\r\nx\x1cy\xa0z ", "\ta"):
        assert normalised(t.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()


def test_exact_groups(frame):
    docs = documents(1, 80) + [(1001, "q " * 5000 + "end"), (1002, "q\n" * 5000 + "end"), (1003, "q " * 5000 + "END"), (1000, "q " * 5000 + "end")]
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    size, first = Counter(norm.values()), {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    got = exact_groups(frame(docs)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {
        (i, first[t], size[t], first[t] == i, sha(t)) for i, t in norm.items()
    }
    assert len(got) == len(docs)


def test_exact_groups_with_hot_blocks(frame, monkeypatch):
    """A text that a third of the rows have, alone and as the beginning of longer ones, is named where it is read."""
    from murmuration.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 16)
    head = "0123456789abcdef"
    docs = [(i, head if i % 3 == 0 else f"{head}{i % 7}" if i % 3 == 1 else f"own text {i % 400}") for i in range(900)]
    docs += [(2000 + i, head * 3 if i % 2 else head * 2 + "x") for i in range(40)]
    source = frame(docs).selectExpr("doc_id", "CAST(text AS binary) AS text")
    for share, hot in ((2000, None), (10, [head.encode()])):
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
        assert hot is None or exact_dedup._hot_blocks(source) == hot
        first, size = {}, {}
        for i, t in docs:
            first.setdefault(t, i)
            size[t] = size.get(t, 0) + 1
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(docs)).collect()}
        assert got == {i: (first[t], size[t], first[t] == i) for i, t in docs}


def test_exact_groups_of_odd_rows(frame):
    got = exact_groups(frame(ODD)).collect()
    assert len(got) == len(ODD)
    assert sum(r.kept for r in got) == len({normalised((t or "").encode()) for _, t in ODD})
    assert sum(r.kept for r in got if r.text_sha256 == sha("x y z")) == 1
    assert exact_groups(frame([])).collect() == []


@pytest.mark.parametrize("induce", [_induce, _induce_stepwise])
def test_suffix_array_and_prefixes(monkeypatch, induce):
    import murmuration.llm.suffix_array as module

    monkeypatch.setattr(module, "_induce", induce)
    monkeypatch.setattr(module, "_induce_stepwise", induce)
    rng = np.random.default_rng(0)
    for trial in range(120):
        k, n = int(rng.integers(1, 5)), int(rng.integers(0, 60))
        text = np.append(np.tile(rng.integers(1, k + 1, 5), 12)[:n] if trial % 3 == 0 else rng.integers(1, k + 1, n), 0)
        s = text.tolist()
        order = suffix_array(text, k + 1)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        prefix = common_prefixes(text, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            x, y, n_same = s[a:], s[b:], 0
            while n_same < min(len(x), len(y)) and x[n_same] == y[n_same]:
                n_same += 1
            assert prefix[b] == n_same


def removed_by_brute_force(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", covered)), sha(kept))
    return out


def test_substrings(frame):
    rng = np.random.default_rng(3)
    docs = documents(2, 70) + [(2001, "ab" * 400), (2002, "a" * 350), (2003, "x" + "a" * 120 + "y"), (2004, "z" * 99), (2005, "z" * 100), (2006, "z" * 100)]
    docs += [(3000 + i, "".join(rng.choice(list("ab"), 160))) for i in range(6)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats_digests(frame(docs)).collect()}
    assert got == removed_by_brute_force(docs)


def test_substrings_of_odd_rows(frame):
    text = "abcdefghij" * 9 + "0123456789"
    got = sorted((r.doc_id is not None, r.n_removed, bytes(r.kept)) for r in remove_repeats(frame([*ODD, (None, text), (5, text), (5, text)])).collect())
    assert len(got) == len(ODD) + 3
    assert [(has, removed) for has, removed, _ in got if removed] == [(True, 100), (True, 100)]
    assert remove_repeats(frame([])).collect() == []


def test_substrings_longer_than_a_slice(frame, monkeypatch):
    rng = np.random.default_rng(5)
    big = "".join(rng.choice(list("abcdefgh"), 5_000_000))
    got = {r.doc_id: r.n_removed for r in remove_repeats_digests(frame([(1, big), (2, "Q" + big[1_048_400:1_048_700] + "Q"), (3, "0" * 3000)])).collect()}
    assert got == {1: 0, 2: 300, 3: 2999}


def test_substrings_around_a_hot_line(spark, frame, monkeypatch):
    import murmuration.llm.substring_dedup as module

    rng = np.random.default_rng(6)
    other = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    lines = ["Licensed under the terms that everyone knows.", "L" + other(98) + "!", "M" + other(150)]
    docs = [(i, other(90) + lines[i % 3] + other(90)) for i in range(120)] + [(500 + i, other(20) + lines[0] + "x" * 70) for i in range(3)]
    groups = []

    def parted(strings, scratch, own=module._parted):
        cold, hot = own(strings, scratch)
        groups.append(([r["count"] for r in cold.groupBy("gram").count().collect()], hot.count()))
        return cold, hot

    monkeypatch.setattr(module, "GROUP_STRINGS", 8)
    monkeypatch.setattr(module, "_parted", parted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats_digests(frame(docs)).collect()}
    assert got == removed_by_brute_force(docs)
    assert max(groups[0][0], default=0) <= 8 and groups[0][1] > 80


def test_shingle_sets():
    for t in ("", "a", "a b", "a b c d e", "a b c d e f a b c d e f", "A b C d EÉ f"):
        assert len(next(iter(shingle_sets([t.encode()])))) == len(shingles(t))
    a, b, c = shingle_sets([b"x y z w v", b"X y\tz w\nv", b"x y z w"])
    assert a.tolist() == b.tolist() != c.tolist()


def near_by_brute_force(docs, percent=85):
    sets, parent = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_groups(frame):
    docs = documents(4, 150)
    rng = np.random.default_rng(8)
    chain = ["w%d" % i for i in range(120)]
    for k in range(40):  # each links to the next, few to the first
        docs.append((5000 + k, " ".join(chain)))
        chain = chain[2:] + [f"v{k}", f"u{k}"]
    star = ["s%d" % i for i in range(100)]
    for k in range(40):  # some linked with the first, some with each other alone, some with nothing
        copy = list(star)
        for j in rng.integers(0, 100, k // 8):
            copy[j] = f"t{k // 2}"
        docs.append((6000 + k, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(frame(docs)).collect()}
    assert got == near_by_brute_force(docs)


def test_near_groups_of_odd_rows(frame):
    rows = near_groups(frame(ODD)).collect()
    assert len(rows) == len(ODD)
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None} == {(None, False)}
    assert {r.component_id for r in rows if r.doc_id == 13} == {13}
    assert {r.n_shingles for r in rows if r.doc_id in (5, 9, 11)} == {0}
    assert near_groups(frame([])).collect() == []


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, monkeypatch, limit):
    import murmuration.llm.components as module

    monkeypatch.setattr(module, "ONE_TASK_LINKS", limit)
    links = [(i, i + 1) for i in range(20, 40)] + [(50, 40), (1, 1), (3, 9), (9, 3), (9, 4)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()}
    expected = dict.fromkeys([*range(20, 41), 50], 20) | dict.fromkeys([3, 4, 9], 3) | dict.fromkeys([7, *range(100, 130)], 7)
    assert got == expected


def lines_by_brute_force(docs, percent=80):
    seen, out = [], {}
    for i, t in sorted(docs):
        lines, keep = (t or "").split("\n"), []
        for line in lines:
            own = set(words(line))
            repeated = own and any(100 * len(own & s) >= percent * len(own | s) for s in seen)
            if own:
                seen.append(own)
            if not repeated:
                keep.append(line)
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_lines(frame):
    docs = documents(6, 120) + [(4001, "a b c d"), (4002, "d c b a\na b c d e\na b c e f"), (4003, "\n\nA B C D\n")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(frame(docs)).collect()}
    assert got == lines_by_brute_force(docs)


def test_lines_of_a_large_group(frame):
    """Many near copies of one line, each with its own words changed: found in full, whichever share decides a line."""
    import random

    rng = random.Random(9)
    base = [f"word{k}" for k in range(40)]
    lines = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(40)] = f"other{rng.randrange(30)}"
        lines.append(" ".join(own))
    docs = [(i, f"{t}\nend {i} of it") for i, t in enumerate(lines)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(frame(docs)).collect()}
    assert got == lines_by_brute_force(docs) and 200 < sum(n for _, n, _ in got.values()) < 400


def test_lines_by_any_share_of_rarity(frame, monkeypatch):
    """Rarity only orders tokens: counted in all documents, in some or in none, the rows are those of brute force, also
    where one line has 64 bits of parity and its match twice as many; and numbers never sort as objects."""
    rng = random.Random(5)
    docs = []
    for i, n in enumerate([64, 65, 70, 80, 120, 200] * 4):
        own = [f"w{k}" for k in range(n)] if i < 12 else [f"{i % 3}v{k}" for k in range(n)]
        for _ in range(n // 14):
            own[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own).title() + "\r\n\x0b \t"))
    want = lines_by_brute_force(docs)
    assert 0 < sum(n for _, n, _ in want.values()) < len(docs)
    for share in (1, 3, 10**9):
        monkeypatch.setattr(line_dedup, "RARITY_SHARE", share)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(frame(docs)).collect()}
        assert got == want
    numbers = frame(docs).select(line_dedup._numbers(line_dedup._fingerprints(line_dedup._words("text")), [0] * line_dedup.SLOTS).alias("n"))
    assert not numbers.schema["n"].dataType.containsNull


def test_lines_with_each_white_space(frame, monkeypatch):
    """White space of one kind, of several and of none; and the places of the classes are not written a second time."""
    names, write = [], line_dedup.Scratch.write
    monkeypatch.setattr(line_dedup.Scratch, "write", lambda self, df, name: (names.append(name), write(self, df, name))[1])
    docs = [(i, f"One{c}two three{c}{c}Four\nrow{c}{i} of its own") for i, c in enumerate(["\t", "\v", "\f", "\r", " ", "\t\v \f\r"])]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(frame(docs)).collect()}
    assert got == lines_by_brute_force(docs) and sum(n for _, n, _ in got.values()) == 5
    assert "classes" in names and "places" not in names


def test_lines_of_odd_rows(frame):
    rows = dedup_lines(frame(ODD)).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows if r.n_removed) == [(7, 1), (13, 1)]
    assert dedup_lines(frame([])).collect() == []


def test_very_long_texts(frame):
    docs = [(1, LONG), (2, LONG), (3, "short one")]
    assert {r.doc_id: r.kept for r in exact_groups(frame(docs)).collect()} == {1: True, 2: False, 3: True}
    assert {r.doc_id: r.component_id for r in near_groups(frame(docs)).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_removed for r in dedup_lines(frame(docs)).collect()} == {1: 0, 2: 1, 3: 0}
