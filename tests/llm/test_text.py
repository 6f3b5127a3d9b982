"""Personal data, decontamination, tokens, language, chat and shards."""

import hashlib
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from murmuration.llm import chat, language, pii
from murmuration.llm.boosting import Booster
from murmuration.llm.decontaminate import contaminated
from murmuration.llm.pieces import CharacterMap, Encoder, Normaliser, encode, encode_digests
from murmuration.llm.sharding import byte_shards

from .conftest import LONG, ODD, documents, sentence
from .test_dedup import sha, shingles

MODEL = Path(public_tokenizers.path("piece_bpe_32k.model"))

# --- personal data ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c", "a@b.c%x@d.e", "a@b..c", "a@b.c.", "x a@b.c@d.e. y", "é ü a.b+c@d-e.f.g.h", "@b.c a@", "a@b.c-_q@r.s", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "0255.1.1.1 256.1.1.1",
    "01.02.03.004x", "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111", "5  67", "1-2--3 4", "4111111111111111 4111111111111112", "9" * 16 + " 0", "+1 (743) 555-3824", "+1", "+1 2", "+49.30.1234567-",
    "+1 555 5555555555555555", "++1 555 1234567", "日本 +81 3 1234 5678 日本 a@b.co 10.0.0.1", None, "", "4111 1111 1111 1111 4111 1111 1111 1111",
]


def spans_of(frame, rows):
    return {r.doc_id: r for r in pii.summarise(pii.find_spans(frame(rows))).collect()}


def test_base_spans(frame):
    rng = np.random.default_rng(1)
    rows = list(enumerate(TRICKY)) + [(100 + i, "".join(rng.choice(list("a.@1- +4()é"), 60))) for i in range(300)]
    got = spans_of(frame, rows)
    for i, t in rows:
        spans = base_spans(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = tuple(sum(k == kind for k, _, _ in spans) for kind in BASE)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*counts, sha(listed)), t
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_trees_add_what_looks_like_confirmed_spans(frame):
    rows = [(i, f"call +1 (555) 010-{1000 + i} now") for i in range(400)] + [(1000, "call (555) 010-9999 now")]
    got = spans_of(frame, rows)
    assert got[1000].spans == "phone:5:19" and got[1000].n_phone == 0
    assert all(got[i].n_phone == 1 and got[i].spans.count(":") == 2 for i in range(400))


def test_trees_add_as_many_as_they_know(frame):
    def card(i, by):
        head = f"4{i:014d}"
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        return by.join(digits[k : k + 4] for k in range(0, 16, 4))

    rows = [(i, f"call +1 (555) 010-{1000 + i} now, mail a{i}@b.org or pay by visa {card(i, ' ')}.") for i in range(150)]
    rows += [(1000 + i, f"call (555) 010-{1000 + i} now, mail a{i} (at) b (dot) org or pay by visa {card(i, '.')}.") for i in range(300)]
    rows += [(2000, "look at example.org"), (2001, "id 4000.0000.0000.0001, 12-555-010-9999-7")]
    got = spans_of(frame, rows)
    for i, t in rows[150:450]:
        found = sorted((k, t[int(a) : int(z)]) for k, a, z in (s.split(":") for s in got[i].spans.split(",")))
        assert found == [("card", card(i - 1000, ".")), ("email", f"a{i - 1000} (at) b (dot) org"), ("phone", f"(555) 010-{i}")]
        assert (got[i].n_email, got[i].n_card, got[i].n_phone) == (0, 0, 0)
    assert got[2000].spans == "" == got[2001].spans


def test_precision_and_recall_of_added_spans(frame):
    """Planted forms that no base pattern matches, against decoys: shares found and right, as the README gives them."""
    import random

    rng = random.Random(12)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"

    def card(valid):
        while True:
            digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(digits) == valid:
                return ".".join(digits[k : k + 4] for k in range(0, 16, 4))

    rows, planted = [], set()

    def put(text, kind=None, span=None):
        i = len(rows)
        rows.append((i, text))
        if kind:
            planted.add((i, f"{kind}:{text.index(span)}:{text.index(span) + len(span)}"))

    for k in range(120):
        # what the labels come from
        put(f'set token = "{key()}" and go')
        put(f"call +1 {number()} now, or pay by card {card(True).replace('.', ' ')} or mail user{k}@mail.example.com today")
        put(f"the part a{'b' * 20}{k} and 1{'0' * 22}{k} of it, order {k}-{rng.randrange(100, 999)}-555-{rng.randrange(1000, 9999)}-1, number {card(False)}")
    for k in range(60):
        for kind, span, text in (
            ("secret", s := key(), f"commit {s} of it"),
            ("phone", s := number(), f"call {s} now"),
            ("card", s := card(True), f"or pay by card {s} or"),
            ("email", s := f"user{k} [at] mail [dot] example [dot] com", f"or mail {s} today"),
        ):
            put(text, kind, span)
    got = spans_of(frame, rows)
    added = set()
    for i, t in rows:
        base = {f"{k}:{a}:{b}" for k, a, b in base_spans(t)}
        found = set(filter(None, got[i].spans.split(",")))
        assert got[i].n_spans == len(found) and got[i].n_added == len(found - base)
        added |= {(i, x) for x in found - base if i >= 360}
        added |= {(i, x) for x in found - base if i < 360 and not (x.startswith("secret") and i % 3 == 0)}
    assert sum(got[i].n_secret for i in range(0, 360, 3)) >= 118
    assert len(added & planted) / len(planted) >= 0.95, "recall"
    assert len(added & planted) / len(added) >= 0.95, "precision"


def test_trees_count_every_labelled_span(frame):
    """A rare kind keeps its positives among many labelled spans of another kind: a sample of 200,000 had too few of them."""
    rows = [(i, "1.2.3.4 " * 110) for i in range(5000)]
    rows += [(10_000 + i, f"call +1 (555) 010-{1000 + i} now") for i in range(70)] + [(20_000 + i, f"call (555) 010-{9900 + i} now") for i in range(6)]
    got = spans_of(frame, rows)
    assert all(got[20_000 + i].spans == "phone:5:19" for i in range(6))


def test_trees_from_sums_in_the_cluster_are_those_of_the_driver(frame, monkeypatch):
    rows = [(i, f"call +1 (555) 010-{1000 + i} now, {'1.2.3.' * (i % 2)}44, part {'a' * (20 + 9 * i)}{i}") for i in range(120)]
    rows += [(1000 + i, f"call (555) 010-{2000 + i} now, 12-555-010-9999-{i}") for i in range(20)] + [(2000 + i, f"token: {sha(str(i))}") for i in range(120)]
    held = spans_of(frame, rows)
    assert all(held[1000 + i].spans.startswith("phone:5:19") for i in range(20))
    monkeypatch.setattr(pii, "DRIVER_TUPLES", 0)
    assert spans_of(frame, rows) == held


def test_redaction_of_rows_that_share_an_id(frame):
    rows = [(7, "mail a@b.co now"), (7, "no data"), (None, "ip 10.0.0.1"), (None, "x"), (7, "a@b.co, c@d.co")]
    got = sorted(str((r.doc_id, r.text)) for r in pii.redact(frame(rows)).collect())
    assert got == sorted(str(x) for x in [(7, "mail <email> now"), (7, "no data"), (None, "ip <ip>"), (None, "x"), (7, "<email>, <email>")])


def test_booster_learns_and_calibrates(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.integers(0, 10, 4000), "b": rng.integers(0, 5, 4000)}
    y = ((x["a"] > 6) & (x["b"] < 2)).astype(float)
    booster = Booster.train(x, y, np.ones(4000))
    booster.calibrate(x, y, np.ones(4000))
    assert ((booster.probabilities(x) > 0.5) == y).mean() > 0.99
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x["a"][:200], x["b"][:200], strict=True)], "a int, b int").coalesce(1)
    assert [r[0] for r in rows.select(booster.column()).collect()] == pytest.approx(list(booster.probabilities({k: v[:200] for k, v in x.items()})))


def test_odd_and_long_texts_for_pii(frame):
    rows = pii.summarise(pii.find_spans(frame([*ODD, (99, LONG)]))).collect()
    assert len(rows) == len(ODD) + 1 and all(r.spans == "" for r in rows)
    assert pii.summarise(pii.find_spans(frame([]))).collect() == []


def test_redaction(frame):
    got = {r.doc_id: r.text for r in pii.redact(frame([(1, "é a@b.co, 10.0.0.1 end"), (2, None), (3, "none")])).collect()}
    assert got == {1: "é <email>, <ip> end", 2: "", 3: "none"}


# --- decontamination ---


def test_contaminated(spark, frame):
    import random

    rng = random.Random(2)
    items = [(i, sentence(rng, 6 + 3 * i)) for i in range(20)] + [(30, "one two three"), (31, None), (32, ""), (33, "solo")]
    docs = documents(9, 60) + [(7000 + i, f"{sentence(rng, 400)} {t} {sentence(rng, 300)}") for i, t in items if t]
    docs.append((8000, items[9][1].replace(" ", "  ").upper()))
    words = items[19][1].split()
    docs += [(8001, " ".join(words[: len(words) * 9 // 10])), (8002, " ".join(words[: len(words) // 2]))]
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, shingles int")
    expected = set()
    for i, t in items:
        own = shingles(t)
        width = min(5, len((t or "").split()))
        for d, text in docs:
            w = (text or "").lower().split()
            there = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if width else set()
            if own and 100 * len(own & there) >= 80 * len(own):
                expected.add((d, i, len(own), len(own & there)))
    assert {tuple(r) for r in contaminated(frame(docs), benchmark).collect()} == expected
    assert contaminated(frame([]), benchmark).collect() == [] == contaminated(frame(docs), benchmark.limit(0)).collect()
    assert contaminated(frame(ODD), benchmark).count() == 0


def test_benchmark_in_blocks(spark, frame, monkeypatch):
    import random

    import murmuration.llm.decontaminate as module

    rng = random.Random(4)
    items = [(i, sentence(rng, 30)) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame([(i, f"{sentence(rng, 50)} {t}") for i, t in items])
    whole = {tuple(r) for r in contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 60)
    assert {tuple(r) for r in contaminated(docs, benchmark).collect()} == whole and len(whole) >= 12


def test_benchmark_item_without_an_id(spark, frame):
    text = "one two three four five six seven"
    benchmark = spark.createDataFrame([(None, text), (3, text), (None, "not there at all in any document")], "item_id long, text string")
    got = contaminated(frame([(1, f"zero {text} eight"), (2, "none")]), benchmark).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 3, 3, 3), (1, None, 3, 3)]


# --- tokens ---


def test_encoding_is_the_librarys(frame):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL.read_bytes())
    docs = documents(3, 30) + [(900, "  two  blanks \n\t日本語 🙂 <s> </s> ▁ \x00"), (901, "a" * 5000), *ODD]
    rows = encode(frame(docs), MODEL.read_bytes()).collect()
    assert len(rows) == len(docs)
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, []).append(t or "")
    for r in rows:
        assert r.ids in [library.encode(t, add_bos=True, add_eos=True) for t in by_id[r.doc_id]]
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(frame(docs), MODEL.read_bytes()).collect()}
    expected = set()
    for i, t in docs:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids))))
    assert digests == expected


def test_pieces_cover_the_source():
    encoder = Encoder(MODEL.read_bytes())
    for text in ("", "a", "Hello  wörld\n日本語 🙂", " x "):
        data = text.encode()
        e = encoder.encode(data)
        covered = [(a, b) for a, b in zip(e.begin.tolist(), e.end.tolist(), strict=True) if b > a]
        assert b"".join(data[a:b] for a, b in covered) == data
        # the library's own offsets; of bytes of one character, it gives the whole to the last
        proto = encoder.library.encode(text, return_type="proto")
        known = [(p.begin, p.end) for p in proto.pieces if not encoder.library.is_byte(p.id)]
        spans = zip(e.begin[1:-1].tolist(), e.end[1:-1].tolist(), e.ids[1:-1].tolist(), strict=True)
        assert [(a, b) for a, b, i in spans if not encoder.library.is_byte(i)] == known


def compiled(mapping):
    """A character map blob: a double-array trie built the slow way, and its pool."""
    trie, pool = {}, b""
    for key, new in mapping.items():
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[-1] = len(pool)
        pool += new + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(node, at):
        labels = [0 if k == -1 else k for k in node]
        # a unit has its label but not its parent, so no two nodes may have their children in one place
        base = next(b for b in range(1, 100_000) if at ^ b not in bases and all((at ^ b ^ k) not in used for k in labels))
        bases.add(at ^ base)
        units[at] |= base << 10 | (256 if -1 in node else 0)
        used.update(at ^ base ^ k for k in labels)
        if -1 in node:
            units[at ^ base] = node[-1] | 1 << 31
        for k, child in node.items():
            if k != -1:
                units[at ^ base ^ k] = k
        for k, child in node.items():
            if k != -1:
                place(child, at ^ base ^ k)

    place(trie, 0)
    array = [units.get(i, 0) for i in range(max(units) + 1)]
    data = struct.pack(f"<{len(array)}I", *array)
    return struct.pack("<I", len(data)) + data + pool


def test_character_map_takes_the_longest_prefix():
    blob = compiled({b"a": b"x", b"ab": b"yy", "é".encode(): b"e", b"\t": b" ", b"abc!": b""})
    chars = CharacterMap(blob)
    assert chars.longest(b"abd", 0) == (b"yy", 2)
    assert chars.longest(b"zabc", 1) == (b"yy", 2)
    assert chars.longest(b"abc!", 0) == (b"", 4)
    assert chars.longest("é".encode(), 0) == (b"e", 2) and chars.longest(b"q", 0) is None
    n = len(blob)
    spec = b"\x12" + bytes([n & 127 | 128, n >> 7 & 127 | 128, n >> 14]) + blob
    out, source = Normaliser(spec)("  ab\té a ".encode())
    assert out.decode() == "▁yy▁e▁x"
    assert source.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 5, 7, 7, 7, 8, 9]


# --- language ---


def test_language(frame):
    import random

    rng = random.Random(1)
    kinds = {"en": ["the", "and", "with", "house"], "de": ["und", "der", "über", "straße"], "fr": ["été", "les", "où", "une"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20))) for i in range(300) for k in [list(kinds)[i % 3]]]
    docs = frame(rows + [(1000, None), (1001, ""), (1002, "123 !?"), (None, "the house")], lang=lambda i: None if i is None or i >= 1000 or i % 20 == 0 else list(kinds)[i % 3])
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == 304
    for r in got:
        assert 0 <= r.score <= 1 and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1))
        if r.doc_id is not None:
            assert r.lang_pred == ("und" if r.doc_id >= 1000 else list(kinds)[r.doc_id % 3])
    blank = frame([(1, "words"), (2, None)])
    assert [r.lang_pred for r in language.identify(blank, language.train(blank)).collect()] == ["und", "und"]
    assert language.identify(frame([]), language.train(frame([]))).collect() == []
    assert language.identify(frame([(1, LONG)]), language.train(docs)).first().score >= 0


def test_numerals_that_are_no_letters_are_und(frame):
    docs = frame([(i, "the house" if i % 2 else "das haus") for i in range(40)], lang=lambda i: "en" if i % 2 else "de")
    (model,) = language.train(docs)
    for odd in ("\u00b2", "\u00bd \u00be", "\u2460\u2461", "1\u00b2_"):
        langs, scores, _ = model.predict(["the house", odd, "the house", odd])
        assert langs == ["en", "und", "en", "und"] and scores[1] == scores[3] == 0
    # letters among them count
    assert model.predict(["\u00b2 the house"])[0] == ["en"]


def grams_by_rule(text):
    """The 2- and 3-grams of a text over letters and blanks, without those that begin with two blanks."""
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()}  ") + "  "
    at = [i for i in range(len(text.lower()) + 3) if t[i : i + 2] != "  "]
    return [t[i : i + k] for i in at for k in (2, 3)]


def test_language_by_brute_force(frame, monkeypatch):
    """Naive Bayes over buckets counted one by one, with one matrix and with several."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefgüß") for _ in range(4)) for _ in range(6)] for k in range(7)}
    texts = {i: " ".join(rng.choice(words[f"l{i % 7:02}"]) for _ in range(rng.randint(1, 9))) for i in range(140)}
    texts |= {500: "zz yy", 501: "12", 502: None, 503: "abc" * 3000}
    docs = frame(list(texts.items()), lang=lambda i: None if i >= 500 else f"l{i % 7:02}")
    bucket = {}
    for t in texts.values():
        gs = grams_by_rule(t or "")
        if gs:
            bucket.update(zip(gs, language._grams([t])[0].tolist(), strict=True))
    assert len(bucket) > 100
    counts = {k: Counter() for k in words}
    for i, t in texts.items():
        if i < 500 and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[f"l{i % 7:02}"].update(bucket[g] for g in grams_by_rule(t))
    for at_once in (64, 3):
        monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", at_once)
        got = {r.doc_id: r for r in language.identify(docs, language.models(docs)).collect()}
        assert len(language.train(docs)) == (1 if at_once == 64 else 3) and len(got) == len(texts)
        for i, t in texts.items():
            gs = [bucket[g] for g in grams_by_rule(t or "")]
            if not any(c.isalpha() for c in t or ""):
                assert (got[i].lang_pred, got[i].score, got[i].per_gram) == ("und", 0, 0)
                continue
            logs = {k: sum(math.log((c[g] + 1) / (c.total() + language.BUCKETS)) for g in gs) for k, c in counts.items()}
            top = max(logs.values())
            assert logs[got[i].lang_pred] >= top - 1e-3 * len(gs)
            assert got[i].score == pytest.approx(1 / sum(math.exp(x - top) for x in logs.values()), abs=1e-2)
            assert got[i].per_gram == pytest.approx(top / len(gs), abs=1e-3)


def test_texts_in_no_language_are_rejected(frame):
    docs = frame([(i, ("the house of the people " if i % 2 else "das haus der leute ") * 900) for i in range(40)], lang=lambda i: "en" if i % 2 else "de")
    (model,) = language.train(docs)
    told = language.rejected(*model.predict(["the people", "die leute", None, "", "12", "xqzj qxvw zzkq wvxq jjqz", "e"]))
    assert told.tolist()[:6] == [False, False, True, True, True, True]
    # a model of few texts rejects nothing that has a letter
    few = frame([(i, "the house" if i % 2 else "das haus") for i in range(9)], lang=lambda i: "en" if i % 2 else "de")
    (model,) = language.train(few)
    assert not language.rejected(*model.predict(["some other words", "xqzj qxvw"])).any()


# --- chat ---


def test_escapes_are_reversible():
    rng = np.random.default_rng(0)
    parts = [*chat.CONTROL, "\\", "<", "s>", "/", "[", "INST]", "a", "<part:image:0>", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 8)))
        inside = chat.escape(text)
        assert chat.unescape(inside) == text and not any(c in inside for c in chat.CONTROL)


def test_typed_parts():
    content = [
        {"type": "text", "text": "see <part:image:0> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "text", "text": " and "},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3},
    ]
    text, begin, end, attachments = chat.format_turn("assistant", content)
    assert attachments == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536)]
    assert list(chat.read_parts(text[begin:end])) == [("text", "see <part:image:0> "), ("image", "0"), ("text", " and "), ("audio", "1"), ("document", "2")]
    text, _, _, attachments = chat.format_turn("user", [{"type": "video", "ref": "d.mp4"}, {"type": None}])
    assert attachments == [(0, "unknown", "d.mp4", 0), (1, "unknown", "", 0)] and list(chat.read_turns(text))[0][1] == "<part:unknown:0><part:unknown:1>"


def test_conversations(spark, frame):
    rows = [(1, 1, "assistant", "</s>\\ x"), (1, 0, "user", "[INST] é"), (1, 2, "assistant", None), (2, 0, None, "hi"), (2, 0, None, "hi"), (None, None, "system", ""), (3, 0, "assistant", "a" * 500_000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    r = got[1]
    assert (r.n_turns, r.turns_sha256) == (3, sha("user\n[INST] é\nassistant\n</s>\\ x\nassistant\n\n"))
    assert (r.loss_chars, r.loss_sha256) == (7, sha("</s>\\ x"))
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[3].loss_chars == 500_000
    assert chat.read_back(chat.format_conversations(turns.limit(0))).collect() == []


def test_conversation_parts_column(spark, frame):
    part = "struct<type: string, text: string, ref: string, width: int, height: int>"
    turns = spark.createDataFrame([(1, 0, "user", [("text", "look", None, None, None), ("image", None, "p", 28, 56)])], f"conv_id long, turn long, role string, content array<{part}>")
    row = chat.format_conversations(turns, "content").first()
    assert row.formatted == "<s>[INST]user[/INST]look<part:image:0></s>" and row.attachments[0].tokens == 2


# --- shards ---


def test_shards(frame):
    docs = [(i, t) for i, t in documents(5, 90)]
    got = sorted(byte_shards(frame(docs), 8).collect(), key=lambda r: r.doc_id)
    text = dict(docs)
    before, total = 0, sum(len((t or "").encode()) + 1 for _, t in docs)
    slots = {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.shard == (2 * before + r.size) * 8 // (2 * total)
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        before += r.size
    odd = byte_shards(frame(ODD), 3).collect()
    assert len(odd) == len(ODD)
    for s in range(3):
        assert sorted(r.slot for r in odd if r.shard == s) == list(range(sum(r.shard == s for r in odd)))
    assert byte_shards(frame([]), 8).collect() == []
    assert {r.shard for r in byte_shards(frame([(1, LONG)]), 8).collect()} == {4}
