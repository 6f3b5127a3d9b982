"""SentencePiece encoding with every piece projected to the bytes of the original text."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import smaller, texts

_SPACE = "▁".encode()


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; nested messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (blob[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if blob[at - 1] < 128:
                return out

    while at < len(blob):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, blob[at : at + n]
            at += n


class CharacterMap:
    """The compiled character map of a model: a double-array trie over byte strings, each leading to a replacement.

    The blob holds the trie's size, its 32-bit units and a pool of zero-ended replacements. A unit's label is in its low
    byte, its leaf flag in bit 8, its offset in the upper bits; a leaf's value is a place in the pool.
    """

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.pool = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << (8 if unit & 512 else 0)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest mapped prefix of text[at:], and that prefix's length."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit & 256:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if not found:
            return None
        start, length = found
        return self.pool[start : self.pool.index(0, start)], length


@dataclass
class Encoding:
    """ids with begin and end marks; the original bytes [begin, end) of each (empty for the marks)."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Normaliser:
    """Rewrites text as the model's specification asks, with the place in the source of every byte it writes."""

    def __init__(self, spec: bytes):
        got = dict(_fields(spec))
        self.map = CharacterMap(got.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each, and for their end, the source byte where its own source starts."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(text)
        space = _SPACE if self.escape else b" "
        steps, at = [], 0
        while at < len(text):
            new, n = self.map.longest(text, at) or (text[at : at + (k := _width(text[at]))], k)
            steps.append((new, at, at + n))
            at += n
        if self.squeeze:
            while steps and steps[0][0].strip(b" ") == b"":
                steps.pop(0)
            if not steps:
                return b"", np.full(1, len(text), np.int64)
        out, source = bytearray(), []

        def put(data: bytes, origin: int) -> None:
            out.extend(data)
            source.extend([origin] * len(data))

        if self.prefix:
            put(space, steps[0][1])
        after_space = self.squeeze
        for new, origin, _ in steps:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", space), origin)
                after_space = self.squeeze and new.endswith(b" ")
        end = steps[-1][2]
        if self.squeeze:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, end], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Where no character is mapped: only blanks change, so places follow from the widths written."""
        space = _SPACE if self.escape else b" "
        widths = np.where(np.frombuffer(text, np.uint8) == 32, len(space), 1)
        places = np.repeat(np.arange(len(text)), widths)
        lead = space if self.prefix else b""
        return lead + text.replace(b" ", space), np.concatenate([np.zeros(len(lead), np.int64), places, [len(text)]])


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Encoder:
    """Normalises with source alignment, segments with the sentencepiece library, and projects the pieces.

    The pieces of a segmentation, laid end to end, are the normalised text; so their widths in bytes, summed, give each
    piece's place there, and the alignment its place in the source. Where the widths do not sum to the normalised text's
    length, as with a normalisation that is not known here, the spans are those of the library's own surfaces.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        fields = list(_fields(model))
        self.normalise = Normaliser(next((v for k, v in fields if k == 3), b""))
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        # kinds: 2 unknown, 3 control, 6 one byte
        self.width = np.array([1 if p.get(3) == 6 else 0 if p.get(3) in (2, 3) else len(p[1]) for p in pieces])
        self.unknown = self.library.unk_id()

    def encode(self, text: bytes) -> Encoding:
        string = text.decode()
        ids = np.array(self.library.encode(string, add_bos=True, add_eos=True), np.uint32)
        normalised, source = self.normalise(text)
        widths = self.width[ids]
        if self.unknown >= 0 and (ids[1:-1] == self.unknown).any():
            proto = self.library.encode(string, return_type="proto")
            widths[1:-1] = [len(p.piece.encode()) if p.id == self.unknown else w for p, w in zip(proto.pieces, widths[1:-1], strict=True)]
        places = np.cumsum(widths)
        if places[-1] != len(normalised):
            return self._by_surface(string, ids)
        begin, end = source[places - widths], source[places]
        # bytes that share a source, such as those of one replacement, end where the next source begins
        return Encoding(ids, begin, np.maximum(begin, end))

    def _by_surface(self, string: str, ids: np.ndarray) -> Encoding:
        """The spans of the pieces' surfaces, which are the source's text laid end to end; marks have none."""
        widths = [len(p.surface.encode()) for p in self.library.encode(string, return_type="proto").pieces]
        ends = np.cumsum([0, *widths, 0])
        return Encoding(ids, np.append(0, ends[:-1]), ends)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_encoder = lru_cache(maxsize=2)(Encoder)


def _arrays(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(model)
    for b in smaller(batches):
        found = [encoder.encode(t) for t in b.column("text").to_pylist()]
        lists = [pa.array([f(e) for e in found], pa.list_(pa.int64())) for f in (lambda e: e.ids.astype(np.int64), lambda e: e.begin, lambda e: e.end)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], names=["doc_id", "ids", "begins", "ends"])


def _digests(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    encoder, sha = _encoder(model), lambda data: hashlib.sha256(data).hexdigest()
    for b in smaller(batches):
        rows = []
        for text in b.column("text").to_pylist():
            e = encoder.encode(text)
            spans = np.stack([e.begin, e.end], 1).astype("<u4").tobytes()
            rows.append((len(e.ids), sha(e.ids.astype("<u4").tobytes()), sha(encoder.decode(e.ids).encode()), sha(spans)))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
        )


def public_model() -> bytes:
    """The content of the public model that the contract names."""
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, and the source byte span (begins, ends) of every id, for each row. Nothing is shuffled.

    model: the model file's content, which travels with the task. Null and empty texts give the two marks alone; repeated
    rows give equal rows; other columns are not read; an empty table gives no rows. A task holds one Arrow batch.
    """
    return texts(docs).mapInArrow(partial(_arrays, model=model), "doc_id long, ids array<long>, begins array<long>, ends array<long>")


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """As encode(), but digests of ids, of the decoded text and of the spans in place of the arrays."""
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return texts(docs).mapInArrow(partial(_digests, model=model), kinds)
