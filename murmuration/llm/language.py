"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, smaller

BUCKETS = 1 << 15
#: Labelled documents of each language that the model learns from, about; chosen by a hash of the id from the whole table.
TRAIN_DOCS = 4000
#: Languages of one matrix, so that what every task gets stays at 8 MB; more languages are several matrices.
LANGUAGES_AT_ONCE = 64
SLICE_CHARS = 1 << 19
#: Below these, rejected() takes a text's language for unknown. The second is a quarter of an even draw: a model of few texts,
#: to which most grams are new, gives all of them a little less than an even draw and rejects none.
LEAST_SCORE, LEAST_PER_GRAM = 0.5, -float(np.log(4 * BUCKETS))
_IDENTIFIED = "doc_id long, held_out boolean, lang_pred string, score double, per_gram double"
_WEIGHTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters = None


def _letter_table() -> np.ndarray:
    """Code point to itself for letters, 0 for the rest."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)
    return _letters


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- and 3-grams of all texts, in order, and where each text's begin.

    Texts are lower-cased; what is not a letter counts as a blank, and a blank stands before and after a text. Grams that
    start with two blanks are left out. Two blanks part the texts, so that no gram spans two.
    """
    parts = [f" {t.lower()}  " for t in texts]
    codes = _letter_table()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum([0, *map(len, parts)])
    codes = np.concatenate([codes, np.zeros(2, np.uint32)])
    keep = (codes[:-2] | codes[1:-1]) != 0
    two = codes[:-2] * _WEIGHTS[0] + codes[1:-1] * _WEIGHTS[1]
    three = two + codes[2:] * _WEIGHTS[2] + np.uint32(1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    both = np.stack([two[keep], three[keep]], 1).reshape(-1)
    both = (both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
    before = np.concatenate([[0], np.cumsum(keep)])
    return both, 2 * before[starts[:-1]]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of SLICE_CHARS at most, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in smaller(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            sums = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for _, part in _slices(texts):
                sums += np.bincount(_grams(part)[0], minlength=BUCKETS)
    for lang, sums in counts.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter, and so a gram."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """languages, in order, and the log-probability of each bucket (columns) in each of them (rows)."""

    languages: list[str]
    matrix: np.ndarray

    def scored(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the index of the likeliest language (-1 without a letter), its log-likelihood, the sum of all
        languages' likelihoods over its own, and the number of grams. Of equal languages the first counts."""
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        best, top = np.full(len(texts), -1), np.zeros(len(texts))
        total, n = np.ones(len(texts)), np.zeros(len(texts), np.int64)
        for first, part in _slices([texts[i] for i in known]):
            grams, starts = _grams(part)
            logs = np.empty((len(part), len(self.languages)))
            for k in range(len(self.languages)):  # a column at a time keeps the gathered rows small
                logs[:, k] = np.add.reduceat(self.matrix[k][grams], starts, dtype=np.float64)
            at = np.array(known[first : first + len(part)])
            best[at], top[at] = logs.argmax(1), logs.max(1)
            total[at] = np.exp(logs - top[at][:, None]).sum(1)
            n[at] = np.diff(np.append(starts, len(grams)))
        return best, top, total, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior and the mean log-likelihood of a gram in it; 'und', 0 and 0
        where there is no letter, hence no gram."""
        best, top, total, n = self.scored(texts)
        return [self.languages[k] if k >= 0 else "und" for k in best], np.where(best >= 0, 1 / total, 0.0), top / np.maximum(n, 1)


def held_out():
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def models(docs: DataFrame) -> Iterator[LanguageModel]:
    """Counts of hashed n-grams by language, with add-one smoothing and equal priors, LANGUAGES_AT_ONCE at a time.

    Learns from rows with a text and a language that held_out() leaves; of a language with more than TRAIN_DOCS of them,
    those whose id hashes under the share that makes about as many. Counts are summed in the cluster; the driver holds the
    rows of one matrix, BUCKETS * LANGUAGES_AT_ONCE at most, and the languages come to it one by one, in order.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = ((r.lang, r["count"]) for r in rows.groupBy("lang").count().orderBy("lang").toLocalIterator())
    for _, block in groupby(enumerate(sizes), lambda x: x[0] // LANGUAGES_AT_ONCE):
        yield _model(rows, dict(pair for _, pair in block))


def _model(rows: DataFrame, sizes: dict[str, int]) -> LanguageModel:
    languages = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang in languages:
        share = min(1 << 20, -(-(TRAIN_DOCS << 20) // sizes[lang]))
        chosen = chosen | ((F.col("lang") == lang) & (draw < share))
    counts = rows.filter(chosen).select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    matrix = np.ones((len(languages), BUCKETS))
    row = {lang: k for k, lang in enumerate(languages)}
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix[got["lang"].map(row).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy()
    return LanguageModel(languages, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32))


def train(docs: DataFrame) -> list[LanguageModel]:
    """All of models(); none if the table has no labels."""
    return list(models(docs))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in smaller(batches):
        lang, score, per_gram = model.value.predict(b.column("text").to_pylist())
        arrays = [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(per_gram)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", "per_gram"])


def _partial(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in smaller(batches):
        best, top, total, n = model.value.scored(b.column("text").to_pylist())
        known = best >= 0
        langs = pa.array([model.value.languages[k] for k in best[known]], pa.string())
        rows = b.column("uid").filter(pa.array(known))
        arrays = [rows, langs, *(pa.array(x[known]) for x in (top, total, n))]
        yield pa.RecordBatch.from_arrays(arrays, names=["uid", "lang", "top", "total", "n"])


def identify(docs: DataFrame, learnt: Iterable[LanguageModel]) -> DataFrame:
    """doc_id, held_out, lang_pred, score and per_gram of each row, by all matrices of models(); with one, nothing is shuffled.

    With several, each is broadcast in turn over the written texts, and a text's best languages and sums are put together.
    score is the posterior of the language, per_gram the mean log-likelihood of a gram in it (0 if 'und'); of equally likely languages the first by name counts. A text that is null,
    empty or without a letter is 'und' with score 0, as is every text when the table has no labels. Only the text enters a
    prediction, the whole of it however long. Rows with a null id are scored too, repeated rows give equal rows, an empty
    table gives none, and other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    learnt = iter(learnt)
    first, second = next(learnt, LanguageModel([], np.zeros((0, BUCKETS), np.float32))), next(learnt, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        return source.mapInArrow(partial(_predict, model=shared), _IDENTIFIED)
    scratch = Scratch(spark, "language")
    rows = scratch.write(source.withColumn("uid", F.monotonically_increasing_id()), "rows")
    parts = None
    for k, model in enumerate(chain([first, second], learnt)):
        shared = spark.sparkContext.broadcast(model)
        part = scratch.write(rows.select("uid", "text").mapInArrow(partial(_partial, model=shared), "uid long, lang string, top double, total double, n long"), f"part{k}")
        shared.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    best = F.min_by(F.struct("lang", "top", "n"), F.struct(-F.col("top"), F.col("lang")))
    joined = parts.groupBy("uid").agg(best.alias("best"), F.collect_list(F.struct("top", "total")).alias("sums"))
    sums = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x.total * F.exp(x.top - F.col("best.top")))
    found = joined.select("uid", F.col("best.lang").alias("lang_pred"), (1 / sums).alias("score"), (F.col("best.top") / F.col("best.n")).alias("per_gram"))
    out = rows.select("uid", "doc_id", "held_out").join(found, "uid", "left")
    return out.select("doc_id", "held_out", *(F.coalesce(c, F.lit(other)).alias(c) for c, other in (("lang_pred", "und"), ("score", 0.0), ("per_gram", 0.0))))


def rejected(lang: list[str], score: np.ndarray, per_gram: np.ndarray) -> np.ndarray:
    """Whether a text's language cannot be told: no letter, no language with half of the posterior at least, or grams that
    would be four times likelier if drawn evenly from all buckets than from the language."""
    return (np.array(lang) == "und") | (score < LEAST_SCORE) | (per_gram < LEAST_PER_GRAM)
