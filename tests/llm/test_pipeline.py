"""The pipeline against brute force, stage by stage, and the entry point without the text operators."""

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from murmuration.llm.pieces import public_model

from .conftest import ODD, documents, sentence
from .test_dedup import near_by_brute_force, shingles

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])


def tables(spark, folder, docs, items):
    rows = [(i, t, None if i is None else "en", None, 1) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def expected(docs, items):
    """(id, text) of what stays."""
    rest = {i: t for i, t in docs if t and re.search(r"[^\W\d_]", t)}
    first = {}
    for i in sorted(rest):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rest[i]), i)
    rest = {i: rest[i] for i in first.values()}
    groups = near_by_brute_force(list(rest.items()), corpus_pipeline.NEAR_PERCENT)
    rest = {i: t for i, t in rest.items() if groups[i][2]}
    benchmark = [shingles(t) for _, t in items if t]
    return {i: t for i, t in rest.items() if not any(100 * len(b & shingles(t)) >= 80 * len(b) for b in benchmark)}


def test_pipeline(spark, frame, tmp_path):
    import random

    import sentencepiece

    rng = random.Random(3)
    items = [(i, sentence(rng, 20 + i)) for i in range(6)]
    docs = documents(11, 120) + [(9000 + i, f"{sentence(rng, 60)}\n{t} {sentence(rng, 40)}") for i, t in items]
    tables(spark, tmp_path, docs, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = expected(docs, items)
    assert set(got) == set(kept) and 9000 not in got
    library = sentencepiece.SentencePieceProcessor(model_proto=public_model())
    for i, t in kept.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_stages_keep_columns_and_take_odd_rows(spark, frame, tmp_path):
    tables(spark, tmp_path, ODD, [(1, "p q r s t u v")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
    # rows without an id stay; of the rows with id 7, equal ones become one; the copy of 13 without an id comes first
    assert sorted(r.doc_id or 0 for r in rows) == [0, 7, 7]


def test_stages_with_clashing_columns_and_long_texts(spark, frame, tmp_path):
    """Columns that have the names of the operators' own come through with their values, whatever a stage decides."""
    from .conftest import LONG

    tables(spark, tmp_path, [(1, "x")], [(1, "p q r s t u v")])
    extra = "row string, _row string, read string, key string, kept string, size string, uid string, band string, component string"
    texts = [(1, LONG), (2, LONG), (3, "one two three four five six"), (6, "ONE two three four five six"), (4, "a p q r s t u v b"), (5, "12")]
    rows = [(i, t, None if t == LONG else "en", None, 1, *(f"{c}{k}" for c in "abcdefghj")) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    left = {name: None for name, _ in corpus_pipeline.STAGES[:4]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        left[name] = sorted(tuple(r)[5:] for r in docs.collect())
    own = lambda *ks: sorted(rows[k][5:] for k in ks)
    assert left == {"language_id": own(0, 1, 2, 3, 4), "exact_dedup": own(0, 2, 3, 4), "near_dedup": own(0, 2, 4), "decontaminate": own(0, 2)}
    assert corpus_pipeline.sentencepiece(spark, docs, str(tmp_path)).count() == 2


def test_decisions_name_rows(spark, frame, tmp_path):
    import random

    rng = random.Random(8)
    leak, clean, near, copy = (sentence(rng, 40) for _ in range(4))
    docs = [(None, f"{sentence(rng, 9)} {leak}"), (1, f"{leak} {sentence(rng, 9)}"), (1, clean), (None, near), (2, f"{near} end"), (3, copy), (4, copy), (4, sentence(rng, 30)), (3, sentence(rng, 20))]
    tables(spark, tmp_path, docs, [(1, leak)])
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        rows = spark.createDataFrame(stage(spark, rows, str(tmp_path)).collect(), rows.schema)
    kept = sorted(((r.doc_id, r.text) for r in rows.collect()), key=str)
    assert kept == sorted([docs[k] for k in (2, 3, 5, 7, 8)], key=str)


def test_stages_hand_python_small_batches(spark, frame, tmp_path):
    """Of whole texts no more than BATCH_BYTES and a row at a time; a smaller setting of the session stays."""
    from murmuration.llm.common import BATCH_BYTES

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    tables(spark, tmp_path, [(i, f"{i} " + "word " * 20_000) for i in range(60)], [(1, "p q r s t u v")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    seen = docs.select("text").mapInArrow(_sizes, "bytes long")
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(setting)
            stage(spark, docs, str(tmp_path))
            sizes = [r.bytes for r in seen.collect()]
            assert sum(sizes) > 4 * BATCH_BYTES and max(sizes) < BATCH_BYTES + 150_000
        spark.conf.set(setting, "200k")
        stage(spark, docs, str(tmp_path))
        assert max(r.bytes for r in seen.collect()) < 350_000
    finally:
        spark.conf.unset(setting)


def test_empty_tables(spark, frame, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_point_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "murmuration", tmp_path / "murmuration", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'colocation_log' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}).returncode == 0
