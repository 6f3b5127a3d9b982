"""The registered query of each text operator, over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_spans, summarise

    return summarise(find_spans(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """model: the path of a SentencePiece model; the public one if none is given."""
    from .pieces import encode_digests, public_model

    return encode_digests(table(spark, sf_dir, "documents"), Path(model).read_bytes() if model else public_model())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, models

    docs = table(spark, sf_dir, "documents")
    return identify(docs, models(docs))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(extra)))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats_digests

    return remove_repeats_digests(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import byte_shards

    shards = byte_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_suffix_array": op8_suffix_array,
    "op9_sharding": op9_sharding,
    "op10_minhash": op10_minhash,
}

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _words_sql(table: str, key: str) -> str:
    """The words of each text, as a list."""
    split = f"string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+')"
    return f"SELECT {key}, list_filter({split}, lambda w: w <> '') AS words FROM {table}"


def _shingles_sql(table: str, key: str) -> str:
    """The distinct runs of five words of each text; of fewer words, the one run of all."""
    five = "list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))"
    runs = f"CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE {five} END"
    return f"SELECT DISTINCT {key}, unnest({runs}) AS shingle FROM ({_words_sql(table, key)})"


_CONTROL_SQL = r"(<s>|</s>|\[INST\]|\[/INST\]|<part:)"


def _escaped_length_sql(text: str) -> str:
    return f"len(replace({text}, '\\', '\\\\')) + len(regexp_extract_all({text}, '{_CONTROL_SQL}'))"


#: What DuckDB can run on whole tables in reasonable time.
ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH t AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM t),
        s AS MATERIALIZED (SELECT doc_id, line_no, line,
            list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM l),
        c AS MATERIALIZED (SELECT list_sort(words) AS words, min({'d': doc_id, 'l': line_no}) AS place, row_number() OVER () AS c FROM s
            WHERE len(words) > 0 GROUP BY 1),
        e AS (SELECT c, len(words) AS n, unnest(words) AS w FROM c),
        f AS (SELECT w, count(*) AS n FROM e GROUP BY 1),
        r AS (SELECT c, e.n, w, row_number() OVER (PARTITION BY c ORDER BY f.n, w) AS k FROM e JOIN f USING (w)),
        p AS MATERIALIZED (SELECT c, n, w FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
        q AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.w = b.w AND a.c <> b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
        m AS (SELECT DISTINCT y.c FROM q JOIN c x ON x.c = a JOIN c y ON y.c = b WHERE x.place < y.place AND
            180 * len(list_intersect(x.words, y.words)) >= 80 * (len(x.words) + len(y.words))),
        k AS (SELECT place.d AS doc_id, place.l AS line_no FROM c WHERE c NOT IN (SELECT c FROM m)),
        o AS (SELECT s.doc_id, s.line_no, s.line, len(words) = 0 OR k.doc_id IS NOT NULL AS stays FROM s LEFT JOIN k USING (doc_id, line_no))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_removed,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '')) AS kept_sha256
        FROM o GROUP BY doc_id""",
    "op3_decontamination": f"""
        WITH d AS MATERIALIZED ({_shingles_sql("documents", "doc_id")}), i AS MATERIALIZED ({_shingles_sql("benchmark", "item_id")}),
        n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY 1, 2)
        SELECT doc_id, item_id, n_item, n_shared FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item""",
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op7_chat_formatting": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(20 + {_escaped_length_sql("role")} + {_escaped_length_sql("text")}) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op10_minhash": f"""
        WITH RECURSIVE s AS MATERIALIZED ({_shingles_sql("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
