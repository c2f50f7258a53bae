"""Registered queries of this package, each over the whole of its table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import attention_lm, bpe, embedding_dedup, exact_dedup, html_text, language_id, line_dedup, mixing, ngram_join, packing, periodic_runs, repair, secret_scan

#: Vocabularies of the encoding and scoring queries; public files outside the repository, read by the driver.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SUBWORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark, folder):
    return ngram_join.similarity_components(_table(spark, folder, "documents"))


def op2_language_id(spark, folder):
    return language_id.language_report(_table(spark, folder, "documents"))


def op3_line_dedup(spark, folder):
    return line_dedup.line_report(_table(spark, folder, "documents"))


def op4_best_fit_packing(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents"))


def op5_embedding_near_dedup(spark, folder):
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op6_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op7_lm_scoring(spark, folder):
    return attention_lm.score_documents(_table(spark, folder, "documents"), SUBWORDS)


def op8_html_extraction(spark, folder):
    return html_text.main_texts(_table(spark, folder, "pages"))


def op9_secret_scan(spark, folder):
    return secret_scan.secret_report(_table(spark, folder, "documents"))


def op10_bpe_encoding(spark, folder):
    return bpe.encoding_report(_table(spark, folder, "documents"), TOKENIZER)


def op11_source_mix(spark, folder):
    return mixing.Mix(_table(spark, folder, "documents")).taken()


def op12_conversation_repair(spark, folder):
    return repair.repair_report(repair.damaged(_table(spark, folder, "conversations")), _table(spark, folder, "conversations"))


def op13_periodic_runs(spark, folder):
    return periodic_runs.run_report(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_language_id,
        op3_line_dedup,
        op4_best_fit_packing,
        op5_embedding_near_dedup,
        op6_exact_dedup,
        op7_lm_scoring,
        op8_html_extraction,
        op9_secret_scan,
        op10_bpe_encoding,
        op11_source_mix,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id
    """,
    "op6_exact_dedup": f"""
        WITH low AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS t FROM documents),
        grouped AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM low)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
    """,
    "op11_source_mix": f"""
        WITH sizes AS (
            SELECT doc_id, source, size, count(*) AS n
            FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents)
            GROUP BY ALL
        ), totals AS (
            SELECT source, sum(size * n)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
            FROM sizes GROUP BY source
        ), weighed AS (
            SELECT *, [3, 1, 2][number % 3 + 1] AS weight, source_size * {mixing.MAX_EPOCHS} AS most FROM totals
        ), levels AS (
            SELECT *, ((SELECT sum(source_size) FROM totals) * {mixing.HALVES} / 2.0 - coalesce(sum(most) OVER before, 0))::DOUBLE
                / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
            FROM weighed WINDOW before AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), targets AS (
            SELECT *, CASE WHEN most <= level * weight THEN most::DOUBLE
                ELSE weight * (SELECT arg_min(level, (most / weight, number)) FROM levels WHERE most > level * weight) END AS target
            FROM levels
        ), bounds AS (
            SELECT *, sum(target) OVER (ORDER BY number) AS high, coalesce(sum(target) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
            FROM targets
        ), total AS (
            SELECT coalesce(sum(source_size), 0) * {mixing.HALVES} / 2.0 AS t FROM totals
        ), points AS (
            SELECT ((k + 1) * {mixing.GOLDEN}::DOUBLE - floor((k + 1) * {mixing.GOLDEN}::DOUBLE)) * t AS x
            FROM (SELECT t::DOUBLE AS t, unnest(range((ceil(floor(t) / {mixing.BLOCK_TOKENS}))::BIGINT)) AS k FROM total)
        ), drawn AS (
            SELECT number, count(*) * {mixing.BLOCK_TOKENS} AS drawn FROM points
            JOIN bounds ON x >= low AND (x < high OR high = (SELECT max(high) FROM bounds)) AND high > low GROUP BY number
        ), places AS (
            SELECT s.*, number, source_size, target, coalesce(sum(s.size * n) OVER (
                PARTITION BY number ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, ' ')), 1, 8))::BIGINT, doc_id NULLS FIRST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), laid AS (SELECT *, start + unnest(range(n)) * size AS a FROM places)
        SELECT doc_id, size, source_size, target, source, (greatest(0, least(a + size, coalesce(drawn, 0)) - a)
            + greatest(0, least(source_size + a + size, coalesce(drawn, 0)) - source_size - a))::BIGINT AS taken
        FROM laid LEFT JOIN drawn USING (number)
    """,
}
