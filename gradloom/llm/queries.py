"""The corpus operators as registered queries; SQL that checks them is in ``ORACLE_SQL``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_pq, html_main, langid, ngram_lm, quality, sentencepiece, simhash, token_counts, toxicity
from ._common import table

#: The folder of the public tokenizers' files, on every machine.
TOKENIZERS = os.environ.get("GRADLOOM_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_table(table(spark, sf_dir, "documents"), PIECES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_folds(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), RANKS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_folds(table(spark, sf_dir, "documents"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_embedding_pq": op3_embedding_pq,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_html_main_text": op6_html_main_text,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_quality_gam": op9_quality_gam,
    "op10_toxicity_zstd": op10_toxicity_zstd,
}

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_pq": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
    SELECT vec_id, e FROM v
    WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id, vec_id <= coalesce(c.c, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
}
