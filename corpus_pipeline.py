"""Five corpus operators one after another; each stage works on all rows that the one before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm import decontaminate, langid, quality, sentencepiece, simhash
from gradloom.llm._common import materialize, table
from gradloom.llm.queries import PIECES

#: Documents under this language score, further than any profile learned allows, are rejected.
LEAST_LANGUAGE_SCORE = 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is learned from the labels of the documents given."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scores(model, F.col("text")) >= quality.THRESHOLD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: texts without a letter or far from every profile go."""
    profiles = langid.fit(langid.training_rows(docs))

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        return pd.Series([lang != langid.UND and score >= LEAST_LANGUAGE_SCORE for lang, score in map(profiles.predict, texts)])

    return docs.where(known("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document left."""
    return sentencepiece.encode_table(docs, PIECES)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
