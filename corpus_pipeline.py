"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, surrogates for personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read back as the next
one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Mapping

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm import decontaminate, language, ngram_join, packing, pii
from rankloom.storage import new_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose n-grams resemble no learned language; a missing lang is filled in.

    Row by row, by the text alone: a null or empty one goes, repeated ids and rows don't matter.  All goes if no row has a label.
    """
    kept = language.identify(docs, language.train(docs)).where("lang_pred != 'und' and familiar")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by 80 % of their five-word shingles one stays, that with the smallest id.

    Row by row: of rows that repeat an id each stays or goes by its own text, a null id yields to any other.  Rows
    without words stay.  An empty table stays empty; columns that documents lack are dropped.
    """
    return ngram_join.drop_near_duplicates(docs, k=5, percent=80).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which half or more of a benchmark item is found, in whatever order.

    Row by row: repeated ids don't matter, null and empty texts stay, all stay if the benchmark is empty.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_items = 0").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes = pii.DEMO_KEY) -> DataFrame:
    """Replaces personal data by surrogates drawn with ``key``; n_chars follows the text.

    All rows stay, repeated ones and those without text too; a null text keeps null, also as n_chars.  An empty table stays empty.
    """
    return pii.pseudonymise(docs, key).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and position for each row, by the number of its tokens.

    A null or empty text has its end token alone; ties in length go by id, then text; an empty table gives no batches.
    """
    return packing.pack(packing.token_lengths(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack_batches),
]

#: Language ID and tokenisation can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, options: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """The last stage's rows; ``options`` has keyword arguments by stage, such as the surrogates' secret key: {"pii_surrogates": {"key": b"..."}}."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir, **(options or {}).get(name, {})).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
