"""A corpus pipeline: documents in, packed training sequences out, one operator a stage.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
``documents``, except the last, which returns packed pieces. Texts that a stage changes get a new ``n_chars``.
Null and empty texts have no language and go in the first stage; empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.llm import decontaminate, language_id, near_dedup, packing, pii
from hearthspark.llm.common import stage, table
from hearthspark.llm.queries import tokenizer_path
from hearthspark.session import ship

#: A document stays if the mean posterior of its best language is at least this; four languages evenly mixed have 0.25.
LEAST_LANGUAGE_SCORE = 0.4


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return docs.withColumn("n_chars", F.char_length("text").cast(kind)).select(columns) if kind is not None else docs.select(columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    ship(spark)
    model = language_id.train(docs.filter(~language_id.held_out()))
    if not model.labels:  # nothing to learn from: only texts without letters go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_id.keep_identified(docs, model, least=LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; drops documents that are mostly benchmark."""
    ship(spark)
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    ship(spark)
    return _counted(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their token ids."""
    ship(spark)
    return packing.pack(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Trained stages can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
