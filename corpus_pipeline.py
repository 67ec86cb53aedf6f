"""Corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Every stage takes whatever columns its predecessor kept and works on all its rows. Null texts fail the quality stage;
empty tables pass through; rows that repeat whole are one document to the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, mixing, pii, quality, simhash
from tallyloom.llm.common import free_name, settle, table
from tallyloom.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rating is likely better than junk."""
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    names = tuple(free_name(docs, n) for n in ("expected_grade", "tail", "kept"))
    return quality.rate(docs, model, names=names).where(names[-1]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at 3 or fewer differing bits: that with
    the smallest doc_id.
    """
    return simhash.keep_one(docs, shingle=3)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return pii.replace_entities(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and what these decode to."""
    return bpe.with_ids(docs, TOKENIZER, decoded="decoded").drop("text")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

# Fitted models, keyed hashes and random rounding have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
