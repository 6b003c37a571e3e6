"""From raw documents to training sequences: quality, exact and near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.catalog import tokenizer
from docweave.llm.exact_dedup import drop_exact
from docweave.llm.mixing import poisson_mix
from docweave.llm.near_dedup import drop_near
from docweave.llm.packing import pack_documents
from docweave.llm.quality import fit_quality, keep_quality
from docweave.session import read
from docweave.streaming.files import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside the held-out fold, does not reject."""
    return keep_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights, in shuffled order."""
    return poisson_mix(docs).drop("copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer have no SQL counterpart; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
