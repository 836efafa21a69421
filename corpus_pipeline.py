"""A training corpus from raw documents: quality, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents;
the last returns packed pieces. run() writes each stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import language_id, mixing, packing, quality_model, simhash
from pagemill.llm.common import read_table, stored
from pagemill.sources import discard, recording

#: A document goes if its language is unknown, or if no language has this share of its words' marginals and its words
#: are not this far from unknown words in certainty either.
LEAST_LANGUAGE = 0.4


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier sound than junk by the ordinal classifier."""
    model = quality_model.train(*quality_model.training_sample(docs, read_table(spark, sf_dir, "labels"), quality_model.GRADES))
    return quality_model.select_documents(docs, model, quality_model.SELECT_GRADE, quality_model.SELECT_PROB)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, or in several, that the field recognises."""
    model = language_id.train(*language_id.training_sample(docs, "doc_id", "text", "lang"))
    return language_id.select_documents(docs, model, LEAST_LANGUAGE)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    return simhash.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, in whole documents: each as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The classifiers, fingerprints and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage has stored besides its rows, and the rows of the stage before it, go once its own are written."""
    docs, rows = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recording() as made:
            found = stage(spark, docs, sf_dir)
            with recording() as written:
                docs = stored(found, name)
        discard(spark, rows + [p for p in made if p not in written])
        rows = written
    return STAGES[-1][1](spark, docs, sf_dir)
