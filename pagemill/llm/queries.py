"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import delta_lloyd, html_extract, language_id, mixing, multi_index, packed_ids, packing, phrase_tries, quality_model, quality_rules, simhash, toxicity, warc
from .common import fold_remainder, read_table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.training_sample(docs, read_table(spark, sf_dir, "labels")))
    found = toxicity.score_documents(docs, model)
    return found.select("doc_id", (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(*language_id.training_sample(docs, "doc_id", "text", "lang"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model.train(*quality_model.training_sample(docs, read_table(spark, sf_dir, "labels"), quality_model.GRADES))
    found = quality_model.score_documents(docs, model, tail_grade=quality_model.SELECT_GRADE)
    modulus, remainder = quality_model.HELD_OUT
    return found.withColumn("held_out", fold_remainder(F.col("doc_id"), modulus) == remainder).withColumn("kept", F.col("tail_prob") >= quality_model.SELECT_PROB)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.encode(read_table(spark, sf_dir, "embeddings"))


def op12_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_tries.collocations(read_table(spark, sf_dir, "documents"))


def op13_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = packed_ids.write_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path(packed_ids.TOKENIZER))
    return packed_ids.read_ids(manifest)


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_rules": op2_quality_rules,
    "op3_multi_index": op3_multi_index,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_phrase_tries": op12_phrase_tries,
    "op13_packed_ids": op13_packed_ids,
}

#: DuckDB SQL where it can express the operator.
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_delta_lloyd": delta_lloyd.ORACLE,
    "op12_phrase_tries": phrase_tries.ORACLE,
}
