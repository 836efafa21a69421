"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fresh_folder, materialised, shared_folder

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder there; sources.discard() removes it with the others."""
    return fresh_folder(spark, name)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written once to the shared folder (with options of the writer) and read back: later uses neither recompute it nor depend on the executor that made it."""
    return materialised(df, name, **options)


def word_array(text: Column) -> Column:
    """The words of a text (null: null)."""
    return F.array_remove(F.split(text, SPACE), "")


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, mod modulus: fixed folds for held-out rows."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_by_text(docs: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs that keep() accepts by their texts, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
