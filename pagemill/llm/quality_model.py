"""Ordinal quality classifier: cumulative-link regression of graded ratings on hashed text.

All grades share one weight vector over hashed features; ordered thresholds split the score: P(grade <= j) =
sigmoid(threshold[j] - score). Features of a text are the means over its words and byte n-grams, plus the share of
words that repeat the one before, so a text's length does not move its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, rows_by_text
from .textfeat import Words, sample_by, short_enough, tables

WORD_BITS, GRAM_BITS, GRAM = 15, 15, 3
#: Bounds of the training sample: rows of each grade and in all; passes over it.
PER_GRADE, MOST_ROWS, EPOCHS = 1200, 4000, 60
#: The rows whose crc32(id as text) mod the first is the second are never learned from.
HELD_OUT = (5, 0)


class Ordinal:
    """weights over features and increasing thresholds between the grades."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.words, self.grams, self.repeat = np.zeros(1 << WORD_BITS), np.zeros(1 + (1 << GRAM_BITS)), 0.0
        self.thresholds = np.zeros(max(0, len(grades) - 1))

    def scores(self, words: Words) -> np.ndarray:
        """One score a text; 0 for texts without words."""
        n = np.maximum(np.bincount(words.text, minlength=words.n_texts), 1)
        word = np.bincount(words.text, weights=self.words[word_features(words)], minlength=words.n_texts) / n
        at, text = gram_features(words)
        grams = np.bincount(text, weights=self.grams[at], minlength=words.n_texts) / np.maximum(np.bincount(text, minlength=words.n_texts), 1)
        return word + grams + self.repeat * repeats(words) / n

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[j]) for j = 1, 2, ...: a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def word_features(words: Words) -> np.ndarray:
    return (words.hashes & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def gram_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each word with its edges, and the text of each."""
    g = words.grams(GRAM, GRAM_BITS)
    marks = np.zeros(len(g) + 1, dtype=np.int64)
    marks[words.starts - 1] = 1
    owner = np.cumsum(marks)[:-1] - 1  # a gram belongs to the word whose leading edge came last
    at = np.flatnonzero((g > 0) & (owner >= 0))
    return g[at], words.text[owner[at]]


def repeats(words: Words) -> np.ndarray:
    """Words of each text that equal the one before."""
    same = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])) + 1
    return np.bincount(words.text[same], minlength=words.n_texts)


def train(texts: list[str], grades: list[int], epochs: int = EPOCHS) -> Ordinal:
    """Fit by Adagrad on the mean log-likelihood, each grade counting alike. Grades are those that occur."""
    levels = sorted(set(grades))
    model = Ordinal(levels)
    if len(levels) < 2:
        return model
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, feature, share; words first, then grams
    repeated = np.zeros(len(texts))
    shift = 1 << WORD_BITS
    for lo, hi, words in tables(texts, lower=False):
        n = np.maximum(np.bincount(words.text, minlength=hi - lo), 1)
        repeated[lo:hi] = repeats(words) / n
        for text, feature in ((words.text, word_features(words)), (lambda g, t: (t, g + shift))(*gram_features(words))):
            key, count = np.unique(text.astype(np.int64) << 32 | feature.astype(np.int64), return_counts=True)
            row = key >> 32
            total = np.maximum(np.bincount(row, weights=count, minlength=hi - lo), 1)
            parts.append((row + lo, key & 0xFFFFFFFF, (count / total[row]).astype(np.float32)))
    row, feature, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = shift + 1 + (1 << GRAM_BITS)
    w, w2 = np.zeros(size), np.full(size, 1e-6)
    rep = rep2 = 0.0
    y = np.searchsorted(levels, grades)
    weight = (len(y) / len(levels) / np.bincount(y, minlength=len(levels)))[y] / len(y)
    cuts = np.linspace(-1, 1, len(levels) + 1)[1:-1]
    c2 = np.full(len(cuts), 1e-6)
    for _ in range(epochs):
        s = np.bincount(row, weights=w[feature] * share, minlength=len(texts)) + rep * repeated
        f = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -50, 50)))  # P(grade <= j)
        f = np.concatenate((np.zeros((len(s), 1)), f, np.ones((len(s), 1))), axis=1)
        d = f * (1 - f)
        at = np.arange(len(s))
        p = np.maximum(f[at, y + 1] - f[at, y], 1e-9)
        gs = -weight * (d[at, y + 1] - d[at, y]) / p  # of the log-likelihood, by the score
        gc = np.array([(weight * d[:, j] * ((y + 1 == j) * 1.0 - (y == j) * 1.0) / p).sum() for j in range(1, len(levels))])
        g = np.bincount(feature, weights=gs[row] * share, minlength=size) - 1e-7 * w
        w2 += g * g
        w += 1.0 * g / np.sqrt(w2)
        gr = float(gs @ repeated)
        rep2 += gr * gr
        rep += 0.5 * gr / np.sqrt(rep2 + 1e-12)
        c2 += gc * gc
        cuts = np.maximum.accumulate(cuts + 0.1 * gc / np.sqrt(c2))
    model.words, model.grams, model.repeat, model.thresholds = w[:shift], w[shift:], rep, cuts
    return model


def training_sample(
    docs: DataFrame, labels: DataFrame, grade_expr: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = HELD_OUT[0], held_out: int = HELD_OUT[1]
) -> tuple[list[str], list[int]]:
    """Texts and grades of about PER_GRADE labelled rows of each grade, MOST_ROWS in all.

    Rows of the held-out fold and texts beyond SAMPLE_CHARS are left out. Of rows of labels that repeat an id the highest grade counts. grade_expr is SQL over labels; where it is null a
    row has no label.
    """
    graded = labels.select(F.col(id_col).alias("__id"), F.expr(grade_expr).cast("int").alias("__grade")).groupBy("__id").agg(F.max("__grade").alias("__grade"))
    graded = graded.where(F.col("__id").isNotNull() & (fold_remainder(F.col("__id"), modulus) != held_out))
    picked = sample_by(graded, "__grade", PER_GRADE, F.col("__id"), MOST_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(short_enough("text"))
    got = rows.join(F.broadcast(picked), F.col("id") == F.col("__id")).orderBy(F.xxhash64("id", "text")).limit(MOST_ROWS).collect()
    return [r.text for r in got], [r["__grade"] for r in got]


def score_documents(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", tail_grade: int | None = None) -> DataFrame:
    """id, expected_grade and tail_prob = P(grade >= tail_grade) of every row; tail_grade defaults to the second grade.

    A null or empty text scores 0, between the grades' thresholds like any text without evidence. With fewer than two
    grades to learn from, expected_grade is the only grade (or null) and tail_prob 1. Rows that repeat are answered each;
    other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the feature bits
    kind = docs.schema[id_col].dataType
    levels = np.array(model.grades, dtype=float)
    at = 1 if tail_grade is None else int(np.searchsorted(levels, tail_grade))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            grade, tail = np.full(len(texts), np.nan), np.ones(len(texts))
            for lo, hi, words in tables(texts, lower=False):
                above = shared.value.cumulative(shared.value.scores(words))
                grade[lo:hi] = (levels[0] + above @ np.diff(levels)) if len(levels) else np.nan
                tail[lo:hi] = above[:, at - 1] if 0 < at <= above.shape[1] else 1.0 if at == 0 or not above.shape[1] else 0.0
            yield pd.DataFrame({"id": batch["id"], "expected_grade": grade, "tail_prob": tail})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInPandas(answer, "id string, expected_grade double, tail_prob double")
    return found.select(F.col("id").cast(kind).alias(id_col), F.nanvl("expected_grade", F.lit(None).cast("double")).alias("expected_grade"), "tail_prob")


def select_documents(docs: DataFrame, model: Ordinal, grade: int, probability: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose P(grade >= `grade`) reaches `probability`, with all their columns; all rows if there was nothing to learn."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the feature bits
    at = int(np.searchsorted(np.array(model.grades, dtype=float), grade))

    def keep(texts: list[str | None]) -> list[bool]:
        out: list[bool] = []
        for lo, hi, words in tables(texts, lower=False):
            above = shared.value.cumulative(shared.value.scores(words))
            out += (above[:, at - 1] >= probability).tolist() if 0 < at <= above.shape[1] else [True] * (hi - lo)
        return out

    return rows_by_text(docs, text_col, keep)


#: The grades of table labels: 0 junk, 1 sound but toxic, 2 sound. A text is selected if it is likelier sound than junk.
GRADES, SELECT_GRADE, SELECT_PROB = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END", 1, 0.5
