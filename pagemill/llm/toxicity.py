"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its affixes. Filters of several widths slide
over the words of a text, each keeps its largest response (max pooling), and a logistic layer scores them. Thresholds
are calibrated for each language, which a hashed word model tells from the text alone, and folded into the score: at
0.5 a text is at its language's threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder
from .textfeat import Words, sample_by, short_enough, tables

BITS, WIDTH, FILTERS, SPANS, PREFIXES = 16, 12, 12, (1, 2, 3), (4, 5)
#: Bounds of the training sample: rows of each label and in all; epochs and rows in a step; the part kept to calibrate.
PER_LABEL, MOST_ROWS, EPOCHS, STEP, CALIBRATION = 2000, 5000, 16, 50, 5
LANGUAGE_BITS = 14


class Classifier:
    """Embeddings (one table a feature), filters by width, output weights, languages and threshold shifts."""

    def __init__(self, languages: list[str], seed: int = 9):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3, (1 << BITS, WIDTH)).astype(np.float32) for _ in range(1 + len(PREFIXES))]
        self.filters = [rng.normal(0, 0.5 / np.sqrt(s), (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
        self.biases = [np.zeros(FILTERS, dtype=np.float32) for _ in SPANS]
        self.out, self.bias = rng.normal(0, 0.3, len(SPANS) * FILTERS).astype(np.float32), 0.0
        self.languages = languages
        self.language_words = np.zeros((1 << LANGUAGE_BITS, len(languages)), dtype=np.float32)
        self.shift = np.zeros(max(1, len(languages)))

    def features(self, words: Words) -> list[np.ndarray]:
        mask = np.uint64((1 << BITS) - 1)
        return [(h & mask).astype(np.int64) for h in (words.hashes, *(words.hashes_up_to(n) for n in PREFIXES))]

    def embed(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(t[f] for t, f in zip(self.tables, features, strict=True))

    def responses(self, x: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the filters' responses at the spans that start at each word; -inf where a span leaves the text."""
        for span, filters, bias in zip(SPANS, self.filters, self.biases, strict=True):
            r = x @ filters[0] + bias
            for k in range(1, span):
                r[: len(x) - k] += x[k:] @ filters[k]
            if span > 1:
                inside = np.zeros(len(x), dtype=bool)
                inside[: len(x) - span + 1] = text[span - 1 :] == text[: len(x) - span + 1]
                r[~inside] = -np.inf
            yield r

    def logits(self, words: Words) -> np.ndarray:
        starts, n = words.text_spans()
        pooled = np.zeros((words.n_texts, len(SPANS) * FILTERS), dtype=np.float32)
        some = np.flatnonzero(n)
        if len(some):
            for i, r in enumerate(self.responses(self.embed(self.features(words)), words.text)):
                pooled[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(r, starts[some], axis=0), 0)
        return pooled @ self.out + self.bias

    def language(self, words: Words) -> np.ndarray:
        """The likeliest language's number of each text."""
        if len(self.languages) < 2:
            return np.zeros(words.n_texts, dtype=np.int64)
        at = self.language_words[words.hashes & np.uint64((1 << LANGUAGE_BITS) - 1)]
        return np.stack([np.bincount(words.text, weights=at[:, j], minlength=words.n_texts) for j in range(len(self.languages))], axis=1).argmax(axis=1)

    def scores(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.shift[self.language(words)] - self.logits(words), -50, 50)))


def train(texts: list[str], labels: list[int], languages: list[str | None], odds: float = 1.0, epochs: int = EPOCHS, seed: int = 9) -> Classifier:
    """Fit by Adagrad on log loss; odds: how many rows of label 0 of the table stand behind one of the sample, against those of 1."""
    names = sorted({x for x in languages if x is not None})
    model = Classifier(names, seed)
    y = np.array(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    kept = rng.permutation(len(texts))
    calibration, learn = kept[: len(kept) // CALIBRATION], kept[len(kept) // CALIBRATION :]
    learn_language(model, texts, languages)
    if len(set(labels)) < 2:
        model.bias = 10.0 if set(labels) == {1} else -10.0
        model.out[:] = 0
        return model
    hashed: list[np.ndarray] = []  # each text's features, hashed once
    for lo, hi, words in tables(texts):
        starts, n = words.text_spans()
        both = np.stack(model.features(words)).astype(np.min_scalar_type((1 << BITS) - 1))
        hashed += [both[:, starts[t] : starts[t] + n[t]].copy() for t in range(hi - lo)]
    squares = [np.full(t.shape, 1e-3, dtype=np.float32) for t in model.tables]
    f2, b2 = [np.full(f.shape, 1e-3) for f in model.filters], [np.full(FILTERS, 1e-3) for _ in SPANS]
    o2, c2, rate = np.full(model.out.shape, 1e-3), 1e-3, 0.05
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        for lo in range(0, len(learn), STEP):
            rows = rng.permutation(learn)[:STEP] if lo + STEP > len(learn) else learn[lo : lo + STEP]
            n = np.array([hashed[i].shape[1] for i in rows])
            starts, some = np.cumsum(n) - n, np.flatnonzero(n)
            if not len(some):
                continue
            features = list(np.concatenate([hashed[i] for i in rows], axis=1).astype(np.int64))
            x = model.embed(features)
            pooled, places = np.zeros((len(rows), len(model.out))), np.zeros((len(rows), len(model.out)), dtype=np.int64)
            for i, r in enumerate(model.responses(x, np.repeat(np.arange(len(rows)), n))):
                for t in some:
                    block = r[starts[t] : starts[t] + n[t]]
                    at = block.argmax(axis=0)
                    places[t, i * FILTERS : (i + 1) * FILTERS] = starts[t] + at
                    pooled[t, i * FILTERS : (i + 1) * FILTERS] = np.maximum(block[at, np.arange(FILTERS)], 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
            g = (y[rows] - p) * balance[rows] / len(rows)
            back = g[:, None] * model.out[None, :] * (pooled > 0)
            go = pooled.T @ g - 1e-4 * model.out
            o2 += go * go
            model.out += (rate * go / np.sqrt(o2)).astype(np.float32)
            c2 += g.sum() ** 2
            model.bias += rate * g.sum() / np.sqrt(c2)
            touched: dict[str, list] = {"at": [], "by": []}
            for i, span in enumerate(SPANS):
                gf = np.zeros(model.filters[i].shape)
                for j in range(FILTERS):
                    t = np.flatnonzero(back[:, i * FILTERS + j])
                    at, by = places[t, i * FILTERS + j], back[t, i * FILTERS + j]
                    for k in range(span):
                        gf[k, :, j] = x[at + k].T @ by
                        touched["at"].append(at + k)
                        touched["by"].append(by[:, None] * model.filters[i][k, :, j][None, :])
                gb = back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0)
                f2[i] += gf * gf
                b2[i] += gb * gb
                model.filters[i] += (rate * gf / np.sqrt(f2[i])).astype(np.float32)
                model.biases[i] += (rate * gb / np.sqrt(b2[i])).astype(np.float32)
            at, by = np.concatenate(touched["at"]), np.concatenate(touched["by"])
            for table, square, feature in zip(model.tables, squares, features, strict=True):
                ids, inverse = np.unique(feature[at], return_inverse=True)
                ge = np.zeros((len(ids), WIDTH))
                np.add.at(ge, inverse, by)
                square[ids] += ge * ge
                table[ids] += (rate * ge / np.sqrt(square[ids])).astype(np.float32)
        learn = rng.permutation(learn)
    calibrate(model, [texts[i] for i in calibration], y[calibration], odds)
    return model


def learn_language(model: Classifier, texts: list[str], languages: list[str | None]) -> None:
    """Log shares of hashed words in each language."""
    if len(model.languages) < 2:
        return
    counts = np.full((1 << LANGUAGE_BITS, len(model.languages)), 0.5)
    for lo, hi, words in tables(texts):
        at = (words.hashes & np.uint64((1 << LANGUAGE_BITS) - 1)).astype(np.int64)
        of = np.array([model.languages.index(x) if x is not None else -1 for x in languages[lo:hi]])[words.text]
        for j in range(len(model.languages)):
            counts[:, j] += np.bincount(at[of == j], minlength=len(counts))
    model.language_words = np.log(counts / counts.sum(axis=0)).astype(np.float32)


def calibrate(model: Classifier, texts: list[str], y: np.ndarray, odds: float) -> None:
    """Shift each language's logits so that 0 lies where F1 of label 1 is largest, with label 0 at its frequency in the table.

    Of a range of thresholds that do alike, the middle is taken; a language with fewer than ten rows of either label
    takes the threshold of all.
    """
    logits, language = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for lo, hi, words in tables(texts):
        logits[lo:hi], language[lo:hi] = model.logits(words), model.language(words)

    def best(rows: np.ndarray) -> float:
        z, one = logits[rows], y[rows] == 1
        cuts = np.unique(z)
        cuts = np.concatenate(([cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]))
        true = np.array([(one & (z > c)).sum() for c in cuts], dtype=float)
        false = odds * np.array([(~one & (z > c)).sum() for c in cuts])
        f1 = 2 * true / (true + false + one.sum())
        top = cuts[f1 >= f1.max() - 1e-9]
        return float((top[0] + top[-1]) / 2)

    enough = lambda rows: min((y[rows] == 1).sum(), (y[rows] == 0).sum()) >= 10
    every = np.arange(len(texts))
    common = best(every) if len(every) and enough(every) else 0.0
    for j in range(len(model.shift)):
        rows = np.flatnonzero(language == j)
        model.shift[j] = best(rows) if enough(rows) else common


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", modulus: int = 5, held_out: int = 0) -> tuple[list[str], list[int], list[str | None], float]:
    """Texts, labels and languages of about PER_LABEL labelled rows of either label (MOST_ROWS in all), and the odds.

    Rows of the held-out fold and texts beyond SAMPLE_CHARS are left out. Of rows of labels that repeat an id, label 1 counts.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__label").isin(0, 1))
    marked = marked.where((fold_remainder(F.col("__id"), modulus) != held_out) & F.col("__id").isNotNull()).groupBy("__id").agg(F.max("__label").alias("__label"))
    counts = {r[0]: r[1] for r in marked.groupBy("__label").count().collect()}
    picked = sample_by(marked, "__label", PER_LABEL, F.col("__id"), MOST_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(short_enough("text"))
    got = rows.join(F.broadcast(picked), F.col("id") == F.col("__id")).orderBy(F.xxhash64("id", "text")).limit(MOST_ROWS).collect()
    y = [r["__label"] for r in got]
    odds = (counts.get(0, 0) / max(1, y.count(0))) / max(1e-9, counts.get(1, 0) / max(1, y.count(1))) if counts.get(1) else 1.0
    return [r.text for r in got], y, [r.lang for r in got], odds


def score_documents(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row.

    A null or empty text has the score of a text without any response. Rows that repeat are answered each; other columns
    are ignored; an empty table gives an empty one. Where only one label could be learned, every score says that label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS, WIDTH and LANGUAGE_BITS
    kind = docs.schema[id_col].dataType

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            score = np.zeros(len(texts))
            for lo, hi, words in tables(texts):
                score[lo:hi] = shared.value.scores(words)
            yield pd.DataFrame({"id": batch["id"], "score": score})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInPandas(answer, "id string, score double")
    return found.select(F.col("id").cast(kind).alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
