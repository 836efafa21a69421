"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of weights of its hashed affixes and character n-grams (n-grams that take in the
word's edges are affixes) and of its place in a hashed lexicon. Transitions and the first label's scores are learned
with them, on spans of different languages joined into code-switched sequences. Forward-backward gives the marginals
of every word's label; a document's language is the one with the largest mean marginal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, rows_by_text
from .textfeat import Words, sample_by, short_enough, tables, words_of

GRAMS, BITS, LEXICON_BITS = (2, 3, 4), 15, 16
#: Bounds of the training sample: documents of each language and in all; sequences and words in each; epochs.
PER_LANGUAGE, MOST_DOCUMENTS, SEQUENCES, SEQUENCE_WORDS, EPOCHS = 300, 4000, 3000, 40, 30
UNKNOWN = "und"
#: Training words whose letters are shuffled to tell how sure the field is of words that it cannot know.
UNKNOWN_WORDS = 5000


class Crf:
    """Weights (rows: features; columns: labels), transitions and first scores."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.grams = [np.zeros((1 + (1 << BITS), k), dtype=np.float32) for _ in GRAMS]
        self.lexicon = np.zeros((1 << LEXICON_BITS, k), dtype=np.float32)
        self.transitions, self.first = np.zeros((k, k)), np.zeros(k)
        self.unknown = 1.0  # the mean certainty of words that are in no language

    def emissions(self, words: Words) -> np.ndarray:
        at = sum(w[words.grams(n, BITS)] for n, w in zip(GRAMS, self.grams, strict=True))
        total = np.zeros((len(at) + 1, len(self.labels)))
        np.cumsum(at, axis=0, out=total[1:])
        return total[words.ends] - total[words.starts - 1] + self.lexicon[words.hashes & np.uint64((1 << LEXICON_BITS) - 1)]

    def certainties(self, scores: np.ndarray) -> np.ndarray:
        """Of each word by itself, whatever its neighbours are: the share of its likeliest label."""
        return 1 / np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -40)).sum(axis=1)

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word's label; first marks the words that start a text."""
        e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -40))
        last = np.append(first[1:], True)
        t = np.exp(self.transitions)
        ahead = scan(e, first, t, np.exp(self.first))
        back = scan(e[::-1], last[::-1], t.T, np.ones(len(self.labels)))[::-1]
        both = ahead * back / e
        return both / both.sum(axis=1, keepdims=True)


def scan(e: np.ndarray, first: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised vectors a[i] = (start if first[i] else a[i - 1] @ t) * e[i] for a long row of words.

    The row is cut into equal blocks that advance side by side. A block without a first word depends on what comes
    before it through a matrix, found from the unit vectors, so any length is exact and none is slow.
    """
    n, k = e.shape
    size = max(16, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    e = np.concatenate((e, np.ones((pad, k)))).reshape(blocks, size, k).transpose(1, 0, 2)
    first = np.concatenate((first, np.ones(pad, dtype=bool))).reshape(blocks, size).T

    def run(a: np.ndarray, e: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        scale = np.zeros(len(a))
        for i in range(size):
            a = np.where(first[i][:, None], start, a @ t) * e[i]
            norm = a.sum(axis=1)
            a /= norm[:, None]
            if keep is not None:
                keep[i] = a
            else:
                scale += np.log(norm)
        return a, scale

    after, _ = run(np.full((blocks, k), 1 / k), e, first)
    through = np.flatnonzero(~first.any(axis=0))
    matrices = {}
    if len(through):
        rows, scale = run(np.tile(np.eye(k), (len(through), 1)), np.repeat(e[:, through], k, axis=1), np.repeat(first[:, through], k, axis=1))
        scale = scale.reshape(-1, k)
        rows = rows.reshape(-1, k, k) * np.exp(scale - scale.max(axis=1, keepdims=True))[:, :, None]
        matrices = dict(zip(through.tolist(), rows, strict=True))
    before = np.full((blocks, k), 1 / k)
    for b in range(1, blocks):
        x = before[b - 1] @ matrices[b - 1] if b - 1 in matrices else after[b - 1]
        before[b] = x / x.sum()
    out = np.empty((size, blocks, k))
    run(before, e, first, out)
    return out.transpose(1, 0, 2).reshape(-1, k)[:n]


def train(texts: list[str], languages: list[str], epochs: int = EPOCHS, seed: int = 6) -> Crf:
    """Fit a field to documents of known language, by gradient ascent on the sequences' log-likelihood."""
    labels = sorted(set(languages))
    model, k = Crf(labels), len(labels)
    if not texts:
        return model
    rng = np.random.default_rng(seed)
    words = words_of(texts)
    starts, counts = words.text_spans()
    of = np.array([labels.index(x) for x in languages])
    by_label = [np.flatnonzero((of == y) & (counts > 0)) for y in range(k)]
    usable = [y for y in range(k) if len(by_label[y])]
    if not usable:
        return model
    picked, y = np.zeros((SEQUENCES, SEQUENCE_WORDS), dtype=np.int64), np.zeros((SEQUENCES, SEQUENCE_WORDS), dtype=np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < SEQUENCE_WORDS:
            lang = usable[rng.integers(len(usable))]
            doc = by_label[lang][rng.integers(len(by_label[lang]))]
            n = int(min(counts[doc], rng.integers(1, SEQUENCE_WORDS + 1), SEQUENCE_WORDS - at))
            lo = starts[doc] + rng.integers(counts[doc] - n + 1)
            picked[s, at : at + n], y[s, at : at + n] = np.arange(lo, lo + n), lang
            at += n
    used, index = np.unique(picked, return_inverse=True)
    index = index.reshape(picked.shape)
    owner = np.zeros(len(words.buffer), dtype=np.int64)  # 1 + the word a gram's first byte belongs to, an edge's space included
    number = np.zeros(len(words.starts), dtype=np.int64)
    number[used] = np.arange(1, len(used) + 1)
    marks = np.repeat(number, words.ends - words.starts + 1)
    owner[np.arange(len(marks)) - np.repeat(np.cumsum(words.ends - words.starts + 1) - (words.ends - words.starts + 1), words.ends - words.starts + 1) + np.repeat(words.starts - 1, words.ends - words.starts + 1)] = marks
    features = []
    for n in GRAMS:
        g = words.grams(n, BITS)
        at = np.flatnonzero((g > 0) & (owner > 0))
        features.append((owner[at] - 1, g[at]))
    features.append((np.arange(len(used)), (words.hashes[used] & np.uint64((1 << LEXICON_BITS) - 1)).astype(np.int64)))
    weights = [*model.grams, model.lexicon]
    squares = [np.full(w.shape, 1e-2) for w in weights]
    t2, f2 = np.full((k, k), 1e-2), np.full(k, 1e-2)
    gold = np.eye(k)[y]
    for _ in range(epochs):
        emit = np.zeros((len(used), k))
        for (row, f), w in zip(features, weights, strict=True):
            for j in range(k):
                emit[:, j] += np.bincount(row, weights=w[f, j], minlength=len(used))
        e = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -40))[index]
        t = np.exp(model.transitions)
        ahead, back = np.empty_like(e), np.empty_like(e)
        a = np.exp(model.first) * e[:, 0]
        for i in range(SEQUENCE_WORDS):
            a = (a @ t) * e[:, i] if i else a
            a = ahead[:, i] = a / a.sum(axis=1, keepdims=True)
        b = np.ones((SEQUENCES, k))
        for i in reversed(range(SEQUENCE_WORDS)):
            back[:, i] = b
            b = (e[:, i] * b) @ t.T
            b /= b.sum(axis=1, keepdims=True)
        m = ahead * back
        m /= m.sum(axis=2, keepdims=True)
        pair = ahead[:, :-1, :, None] * t * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        gt, gf = (seen - pair.sum(axis=(0, 1))) / SEQUENCES, (gold[:, 0] - m[:, 0]).mean(axis=0)
        t2 += gt * gt
        f2 += gf * gf
        model.transitions += 0.2 * gt / np.sqrt(t2)
        model.first += 0.2 * gf / np.sqrt(f2)
        miss = np.zeros((len(used), k))
        for j in range(k):
            miss[:, j] = np.bincount(index.ravel(), weights=(gold - m)[:, :, j].ravel(), minlength=len(used))
        for (row, f), w, s in zip(features, weights, squares, strict=True):
            for j in range(k):
                g = np.bincount(f, weights=miss[row, j], minlength=len(w)) - 0.01 * w[:, j]
                s[:, j] += g * g
                w[:, j] += 0.1 * g / np.sqrt(s[:, j])
    lettered = np.flatnonzero(words.lettered)
    seen = [bytes(words.buffer[words.starts[i] : words.ends[i]]).decode() for i in rng.choice(lettered, min(len(lettered), UNKNOWN_WORDS), replace=False)]
    unknown = words_of([" ".join("".join(rng.permutation(list(w))) for w in seen)])
    if len(unknown.starts):
        model.unknown = float(model.certainties(model.emissions(unknown)).mean())
    return model


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int = 3, held_out: int = 1) -> tuple[list[str], list[str]]:
    """Texts (up to SAMPLE_CHARS each) and languages of about PER_LANGUAGE documents each (MOST_DOCUMENTS in all), none of the held-out fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((fold_remainder(F.col("id"), modulus) != held_out) & short_enough("text"))
    got = sample_by(rows, "lang", PER_LANGUAGE, F.struct("id", "text"), MOST_DOCUMENTS).collect()
    return [r.text for r in got], [r.lang for r in got]


def predict(model: Crf, texts: list[str | None]) -> tuple[list[str], list[float]]:
    return judged(model, texts)[:2]


def judged(model: Crf, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, its score, and the mean certainty of the words of each text."""
    names, scores, certain = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    for lo, hi, words in tables(texts):
        use = words.lettered
        if not use.any() or not model.labels:
            continue
        text = words.text[use]
        emitted = model.emissions(words)[use]
        m = model.marginals(emitted, np.concatenate(([True], text[1:] != text[:-1])))
        sure = np.bincount(text, weights=model.certainties(emitted), minlength=hi - lo)
        n = np.bincount(text, minlength=hi - lo)
        mean = np.stack([np.bincount(text, weights=m[:, j], minlength=hi - lo) for j in range(len(model.labels))], axis=1) / np.maximum(n, 1)[:, None]
        for i in np.flatnonzero(n):
            if any(c.isalpha() for c in texts[lo + i]):
                j = int(mean[i].argmax())
                names[lo + i], scores[lo + i] = model.labels[j], float(min(1.0, max(0.0, mean[i, j])))
                certain[lo + i] = float(sure[i] / n[i])
    return names, scores, certain


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out-independent prediction (lang_pred, score) and nothing else, of every row.

    A text that is null or has no letter is `und` with score 0, as is every text if nothing could be learned. Rows
    that repeat are answered each; an empty table gives an empty one; other columns are ignored. Ties between
    languages go to the first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS, LEXICON_BITS and the labels
    kind = docs.schema[id_col].dataType

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = predict(shared.value, batch["text"].tolist())
            yield pd.DataFrame({"id": batch["id"], "lang_pred": names, "score": scores})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInPandas(answer, "id string, lang_pred string, score double")
    return found.select(F.col("id").cast(kind).alias(id_col), "lang_pred", "score")


def select_documents(docs: DataFrame, model: Crf, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, with all their columns; all rows if none could be learned.

    A text that switches between languages has no such score for any of them. It is kept if its words are surely of some
    language: if their mean certainty is `least` of the way or more from that of unknown words to 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS, LEXICON_BITS and the labels

    def keep(texts: list[str | None]) -> list[bool]:
        model = shared.value
        enough = model.unknown + least * (1 - model.unknown)
        return [not model.labels or n != UNKNOWN and (s >= least or c >= enough) for n, s, c in zip(*judged(model, texts), strict=True)]

    return rows_by_text(docs, text_col, keep)


def word_languages(model: Crf, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its likeliest language and that one's marginal."""
    words = words_of([text])
    if not len(words.starts):
        return []
    m = model.marginals(model.emissions(words), np.arange(len(words.starts)) == 0)
    return [(bytes(words.buffer[s:e]).decode(), model.labels[int(p.argmax())], float(p.max())) for s, e, p in zip(words.starts, words.ends, m, strict=True)]
