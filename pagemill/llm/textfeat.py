"""Words and hashed features of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts are taken together up to so many bytes; a longer text is taken alone.
TABLE_BYTES = 1 << 20
#: Training samples hold texts of up to so many characters, and the most frequent labels up to this number: with the bound
#: on rows this bounds the bytes that a sample brings to the driver.
SAMPLE_CHARS, MOST_LABELS = 32_768, 256


@dataclass
class Words:
    """The words of some texts: byte range, text number and hash of each."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    n_texts: int

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hashes_up_to(None)

    def hashes_up_to(self, n: int | None) -> np.ndarray:
        """64-bit hashes of the words, or of their first n bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        size = self.ends - self.starts
        size = size if n is None else np.minimum(size, n)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        powers = np.cumprod(np.full(int(size.max()), _MULTIPLIER))
        total = np.add.reduceat((self.buffer[place + np.repeat(self.starts, size)].astype(np.uint64) + np.uint64(1)) * powers[place], first)
        return _mixed(total)

    def grams(self, n: int, bits: int, raw: bool = False) -> np.ndarray:
        """For each byte, 1 + the hash of the n bytes from there on, or 0 where a space lies inside or nothing else does.

        A space at either end stands for the word's edge, so grams are affixes too. raw: spaces inside count as well.
        """
        b = self.buffer.astype(np.uint32)
        size = len(b)
        h = np.zeros(size, dtype=np.uint32)
        valid = np.ones(size, dtype=bool)
        for k in range(n):
            part = b[k:] if k else b
            h[: size - k] = h[: size - k] * np.uint32(0x01000193) + part
            if 0 < k < n - 1 and not raw:
                valid[: size - k] &= ~_SPACE[self.buffer[k:]]
        valid[size - n + 1 :] = False
        if not raw:
            valid[: size - n + 1] &= ~(_SPACE[self.buffer[: size - n + 1]] & _SPACE[self.buffer[n - 1 :]])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        return np.where(valid, 1 + (h & np.uint32((1 << bits) - 1)).astype(np.int32), 0)

    @cached_property
    def lettered(self) -> np.ndarray:
        """Whether a word has a byte of an ASCII letter or of a character beyond ASCII."""
        c = np.concatenate(([0], np.cumsum(_LETTER[self.buffer])))
        return c[self.ends] > c[self.starts]

    def text_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and word count of each text."""
        n = np.bincount(self.text, minlength=self.n_texts)
        return np.cumsum(n) - n, n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[str | None], lower: bool = True) -> Words:
    parts = [(t.lower() if lower else t).encode() if t else b"" for t in texts]
    buffer = np.frombuffer(b" " + b" ".join(parts) + b"    ", dtype=np.uint8)
    space = _SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    limits = np.cumsum([len(p) + 1 for p in parts])
    return Words(buffer, starts, ends, np.searchsorted(limits, starts, side="right"), len(texts))


def tables(texts: list[str | None], lower: bool = True, most: int = TABLE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(lo, hi, words of texts[lo:hi]) over all texts."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield lo, i, words_of(texts[lo:i], lower)
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts), words_of(texts[lo:], lower)


def short_enough(text_col: str, most: int = SAMPLE_CHARS) -> Column:
    """Whether a row's text may be in a training sample: it is not null and not beyond `most` characters."""
    return F.col(text_col).isNotNull() & (F.length(text_col) <= most)


def sample_by(rows: DataFrame, label: str, per_label: int, key: Column, most: int, most_labels: int = MOST_LABELS) -> DataFrame:
    """About per_label rows of each label by the hash of key, and `most` in all; rows without a label are left out.

    Labels are counted first, so the sample's size is bounded; beyond most_labels labels the rarest have no rows in it. A
    row's place among its label's is told from its hash and the count; where labels together exceed `most`, the farthest
    places go, so that frequent labels are cut to one length and rare ones stay whole.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()}
    if not counts:
        return rows.limit(0)
    number = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, float(n))])
    hashed = (F.xxhash64(key) / F.lit(float(2**64)) + 0.5).alias("__hash")
    placed = rows.withColumn("__hash", hashed).withColumn("__place", F.col("__hash") * F.try_element_at(number, F.col(label)))
    return placed.where(F.col("__place") < 1.1 * per_label).orderBy("__place").limit(most).orderBy("__hash").drop("__place", "__hash")
