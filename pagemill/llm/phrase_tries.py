"""Collocations from count tries of limited depth.

Each shard of texts becomes a trie a language: every word starts a path of up to DEPTH words that ends with its piece,
and a node's count is the paths through it, the occurrences of its phrase. A trie is serialised in sorted order, cut at
the bounds of prefix ranges, and the cuts that share a range meet in one task, where their sorted runs are merged and
equal paths added up. Nodes that are frequent in all are stored. From there a walk down the trie, level by level, gives
each phrase the counts of its first words, and links from each phrase to the one without its first word give those of
the rest; both are joins of a level with the one above, so no task holds a language's trie.

Ranges are runs of whole paths, not first words, so a word that begins a third of all phrases is many ranges. Nodes on
the way to a range's bounds are counted in part there and added up by phrase at the end.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DEPTH, LEAST, TOP, MOST_INSIDE = 4, 30, 2000, 80
#: Bytes of text in a shard; words in a prefix range, about, and ranges at most (then they grow instead).
SHARD_BYTES, RANGE_WORDS, MOST_RANGES = 8 << 20, 1 << 19, 1_000_000
#: Paths drawn for each bound of a range, texts they are drawn from at most, and bytes looked at of each: they decide how even ranges are, and no result.
DRAWN_PER_RANGE, SAMPLE_TEXTS, SAMPLE_BYTES = 64, 2000, 65_536
#: Salts of a language while its first phrases are found.
SALTS = 16

BLANKS, ENDS = b"\t ", b".,;:!?\n\v\f\r"
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(BLANKS)], KIND[list(ENDS)] = 1, 2
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def slices(text: bytes, most: int) -> Iterator[bytes]:
    """text in slices of at most `most` bytes if its pieces allow it, cut where a piece ends."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(bytes([c]), at, at + most) for c in ENDS)
        if cut <= at:
            cut = min((p for c in ENDS if (p := text.find(bytes([c]), at + 1)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of data, A-Z in lower case, and the number of the piece that each lies in."""
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = KIND[raw]
    solid = kind == 0
    edge = np.diff(np.concatenate(([False], solid, [False])).view(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    offsets = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[raw[solid]])])
    return words, piece


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in the order of their bytes, and for each word its place there, from 1."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()] if len(words) else np.empty(0, dtype=np.int64)


def path_keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One integer a path, in the order of paths; and the two tables of pairs that it is made of: columns are four words."""
    first, one = np.unique(columns[0] << 32 | columns[1], return_inverse=True)
    second, two = np.unique(columns[2] << 32 | columns[3], return_inverse=True)
    return one << 32 | two, first, second


def columns_of(keys: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    one, two = first[keys >> 32], second[keys & 0xFFFFFFFF]
    return np.stack([one >> 32, one & 0xFFFFFFFF, two >> 32, two & 0xFFFFFFFF], axis=1)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, dtype=np.int64)


class Trie(NamedTuple):
    """Words in order; paths in order as keys of pairs of pairs; how often each path occurs."""

    vocabulary: pa.Array
    keys: np.ndarray
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @property
    def paths(self) -> np.ndarray:
        """Rows of four places in the vocabulary, from 1; 0 after the end."""
        return columns_of(self.keys, self.first, self.second)


def shard_trie(data: bytes) -> Trie:
    words, piece = words_of(data)
    vocabulary, ids = ranked(words)
    following = []
    for k in range(DEPTH):
        column = np.zeros(len(ids), dtype=np.int64)
        if k < len(ids):
            column[: len(ids) - k] = np.where(piece[k:] == piece[: len(ids) - k], ids[k:], 0)
        following.append(column)
    keys, first, second = path_keys(following)
    keys.sort()
    at = runs(keys)
    return Trie(vocabulary, keys[at], first, second, np.diff(np.append(at, len(keys))))


def places_of(bounds: list[tuple[bytes, ...]], trie: Trie) -> np.ndarray:
    """How many paths of the trie lie before each bound, a path of words."""
    words = np.array([None, *trie.vocabulary.to_pylist()], dtype=object)[1:]
    ranks = np.zeros((len(bounds), DEPTH), dtype=np.int64)
    for i, bound in enumerate(bounds):
        own = np.searchsorted(words, np.array([*bound, None], dtype=object)[:-1]) if len(words) else np.zeros(len(bound), dtype=np.int64)
        for k, (w, at) in enumerate(zip(bound, own.tolist(), strict=True)):
            ranks[i, k] = at + 1
            if at == len(words) or words[at] != w:  # paths from the next word on are not before it
                break
    one, two = ranks[:, 0] << 32 | ranks[:, 1], ranks[:, 2] << 32 | ranks[:, 3]
    pair = np.searchsorted(trie.first, one)
    known = np.append(trie.first, -1)[pair] == one
    return np.searchsorted(trie.keys, pair << 32 | np.where(known, np.searchsorted(trie.second, two), 0))


HEAD = struct.Struct("<BQ")


def small(a: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after their width and number."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    return HEAD.pack(kind.itemsize, len(a)) + a.astype(f"<u{kind.itemsize}").tobytes()


def serialise(vocabulary: pa.Array, paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted paths as a trie: their words in order; for each level its nodes' words and how many nodes each has below; the leaves' counts."""
    used = np.unique(np.append(paths.ravel(), 0))
    local = np.searchsorted(used, paths)
    words = b"\n".join(vocabulary.take(pa.array(used[1:] - 1)).to_pylist())  # no word holds a line feed
    new = np.zeros(len(paths), dtype=bool)
    new[:1] = True
    parts, starts = [], []
    for k in range(DEPTH):
        new[1:] |= paths[1:, k] != paths[:-1, k]
        starts.append(np.flatnonzero(new))
        parts.append(small(local[starts[k], k]))
    for k in range(DEPTH - 1):
        parts.append(small(np.diff(np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])))))
    return struct.pack("<Q", len(words)) + words + b"".join(parts) + small(counts)


def deserialise(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n = struct.unpack_from("<Q", blob)[0]
    words = blob[8 : 8 + n].split(b"\n") if n else []
    at, arrays = 8 + n, []
    for _ in range(2 * DEPTH):
        size, count = HEAD.unpack_from(blob, at)
        arrays.append(np.frombuffer(blob, f"<u{size}", count, at + HEAD.size).astype(np.int64))
        at += HEAD.size + size * count
    labels, below, counts = arrays[:DEPTH], arrays[DEPTH:-1], arrays[-1]
    paths = np.empty((len(counts), DEPTH), dtype=np.int64)
    for k in range(DEPTH):
        column = labels[k]
        for fan in below[k:]:
            column = np.repeat(column, fan)
        paths[:, k] = column
    return words, paths, counts


def merged(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tries of one range as one: words, paths in order, counts. Runs are sorted already, which the stable sort merges."""
    tries = [deserialise(b) for b in blobs]
    words = pa.array([w for t in tries for w in t[0]], type=pa.large_binary())
    vocabulary, rank = ranked(words)
    parts, at = [], 0
    for own, paths, _ in tries:
        parts.append(np.concatenate(([0], rank[at : at + len(own)]))[paths])
        at += len(own)
    paths, counts = np.concatenate(parts), np.concatenate([t[2] for t in tries])
    keys, first, second = path_keys(list(paths.T))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = runs(keys)
    return vocabulary, columns_of(keys[at], first, second), np.add.reduceat(counts, at) if len(at) else counts


def nodes(vocabulary: pa.Array, paths: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[int, str, int]]:
    """(depth, phrase, count) of the nodes of at least that count, of all nodes on the first and the last path, and of the root."""
    yield 0, "", int(counts.sum())
    words = vocabulary
    new = np.zeros(len(paths), dtype=bool)
    new[:1] = True
    for k in range(DEPTH):
        new[1:] |= paths[1:, k] != paths[:-1, k]
        at = np.flatnonzero(new)
        f = np.add.reduceat(counts, at)
        wanted = f >= least
        wanted[[0, -1]] = True  # may go on in the ranges beside this one
        wanted &= paths[at, k] > 0
        for row, n in zip(paths[at[wanted], : k + 1].tolist(), f[wanted].tolist(), strict=True):
            yield k + 1, b" ".join(words[w - 1].as_py() for w in row).decode(errors="replace"), n


def languages(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def range_bounds(rows: DataFrame, range_words: int) -> list[tuple[str, list[bytes]]]:
    """Bounds of prefix ranges of about range_words words, from the paths of a bounded sample of texts."""
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    number = min(MOST_RANGES, int((size["bytes"] or 0) / 6 / range_words))
    if number < 1:
        return []
    wanted = DRAWN_PER_RANGE * number

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie = shard_trie(text)
                some = trie.paths[rng.random(len(trie.keys)) < share]
                found += [(lang, [trie.vocabulary[w - 1].as_py() for w in row if w]) for row in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.list_(pa.binary()))], ["lang", "path"])

    few = rows.where(F.xxhash64("text") / F.lit(float(2**64)) + 0.5 <= min(1.0, 1.2 * SAMPLE_TEXTS / size["rows"])).limit(SAMPLE_TEXTS)
    few = few.select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    share = min(1.0, 8 * wanted / max(1, SAMPLE_TEXTS * size["bytes"] / size["rows"] / 6))  # more than are used
    paths = few.mapInArrow(drawn, "lang string, path array<binary>").distinct().limit(8 * wanted).collect()
    found = sorted((r["lang"], [bytes(w) for w in r["path"]]) for r in paths)
    return [found[i * len(found) // (number + 1)] for i in range(1, number + 1)] if found else []


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, words (1 to DEPTH, 0 for all words of the language), phrase, f: every phrase that occurs at least `least` times."""
    rows = languages(docs, text_col, lang_col)
    bounds = sorted(set((lang, tuple(path)) for lang, path in range_bounds(rows, range_words)))
    sent = docs.sparkSession.sparkContext.broadcast(bounds)  # MOST_RANGES at most

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in slices(text, shard_bytes) if len(text) > shard_bytes else (text,):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size >= shard_bytes:
                        yield from ((name, b"\n".join(parts)) for name, parts in held.items())
                        held, size = {}, 0
        yield from ((name, b"\n".join(parts)) for name, parts in held.items())

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value
        for lang, data in shards(batches):
            trie = shard_trie(data)
            if not len(trie.keys):
                continue
            paths = trie.paths
            lo, hi = bisect_left(bounds, (lang,)), bisect_right(bounds, (lang, (b"\xff",)))  # no word of a text begins with that byte
            cuts = [0, *places_of([path for _, path in bounds[lo:hi]], trie).tolist(), len(paths)]
            out = [(lo + i, serialise(trie.vocabulary, paths[x:y], trie.counts[x:y])) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out]), pa.array([lang] * len(out)), pa.array([b for _, b in out], type=pa.binary())], ["range", "lang", "trie"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for r, lang, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (r, lang) != at:
                    if blobs:
                        yield table(at[1], blobs)
                    at, blobs = (r, lang), []
                blobs.append(blob)
        if blobs:
            yield table(at[1], blobs)

    def table(lang: str, blobs: list[bytes]) -> pa.RecordBatch:
        found = list(nodes(*merged(blobs), least))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([n[0] for n in found], type=pa.int32()), pa.array([n[1] for n in found]), pa.array([n[2] for n in found], type=pa.int64())], ["lang", "words", "phrase", "f"])

    sliced = rows.mapInArrow(tries, "range long, lang string, trie binary")
    met = sliced.repartition(2 * len(bounds) + 2, "range").sortWithinPartitions("range", "lang")
    found = met.mapInArrow(merge, "lang string, words int, phrase string, f long")
    whole = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stored(whole.where((F.col("words") == 0) | (F.col("f") >= least)), "phrases")


def with_parts(phrases: DataFrame) -> DataFrame:
    """Nodes of two words and more with lefts (counts of their first 1, 2, .. words) and rights (of the rest after those), level by level."""
    level = phrases.where("words = 1").select("lang", "phrase", "f", F.array().cast("array<long>").alias("lefts"), F.array().cast("array<long>").alias("rights"))
    levels = []
    for k in range(2, DEPTH + 1):
        own = phrases.where(F.col("words") == k).select("lang", "words", "phrase", "f", F.substring_index("phrase", " ", k - 1).alias("parent"), F.substring_index("phrase", " ", 1 - k).alias("link"))
        above = level.select(F.col("lang").alias("l1"), F.col("phrase").alias("p1"), F.concat("lefts", F.array("f")).alias("lefts"))
        linked = level.select(F.col("lang").alias("l2"), F.col("phrase").alias("p2"), F.concat(F.array("f"), "rights").alias("rights"))
        walked = own.join(above, (F.col("lang") == F.col("l1")) & (F.col("parent") == F.col("p1"))).drop("l1", "p1")
        level = walked.join(linked, (F.col("lang") == F.col("l2")) & (F.col("link") == F.col("p2"))).drop("l2", "p2")
        level = stored(level, f"level-{k}") if k < DEPTH else level
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def lowest_cut(a: Column) -> Column:
    """score, k, l, r of the cut with the lowest score, ties to the fewest first words; integers throughout, products as decimals."""
    score = lambda l, r: F.call_function("div", a.cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)"), l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))  # noqa: E731, E741
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda c, i: F.struct(score(c["lefts"], c["rights"]).alias("score"), i.alias("k"), c["lefts"].alias("l"), c["rights"].alias("r")))
    return F.array_min(cuts)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    inside: int = MOST_INSIDE,
    shard_bytes: int = SHARD_BYTES,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of anything but blanks and the signs that end pieces, A-Z in lower case; phrases are 2 to DEPTH words
    of one piece. A phrase counts if it occurs `least` times and no longer counted phrase holds it that occurs `inside`
    percent as often; its score is that of its weakest cut. A null language is `und`, a null text empty; a phrase of one
    text that repeats is counted each time. Rows that repeat count each. Empty tables and texts give no row; other
    columns are ignored.
    """
    phrases = counted(docs, text_col, lang_col, least, shard_bytes, range_words)
    found = stored(with_parts(phrases), "collocations")
    # What holds a phrase and is most frequent among what does is one word longer: parents and links reach all of it.
    around = found.where("words > 2").select("lang", F.explode(F.array("parent", "link")).alias("phrase"), F.col("f").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")).select(F.col("lang").alias("l1"), F.col("phrase").alias("p1"), "longer")
    kept = found.join(around, (F.col("lang") == F.col("l1")) & (F.col("phrase") == F.col("p1")), "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = kept.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * inside))
    scored = kept.select("lang", "phrase", F.col("f").alias("a"), lowest_cut(F.col("f")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.hash("phrase"), F.lit(SALTS)).alias("salt"))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    few = scored.withColumn("rank", first("salt")).where(F.col("rank") <= top)
    best = few.withColumn("rank", first()).where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select(F.col("lang").alias("l1"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("l1")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Every phrase spelt out and counted; what holds a candidate is looked for among all longer ones.
ORACLE = rf"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang, TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, UNNEST(REGEXP_SPLIT_TO_ARRAY(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, REGEXP_EXTRACT_ALL(piece, '[^\x20\x09]+') AS ws FROM p),
f AS MATERIALIZED (
  SELECT lang, m, phrase, COUNT(*) AS f
  FROM (SELECT lang, m, UNNEST(LIST_TRANSFORM(RANGE(1, CAST(LEN(ws) - m + 2 AS BIGINT)), lambda i: ARRAY_TO_STRING(ws[i:i + m - 1], ' '))) AS phrase
        FROM w, RANGE(1, {DEPTH + 1}) r(m) WHERE LEN(ws) >= m) GROUP BY ALL),
n AS (SELECT lang, SUM(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, STRING_SPLIT(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, phrase, k, c.f AS a, ARRAY_TO_STRING(ws[:k], ' ') AS lp, ARRAY_TO_STRING(ws[k + 1:], ' ') AS rp FROM c, RANGE(1, {DEPTH}) r(k) WHERE k < m),
s AS (SELECT cuts.lang, cuts.phrase, k, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f)::HUGEINT AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, MAX(f) AS longer
         FROM (SELECT lang, f, UNNEST(FLATTEN(LIST_TRANSFORM(RANGE(2, m), lambda z: LIST_TRANSFORM(RANGE(1, m - z + 2), lambda i: ARRAY_TO_STRING(ws[i:i + z - 1], ' '))))) AS phrase FROM c WHERE m > 2)
         GROUP BY ALL)
SELECT b.lang, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, ENCODE(b.phrase)) AS rank, b.phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN n USING (lang) LEFT JOIN held ON held.lang = b.lang AND held.phrase = b.phrase
WHERE longer IS NULL OR 100::HUGEINT * longer < {MOST_INSIDE}::HUGEINT * a
QUALIFY rank <= {TOP}
"""
