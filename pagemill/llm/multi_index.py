"""Nearest neighbours by an inverted multi-index.

Each vector is cut in two halves, and each half is quantised by a codebook of its own, so two codes name one of K * K
cells. A query ranks the centroids of either half by distance and walks the pairs in the order of summed distance with
a heap, until the cells it has named hold enough vectors; the entries of those cells are reranked by their exact
inner products. Distance is what the search minimises, the negative inner product, so a pair's summed distance is that
to the two centroids set side by side. The index is a table: every vector under its cell, cells cut into blocks of
bounded size. Queries are sent to the blocks that hold their cells, and there only the entries of those cells are scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors the codebooks are fitted on at most; Lloyd steps; rows in a block.
SAMPLE, STEPS, BLOCK_ROWS = 10_000, 12, 8192
#: The share of all vectors that the cells of a query hold, at every number of vectors.
PROBED = 0.45
#: Centroids of each half at most; a walk visits up to their square in cells.
BOOK = 128


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the vectors that are not null, zero, or holding null or non-finite components."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def codebook(points: np.ndarray, k: int, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """k centroids by Lloyd's steps from distinct random points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[: min(k, len(points))]].copy()
    for _ in range(steps):
        own = (points @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        n = np.bincount(own, minlength=len(centres))
        for d in range(points.shape[1]):
            sums = np.bincount(own, weights=points[:, d], minlength=len(centres))
            centres[n > 0, d] = sums[n > 0] / n[n > 0]
    return centres


def codes(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of each row."""
    half = books[0].shape[1]
    parts = [(h @ b.T - 0.5 * (b * b).sum(axis=1)).argmax(axis=1) for h, b in zip((x[:, :half], x[:, half:]), books, strict=True)]
    return parts[0] * len(books[1]) + parts[1]


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> tuple[list[int], float]:
    """Cells with entries in the order of first[i] + second[j] until their counts reach `enough`, and the last such sum; ties with that are taken.

    first, second: distances to the centroids. The heap holds one pair of each first centroid that has been reached; the
    next first centroid enters when the one before it is first visited.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    width, n = len(b), counts.tolist() if isinstance(counts, np.ndarray) else counts
    heap, found, total, at = [(x[0] + y[0], 0, 0)], [], 0, -np.inf
    while heap and (total < enough or heap[0][0] <= at):
        at, i, j = heap[0]
        cell = a[i] * width + b[j]
        held = n[cell]
        if held:
            found.append(cell)
            total += held
        if j + 1 < width:
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return found, at


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an array column, all of `size` components, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    probed: float = PROBED,
    book: int = BOOK,
    block_rows: int = BLOCK_ROWS,
    work: list | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query among the other rows.

    Vectors that are null, zero, of another size than most, or with null or non-finite components take no part, nor do
    rows without an id; ties go to the smaller vec_id. Rows that repeat an id are one candidate each for other ids, and
    none for their own; a query id that repeats asks with its smallest vector. A walk goes on until its cells hold k vectors
    besides the query even where the share is less. The codebooks are fitted on at most SAMPLE vectors; every vector is
    indexed. Empty tables give an empty result; other columns are ignored. work: takes, as a row, the pairs scored, all
    pairs, the visits of queries to blocks, and what they would be if each query met each block.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = stored(usable(vectors, id_col, vec_col), "vectors")
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    size, total = sizes["d"], sizes["count"]
    base = base.where(F.size("v") == size)
    drawn = base.where(F.xxhash64("id", "v") / F.lit(float(2**64)) + 0.5 < min(1.0, 1.1 * SAMPLE / total)).orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow().combine_chunks()
    sample, sample_ids = matrix(pa.concat_arrays(drawn["v"].chunks), size), drawn["id"].to_numpy()
    half = size // 2
    number = int(np.clip(total // 4, 2, book))
    books = (codebook(sample[:, :half], number), codebook(sample[:, half:], number))
    cells, width = len(books[0]) * len(books[1]), len(books[1])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes(matrix(batch.column(1), size), books))], ["id", "v", "cell"])

    index = stored(base.mapInArrow(coded, "id long, v array<double>, cell long"), "multi-index")
    held = index.groupBy("cell").count().collect()  # at most book ** 2 rows
    counts = np.zeros(cells, dtype=np.int64)
    for r in held:
        counts[r["cell"]] = r["count"]
    block_rows = min(block_rows, max(512, -(-total // 16)))
    # Neighbouring cells share a block up to block_rows; a cell beyond that has blocks of its own.
    first_block, n_blocks, block, room = np.zeros(cells, dtype=np.int64), np.ones(cells, dtype=np.int64), 0, block_rows
    for c in np.flatnonzero(counts).tolist():
        if counts[c] > room and room < block_rows:
            block, room = block + 1, block_rows
        first_block[c], n_blocks[c] = block, -(-counts[c] // block_rows)
        if n_blocks[c] > 1:
            block, room = block + n_blocks[c], block_rows
        else:
            room -= counts[c]
    enough = max(k + 1, int(np.ceil(probed * total)))
    # The sample's vectors are entries too: the k-th best of those in a query's cells bounds what can be among its k nearest found.
    known = spark.sparkContext.broadcast((sample, sample_ids, codes(sample, books)))  # SAMPLE vectors at most
    columns = ["block", "query", "id", "v", "cell", "reach", "bound"]
    kinds = "block long, query boolean, id long, v array<double>, cell long, reach double, bound double"

    def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(x[:, :half] @ books[0].T), -(x[:, half:] @ books[1].T)

    def row_batch(block, query, ids, x, cell, reach, bound) -> pa.RecordBatch:
        n = len(ids)
        full = lambda value, kind: pa.array(np.full(n, value, dtype=kind)) if np.ndim(value) == 0 else pa.array(value)
        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(x).ravel()))
        return pa.RecordBatch.from_arrays([full(block, np.int64), full(query, bool), pa.array(ids), v, full(cell, np.int64), full(reach, np.float64), full(bound, np.float64)], columns)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, vector_ids, cell = known.value
        n = counts.tolist()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x, ids = matrix(part.column(1), size), part.column(0).to_numpy()
                near = distances(x)
                scores = x @ vectors.T
                blocks, bounds, reaches = [], [], []
                for row in range(len(x)):
                    found, reach = walk(near[0][row], near[1][row], n, enough)
                    seen = np.zeros(cells, dtype=bool)
                    seen[found] = True
                    s = scores[row, seen[cell] & (vector_ids != ids[row])]
                    bounds.append(float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -np.inf)
                    reaches.append(reach)
                    own = np.unique(first_block[found])
                    large = [c for c in found if n_blocks[c] > 1]
                    blocks.append(np.concatenate([own, *[np.arange(first_block[c] + 1, first_block[c] + n_blocks[c]) for c in large]]))
                of = np.repeat(np.arange(len(x)), [len(b) for b in blocks])
                yield row_batch(np.concatenate(blocks), True, ids[of], x[of], -1, np.array(reaches)[of], np.array(bounds)[of])

    asked = stored(usable(queries, id_col, vec_col).where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n_queries = asked.count()
    spread = asked.select("id", "v").repartition(max(1, -(-n_queries // 256)), "id")  # walks are the work: spread them, however few bytes the queries have
    wanted = spread.mapInArrow(probes, kinds)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, c = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield row_batch(first_block[c] + salt % n_blocks[c], False, ids, matrix(batch.column(1), size), c, 0.0, 0.0)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block in turn, first the entries, which are held, then the queries, which pass by."""
        at, gathered, held = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if place[lo, 0] != at:
                    at, gathered, held = place[lo, 0], [], None
                if not place[lo, 1]:
                    gathered.append(tuple(np.array(c) for c in (part.column(2).to_numpy(), matrix(part.column(3), size), part.column(4).to_numpy())))
                    continue
                if held is None and gathered:
                    ids, x, cell = (np.concatenate(c) for c in zip(*gathered, strict=True))
                    order = np.argsort(cell, kind="stable")
                    held, gathered = (ids[order], x[order], *np.unique(cell, return_counts=True)), []
                if held is not None:
                    yield from best(part, *held)

    def best(part: pa.RecordBatch, ids: np.ndarray, x: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """own: the cells of the block; sizes: their entries, which follow each other."""
        for lo in range(0, part.num_rows, 256):
            few = part.slice(lo, 256)
            q, v, reach, bound = few.column(2).to_numpy(), matrix(few.column(3), size), few.column(5).to_numpy(), few.column(6).to_numpy()
            near = distances(v)
            # The cells of a walk are those within its last sum; sums are added anew here, so up to rounding.
            walked = near[0][:, own // width] + near[1][:, own % width] <= reach[:, None] + 1e-9
            out, scored = [], 0
            for row in range(len(q)):
                use = np.flatnonzero(np.repeat(walked[row], sizes))
                scored += len(use)
                s = x[use] @ v[row]
                ok = (s >= bound[row] - 1e-9) & (ids[use] != q[row])
                use, s = use[ok], s[ok]
                if len(use) > k:  # all that may be among the k nearest
                    use = use[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
                # The same order of additions wherever a pair meets, so equal vectors have equal scores.
                exact = (x[use] * v[row]).cumsum(axis=1)[:, -1]
                top = np.lexsort((ids[use], -exact))[:k]
                out.append((np.full(len(top), q[row]), ids[use][top], exact[top]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])
            yield pa.RecordBatch.from_arrays([pa.array([len(q)]), pa.array([None], pa.int64()), pa.array([float(scored)])], ["query_id", "vec_id", "score"])

    entries = index.mapInArrow(located, kinds)
    met = entries.unionByName(wanted).repartition("block").sortWithinPartitions("block", "query")
    found = met.mapInArrow(rerank, "query_id long, vec_id long, score double")
    if work is not None:
        found = stored(found, "found")
        done = found.where("vec_id IS NULL").agg(F.sum("score").cast("long").alias("scored"), F.sum("query_id").alias("visits")).first()
        work.append({**done.asDict(), "pairs": n_queries * total, "all_visits": n_queries * int(first_block.max() + n_blocks[first_block.argmax()])})
    found = found.where("vec_id IS NOT NULL")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
