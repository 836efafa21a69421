"""Product codes of vectors by Lloyd's rounds whose sums are maintained by differences.

Vectors become integers and are cut into parts, each with a codebook of its own. A part's codebook is kept as integer
sums and counts. Each round assigns every part to its nearest entry, stores the assignments beside the ones before, and
only parts that changed their entry send a minus to the old entry and a plus to the new one; tasks add these up before
they are shuffled, so a round that moves few parts shuffles little. Arithmetic is in integers throughout, so the order
of additions does not matter and a task that is run again gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import discard, recording
from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to a codebook are held at once.
ROWS_AT_ONCE = 2048


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label and v, the components times scale rounded down, of vectors that are whole and finite.

    Components go to integers as long as they are below 2 ** 31 in size; beyond, v holds nulls and encode() refuses it.
    """
    component = lambda x: x.cast("double")
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(component(x)) & (F.abs(component(x)) < float("inf")))
    scaled = lambda x: F.floor(component(x) * scale)
    v = F.transform(vec_col, lambda x: F.when(F.abs(component(x)) < 2.0**31 / scale, scaled(x).cast("int")))
    rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & whole)
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lower index) and the squared distance to it: rows by parts, exact.

    x: integers, rows by components. books: integers, parts by entries by components of a part. Products are taken in
    double precision where they are integers it holds exactly, otherwise in 64 bits, where encode() has seen that they fit.
    """
    parts, _, width = books.shape
    codes, errors = np.empty((len(x), parts), dtype=np.uint8), np.empty((len(x), parts), dtype=np.int64)
    size = max(abs(int(a.min(initial=0))) if s else abs(int(a.max(initial=0))) for a in (x, books) for s in (0, 1))
    kind = np.float64 if 4 * width * size * size < 2**53 else np.int64
    for j in range(parts):
        c = books[j].astype(kind)
        norms = (c * c).sum(axis=1)
        for lo in range(0, len(x), ROWS_AT_ONCE):
            p = x[lo : lo + ROWS_AT_ONCE, j * width : (j + 1) * width].astype(kind)
            d = norms - 2 * (p @ c.T)
            own = d.argmin(axis=1)  # the first of equal ones
            codes[lo : lo + ROWS_AT_ONCE, j] = own
            errors[lo : lo + ROWS_AT_ONCE, j] = d[np.arange(len(p)), own] + (p * p).sum(axis=1)
    return codes, errors


def differences(x: np.ndarray, new: np.ndarray, old: np.ndarray | None, n: np.ndarray, sums: np.ndarray) -> None:
    """Add to n (parts by entries) and sums (by components) the plus of each changed part's new entry and the minus of its old one."""
    width = sums.shape[2]
    for j in range(new.shape[1]):
        moved = np.flatnonzero(new[:, j] != old[:, j]) if old is not None else np.arange(len(new))
        p = x[moved, j * width : (j + 1) * width].astype(np.int64)
        for codes, sign in ((new, 1), (old, -1)):
            if codes is not None:
                np.add.at(n[j], codes[moved, j], sign)
                np.add.at(sums[j], codes[moved, j], sign * p)


def codes_column(codes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())


def rows_of(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of lists or of bytes, all of one width, as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    changed: list[int] | None = None,
) -> DataFrame:
    """A row per kept vector: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null, empty, of another length than most (ties: the shorter), or hold null or non-finite components
    are dropped; a length that parts do not divide is filled up with zeros. Codebooks start as the parts of the
    `entries` smallest ids (null last; equal ids by vector); fewer vectors give fewer entries, and entries that no part
    is nearest to stay. Rows that repeat an id are rows of their own; null labels are one label. Components so large
    that distances pass 64 bits are an error. Empty tables give an empty result; other columns are ignored.
    changed: takes the number of parts that moved in each round.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    kinds = {"id": vectors.schema[id_col].dataType, "label": vectors.schema[label_col].dataType}
    with recording() as made:
        base = stored(integer_vectors(vectors, id_col, vec_col, label_col, scale), "integer-vectors")
        large = F.when(F.exists("v", lambda c: c.isNull()), F.lit(2**31)).otherwise(F.array_max(F.transform("v", lambda c: F.abs(c.cast("long")))))
        sizes = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(large).alias("large")).orderBy(F.desc("n"), "d").first()
        if sizes is None:
            empty = T.StructType([T.StructField(id_col, kinds["id"]), *T._parse_datatype_string("code string, error long, label_error long, codebooks_sha256 string").fields])
            return spark.createDataFrame([], empty)
        d, width = sizes["d"], -(-sizes["d"] // parts)
        if sizes["large"] * max(4 * parts * width * sizes["large"], sizes["n"]) >= 2**62:
            raise ValueError(f"components up to {sizes['large']} times {scale}: sums or squared distances of {d} of them pass 64 bits")
        base = base.where(F.size("v") == d)
        base = base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), parts * width - d))) if parts * width > d else base
        first = np.array([r["v"] for r in base.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()], dtype=np.int64)
        books = np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2))
        n, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        keep = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"])])
        state_schema = T.StructType([*keep.fields, *T._parse_datatype_string("v array<int>, code binary, old binary").fields])
        state = base.withColumn("code", F.lit(None).cast("binary"))

        def assigned(books: np.ndarray):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    codes, _ = assign(rows_of(batch, "v", parts * width), books)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], codes_column(codes), batch.column(3)], ["id", "label", "v", "code", "old"])

            return run

        def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task's pluses and minuses, added up: at most a row an entry."""
            n, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
            moves = 0
            for batch in batches:
                new = rows_of(batch, "code", parts)
                old = None if batch.column(2).null_count else rows_of(batch, "old", parts)
                moves += new.size if old is None else int((new != old).sum())
                differences(rows_of(batch, "v", parts * width), new, old, n, sums)
            at = np.argwhere((n != 0) | (sums != 0).any(axis=2))
            flat = sums[at[:, 0], at[:, 1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
            whole = [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n[at[:, 0], at[:, 1]]), lists]
            yield pa.RecordBatch.from_arrays(whole, ["part", "entry", "n", "sums"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([moves]), pa.array([[0]], type=pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        for _ in range(rounds):
            with recording() as before:
                following = stored(state.select("id", "label", "v", "code").mapInArrow(assigned(books), state_schema), "assignments")
            moved = following.where("old IS NULL OR code <> old").select("v", "code", "old")
            deltas = moved.mapInArrow(contributions, "part long, entry long, n long, sums array<long>")
            deltas = deltas.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            moves = 0
            for r in deltas.collect():  # at most a row a component of the codebooks
                if r["part"] < 0:
                    moves = r["n"]
                    continue
                sums[r["part"], r["entry"], r["place"]] += r["s"]
                n[r["part"], r["entry"]] += r["n"] if r["place"] == 0 else 0
            if changed is not None:
                changed.append(moves)
            books = np.where(n[:, :, None] > 0, np.floor_divide(sums, np.maximum(n, 1)[:, :, None]), books)
            discard(spark, [p for p in made if p not in before])  # the round before
            made[:] = before
            state = following

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, errors = assign(rows_of(batch, "v", parts * width), books)
                text = codes.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([text[i : i + step] for i in range(0, len(text), step)], type=pa.string()), pa.array(errors.sum(axis=1))], ["id", "label", "code", "error"])

        final = T.StructType([*keep.fields, *T._parse_datatype_string("code string, error long").fields])
        with recording() as results:
            rows = stored(state.select("id", "label", "v").mapInArrow(coded, final), "vector-codes")
        discard(spark, [p for p in made if p not in results])
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds written out one after another, every sum taken anew."""
    w = f"(SELECT MAX(LEN(v)) // {parts} FROM k)"
    distance = "LIST_SUM(LIST_TRANSFORM(LIST_ZIP(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = [
        f"""k AS MATERIALIZED (
  SELECT vec_id, label, LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR(x::DOUBLE * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, j, v[j * {w} + 1 : (j + 1) * {w}] AS x FROM k, RANGE({parts}) t(j))",
        f"b0 AS MATERIALIZED (SELECT j, ROW_NUMBER() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, j, ANY_VALUE(x) AS x, MIN({distance} * 256 + e) AS m FROM p JOIN b{r} USING (j) GROUP BY vec_id, j)")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT j, e, LIST(CAST(FLOOR(s / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY i) AS c
  FROM (SELECT j, m % 256 AS e, i, CAST(SUM(x[i]) AS BIGINT) AS s, COUNT(*) AS n FROM a{r}, RANGE(1, {w} + 1) t(i) GROUP BY ALL) GROUP BY j, e)""")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.j, b.e, COALESCE(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s USING (j, e))")
    steps.append(f"""c AS (
  SELECT vec_id, STRING_AGG(PRINTF('%02x', CAST(m % 256 AS INT)), '' ORDER BY j) AS code, CAST(SUM(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)""")
    steps.append(f"h AS (SELECT SHA256(STRING_AGG(ARRAY_TO_STRING(c, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"


ORACLE = _oracle()
