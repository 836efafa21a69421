import hashlib
import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import delta_lloyd as D
from pagemill.llm.queries import op11_delta_lloyd

from .conftest import as_set


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over Python integers, every sum taken anew. rows: (id, label, vector)."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    part = lambda v, j: v[j * w : (j + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[part(r[2], j) for r in first] for j in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            mine = [near(part(r[2], j), books[j])[1] for r in kept]
            for e in range(len(books[j])):
                own = [part(r[2], j) for r, m in zip(kept, mine, strict=True) if m == e]
                if own:
                    books[j][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, label, [near(part(v, j), books[j]) for j in range(parts)]) for i, label, v in kept]
    totals = {}
    for _, label, found in out:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in found)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), totals[label], digest) for i, label, f in out)


def rows_of(df, key="vec_id"):
    return sorted((str(r[key]), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_oracle_and_loops_on_the_whole_table(spark, sql):
    folder = "/root/testdata/sf0.01"
    got = op11_delta_lloyd(spark, folder)
    assert as_set(got) == sql(D.ORACLE, folder=folder)
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()][:90]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    changed = []
    assert rows_of(D.encode(df, entries=16, changed=changed)) == brute(rows, entries=16)
    assert changed[0] == 4 * len(rows) and all(0 <= b < a for a, b in zip(changed, changed[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.sampled_from([3, 1000, 2**29]), st.integers(0, 10**6))
def test_sums_kept_by_differences_are_those_taken_anew(rows, entries, size, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size, (rows, 6))
    n, sums, old = np.zeros((2, entries), dtype=np.int64), np.zeros((2, entries, 3), dtype=np.int64), None
    for _ in range(3):
        new, errors = D.assign(x, rng.integers(-size, size, (2, entries, 3)))
        D.differences(x, new, old, n, sums)
        for j in range(2):
            for e in range(entries):
                own = x[new[:, j] == e, 3 * j : 3 * j + 3]
                assert n[j, e] == len(own) and sums[j, e].tolist() == own.sum(axis=0).tolist()
        old = new
        assert (errors >= 0).all()


def test_ties_go_to_the_lower_entry():
    books = np.array([[[0, 0], [0, 0], [4, 0]]])
    codes, errors = D.assign(np.array([[2, 0], [0, 0], [3, 0], [-5, -1]]), books)
    assert codes.ravel().tolist() == [0, 0, 2, 0] and errors.ravel().tolist() == [4, 0, 1, 26]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 50 if i % 3 else None, None if i % 5 == 0 else i % 2, [math.sin(i * 7 + j) for j in range(8)]) for i in range(60)]
    rows += rows[:20] + [(7, 1, None), (8, None, [nan] * 8), (9, 1, [inf] * 8), (10, 1, [None] + [1.0] * 7), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "vec_id long, label int, embedding array<double>, v int, code binary").repartition(3)
    assert rows_of(D.encode(df, entries=8)) == brute(rows, entries=8)
    assert rows_of(D.encode(df)) == brute(rows)
    odd = df.select("vec_id", "label", "embedding").union(spark.createDataFrame([(1, 1, [1.0] * 4), (2, 2, [])], "vec_id long, label int, embedding array<double>"))
    assert rows_of(D.encode(odd, entries=8)) == brute(rows, entries=8)  # other lengths take no part
    seven = spark.createDataFrame([(i, "x", [float(i + j) for j in range(7)]) for i in range(9)], "key int, vec_id string, vec array<double>")
    assert rows_of(D.encode(seven, "key", "vec", "vec_id", entries=2), "key") == brute([(i, "x", [float(i + j) for j in range(7)] + [0.0]) for i in range(9)], entries=2)
    for none in (df.limit(0), df.where("embedding IS NULL")):
        assert D.encode(none).collect() == [] and D.encode(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = spark.createDataFrame([(1, 1, [1e30, 1.0, 1.0, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        D.encode(huge)


def test_what_rounds_store_is_removed(spark):
    from pagemill import sources

    df = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5)] * 2) for i in range(30)], "vec_id long, label int, embedding array<double>")
    with sources.recording() as made:
        out = D.encode(df, entries=4)
        assert out.count() == 30
    left = [p for p in made if Path("/" + p.removeprefix("file:").lstrip("/")).exists()]
    assert len(made) > 5 and [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left] == ["vector-codes"]
