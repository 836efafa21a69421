import numpy as np
import pytest

from pagemill.llm import multi_index as M


def brute(ids, x, q, k=20):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]]
    return order[:k], s


def test_walk_is_in_the_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    got, reach = M.walk(a, b, np.ones(63, dtype=int), 63)
    sums = (a[:, None] + b[None, :]).ravel()
    assert sorted(got) == list(range(63)) and list(sums[got]) == sorted(sums)
    assert reach == sums.max() and M.walk(a, b, np.ones(63, dtype=int), 5) == (got[:5], sums[got[4]])
    few = np.arange(63) % 4 == 0
    assert M.walk(a, b, few.astype(int), 3)[0] == [c for c in got if few[c]][:3]


@pytest.mark.parametrize(("folder", "options"), [("sf0.01", {}), ("sf0.1", {}), ("sf0.1", {"block_rows": 300})])
def test_recall_and_scores_on_the_whole_table(spark, folder, options):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = v.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found, work = {}, []
    for r in M.nearest(v, v.where("vec_id % 20 = 0"), work=work, **options).collect():
        found.setdefault(r.query_id, []).append(r)
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(found) == {ids[q] for q in queries}
    hits = 0
    for q in queries:
        best, s = brute(ids, x, q)
        got = sorted(found[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert [(-round(r.score, 12), r.vec_id) for r in got] == sorted((-round(r.score, 12), r.vec_id) for r in got)
        at = {i: n for n, i in enumerate(ids)}
        assert all(abs(r.score - s[at[r.vec_id]]) < 1e-12 for r in got)
        hits += len({r.vec_id for r in got} & {ids[i] for i in best})
    assert hits / (20 * len(queries)) >= 0.9
    # Only what lies in walked cells is scored; walks go on until their cells hold the share, so hardly further.
    assert work[0]["pairs"] == len(ids) * len(queries) and M.PROBED <= work[0]["scored"] / work[0]["pairs"] < 0.5
    assert len(queries) <= work[0]["visits"] <= work[0]["all_visits"]


def test_a_query_sees_only_its_cells(spark):
    """With a small share the index decides: some of the nearest are missed, and what is found is still exact."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = M.nearest(v, v.where("vec_id % 20 = 0"), probed=0.05).collect()
    want = {(int(ids[q]), int(ids[i])) for q in range(len(ids)) if ids[q] % 20 == 0 for i in brute(ids, x, q)[0]}
    assert 0.2 < len({(r.query_id, r.vec_id) for r in got} & want) / len(want) < 0.8


def test_edges_and_a_hot_vector(spark):
    good = [(i, [1.0, float(i % 3)], "x") for i in range(50)]
    odd = [(100, None, "x"), (101, [0.0, 0.0], "x"), (102, [float("nan"), 1.0], "x"), (103, [None, 1.0], "x"), (104, [1.0], "x"), (None, [1.0, 1.0], "x"), (105, [float("inf"), 1.0], "x")]
    v = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, score string")
    got = M.nearest(v, v.where("vec_id % 20 = 0 OR vec_id > 99"), block_rows=5).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    for q in (0, 20, 40):
        want = sorted(((-(1 + (q % 3) * (i % 3)), i) for i in range(50) if i != q))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    twice = v.union(v.where("vec_id = 3")).union(spark.createDataFrame([(3, [9.0, 9.0], "y"), (0, [5.0, 5.0], "y")], v.schema))
    again = M.nearest(twice, twice.where("vec_id = 0"), k=4).orderBy("rank").collect()  # asks with [1, 0], the smaller; no own rows
    assert [(r.vec_id, r.score) for r in again] == [(3, 9.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    assert M.nearest(v.limit(0), v.limit(0)).count() == 0
    assert M.nearest(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0
