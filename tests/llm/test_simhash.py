import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=4):
    low = list(range(len(ids)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                low[root(i)] = root(j)
    smallest = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            smallest[root(i)] = min(ids[i], smallest.get(root(i), ids[i]))
    return [smallest.get(root(i)) for i in range(len(ids))]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps), strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()} == want


@pytest.mark.parametrize(("cluster", "long_run"), [(0, 10**6), (250, 10**6), (250, 100), (250, 60), (0, 49)])
def test_links_connect_as_brute_force(spark, cluster, long_run):
    """Random, chained and dense fingerprints; the dense ones fill runs beyond SHORT_RUN, and beyond long_run on every level."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for start in list(fps)[:30]:
        x = start
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    for _ in range(cluster):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    links = simhash.links(nodes, long_run=long_run).cache()
    found = {tuple(r) for r in links.collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)
    from pagemill.llm.components import components

    root = {r.node: r.root for r in components(links).collect()}
    want = brute_components([sign(x) for x in fps], fps)
    assert [root.get(sign(x), sign(x)) for x in fps] == want


def test_long_buckets_pass_in_small_batches(spark):
    """A bucket of many batches is told to be long as a whole, its neighbours in the table are searched as ever."""
    rng = random.Random(5)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(sign(rng.getrandbits(64)), 1, k) for k in (1, 2, 3) for _ in range(5000 if k == 2 else 100)]
    rows += [(sign(rng.getrandbits(61) << 3 | 5), 0, 9) for _ in range(30)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("64", "1000", "100000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = simhash.compared(spark.createDataFrame(rows, "fp long, band int, key long").coalesce(1), 4, simhash.pivots(), None, 3000).where("b IS NULL").collect()
        assert {r.a for r in got} == {r[0] for r in rows if r[2] == 2} and len(got) == 5000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Ä one"), (4, "Ä one"), (5, "ä one"), (None, "x y z w v " * 50), (7, "lone")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert got == {(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps), strict=True)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.where(F.col("doc_id").isin(2, 3)).count() == 0 and kept.where("doc_id = 4").count() == 1


def test_one_row_of_each_component_whatever_its_id(spark):
    words = lambda seed, n=60: " ".join(random.Random(seed).choices([f"w{i}" for i in range(900)], k=n))
    rows = [(None, words(i)) for i in range(30)] + [(None, words(i)) for i in range(5)]  # 30 texts, 5 of them twice
    rows += [(7, words(100 + i)) for i in range(20)]  # one id, 20 texts
    rows += [(8, words(200)), (3, words(200)), (8, words(201)), (None, words(200))]  # id 8 is a copy here and alone there
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, __row string").repartition(3)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    want = [(None, words(i)) for i in range(30)] + [(7, words(100 + i)) for i in range(20)] + [(3, words(200)), (8, words(201))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
