import pandas as pd
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import mixing as M
from pagemill.llm.queries import op7_mixing

from .conftest import SF, as_set


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, top=2):
    """sizes by source in order; shares are dealt again and again until no source is above its cap."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        level = left / sum(w[i] for i in open_)
        full = [i for i in open_ if level * w[i] > top * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * w[i]
            break
        for i in full:
            out[i] = top * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


@example([1, 0, 0, 1])
@example([0, 0])
@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_against_repeated_dealing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", f"s{i}", n) for i, n in enumerate(sizes)], "src string, source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    for i, want in enumerate(brute_targets(sizes)):
        assert got[f"s{i}"] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_oracle(spark, sql):
    got, want = as_set(op7_mixing(spark, SF)), sql(M.ORACLE)
    assert got[0] == want[0] and {tuple(round(x, 6) for x in r) for r in got[1]} == {tuple(round(x, 6) for x in r) for r in want[1]}


def test_every_source_is_cut_at_its_budget(docs):
    rows = M.mix_sources(docs, rows_per_bucket=16).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(r.taken == int(r.target + 0.5) and r.over <= 0 for r in rows)
    assert M.mix_sources(docs, rows_per_bucket=3, buckets_per_group=4).select("doc_id", "taken").exceptAll(M.mix_sources(docs).select("doc_id", "taken")).count() == 0


def test_edges(messy, sql):
    got = M.mix_sources(messy)
    assert got.count() == messy.count() and M.mix_sources(messy.limit(0)).count() == 0
    frame = pd.DataFrame([tuple(r) for r in messy.select("doc_id", "text", "source").collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    rows = lambda s: sorted(((r[0] is None, r[0] or 0, *r[1:]) for r in s))
    want = sql(M.ORACLE, documents=frame)
    assert rows(as_set(got.select(*want[0]))[1]) == rows(want[1])
    mixed = M.mixed_documents(messy)
    assert mixed.columns == messy.columns and mixed.count() > 0
    assert M.mixed_documents(messy.limit(0)).count() == 0


def test_rows_without_an_id_or_with_a_common_one_are_mixed_one_by_one(spark):
    rows = [(None if i % 3 else 5, f"{i} " + "word " * (i % 7), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    targets = {r.source: r.target for r in M.mix_sources(docs).select("source", "target").distinct().collect()}
    mixed = M.mixed_documents(docs)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert all(abs(got[s] - t) <= 7 for s, t in targets.items())  # whole rows, of 7 words at most
    assert mixed.groupBy("text").count().where("count > 2").count() == 0


def test_rows_without_an_id_are_spread_over_buckets(spark, sql):
    """With the query's settings: a third of the ids null, another third one id."""
    docs = spark.range(30_000).selectExpr("CASE id % 3 WHEN 0 THEN id WHEN 1 THEN 7 END AS doc_id", "concat('word ', id) AS text", "'s' AS source")
    buckets = -(-30_000 // M.ROWS_PER_BUCKET)
    sizes = [r["count"] for r in docs.groupBy(M.bucket_of(M.mixing_key(F.col("doc_id"), F.col("text")), buckets).alias("b")).count().collect()]
    assert len(sizes) == buckets and max(sizes) <= 4 * sorted(sizes)[buckets // 2]
    rows = M.mix_sources(docs).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).first()
    assert rows.taken == int(rows.target + 0.5)
