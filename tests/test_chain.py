"""The similarity chain and the metric log on literal rows."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import drift, text


def test_each_pair_takes_the_first_step_that_applies(spark):
    rows = [
        (1, "same", "same", [1.0, 0.0], [0.0, 1.0]), (2, None, "", None, None), (3, "a text", "another", [1.0, 0.0], [3.0, 4.0]), (4, "a text", "another", [1.0, 0.0], [-1.0, 0.0]),
        (5, "two words", "two others", [0.0, 0.0], [1.0, 0.0]), (6, "two words", "two others", [1.0], [1.0, 0.0]), (7, "two words", "two others", None, [1.0]), (8, "! ! !", "! ! ?", None, None), (9, "?", "!", None, None),
        (10, "x", "words here", None, None),
    ]
    df = spark.createDataFrame(rows, "k int, a string, b string, va array<double>, vb array<double>")
    got = {r.k: (r.method, r.similarity) for r in text.similarity_chain(df, ["k"], "a", "b", "va", "vb").collect()}
    assert [got[k][0] for k in range(1, 11)] == ["hash_match", "hash_match", "embedding", "embedding", "tfidf", "tfidf", "tfidf", "jaccard", "jaccard", "tfidf"]
    assert got[1][1] == got[2][1] == 1.0 and got[3][1] == pytest.approx(0.6) and got[4][1] == 0.0
    idf = 1 + __import__("math").log(3 / 2)
    assert got[5][1] == got[6][1] == got[7][1] == pytest.approx(1 / (1 + idf**2)) and got[10][1] == 0.0
    assert got[8][1] == pytest.approx(2 / 3)  # "! !" and " ! " of these and "! ?"


def test_metric_rows(spark):
    df = spark.createDataFrame([(1, "t", " ", "body"), (2, None, "x", ""), (3, "t", "x", None)], "k int, title string, price string, content string")
    rows = drift.metric_rows(df, ["k"], {"title": F.col("title"), "price": F.col("price")}, {"title"}, F.lit(0.5), F.col("content")).orderBy("k").collect()
    assert [(r.passed, r.field_status, r.content_hash is None) for r in rows] == [(True, {"title": True, "price": False}, False), (False, {"title": False, "price": True}, True), (True, {"title": True, "price": True}, True)]
    found = drift.validation_failures(drift.metric_rows(df.withColumn("d", F.lit("x")), ["d"], {"title": F.col("title")}, {"title"}, F.lit(1), F.col("content")), ["d"]).first()
    assert (found.samples, found.failures) == (3, 1)
