import pandas as pd
from pyspark.sql import functions as F

from pagemill.llm import quality_rules as Q
from pagemill.llm.queries import op2_quality_rules

from .conftest import SF, as_set


def brute_repeats(text):
    w = [x for x in text.replace("\n", " ").replace("\t", " ").split(" ") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_oracle_and_brute_force(spark, sql):
    assert as_set(op2_quality_rules(spark, SF)) == sql(Q.ORACLE)
    texts = ["a b c a b c", "a a a a", "a b c d", "a b c x a b c y b c x", "", "a b", "p q r p q r p q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in Q.measurements(df).collect()} == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_no_python_in_the_plan(docs):
    plan = Q.apply_policy(Q.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_policies_and_ablations(docs):
    ledger = Q.ledger(docs).cache()
    bits = [r.fail_bits for r in ledger.select("fail_bits").collect()]
    for version, mask in Q.POLICIES.items():
        assert Q.apply_policy(ledger, version).where("kept").count() == sum(b & mask == 0 for b in bits)
        for r in Q.ablations(ledger, version).collect():
            bit = Q.BIT[r.rule]
            assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_edges(messy, sql):
    rows = Q.apply_policy(Q.ledger(messy))
    assert rows.count() == messy.count() and Q.ledger(messy.limit(0)).count() == 0
    want = sql(Q.ORACLE, documents=pd.DataFrame([tuple(r) for r in messy.select("doc_id", "text").collect()], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert as_set(rows.select(*want[0])) == want
    assert rows.where(F.col("doc_id") == 7).first().n_repeat_words == 60_000
