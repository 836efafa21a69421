import numpy as np
import public_tokenizers

import corpus_pipeline as C
from pagemill.llm import language_id, mixing, packing, quality_model
from pagemill.llm.textfeat import tables

from .conftest import SF
from .test_packing import check
from .test_simhash import brute_components, brute_fingerprint


def test_run_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality_model.train(*quality_model.training_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality_model.GRADES))
    tail = {}
    for i, r in rows.items():
        tail[i] = model.cumulative(np.concatenate([model.scores(w) for _, _, w in tables([r.text], lower=False)]))[0, 0]
    kept = {i for i in rows if tail[i] >= 0.5}
    stage = C.quality_classifier(spark, docs, SF)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == kept
    field = language_id.train(*language_id.training_sample(stage, "doc_id", "text", "lang"))
    kept = {i for i in kept for n, s in [[x[0] for x in language_id.predict(field, [rows[i].text])]] if n != "und" and s >= C.LEAST_LANGUAGE}
    second = C.language(spark, stage, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == kept
    ids = sorted(kept)
    roots = brute_components(ids, [brute_fingerprint(rows[i].text) for i in ids])
    third = C.simhash_near_dedup(spark, second, SF)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(set(roots))
    passes = {r.doc_id: r.passes for r in mixing.mix_sources(third).collect()}
    fourth = C.source_mixing(spark, third, SF)
    assert fourth.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in passes.items() if n} and set(counts.values()) <= {1, 2}
    got = C.run(spark, SF).collect()
    encode = packing.byte_bpe(public_tokenizers.path(packing.TOKENIZER))
    want = {i: [*encode(rows[i].text).tolist(), 2] for i in counts}
    assert sum(r.length for r in got) == sum(len(want[i]) * n for i, n in counts.items())
    once = [i for i in counts if counts[i] == 1]
    check([r for r in got if r.doc_id in set()], {}, packing.LENGTH)
    for i in once[:50]:
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(want[i])


def test_stages_on_messy_and_empty_tables(spark, messy):
    for name, stage in C.STAGES:
        for table in (messy, messy.limit(0)):
            out = stage(spark, table, SF)
            assert name == "best_fit_packing" or out.columns == table.columns
            assert (out.count() == 0) >= (table.count() == 0)
