import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import language_id as L
from pagemill.llm import quality_model as Q
from pagemill.llm import toxicity as T
from pagemill.llm.textfeat import sample_by, words_of

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    return docs, labels


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_hashes_and_grams_do_not_depend_on_the_neighbours():
    texts = ["alpha beta  gämma\n", None, "", "beta", " x alpha"]
    w = words_of(texts)
    names = [bytes(w.buffer[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)]
    assert names == ["alpha", "beta", "gämma", "beta", "x", "alpha"] and w.text.tolist() == [0, 0, 0, 3, 4, 4]
    for n in (None, 2, 4):
        h = w.hashes_up_to(n)
        assert h[0] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 4
    grams = w.grams(3, 15)
    span = lambda i: grams[w.starts[i] - 1 : w.ends[i]]
    assert span(0).tolist() == span(5).tolist() and span(1).tolist() == span(3).tolist()


def test_scan_against_one_step_at_a_time():
    rng = np.random.default_rng(0)
    for n, share in ((1, 1), (40, 0.3), (900, 0.004), (2500, 0.0)):
        e, first, t, start = rng.random((n, 3)) + 0.05, rng.random(n) < share, np.exp(rng.normal(size=(3, 3))), rng.random(3) + 0.1
        first[0] = True
        got, a = L.scan(e, first, t, start), None
        for i in range(n):
            a = (start if first[i] else a @ t) * e[i]
            a = a / a.sum()
            assert np.allclose(got[i], a, atol=1e-12)


def test_marginals_against_all_labellings():
    model = L.Crf(["a", "b"])
    rng = np.random.default_rng(1)
    model.transitions, model.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    scores = rng.normal(size=(5, 2))
    total, want = 0.0, np.zeros((5, 2))
    for y in np.ndindex(*[2] * 5):
        p = np.exp(model.first[y[0]] + sum(scores[i, y[i]] for i in range(5)) + sum(model.transitions[y[i], y[i + 1]] for i in range(4)))
        total += p
        for i in range(5):
            want[i, y[i]] += p
    assert np.allclose(model.marginals(scores, np.arange(5) == 0), want / total)


def test_language_held_out_accuracy_and_code_switching(labelled):
    docs, _ = labelled
    texts, langs = L.training_sample(docs, "doc_id", "text", "lang")
    assert len(texts) <= L.MOST_DOCUMENTS
    model = L.train(texts, langs)
    rows = [r for r in L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect() if fold(r.doc_id, 3) == 1]
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    english, german = (next(t for t, x in zip(texts, langs, strict=True) if x == y and len(t.split()) > 60) for y in ("en", "de"))
    words = L.word_languages(model, " ".join(english.split()[20:40] + german.split()[20:40]))
    assert np.mean([x == "en" for _, x, _ in words[:20]]) > 0.8 and np.mean([x == "de" for _, x, _ in words[20:]]) > 0.8


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    sample = T.training_sample(docs, labels)
    model = T.train(*sample)
    rows = [r for r in T.score_documents(docs, model).join(labels, "doc_id").collect() if fold(r.doc_id, 5) == 0]
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert (p == y).mean() > 0.95 and (p & y).sum() / y.sum() > 0.75
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_held_out(labelled):
    docs, labels = labelled
    texts, grades = Q.training_sample(docs, labels, Q.GRADES)
    model = Q.train(texts, grades)
    assert model.grades == [0, 1, 2] and model.thresholds[0] <= model.thresholds[1] and len(texts) <= Q.MOST_ROWS
    rows = [r for r in Q.score_documents(docs, model).join(labels, "doc_id").collect() if fold(r.doc_id, 5) == 0]
    junk, sound = np.array([r.tail_prob for r in rows if r.quality == 0]), np.array([r.tail_prob for r in rows if r.quality == 1])
    assert len(junk) > 50 and len(sound) > 300
    assert (sound >= 0.5).mean() > 0.98 and (junk < 0.5).mean() > 0.95
    assert all(0 <= r.expected_grade <= 2 for r in rows)
    toxic, clean = (np.mean([r.expected_grade for r in rows if r.quality == 1 and r.toxic == t]) for t in (1, 0))
    assert np.mean([r.expected_grade for r in rows if r.quality == 0]) < toxic < clean  # the grades are in order


WHITE = " \t\n\v\f\r"
ODD = ["", "   ", "one", "one one one two", "a bb ccc", "Ünï\tcode\n\nwörds a", "same same\nsame a b", "long " + "longer words here " * 40]


def brute_words(text):
    out, word = [], b""
    for byte in text.encode() + b" ":
        if chr(byte) in WHITE:
            out, word = out + [word] * bool(word), b""
        else:
            word += bytes([byte])
    return out


def brute_hash(word, n=None):
    total, power = 0, 1
    for byte in word[:n]:
        power = power * 0x9E3779B97F4A7C15 % 2**64
        total = (total + (byte + 1) * power) % 2**64
    total ^= total >> 31
    total = total * 0xBF58476D1CE4E5B9 % 2**64
    return total ^ total >> 29


def brute_gram(window, bits):
    h = 0
    for byte in window:
        h = (h * 0x01000193 + byte) % 2**32
    h ^= h >> 15
    h = h * 0x85EBCA6B % 2**32
    return 1 + ((h ^ h >> 13) & ((1 << bits) - 1))


def test_quality_scores_against_loops(spark):
    """Word by word and gram by gram, with the definitions of the features written out."""
    model = Q.train(["good clean text here", "bad!! BAD!! bad!!", "mid text", "more good words", "bad bad"] * 4, [2, 0, 1, 2, 0] * 4, epochs=20)
    want = {}
    for i, text in enumerate(ODD):
        data, words, score = b" " + text.encode() + b" ", brute_words(text), 0.0
        grams = [data[k : k + 3] for k in range(len(data) - 2) if chr(data[k + 1]) not in WHITE and not (chr(data[k]) in WHITE and chr(data[k + 2]) in WHITE)]
        if words:
            score += sum(model.words[brute_hash(w) % 2**Q.WORD_BITS] for w in words) / len(words)
            score += model.repeat * sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words)
        if grams:
            score += sum(model.grams[brute_gram(g, Q.GRAM_BITS)] for g in grams) / len(grams)
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        want[i] = (sum(above), above[0])
    table = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in Q.score_documents(table, model).collect():
        assert np.allclose((r.expected_grade, r.tail_prob), want[r.doc_id], atol=1e-9)


def test_toxicity_scores_against_loops(spark):
    """Word by word, filter by filter and span by span, with each language's threshold."""
    texts = ["bad word here", "das ist bad hier", "good one there", "das ist gut hier"] * 25
    model = T.train(texts, [1, 1, 0, 0] * 25, ["en", "de", "en", "de"] * 25, epochs=3)
    model.shift = np.array([0.3, -0.7])  # so that the language matters
    want = {}
    for i, text in enumerate(ODD):
        words = brute_words(text.lower())
        x = [sum(t[brute_hash(w, n) % 2**T.BITS].astype(float) for t, n in zip(model.tables, (None, *T.PREFIXES), strict=True)) for w in words]
        logit, at = float(model.bias), 0
        for span, filters, bias in zip(T.SPANS, model.filters, model.biases, strict=True):
            for f in range(T.FILTERS):
                found = [sum(float(x[s + k] @ filters[k][:, f]) for k in range(span)) + float(bias[f]) for s in range(len(x) - span + 1)]
                logit += float(model.out[at]) * max([0.0, *found])
                at += 1
        sums = [sum(float(model.language_words[brute_hash(w) % 2**T.LANGUAGE_BITS, j]) for w in words) for j in range(2)]
        want[i] = 1 / (1 + np.exp(model.shift[int(sums[1] > sums[0])] - logit))
    table = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in T.score_documents(table, model).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == (r.score >= 0.5)


def test_samples_are_bounded_in_bytes_and_labels(spark, messy):
    labels = spark.createDataFrame([(i, 1, 0, "z", 7) for i in range(10)], "doc_id long, quality int, toxic int, text string, id int")  # columns that clash
    for texts in (Q.training_sample(messy, labels, Q.GRADES)[0], T.training_sample(messy, labels)[0], L.training_sample(messy, "doc_id", "text", "lang")[0]):
        assert texts and max(map(len, texts)) <= 32_768
    rows = spark.createDataFrame([(f"l{i}", i * 100 + k) for i in range(300) for k in range(1 + (i < 3))], "lang string, id long")
    got = sample_by(rows, "lang", 5, F.col("id"), 1000, most_labels=10).collect()
    assert len({r.lang for r in got}) == 10 and {"l0", "l1", "l2"} <= {r.lang for r in got}


def test_edges(spark, messy):
    n = messy.count()
    for model in (L.train([], []), L.train(["the of"], ["en"]), L.train(["the of and", "der die das"] * 5, ["en", "de"] * 5, epochs=2)):
        rows = L.identify(messy, model).collect()
        assert len(rows) == n and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 9)} == {"und"}
        assert L.select_documents(messy, model, 0.4).columns == messy.columns and L.identify(messy.limit(0), model).count() == 0
    for model in (T.train([], [], []), T.train(["bad word here"] * 30 + ["good one there"] * 30, [1] * 30 + [0] * 30, ["en", None] * 30), T.train(["x", ""], [1, 1], [None, None])):
        rows = T.score_documents(messy, model).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows) and T.score_documents(messy.limit(0), model).count() == 0
    for model in (Q.train([], []), Q.train(["a"], [3]), Q.train(["good text", "bad!! BAD!!", "", "mid text"] * 5, [2, 0, 0, 1] * 5)):
        assert Q.score_documents(messy, model).count() == n and Q.score_documents(messy.limit(0), model).count() == 0
        assert Q.select_documents(messy, model, 1, 0.5).columns == messy.columns
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(Q.training_sample(messy, labels, Q.GRADES, held_out=9)[1]) == [1, 1, 2]
    assert T.training_sample(messy, labels.limit(0))[0] == [] and L.training_sample(messy.limit(0), "doc_id", "text", "lang") == ([], [])


def test_sample_gives_every_label_its_share(spark):
    counts = {f"l{i:02d}": 20 + 30 * i * i for i in range(20)}  # 20 to 10,850 rows
    rows = spark.createDataFrame([(k, i) for k, n in counts.items() for i in range(n)], "lang string, id long")
    got = {}
    for r in sample_by(rows, "lang", 300, F.struct("lang", "id"), 4000).collect():
        got[r.lang] = got.get(r.lang, 0) + 1
    assert sum(got.values()) == 4000 and got["l00"] == 20 and got["l01"] == 50 and got["l02"] == 140  # rare ones whole
    assert all(140 < got[k] < 330 for k, n in counts.items() if n > 400)


def test_code_switched_documents_are_kept_and_unknown_words_are_not(spark, labelled):
    docs, _ = labelled
    texts, langs = L.training_sample(docs, "doc_id", "text", "lang")
    model = L.train(texts, langs)
    rng = np.random.default_rng(3)
    held = [r for r in docs.where("n_chars between 600 and 4000").select("doc_id", "text", "lang").limit(3000).collect() if fold(r.doc_id, 3) == 1]
    of = lambda lang: [r.text.split() for r in held if r.lang == lang and len(r.text.split()) >= 60]
    parts = [of(x) for x in ("de", "en", "es")]
    mixed = [" ".join(" ".join(p[i % len(p)][at : at + 5]) for at in range(0, 60, 5) for p in parts) for i in range(20)]
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 400)) for _ in range(20)]
    noise = [t for t, s in zip(noise, L.predict(model, noise)[1], strict=True) if s < 0.4]
    assert len(noise) > 5 and max(L.predict(model, mixed)[1]) < 0.4
    table = spark.createDataFrame([(i, t) for i, t in enumerate(mixed + noise)], "doc_id long, text string")
    assert sorted(r.doc_id for r in L.select_documents(table, model, 0.4).collect()) == list(range(len(mixed)))
