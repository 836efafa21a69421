import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import phrase_tries as T
from pagemill.llm.queries import op12_phrase_tries

from .conftest import as_set

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, top=2000, inside=80):
    """Counters a language, and all pairs of a phrase and a longer one. rows: (lang, text)."""
    counts = {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for ws in pieces(text):
            f.update(" ".join(ws[i : i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least and " " in p}
        n = sum(a for p, a in f.items() if " " not in p)
        held = {p for p, a in frequent.items() for q, b in frequent.items() if len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= inside * a}
        found = []
        for p, a in frequent.items():
            if p not in held:
                ws = p.split(" ")
                cuts = [(f[" ".join(ws[:k])], f[" ".join(ws[k:])]) for k in range(1, len(ws))]
                score, k = min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate(cuts))
                found.append((-score, -a, p.encode(), *cuts[k]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_oracle_on_the_whole_table(spark, sql):
    folder = "/root/testdata/sf0.01"
    want = sql(T.ORACLE, folder=folder)
    assert as_set(op12_phrase_tries(spark, folder)) == want and len(want[1]) > 100
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows_of(T.collocations(docs)) == brute([(r.lang, r.text) for r in docs.collect()], T.LEAST)


@pytest.mark.parametrize(("shard", "words"), [(2_000, 400), (40_000, 100), (1 << 24, 10_000)])
def test_shards_and_ranges_change_nothing(spark, docs, shard, words):
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = T.collocations(docs.repartition(5), least=5, top=40, shard_bytes=shard, range_words=words)
    assert rows_of(got) == brute(rows, 5, top=40)


texts = st.lists(st.sampled_from(["a", "b", "the", "ñ", "A", "é", " ", "  ", "\t", ".", "\n", ", ", "longer", "\x0b", "日", "-"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", "ñ".encode(), b"the", b"zz"]), min_size=1, max_size=4), max_size=5))
def test_tries_cut_serialised_and_merged(several, bounds):
    bounds = sorted({tuple(b) for b in bounds})
    slots: list[list[bytes]] = [[] for _ in range(len(bounds) + 1)]
    want = Counter()
    for text in several:
        trie = T.shard_trie(text.encode())
        words = [[trie.vocabulary[w - 1].as_py() for w in row if w] for row in trie.paths.tolist()]
        assert words == sorted(words)
        mine = Counter(tuple(w.encode() for w in ws[i : i + 4]) for ws in pieces(text) for i in range(len(ws)))
        assert {tuple(w): n for w, n in zip(words, trie.counts.tolist(), strict=True)} == mine
        want += mine
        cuts = [0, *T.places_of(bounds, trie).tolist(), len(words)]
        assert cuts[1:-1] == [sum(tuple(w) < b for w in words) for b in bounds]
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if hi > lo:
                slots[i].append(T.serialise(trie.vocabulary, trie.paths[lo:hi], trie.counts[lo:hi]))
    got, found = Counter(), Counter()
    for blobs in filter(None, slots):
        vocabulary, paths, counts = T.merged(blobs)
        got.update({tuple(vocabulary[w - 1].as_py() for w in row if w): n for row, n in zip(paths.tolist(), counts.tolist(), strict=True)})
        for _, phrase, n in T.nodes(vocabulary, paths, counts, 2):
            found[phrase] += n
    assert got == want
    whole = Counter(" ".join(ws[i : i + m]) for t in several for ws in pieces(t) for m in range(1, 5) for i in range(len(ws) - m + 1))
    assert {p: n for p, n in whole.items() if n >= 2 * len(slots)}.items() <= found.items() | set()  # nodes that one range holds whole, or all of them name
    assert all(n <= whole[p] for p, n in found.items() if p) and found[""] == sum(want.values())


def test_long_texts_are_cut_where_pieces_end():
    text = ("one two. " * 50 + "x" * 500 + " y " * 300 + "; z").encode()
    parts = list(T.slices(text, 100))
    assert b"".join(parts) == text and len(parts) > 4
    both = lambda t: [ws for ws in pieces(t.decode()) if ws]
    assert [ws for p in parts for ws in both(p)] == both(text)
    assert list(T.slices(b"x" * 1000, 100)) == [b"x" * 1000]


def test_edges(spark, messy, sql):
    rows = [(r.lang, r.text) for r in messy.collect()]
    assert rows_of(T.collocations(messy, least=2)) == brute(rows, 2)
    frame = pd.DataFrame([("en", "A b. " * 40 + "a B"), (None, "x y z\n" * 31), ("fr", None), ("fr", "")], columns=["lang", "text"])
    got = T.collocations(spark.createDataFrame(list(frame.itertuples(index=False)), "lang string, text string"))
    assert as_set(got) == sql(T.ORACLE, documents=frame)
    assert {(r.lang, r.phrase, r.a) for r in got.collect()} == {("en", "a b", 41), ("und", "x y z", 31)}
    assert T.collocations(messy.limit(0)).collect() == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a = 9_000_000_000_000_000_001
    df = spark.createDataFrame([(a, [a, a + 1], [a + 5, a + 3])], "f long, lefts array<long>, rights array<long>")
    cut = df.select(T.lowest_cut(F.col("f")).alias("c")).first().c
    assert (cut.score, cut.k, cut.l, cut.r) == (min(2_000_000 * a // (2 * a + 5), 2_000_000 * a // (2 * a + 4)), 0, a, a + 5)


def test_a_word_before_every_other_is_many_ranges(spark):
    rng = np.random.default_rng(5)
    texts = [" . ".join(f"the {a} {b}" for a, b in rng.integers(0, 90, (40, 2))) for _ in range(60)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    bounds = T.range_bounds(T.languages(docs, "text", "lang"), 300)
    assert sum(path[0] == b"the" and len(path) > 1 for _, path in bounds) >= 3
    assert rows_of(T.collocations(docs, least=3, range_words=300, shard_bytes=5000)) == brute([("en", t) for t in texts], 3)
