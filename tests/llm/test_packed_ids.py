import io
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import packed_ids as P
from pagemill.llm.queries import op13_packed_ids

from .conftest import SF

PATH = public_tokenizers.path(P.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return P.PartEncoder(PATH)


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_whole_table_round_trip(spark, docs, plain):
    want, at = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in op13_packed_ids(spark, SF).collect()) == want


def test_files_in_order_and_any_run_of_ids(spark, docs, plain):
    manifest = P.write_ids(docs.repartition(7), PATH, block_ids=1000)
    rows = {r.doc_id: r for r in P.read_ids(manifest, ids=True).collect()}
    whole = [i for r in sorted(rows.values(), key=lambda r: r.start) for i in r.ids]
    assert [r.doc_id for r in sorted(rows.values(), key=lambda r: r.start)] == sorted(rows)
    found = manifest.orderBy("file").collect()
    assert sum(r.n_ids for r in found) == len(whole) and sum(r.n_docs for r in found) == len(rows)
    for start, n in ((0, 1), (999, 2), (5, 0), (1000, 1000), (len(whole) - 3, 3), (found[-1].first_id - 2, 5), (0, len(whole))):
        assert P.read_document(manifest, max(0, start), n).tolist() == whole[max(0, start) : max(0, start) + n]
    sizes = [Path(r.path.removeprefix("file:").replace("//", "/")).stat().st_size for r in found]
    assert sum(sizes) < 2 * len(whole) + 16 * len(rows) + len(found) * 100 + 16 * (len(whole) // 1000 + len(found)) + 1  # two bytes an id


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=70)), dtype="<u4")
    packed = P.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    number = int.from_bytes(packed, "little")  # the definition of the format
    assert [(number >> (bits * i)) & ((1 << bits) - 1) for i in range(len(ids))] == ids.tolist()
    start = data.draw(st.integers(0, len(ids)))
    assert P.unpack(packed, bits, len(ids) - start, start).tolist() == ids[start:].tolist()


def test_width_and_what_does_not_fit():
    assert [P.width_of(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError, match="bits"):
        P.pack(np.array([4], dtype="<u4"), 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63) + 1, 2**63 - 1)), st.integers(0, 30)), max_size=12), st.integers(1, 17), st.integers(1, 40))
def test_a_file(documents, bits, block):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 1 << bits, n).astype("<u4") for _, n in documents]
    out = io.BytesIO()
    writer = P.Writer(out, bits, block)
    for (key, _), own in zip(documents, ids, strict=True):
        writer.add(key, own)
    writer.close()
    reader = P.Reader(out, len(out.getvalue()))
    for at_once in (1, 7, 1 << 20):
        assert [(k, s, x.tolist()) for k, s, x in reader.documents(at_once)] == [(k, sum(map(len, ids[:i])), ids[i].tolist()) for i, (k, _) in enumerate(documents)]
    assert reader.bits == bits and len(reader.offsets) == -(-sum(map(len, ids)) // block)
    with pytest.raises(IndexError):
        reader.read(0, sum(map(len, ids)) + 1)
    with pytest.raises(ValueError, match="packed"):
        P.Reader(io.BytesIO(bytes(200)), 200)


SAMPLES = list("abZH'19.,!-<| \n\té́ñ日🙂̱Åßİ½≠") + ["'s", "'T", "'ll", " ", "\x85", "\x1c", "<|endoftext|>", "<|startoftext|>", "don't", "it's'", "ﬁ", "İ", "K"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(SAMPLES), st.characters(exclude_categories=["Cs"])), max_size=25).map("".join), min_size=1, max_size=6))
def test_ids_are_those_of_the_library(encoder, plain, texts):
    assert [g.tolist() for g in encoder([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_beside_every_code_point_of_the_first_planes(encoder, plain):
    texts = ["".join(f"a{c}1{c} {c}{c}! {c}  {c}\nH{c}'{c}s," for c in map(chr, range(lo, lo + 512))) for lo in range(0, 0x20000, 512) if not 0xD800 <= lo < 0xE000]
    for text, got in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    encode = P.PartEncoder(PATH)
    for text in ("a b c d", "e f g a", "h i j k l m n o", "a"):
        assert encode([text.encode()])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encode.known) <= 8


def test_edges(spark, messy, plain):
    rows = [tuple(r) for r in P.read_ids(P.write_ids(messy, PATH)).orderBy("start").collect()]
    texts = [(r.doc_id, r.text or "") for r in messy.collect()]
    want = sorted((k is None, k or 0, len(i), crc(i)) for k, t in texts for i in [[*plain.encode(t, add_special_tokens=False).ids, 2]])
    assert sorted((k is None, k or 0, n, c) for k, _, n, c in rows) == want
    assert [r[1] for r in rows] == [sum(x[2] for x in rows[:i]) for i in range(len(rows))]
    assert [r[0] for r in rows if r[0] is not None] == sorted(r[0] for r in rows if r[0] is not None) and rows[-1][0] is None
    assert P.read_ids(P.write_ids(messy.limit(0), PATH)).collect() == []


def test_rows_without_an_id_are_spread_over_files(spark, plain):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id END AS doc_id", "CASE WHEN id % 3 = 1 THEN 'same text' ELSE concat('t ', id) END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one file
    try:
        files = P.write_ids(docs.repartition(8), PATH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 2 and max(f.n_docs for f in files) < 1500
