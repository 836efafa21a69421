import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from pagemill.llm import warc as W
from pagemill.llm.queries import op4_warc

from .conftest import SF, as_set


def test_oracle(spark, sql):
    assert as_set(op4_warc(spark, SF)) == sql(W.ORACLE)


def test_round_trip_of_payloads_over_several_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = W.write_archives(pages, archive_bytes=4000)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == pages.count()
    got = {r.page_id: (r.url, bytes(r.payload)) for r in W.read_archives(manifest, payloads=True).collect()}
    assert got == {r.page_id: (r.url, r.html.encode()) for r in pages.collect()}


def test_records_are_plain_zstandard_frames_behind_a_dictionary():
    records = [W.warc_record(i, f"http://h/{i}", b"<p>text %d</p>" % i * 50, None, False) for i in range(40)]
    dictionary = W.train(records, 4096)
    out = io.BytesIO()
    assert W.write_archive(iter(records), dictionary, out) == (40, len(out.getvalue()))
    assert out.getvalue()[:4] == bytes.fromhex("5d2a4d18")
    found = list(W.read_archive(io.BytesIO(out.getvalue())))
    assert [b for _, _, b in found] == [b"<p>text %d</p>" % i * 50 for i in range(40)]
    with pytest.raises(ValueError):
        list(W.read_archive(io.BytesIO(b"\0" * 100)))


def test_edges(spark):
    big = "<p>" + "é" * 500_000 + "</p>"
    rows = [(3, "u", "same"), (1, "u1", "same"), (1, "u1", "same"), (None, "n", "same"), (5, None, None), (4, "e", ""), (6, "a\r\nb: c", big), (7, "k", "Content-Length: 3\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(2))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in W.read_archives(W.write_archives(pages)).collect()), key=str)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(3, "revisit", 1, 4, digest("same")), (1, "response", None, 4, digest("same")), (1, "response", None, 4, digest("same")), (None, "revisit", 1, 4, digest("same")), (5, "revisit", 4, 0, digest("")), (4, "response", None, 0, digest("")), (6, "response", None, 1_000_007, digest(big)), (7, "response", None, len(rows[7][2]), digest(rows[7][2]))]
    assert got == sorted(want, key=str)
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0
    assert W.read_archives(W.write_archives(pages, min_revisit_bytes=5)).where("record_type = 'revisit'").count() == 0
