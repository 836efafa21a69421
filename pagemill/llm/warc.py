"""Dictionary-compressed WARC archives: written by the tasks that hold the pages, and read back record by record.

An archive starts with a skippable frame that holds the Zstandard dictionary, followed by one compressed frame a
record. The dictionary is built from a bounded sample of the records to be archived. Of records with equal payloads,
one is a response and the others revisit it. Archives go to the shared folder under names of their own attempt; the
manifest, a table written by Spark, names those of the attempts that counted, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stored

#: The skippable frame's magic number and the profile of revisits are fixed by the formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and bytes of each that the dictionary is trained on at most, its size, and the size at which archives roll.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 1000, 16_384, 65_536, 64 << 20
LEVEL, DATE = 3, "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(text: str) -> str:
    """A header value without characters that would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response, or a revisit whose block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {header_value(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []
    lines += [f"X-Page: {page_id}"] if page_id is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like the samples; the samples' own ends where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_archive(records: Iterator[bytes], dictionary: bytes, out: io.IOBase, limit: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Write records until `limit` bytes; the number of records and bytes written."""
    import zstandard

    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
    n, size = 0, 8 + len(dictionary)
    for record in records:
        frame = pack(record)
        out.write(frame)
        n, size = n + 1, size + len(frame)
        if size >= limit:
            break
    return n, size


def read_archive(source: io.IOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and body of each record."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(source.read(size))
    raw = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True)
    plain = io.BufferedReader(raw, 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:20]!r}")
        head = header_lines(plain)
        block = plain.read(int(head["Content-Length"]))
        plain.read(4)
        http, _, body = block.partition(b"\r\n\r\n")
        yield head, header_lines(io.BytesIO(http.partition(b"\r\n")[2])), body


def header_lines(source: io.IOBase) -> dict[str, str]:
    found = {}
    while line := source.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(": ")
        found[name] = value
    return found


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def with_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """id, url, payload, response_id: the smallest id among equal payloads of at least min_bytes, else the row's own."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("shared", F.octet_length("payload") >= min_bytes)
    first = base.where("shared").groupBy("digest").agg(F.min("id").alias("first_id")).withColumnRenamed("digest", "of")
    joined = base.join(first, (F.col("digest") == F.col("of")) & F.col("shared"), "left")
    return joined.select("id", "url", "payload", F.when(F.col("shared"), F.col("first_id")).otherwise(F.col("id")).alias("response_id"))


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Archive every row; the manifest: path, n_records, n_bytes.

    A null payload is an empty one; a null url leaves out its header, a null id likewise. Payloads that are equal have
    one response, the smallest id (ids that are null come last); rows that repeat it with its payload are responses
    too. The dictionary is trained on at most SAMPLE_RECORDS records. An empty table has an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    part = F.substring(F.col(payload_col), 1, SAMPLE_BYTES).cast("binary").alias("payload")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), part)
    place = F.xxhash64("id", "url")
    share = min(1.0, 1.2 * SAMPLE_RECORDS / max(1, pages.count()))  # so that tasks send the driver little more than the sample
    sample = rows.where(place / F.lit(float(2**64)) + 0.5 <= share).orderBy(place, "id").limit(SAMPLE_RECORDS).collect()
    dictionary = train([warc_record(r.id, r.url, bytes(r.payload or b""), None, False) for r in sample])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for key, url, payload, first in zip(batch["id"].astype("Int64"), batch["url"], batch["payload"], batch["response_id"].astype("Int64"), strict=True):
                    key, first = (None if pd.isna(x) else int(x) for x in (key, first))
                    revisit = first is not None and first != key
                    yield warc_record(key, url, bytes(payload), first if revisit else None, revisit)

        found = records()
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        done = []
        for record in found:
            name = f"{uuid.uuid4().hex}.warc.zst"

            def rolled(first=record):
                yield first
                yield from found

            with store.open_output_stream(f"{base}/{name}") as out:
                done.append((f"{folder}/{name}", *write_archive(rolled(), dictionary, out, archive_bytes)))
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    rows = with_responses(pages, id_col, url_col, payload_col, min_revisit_bytes)
    return stored(rows.mapInPandas(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and payload if asked for.

    Digest and length of a response are those of the payload read, which must be the ones its headers state; those of
    a revisit are of the payload it stands for, as its headers state.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
        for batch in batches:
            for path in batch["path"]:
                store, base = file_system(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(base) as source:
                    for head, http, body in read_archive(source):
                        stated, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        if head["WARC-Type"] == "response" and (payload_digest(body), len(body)) != (stated, n):
                            raise ValueError(f"{path}: record {head['WARC-Record-ID']} is damaged")
                        rows.append((head.get("X-Page"), head.get("WARC-Target-URI"), head["WARC-Type"], head.get("X-Refers-To-Page"), n, stated, body)[: len(names)])
                        held += len(body) if payloads else 200
                        if held > 8 << 20:
                            yield table(rows, names)
                            rows, held = [], 0
                yield table(rows, names)

    def table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.assign(page_id=pd.to_numeric(out["page_id"]).astype("Int64"), refers_to=pd.array([None if x is None else int(x) for x in out["refers_to"]], dtype="Int64"))

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInPandas(read, schema)


ORACLE = r"""
WITH p AS (SELECT page_id, ENCODE(COALESCE(html, '')) AS payload FROM pages),
d AS (SELECT page_id, OCTET_LENGTH(payload) AS payload_bytes, SHA1(payload) AS h FROM p),
b AS (SELECT *, MIN(page_id) OVER (PARTITION BY h) AS first_id FROM d),
c AS (SELECT page_id, payload_bytes, first_id, h, LIST_TRANSFORM(RANGE(0, 40), lambda i: INSTR('0123456789abcdef', h[i + 1]) - 1) AS n FROM b),
e AS (SELECT page_id, payload_bytes, first_id,
             ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
               ((n[(i * 5) // 4 + 1] * 16 + COALESCE(n[(i * 5) // 4 + 2], 0)) // CAST(POW(2, 3 - (i * 5) % 4) AS BIGINT)) % 32 + 1]), '') AS payload_digest
      FROM c)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM e
"""
