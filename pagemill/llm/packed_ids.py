"""Token ids in files of fixed-width bits, written in the order of document ids and read back in part or whole.

A file holds blocks of BLOCK_IDS ids, each id in as many bits as the vocabulary needs, little-endian from the lowest
bit on; then an index: where each block starts, how many ids lie before it, and each document's id and number of ids;
then a tail of fixed length that says where the index is. An id's place is thus known without reading what lies before
it, and a block is unpacked by a few numpy operations whatever the width.

Documents are sorted across files by Spark, a file a task, so files follow each other in the order of their numbers and
a document's start is the ids of earlier files plus those before it in its own.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Ids in a block; bytes of text that are encoded in one go; distinct word parts whose ids a task remembers.
BLOCK_IDS, BYTES_AT_ONCE, REMEMBERED = 65_536, 4 << 20, 1_000_000
MAGIC, TAIL = b"IDBITS01", struct.Struct("<QQQQHI4x8s")  # index offset, ids, blocks, documents, bits, ids in a block
#: The smallest document id stands for none; ids are not otherwise restricted.
NO_ID = np.iinfo(np.int64).min


def width_of(vocabulary: int) -> int:
    """The least number of bits that tells so many ids apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, from the lowest bit of the first byte on; the last byte is filled up with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    plane = np.empty((len(ids), bits), dtype=np.uint8)
    for b in range(bits):
        plane[:, b] = (ids >> b) & 1
    return np.packbits(plane.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """n ids from number `start` on: of each, the eight bytes that hold it are read at once, shifted and masked."""
    window = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(window.view("<u1"), shape=(len(data) + 1, 8), strides=(1, 1))
    at = np.arange(start, start + n, dtype=np.int64) * bits
    whole = np.ascontiguousarray(words[at >> 3]).view("<u8").ravel()
    return ((whole >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """One file of packed ids; close() writes the index and the tail."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at, self.ids, self.pending, self.held = 0, 0, [], 0
        self.offsets, self.keys, self.lengths = [], [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(NO_ID if key is None else key)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            rest = np.concatenate(self.pending)
            full = len(rest) - len(rest) % self.block_ids
            for lo in range(0, full, self.block_ids):
                self._block(rest[lo : lo + self.block_ids])
            self.pending, self.held = [rest[full:]], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append((self.at, self.ids))
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at, self.ids = self.at + len(data), self.ids + len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        for table, kind in ((self.offsets, "<u8"), (self.keys, "<i8"), (self.lengths, "<u8")):
            self.out.write(np.asarray(table, dtype=kind).tobytes())
        self.out.write(TAIL.pack(self.at, self.ids, len(self.offsets), len(self.keys), self.bits, self.block_ids, MAGIC))


class Reader:
    """A file of packed ids behind anything that seeks: whole documents in turn, or any run of ids."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - TAIL.size)
        index, self.ids, blocks, docs, self.bits, self.block_ids, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(index)
        table = source.read(size - TAIL.size - index)
        self.offsets = np.frombuffer(table, "<u8", 2 * blocks).reshape(-1, 2)
        self.keys = np.frombuffer(table, "<i8", docs, 16 * blocks)
        self.lengths = np.frombuffer(table, "<u8", docs, 16 * blocks + 8 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.end = index

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from number `start` of the file on; only the blocks that hold them are read."""
        if n <= 0:
            return np.empty(0, dtype="<u4")
        if start < 0 or start + n > self.ids:
            raise IndexError(f"ids {start} to {start + n} of {self.ids}")
        found = []
        first = int(np.searchsorted(self.offsets[:, 1], start, side="right")) - 1
        while n:
            at, before = (int(x) for x in self.offsets[first])
            stop = int(self.offsets[first + 1, 0]) if first + 1 < len(self.offsets) else self.end
            held = (int(self.offsets[first + 1, 1]) if first + 1 < len(self.offsets) else self.ids) - before
            self.source.seek(at)
            take = min(n, before + held - start)
            found.append(unpack(self.source.read(stop - at), self.bits, take, start - before))
            start, n, first = start + take, n - take, first + 1
        return np.concatenate(found)

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of every document in turn; blocks are read once unless a document is longer than what is held."""
        lo, held = 0, np.empty(0, dtype="<u4")
        for key, start, n in zip(self.keys.tolist(), self.starts.tolist(), self.lengths.tolist(), strict=True):
            if start + n > lo + len(held):
                held, lo = self.read(start, min(self.ids - start, max(n, ids_at_once))), start
            yield None if key == NO_ID else key, start, held[start - lo : start - lo + n]


def _classes() -> np.ndarray:
    """0 blank, 1 letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 beyond ASCII."""
    found = np.full(256, 5, dtype=np.uint8)
    found[:128] = 4
    for chars, c in ((b"\t\n\v\f\r ", 0), (b"0123456789", 2), (b"'", 3)):
        found[list(chars)] = c
    found[[*range(65, 91), *range(97, 123)]] = 1
    return found


CLASSES, LOWER = _classes(), np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def word_parts(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where in data each part starts, and the parts, so that encoding them one by one is encoding the whole.

    This tokenizer normalises characters, lower-cases, drops blanks and cuts words at letters, digits and the rest, so
    it never joins what blanks part, letters and signs next to them, or two digits. Parts are cut there where both
    neighbours are ASCII; beyond ASCII, and after an apostrophe, which may begin a part such as 's, they are left whole.
    A-Z is lower-cased where no character beyond ASCII follows that might be composed with it.
    """
    kind = CLASSES[data]
    solid = kind != 0
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (left < 5) & (right < 5) & (left != 0) & (right != 0)
    sign = lambda c: (c == 3) | (c == 4)
    cut &= ~(sign(left) & sign(right)) & ~((left == 3) & (right == 1))
    cut |= (left == 2) & (right == 2)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut
    starts = np.flatnonzero(begins)
    lower = np.ones(len(data), dtype=bool)
    lower[:-1] = right < 5
    text = np.where(lower, LOWER[data], data)[solid]
    # A part is the solid bytes from where it starts to the next start.
    offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(solid.view(np.uint8), starts, dtype=np.int64)))) if len(starts) else np.zeros(1, dtype=np.int64)
    return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


class PartEncoder:
    """ids of texts by a tokenizers file such as TOKENIZER, as tokenizers gives them; word parts met before are looked up.

    Distinct parts of a batch are found by Arrow and encoded once by the library; what a task remembers of them is
    bounded, and forgotten when it is full. Texts with a string of an added token go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.added = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> np.ndarray:
        return np.asarray(self.library.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")

    def parts(self, words: list[bytes]) -> list[bytes]:
        """The ids of each part, as little-endian 32-bit integers."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        for lo in range(0, len(new), 10_000):
            some = new[lo : lo + 10_000]
            for word, found in zip(some, self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.known[word] = np.asarray(found.ids, dtype="<u4").tobytes()
        return [self.known[w] for w in words]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        plain = [not any(t in text for t in self.added) for text in texts]
        data = np.frombuffer(b"\n".join(t if p else b"" for t, p in zip(texts, plain, strict=True)), dtype=np.uint8)
        out: list[np.ndarray] = [np.empty(0, dtype="<u4")] * len(texts)
        if len(data):
            starts, words = word_parts(data)
            coded = words.dictionary_encode()
            found = self.parts(coded.dictionary.to_pylist())
            which = coded.indices.to_numpy()
            sizes = np.array([len(f) // 4 for f in found] or [0], dtype=np.int64)
            flat = np.frombuffer(b"".join(found), dtype="<u4")
            firsts, n = np.cumsum(sizes) - sizes, sizes[which] if len(which) else np.empty(0, dtype=np.int64)
            ends = np.cumsum(n)
            ids = flat[np.repeat(firsts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate(([0], np.cumsum([len(t) + 1 if p else 1 for t, p in zip(texts, plain, strict=True)])))
            at = np.concatenate(([0], ends))[np.searchsorted(starts, bounds)]
            out = [ids[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return [o if p else self.whole(t) for o, p, t in zip(out, plain, texts, strict=True)]


@lru_cache(maxsize=2)
def part_encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    folder: str | None = None,
) -> DataFrame:
    """Encode every row and write the ids; the manifest: file (its number), path, n_docs, n_ids, first_id (the ids of all files before it).

    A document is the ids of its text followed by end_id; a null text is empty. Documents lie in ascending order of
    their ids (cast to long), null last; rows that share an id are ordered by their texts' hash, rows that are alike
    arbitrarily. A file is what one task of the sort holds: hot ids are spread over tasks, for the order goes on with
    hash and row. Tasks that are run again write files of new names, and the manifest names those that count. An empty
    table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "packed-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = part_encoder(tokenizer)
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.ids"
        end, sink, writer = np.array([end_id], dtype="<u4"), None, None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:  # some documents at a time
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BYTES_AT_ONCE, side="right")))
                for key, ids in zip(keys.slice(lo, hi - lo).to_pylist(), encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    if writer is None:
                        sink = store.open_output_stream(f"{base}/{name}")
                        writer = Writer(sink, width_of(max(encode.vocabulary, end_id + 1)), block_ids)
                    writer.add(key, np.concatenate((ids, end)))
                lo = hi
        if writer is not None:
            writer.close()
            sink.close()
            done = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [len(writer.keys)], [writer.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], ["file", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_last(), "hash", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    manifest = stored(placed.mapInArrow(write, "file long, path string, n_docs long, n_ids long"), "id-files")
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    return manifest.withColumn("first_id", F.coalesce(before, F.lit(0)))


def read_ids(manifest: DataFrame, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """A row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers), and the ids if asked for."""
    names = [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, base = file_system(path)
                with store.open_input_file(base) as source:
                    rows, held = [], 0
                    for key, start, found in Reader(source, source.size()).documents():
                        rows.append((key, first + start, len(found), zlib.crc32(found.tobytes()), found.tolist() if ids else None)[: len(names)])
                        held += len(found) if ids else 1
                        if held > 1 << 17:
                            yield table(rows)
                            rows, held = [], 0
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return manifest.select("path", "first_id").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def read_document(manifest: DataFrame, start: int, n: int) -> np.ndarray:
    """n ids from number `start` of the whole corpus on, read from the blocks that hold them and nothing else."""
    end = F.col("first_id") + F.col("n_ids")
    found = []
    for r in manifest.where((F.col("first_id") < start + n) & (end > start)).orderBy("first_id").collect():  # the files that hold the run
        store, base = file_system(r["path"])
        with store.open_input_file(base) as source:
            lo = max(start, r["first_id"])
            found.append(Reader(source, source.size()).read(lo - r["first_id"], min(start + n, r["first_id"] + r["n_ids"]) - lo))
    return np.concatenate(found) if found else np.empty(0, dtype="<u4")
