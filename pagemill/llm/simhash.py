"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its shingles. Equal fingerprints
are one node. Nodes are dealt to buckets so that any two within `max_bits` share one: the 64 bits are cut into
max_bits + 2 bands, and two fingerprints that differ in max_bits bits at most agree on two bands or more. In a bucket,
the Hamming distances of every node to the reference fingerprints (the pivots) are a table; a pair whose distances
differ by more than max_bits at any pivot is discarded, and the survivors are verified. A bucket that is too long for
a task is dealt again by bands of its other bits, and what is still too long by the words between two neighbours.
Connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored, unused
from .components import components

SHINGLE, SEED, MAX_BITS, PIVOTS = 4, 42, 4, 16
#: Runs of one bucket up to this length are compared pair by pair; longer ones are searched outward from each node.
SHORT_RUN = 48
#: Buckets beyond this length are dealt again, so that no task gathers more.
LONG_RUN = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: 0 if it has no word; a text of fewer words than a shingle is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # of bytes, both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, stops, strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(hashed, "id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def band_pairs(bits: list[int], max_bits: int) -> list[int]:
    """The masks of every pair of bands, of which max_bits + 2 cut the given bits evenly."""
    cuts = [round(len(bits) * i / (max_bits + 2)) for i in range(max_bits + 3)]
    masks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(masks, 2)]


def bands(max_bits: int = MAX_BITS) -> list[int]:
    """The masks of every pair of bands of the whole word."""
    return band_pairs(list(range(64)), max_bits)


def finer_bands(mask: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks that add to a mask every pair of bands of the other bits: two words within max_bits that agree on the mask agree on one of these."""
    return [mask | m for m in band_pairs([b for b in range(64) if not mask >> b & 1], max_bits)]


def flips(radius: int) -> np.ndarray:
    """All words of at most `radius` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], dtype=np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def run_links(fps: np.ndarray, max_bits: int, references: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the distinct fingerprints of one bucket exactly as all links within it do.

    Nodes are kept sorted by their distance to the first pivot, so a node's candidates are a slice of the table; those
    within max_bits at every other pivot are verified. A node that has been linked is searched from in its turn and
    never again compared with nodes found before, so dense groups cost little and emit one link a node.
    """
    table = np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    links: list[tuple[int, int]] = []
    while len(fps):
        stack = [(fps[0], table[0])]
        fps, table = fps[1:], table[1:]
        while stack and len(fps):
            node, at = stack.pop()
            lo, hi = np.searchsorted(table[:, 0], [at[0] - max_bits, at[0] + max_bits + 1])
            near = lo + np.flatnonzero((np.abs(table[lo:hi, 1:] - at[1:]) <= max_bits).all(axis=1))
            near = near[np.bitwise_count(fps[near] ^ node) <= max_bits]
            if len(near):
                links += [(int(node), int(x)) for x in fps[near]]
                stack += [(fps[k], table[k].copy()) for k in near]
                keep = np.ones(len(fps), dtype=bool)
                keep[near] = False
                fps, table = fps[keep], table[keep]
    return links


def compared(dealt: DataFrame, max_bits: int, references: np.ndarray, masks: list[int] | None, long_run: int | None) -> DataFrame:
    """dealt (fp, band, key) -> (a, b, band): links that connect each bucket (band, key) as all links within it do.

    masks: those of the bands, if every node is in the bucket of each; a link is then told in the first of its buckets
    if that is short. A bucket of more than long_run nodes gives a row (fp, null, band) for each of them in place of links.
    """
    unsigned = np.array(masks, dtype=np.uint64) if masks else None

    def out(a: np.ndarray, b: np.ndarray | None, band: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(b.view(np.int64)) if b is not None else pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), ends, pa.array(band.astype(np.int32))], ["a", "b", "band"])

    def whole_runs(fp: np.ndarray, band: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]))))
        lengths = np.diff(np.append(starts, len(fp)))
        run = np.repeat(np.arange(len(starts)), lengths)
        words = fp.view(np.uint64)
        at = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths))
        table = np.bitwise_count(words[at][:, None] ^ references[None, :]).astype(np.int16)
        w, r, b = words[at], run[at], band[at]
        for d in range(1, min(SHORT_RUN, len(at))):
            same = np.flatnonzero(r[d:] == r[:-d])
            if not len(same):
                break
            near = same[(np.abs(table[same + d] - table[same]) <= max_bits).all(axis=1)]
            near = near[np.bitwise_count(w[near] ^ w[near + d]) <= max_bits]
            if unsigned is not None:
                near = near[np.argmax((unsigned[None, :] & (w[near] ^ w[near + d])[:, None]) == 0, axis=1) == b[near]]
            if len(near):
                yield out(w[near], w[near + d], b[near])
        for k in np.flatnonzero(lengths > SHORT_RUN):
            own = words[starts[k] : starts[k] + lengths[k]]
            if long_run is not None and lengths[k] > long_run:
                yield out(own, None, np.full(len(own), band[starts[k]]))
            elif found := run_links(own, max_bits, references):
                both = np.array(found, dtype=np.uint64)
                yield out(both[:, 0].copy(), both[:, 1].copy(), np.full(len(both), band[starts[k]]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        passed = None  # a bucket known to be too long, whose nodes pass by
        for batch in batches:
            now = tuple(np.asarray(batch.column(i)) for i in range(3))
            if not len(now[0]):
                continue
            if passed is not None:
                n = int(((now[1] == passed[0]) & (now[2] == passed[1])).sum())
                yield out(now[0][:n].view(np.uint64), None, now[1][:n])
                now = tuple(x[n:] for x in now)
                if not len(now[0]):
                    continue
                passed = None
            if held and (held[-1][1][-1], held[-1][2][-1]) == (now[1][-1], now[2][-1]):  # all of one run: gathered without copying
                held.append(now)
            else:
                held.append(now)
                fp, band, key = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.flatnonzero((band != band[-1]) | (key != key[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from whole_runs(fp[:cut], band[:cut], key[:cut])
                held = [(fp[cut:], band[cut:], key[cut:])]
            # All that is held is one run but for the first part's beginning, which whole_runs has taken.
            if long_run is not None and sum(len(x[0]) for x in held) > long_run and held[0][1][0] == held[-1][1][-1] and held[0][2][0] == held[-1][2][-1]:
                passed = (held[-1][1][-1], held[-1][2][-1])
                for x in held:
                    yield out(x[0].view(np.uint64), None, x[1])
                held = []
        if held:
            yield from whole_runs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    met = dealt.select("fp", F.col("band").cast("int").alias("band"), "key").repartition("band", "key").sortWithinPartitions("band", "key", "fp")
    return met.mapInArrow(compare, "a long, b long, band int")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS, long_run: int = LONG_RUN) -> DataFrame:
    """(a, b) over distinct fp: every component of the graph of pairs within max_bits is connected by these links.

    No task gathers more than long_run nodes of a bucket. Longer ones are dealt again by pairs of bands of the bits in
    which their nodes may differ. A group so dense that this leaves long buckets is dealt by the words within half of
    max_bits of each node: two neighbours share one, and each has at most as many nodes as there are words around it.
    """
    masks, references = bands(max_bits), pivots(n_pivots)
    first = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("band", "key")
    found = stored(compared(nodes.select("fp", first), max_bits, references, masks, long_run), "links")
    told = found.where("b IS NOT NULL").select("a", "b")
    long = found.where("b IS NULL")
    if not long.limit(1).count():
        return told
    finer = [finer_bands(m, max_bits) for m in masks]
    again = F.array(*[F.array(*[F.lit(signed(m)) for m in ms]) for ms in finer])[F.col("band")]
    second = long.select(F.col("a").alias("fp"), "band", F.posexplode(again).alias("sub", "mask"))
    second = second.select("fp", (F.col("band") * len(finer[0]) + F.col("sub")).alias("band"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    found = stored(compared(second, max_bits, references, None, long_run), "links")
    told = told.union(found.where("b IS NOT NULL").select("a", "b"))
    long = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if not long.limit(1).count():
        return told
    around = flips(-(-max_bits // 2)).view(np.int64)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0))
            for lo in range(0, len(fps), 32):
                some = fps[lo : lo + 32]
                keys = (some[:, None] ^ around[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(around))), pa.array(np.zeros(len(keys), dtype=np.int32)), pa.array(keys)], ["fp", "band", "key"])

    third = long.mapInArrow(neighbours, "fp long, band int, key long")
    return told.union(compared(third, max_bits, references, None, None).select("a", "b"))


def memberships(rows: DataFrame, max_bits: int) -> DataFrame:
    """rows (id, fp) -> node (each distinct fp), root of its component (an fp) and component_id."""
    nodes = rows.groupBy("fp").agg(F.min("id").alias("low"))
    found = components(links(nodes.select("fp"), max_bits))
    rooted = stored(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")  # so that the join can split a hot component
    return stored(rooted.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("node"), "root", "component_id"), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id that links lead to) of every row.

    A null or empty text, or one without words, has fingerprint zero, which links like any other. Rows that repeat an
    id are kept, all linked by having one id only if their fingerprints link. A null id is never a component_id unless
    the component has no other. An empty table gives an empty one. Other columns of docs are ignored.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    members = memberships(rows, max_bits)
    named = rows.join(members, rows["fp"] == members["node"])
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs with exactly one row of each component: the smallest id (null last), and of rows that repeat it there the first by text.

    Components are told by their fingerprints and rows by a key that is stored with them, never by ids: these may be null or repeat.
    """
    row, fp = unused(docs, "__row"), unused(docs, "__fp")
    names, at = [*docs.columns, fp], docs.columns.index(text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at).cast(pa.string())), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names)

    keyed = stored(docs.mapInArrow(hashed, StructType([*docs.schema.fields, StructField(fp, LongType())])).withColumn(row, F.monotonically_increasing_id()), "keyed")
    rows = keyed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(fp).alias("fp"))
    members = memberships(rows, max_bits)
    least = rows.join(members, rows["fp"] == members["node"]).where(F.col("id").eqNullSafe(F.col("component_id")))
    least = stored(least.select("row", "root"), "least")
    counts = stored(least.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")), "least-counts")
    # One plan at every size: the kept rows grow with the documents, so they are never sent to all tasks.
    chosen = lambda some: keyed.join(some.select("row").hint("merge"), keyed[row] == some["row"], "left_semi").select(*docs.columns)
    if not counts.where("n > 1").limit(1).count():
        return chosen(counts)
    tied = least.join(counts.where("n > 1").select("root"), "root")
    tied = keyed.select(F.col(row).alias("__tied"), F.col(text_col).alias("text")).join(tied.hint("merge"), F.col("__tied") == F.col("row"))
    first = tied.groupBy("root").agg(F.min(F.struct(F.col("text").isNull(), "text", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return chosen(counts.where("n = 1").select("row").unionByName(first))
