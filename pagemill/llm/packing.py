"""Vector best-fit packing of tokenised documents into fixed-length sequences.

Documents become ids, longer ones are cut into full-length pieces, and pieces are packed in groups of bounded size
dealt by hash. Within a group, pieces go in decreasing length to the open bin that fits under every capacity (tokens,
documents, attention cost) and that scores best. Only piece lengths travel to the packer, never texts or ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TOKENIZER = "byte_bpe_50k.json"
END_ID, LENGTH = 2, 1024
#: Pieces in a sequence at most, and the weights of the residual tokens, documents and attention cost in the choice of a bin.
MAX_DOCUMENTS, WEIGHTS = 256, (1.0, 1.0, 1.0)


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The encoding of a tokenizers file of byte-level BPE, as a function from text to ids: those of
    Tokenizer.from_file(path).encode(text, add_special_tokens=False), strings of added tokens included.

    Ids of such a file rank its merges, so the vocabulary and the added tokens define the encoding, and a faster encoder
    is built of them. Its pattern engine gives up on some runs of white space; such texts go to the library's own.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except ValueError:
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def piece_bounds(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all full but the first, which has the remainder."""
    first = n if n <= length else n % length
    starts = ([0] if first else []) + list(range(first, n, length))
    return [(s, (first if s == 0 and first else length)) for s in starts]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_bpe(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                rows += [(key, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(piece_bounds(len(ids), length))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Ids travel as text so that a null stays a null whatever their type.
    out = base.withColumn("id", F.col("id").cast("string")).mapInPandas(pieces, "id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. capacity and weights: tokens, documents, attention cost (sum of squared lengths).

    score "norm": the bin whose weighted residual norm after placement is least; "dot": the one whose weighted
    residual has the largest dot product with the piece's needs. Ties go to the oldest bin.
    """
    cap = np.asarray(capacity, dtype=np.float64)
    scale = np.asarray(weights, dtype=np.float64) / cap
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    rest = np.empty((3, max(1, len(lengths))), dtype=np.float64)  # residuals of bins that may still take a piece
    names = np.empty(max(1, len(lengths)), dtype=np.int64)
    n_open = n_bins = 0
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if len(lengths) else 0
    least = np.array([smallest, 1, smallest * smallest], dtype=np.float64)
    for at in order:
        need = np.array([lengths[at], 1, float(lengths[at]) ** 2])
        if (need > cap).any():
            raise ValueError(f"a piece of {lengths[at]} tokens exceeds the capacity {capacity}")
        left = rest[:, :n_open] - need[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            near = left[:, fits] * scale[:, None]
            value = (near * near).sum(axis=0) if score == "norm" else -((rest[:, fits] * scale[:, None]) * (need * scale)[:, None]).sum(axis=0)
            k = fits[int(np.argmin(value))]
        else:
            k = n_open
            rest[:, k], names[k] = cap, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[at], offsets[at] = names[k], int(cap[0] - rest[0, k])
        rest[:, k] -= need
        if (rest[:, k] < least).any():  # full: the smallest piece no longer fits
            n_open -= 1
            rest[:, k : n_open], names[k:n_open] = rest[:, k + 1 : n_open + 1].copy(), names[k + 1 : n_open + 1].copy()
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    max_documents: int = MAX_DOCUMENTS,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
    group_pieces: int = 16_384,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids followed by end_id; a null text is empty, so its document is end_id alone. Documents of
    more than `length` ids are cut into pieces of `length`, the first of which may be shorter. max_documents bounds
    the pieces in a sequence and max_cost the sum of their squared lengths (default: length squared, which one full
    piece needs and no sequence within `length` tokens exceeds). All three residuals enter the choice by their weights. A group has about group_pieces pieces, however many there are
    in all and however often a row repeats. Rows that repeat an id are packed each for itself, also where the id is null. An empty table gives an empty one.
    """
    capacity = (length, max_documents, max_cost or length * length)
    pieces = stored(token_pieces(docs, id_col, text_col, tokenizer, length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["length", "id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, weights, score)
        return table.assign(sequence_id=(table["group"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets).drop(columns="group")

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long")).withColumn("id", F.col("id").cast("string"))
    packed = dealt.groupBy("group").applyInPandas(pack, "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
