"""Split Markdown into chunks for models with a limited window.

A text is measured as spans, its sections and, where one is too large, the paragraphs of that section. One fold deals
consecutive spans to chunks; contents are cut from the text at the end. The fold runs within one document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^#{1,6}\s+(.+)$", re.M)
TABLE_ROW = re.compile(r"^\|.*\|$", re.M)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
CONTINUED = "[...continued] "
#: Characters between the places where a chunk of sections is probed for tables, and what a paragraph's break adds to it.
PROBE, BREAK = 100, 2


class Span(NamedTuple):
    """A run of a text that no chunk divides. kin: 0 for a section, else the number of the section that it is a paragraph of."""

    start: int
    width: int
    title: str
    kin: int


def table_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges of runs of lines that begin and end with a pipe."""
    bare = [line.strip() for line in text.split("\n")]
    starts = [0, *accumulate(len(line) + 1 for line in text.split("\n"))]
    marks = [False, *(b.startswith("|") and b.endswith("|") for b in bare), False]
    edges = [starts[i] for i, (x, y) in enumerate(pairwise(marks)) if x != y]
    return list(zip(edges[::2], edges[1::2], strict=True))


def sections_of(text: str) -> list[Span]:
    """The text cut at its headings; what comes before the first is a section if it is not blank."""
    heads = list(HEADING.finditer(text))
    cuts = [m.start() for m in heads] or [0]
    titles = [m[1].strip() for m in heads] or [""]
    if cuts[0] and text[: cuts[0]].strip():
        cuts, titles = [0, *cuts], ["", *titles]
    return [Span(a, b - a, t, 0) for t, (a, b) in zip(titles, pairwise([*cuts, len(text)]), strict=True)]


def paragraphs_of(text: str, section: Span, kin: int) -> list[Span]:
    """A section cut at blank lines; each paragraph is as wide as with the break after it."""
    widths = [len(p) + BREAK for p in text[section.start : section.start + section.width].split("\n\n")]
    return [Span(section.start + at - w, w, section.title, kin) for w, at in zip(widths, accumulate(widths), strict=True)]


def dealt(text: str, limit: int) -> list[list[Span]]:
    """The spans of each chunk.

    A span joins the open chunk if that holds its like and has room. A section beyond the limit comes as paragraphs, but
    one with a table row that is under half as much again, and that an open chunk of sections has no room for, comes whole.
    """
    groups: list[list[Span]] = []
    used = 0
    for number, section in enumerate(sections_of(text), 1):
        sections_open = bool(groups) and groups[-1][0].kin == 0
        has_row = TABLE_ROW.search(text, section.start, section.start + section.width) is not None
        whole = section.width <= limit or has_row and section.width < 1.5 * limit and sections_open and used + section.width > limit
        for span in [section] if whole else paragraphs_of(text, section, number):
            if groups and groups[-1][0].kin == span.kin and used + span.width <= limit:
                groups[-1].append(span)
                used += span.width
            else:
                groups.append([span])
                used = span.width
    return groups


def extended(before: str, own: str, overlap: int) -> str:
    """A chunk's content after the last `overlap` sentences of the one before it, if that has more than those."""
    sentences = SENTENCE_END.split(before)
    return f"{CONTINUED}{' '.join(sentences[-overlap:])}\n\n{own}" if overlap and len(sentences) > overlap else own


def chunk_text(text: str, max_tokens: int = 4000, overlap: int = 2, chars_per_token: float = 4.0) -> list[dict]:
    """Chunks of at most max_tokens where sections and paragraphs allow it; a blank text has none, one within the limit is one as it stands.

    A chunk of sections is named by the last title up to its end and probed for tables every PROBE characters; one of
    paragraphs by its section, and searched for table rows. Each chunk opens with the last sentences of the one before, as extended.
    """
    limit = int(max_tokens * chars_per_token)
    if not text.strip():
        return []
    if len(text) <= limit:
        return [{"content": text, "start": 0, "end": len(text), "section": None, "has_table": False, "overlap_chars": 0, "tokens": int(len(text) / chars_per_token)}]
    edges = [e for span in table_spans(text) for e in span]
    titled = [""]
    rows = []
    for group in dealt(text, limit):
        titled += [s.title for s in group if s.title]
        start, width = group[0].start, sum(s.width for s in group)
        piece = text[start : start + width]
        if group[0].kin:  # the last paragraph's break is not the next section's
            piece = "\n\n".join(text[s.start : s.start + s.width - BREAK] for s in group)
        if piece.strip():
            section = group[0].title if group[0].kin else titled[-1] or None
            has_table = bool(TABLE_ROW.search(piece)) if group[0].kin else any(bisect_right(edges, p) % 2 for p in range(start, start + width, PROBE))
            rows.append({"content": piece.strip(), "start": start, "end": start + width, "section": section, "has_table": has_table, "tokens": int(width / chars_per_token)})
    whole = list(accumulate((r["content"] for r in rows), lambda before, own: extended(before, own, overlap)))
    return [{**r, "content": c, "overlap_chars": max(0, len(c) - len(r["content"]) - len(CONTINUED) - BREAK)} for r, c in zip(rows, whole, strict=True)]


def chunks(docs: DataFrame, key: str, text: str, max_tokens: int = 4000, overlap: int = 2, chars_per_token: float = 4.0) -> DataFrame:
    """key, index, total, content, start, end, section, has_table, overlap_chars, tokens.

    Texts that fit are one chunk and never leave the JVM; only longer ones reach Python. Null and blank texts give none.
    """
    limit = int(max_tokens * chars_per_token)
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.regexp_replace("t", r"\s+", "") != ""))
    whole = base.where(F.length("t") <= limit).select(
        "k", F.lit(0).alias("index"), F.lit(1).alias("total"), F.col("t").alias("content"), F.lit(0).cast("long").alias("start"), F.length("t").cast("long").alias("end"),
        F.lit(None).cast("string").alias("section"), F.lit(False).alias("has_table"), F.lit(0).alias("overlap_chars"), F.floor(F.length("t") / chars_per_token).cast("int").alias("tokens"),
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["content", "start", "end", "section", "has_table", "overlap_chars", "tokens"]
        for batch in batches:
            rows = [(k, i, len(found), *[c[n] for n in names]) for k, t in zip(batch["k"], batch["t"], strict=True) for found in [chunk_text(t, max_tokens, overlap, chars_per_token)] for i, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["k", "index", "total", *names])

    schema = f"k {kind}, index int, total int, content string, start long, end long, section string, has_table boolean, overlap_chars int, tokens int"
    return whole.unionByName(base.where(F.length("t") > limit).mapInPandas(split, schema)).withColumnRenamed("k", key)
