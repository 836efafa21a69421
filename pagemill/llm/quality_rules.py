"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once a document. The ledger keeps the measurements and one failure bit a rule; a policy is a
version with a mask of the rules it enforces. Verdicts and ablations read the bits alone, never the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, word_array

SYMBOLS = r"[#*$%&|<>]"

#: Name and failing condition over the measurements, by bit. Bits are appended, never reused.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("shouting", "100 * n_shouted > 60 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policies by version: the mask of rules that reject.
POLICIES: dict[int, int] = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["repeated_lines"],
    3: BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["shouting"],
}
CURRENT = 3


def repeated_words(words: Column) -> Column:
    """The number of positions that lie in a window of three words found at least twice.

    Windows whose 64-bit hashes all differ all differ; where some agree, windows are ordered and compared by their words too.
    """

    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(at: Column) -> Column:  # each place covers three words, up to the next place
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)

    def places(ranked: Column) -> Column:
        alike = lambda e, o: F.coalesce((e["h"] == o["h"]) & (e["w"] == o["w"]), F.lit(False))
        kept = F.transform(ranked, lambda e, i: F.when(alike(e, F.get(ranked, i - 1)) | alike(e, F.get(ranked, i + 1)), e["i"]))
        return F.sort_array(F.array_compact(kept))

    def count(w: Column) -> Column:
        def of(h: Column) -> Column:
            named = F.transform(h, lambda x, i: F.struct(x.alias("h"), F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(named), places), covered))

        return let(windows(w), of)

    return let(words, count)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_shouted, n_repeat_words, all of the whole text."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    shouted = lambda w: F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x))))
    measured = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        shouted(w).cast("long").alias("n_shouted"),
        repeated_words(w).alias("n_repeat_words"),
    )
    by_line = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = base.select("id", let(word_array(F.col("text")), measured).alias("w"), let(lines, by_line).alias("l"), F.regexp_count(F.col("text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return out.select("id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_shouted", "w.n_repeat_words").withColumnRenamed("id", id_col)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `fail_bits`, bit i set if rule i fails.

    A null text counts as empty. Rows that repeat stay apart; an empty table gives an empty ledger; other columns of
    docs are ignored, whatever their names.
    """
    bits = sum((F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)), F.lit(0))
    return measurements(docs, id_col, text_col).withColumn("fail_bits", bits.cast("int"))


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", failed(BASE)).withColumn("kept", ~failed(POLICIES[version] | BASE))


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A row for each rule of a policy: n_failed, n_only (rejected by this rule alone, so kept without it), n_kept_without.

    Documents are first counted by bit pattern, of which there are at most 2 ** len(RULES); rules then read patterns.
    """
    mask = POLICIES[version]
    names = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = patterns.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in names])))
    has, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("r.rule").agg(total(has).alias("n_failed"), total(has & rest).alias("n_only"), total(rest).alias("n_kept_without"))


ORACLE = r"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS rid, doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
         LIST_FILTER(STRING_SPLIT(COALESCE(text, ''), CHR(10)), lambda x: REGEXP_MATCHES(x, '[^\x20\x09-\x0D]')) AS lines,
         LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[#*$%&|<>]')) AS n_symbols
  FROM documents),
t AS (SELECT rid, UNNEST(w) AS x, UNNEST(RANGE(1, LEN(w) + 1)) AS i FROM d),
g AS (SELECT rid, i, x, LEAD(x) OVER s AS y, LEAD(x, 2) OVER s AS z FROM t WINDOW s AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, x, y, z) AS c FROM g WHERE z IS NOT NULL),
v AS (SELECT rid, LEAST(3, COALESCE(LEAD(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS covers FROM h WHERE c > 1),
r AS (SELECT rid, SUM(covers) AS n FROM v GROUP BY rid),
m AS (
  SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(LENGTH(ARRAY_TO_STRING(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(LEN(lines) AS BIGINT) AS n_lines, CAST(LEN(lines) - LEN(LIST_DISTINCT(lines)) AS BIGINT) AS n_dup_lines,
         LEN(LIST_FILTER(w, lambda x: x = UPPER(x) AND x <> LOWER(x))) AS n_shouted, CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_shouted > 60 * n_words) AS kept
FROM m
"""
