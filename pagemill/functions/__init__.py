"""Column functions: built-in expressions only, so all of them stay inside Catalyst; character references alone need Python."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Strings that stand for "no value" in extracted fields, and those that count against confidence.
EMPTY_VALUES = ("", "na", "n/a", "none", "null", "unknown", "-")
UNFILLED_VALUES = ("", "na", "n/a")


def domain_of(url: Column) -> Column:
    """The authority of an http(s) URL, '' if there is none (null: null)."""
    return F.regexp_extract(url, r"^https?://([^/]+)", 1)


def netloc(url: Column) -> Column:
    """The authority of a URL of any scheme, user and port included, '' if there is none (null: null)."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def is_empty(value: Column) -> Column:
    """Whether an extracted string says nothing: null or one of EMPTY_VALUES, case and outer space aside."""
    return F.coalesce(F.lower(F.trim(value)).isin(*EMPTY_VALUES), F.lit(True))


def is_unfilled(value: Column) -> Column:
    """Whether a field counts against confidence: null or one of UNFILLED_VALUES."""
    return F.coalesce(F.lower(F.trim(value)).isin(*UNFILLED_VALUES), F.lit(True))


def missing_fields(values: dict[str, Column], required: set[str]) -> Column:
    """Names of the fields without a value; a null counts only if the field is required."""
    parts = [F.when(v.isNull() & F.lit(name in required) | v.isNotNull() & is_empty(v), F.lit(name)) for name, v in values.items()]
    return F.array_compact(F.array(*parts))


def confidence(values: list[Column]) -> Column:
    """Share of the fields that are filled; 0 without fields."""
    if not values:
        return F.lit(0.0)
    return sum((F.when(is_unfilled(v), 0).otherwise(1) for v in values), F.lit(0)).cast("double") / len(values)


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("long")


def once(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(values: Column) -> Column:
    """The distinct values of an array in order, with how often each occurs: structs of value and n. One sort, then linear."""
    starts = lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda a: once(starts(a), lambda s: F.transform(s, lambda at, i: F.struct(F.get(a, at).alias("value"), (F.coalesce(F.get(s, i + 1), F.size(a)) - at).alias("n"))))
    return once(F.array_sort(values), runs)


def grams(text: Column, n: int) -> Column:
    """The set of n-character substrings, from the text's characters, which are told apart once: linear in the text."""

    def of(chars: Column) -> Column:
        last = F.size(chars) - n + 1
        windows = F.transform(F.slice(chars, 1, F.greatest(last, F.lit(1))), lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))
        return F.when(last > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(text, "")), of), F.lit(0))


def upper_by_character(text: Column) -> Column:
    """The text in upper case, a character for each: those that would become several (ß) stay, as in SQL engines that map characters singly."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of character bigrams."""
    x, y = grams(a, 2), grams(b, 2)
    both = F.size(x) + F.size(y)
    score = F.lit(2.0) * F.size(F.array_intersect(x, y)) / both
    same = F.when(a == b, 1.0).otherwise(0.0)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(both == 0, same).otherwise(score)


def jaccard(x: Column, y: Column) -> Column:
    """Jaccard index of two sets; 1 where both are empty."""
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def numbers_match(a: Column, b: Column, tolerance: float = 0.01, floor: float = 0.0) -> Column:
    """Whether two numbers agree within a share of the larger one."""
    top = F.greatest(F.abs(a), F.abs(b), F.lit(floor))
    return F.when(top == 0, F.lit(True)).otherwise(F.abs(a - b) / F.nullif(top, F.lit(0.0)) <= tolerance)


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """The text with all named and numeric character references resolved (null: null)."""
    return text.map(lambda t: unescape(t) if isinstance(t, str) and "&" in t else t)


def clean_markdown(text: Column) -> Column:
    """At most one blank line in a row, no space before line ends, no character references, no invisible characters, trimmed."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+(?=\n|$)", "")
    text = unescaped(text)
    text = F.regexp_replace(text, "[​‌‍﻿­]", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_currency(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\d.,]", "")


def strip_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def fenced_json(text: Column) -> Column:
    """The JSON of a fenced block in model output, else the whole text, trimmed; null where it is not JSON."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    found = F.trim(F.when(inner != "", inner).otherwise(text))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def http_class(status: Column) -> Column:
    """How a fetch ended: ok, retry (blocked, limited, overloaded), fatal (missing, unauthorised), error, or network."""
    return (
        F.when(status.isNull(), "network").when(status.isin(403, 429, 503), "retry").when(status.isin(401, 404, 407), "fatal")
        .when(status >= 400, "error").otherwise("ok")
    )


def backoff_seconds(attempt: Column, first: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """The wait before retry number `attempt` (from 1)."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(factor), attempt - 1))


def png_size(data: Column, default: tuple[int, int] = (1920, 1080)) -> Column:
    """Width and height from a PNG header, else the default."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    is_png = (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(data) >= 24)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(F.coalesce(is_png, F.lit(False)), size(number(17), number(21))).otherwise(size(F.lit(default[0]), F.lit(default[1])))
