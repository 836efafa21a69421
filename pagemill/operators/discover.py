"""Schemas found in pages, schemas as Spark types, and the seam where a model may take over."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import materialised
from . import html

# Names of field types and the Spark types they stand for. Others are strings.
FIELD_TYPES = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.StringType(), "date": T.StringType(), "url": T.StringType(),
    "list[str]": T.ArrayType(T.StringType()), "list[int]": T.ArrayType(T.LongType()), "list[float]": T.ArrayType(T.DoubleType()),
}
ACCEPT, HYBRID_BONUS = 0.3, 0.1


def struct_type(fields: list[dict]) -> T.StructType:
    """[{name, type, required?}] as a Spark schema; optional fields are nullable."""
    return T.StructType([T.StructField(f["name"], FIELD_TYPES.get(f["type"], T.StringType()), not f.get("required", False)) for f in fields])


def type_name(entity: str) -> str:
    """An entity's name in PascalCase, as a generated class would carry it."""
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", entity) if p) or "Entity"


def type_source(entity: str, fields: list[dict]) -> str:
    """The schema as DDL text."""
    return f"{type_name(entity)} STRUCT<" + ", ".join(f"{f['name']}: {FIELD_TYPES.get(f['type'], T.StringType()).simpleString()}" for f in fields) + ">"


def schema_hash(entity: Column, fields: Column) -> Column:
    """A short hash of entity and fields; fields: array of structs (name, type)."""
    text = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",")
    return F.substring(F.sha2(F.concat(entity, F.lit(":"), text), 256), 1, 16)


def typed(rows: DataFrame, json: str, fields: list[dict], into: str = "entity") -> DataFrame:
    """JSON text as a struct of the schema; null where it is not JSON. Fields of another type are null."""
    return rows.withColumn(into, F.from_json(F.col(json), struct_type([f | {"required": False} for f in fields]), {"mode": "PERMISSIVE"})).withColumn(
        f"{into}_valid", F.col(into).isNotNull() & ~F.exists(F.array(*[F.col(f"{into}.{f['name']}").isNull() for f in fields if f.get("required")] or [F.lit(False)]), lambda x: x)
    )


def value_type(value: Column) -> Column:
    """int, float, url or str by the look of a text."""
    return (
        F.when(F.rlike(value, F.lit(r"^\s*[-+]?\d+\s*$")), "int").when(F.rlike(value, F.lit(r"^\s*[$€£]?\s*[-+]?\d[\d,]*\.\d+\s*$")), "float")
        .when(F.rlike(value, F.lit(r"^\s*https?://\S+\s*$")), "url").otherwise("str")
    )


def _tests(tag: Column, attrs: Column) -> Column:
    """Selectors of one element by itself: its tag, its tag with its id or with each of its classes."""
    get = lambda n: F.coalesce(F.element_at(attrs, F.lit(n)), F.lit(""))
    plain = lambda c: F.rlike(c, F.lit(r"^[A-Za-z_][A-Za-z0-9_-]*$"))
    classes = F.transform(F.filter(F.array_distinct(F.split(get("class"), r"\s+")), plain), lambda c: F.concat(tag, F.lit("."), c))
    ids = F.when(plain(get("id")), F.array(F.concat(tag, F.lit("#"), get("id")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(tag), classes, ids)


def candidate_selectors(all_nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pre and each selector of one, two or three child steps that names the node, among others or alone."""
    own = all_nodes.where(F.rlike("tag", F.lit(r"^[a-z][a-z0-9-]*$"))).select(key, "pre", "parent", _tests(F.col("tag"), F.col("attrs")).alias("t1"))
    above = lambda n, t, up: own.select(F.col(key).alias(f"__k{n}"), F.col("pre").alias(f"__p{n}"), F.col("t1").alias(t), F.col("parent").alias(up))
    chained = own.join(above(2, "t2", "up2"), (F.col(key) == F.col("__k2")) & (F.col("parent") == F.col("__p2")), "left")
    chained = chained.join(above(3, "t3", "up3"), (F.col(key) == F.col("__k3")) & (F.col("up2") == F.col("__p3")), "left")
    crossed = lambda outer, inner: F.flatten(F.transform(outer, lambda a: F.transform(inner, lambda b: F.concat(a, F.lit(" > "), b))))
    two = F.coalesce(crossed(F.col("t2"), F.col("t1")), F.array().cast("array<string>"))
    three = F.coalesce(crossed(F.col("t3"), two), F.array().cast("array<string>"))
    return chained.select(key, "pre", F.explode(F.array_distinct(F.concat("t1", two, three))).alias("selector"))


def induced(all_nodes: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """The shortest selector of each set of nodes that names them all and no other node of the page: key, set, selector (null if none does).

    wanted: key, set and pre. Every node tells the selectors that name it; a selector fits a set if as many of the set
    as there are, and as many of the page, tell it. Ties go to the first in the order of letters.
    """
    told = candidate_selectors(all_nodes, key)
    total = told.groupBy(key, "selector").agg(F.count(F.lit(1)).alias("all"))
    inside = told.join(wanted, [key, "pre"]).groupBy(key, "set", "selector").agg(F.count(F.lit(1)).alias("hits"))
    sizes = wanted.groupBy(key, "set").agg(F.count(F.lit(1)).alias("size"))
    fit = inside.join(sizes, [key, "set"]).where("hits = size").join(total, [key, "selector"]).where(F.col("all") == F.col("size"))
    best = fit.groupBy(key, "set").agg(F.min(F.struct(F.length("selector").alias("n"), "selector"))["selector"].alias("selector"))
    return sizes.select(key, "set").join(best, [key, "set"], "left")


def discover(all_nodes: DataFrame, key: str = "page_id", least: int = 3) -> DataFrame:
    """key, structure, count, fields, confidence, selector: the structure that recurs most on a page, with the leaves of its first element as fields.

    A field is named by its first class, else by its tag. Confidence grows with the count and has a bonus for being
    told by structure; pages without a structure above ACCEPT are absent, for a model to look at. selector names the
    structure's elements and no others; a field has one that names its leaf of every element, at the same place in
    each, and nothing else. They are null where no selector of up to three child steps does that.
    """
    told = materialised(html.structures(all_nodes, key, least=least), "structures")
    found = html.repeated_subtrees(all_nodes, key, least, told=told)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first_pre"))
    top = found.withColumn("place", best).where("place = 1").withColumn("confidence", F.least(F.lit(1.0), F.col("count") / 10 + HYBRID_BONUS)).where(F.col("confidence") > ACCEPT)
    top = materialised(top, "top-structures")
    elements = told.join(top.select(key, "structure", "first_pre"), [key, "structure"]).select(F.col(key).alias("__k"), F.col("pre").alias("element"), "first_pre")
    spans = elements.join(all_nodes.select(key, "pre", "post"), (F.col("__k") == F.col(key)) & (F.col("element") == F.col("pre"))).select("__k", "element", "first_pre", F.col("post").alias("__post"))
    # Elements of one structure have their nodes at the same distances from their tops.
    inner = all_nodes.join(spans, (F.col(key) == F.col("__k")) & F.col("pre").between(F.col("element"), F.col("__post")))
    inner = inner.select(key, "pre", "tag", "attrs", "own_text", (F.col("pre") - F.col("element")).alias("at"), (F.col("element") == F.col("first_pre")).alias("first"))
    leaves = inner.where("first").where(F.trim("own_text") != "")
    label = F.split(html.attribute("class"), r"\s+")[0]
    named = leaves.select(key, "at", "pre", F.when(label != "", label).otherwise(F.col("tag")).alias("name"), value_type(F.col("own_text")).alias("type"))
    # Set -1: the elements; the others: the leaves at one distance.
    sets = inner.where("at = 0").select(key, F.lit(-1).alias("set"), "pre").union(inner.join(named.select(key, "at"), [key, "at"]).select(key, F.col("at").alias("set"), "pre"))
    selectors = materialised(induced(all_nodes, sets, key), "selectors")
    fields = named.join(selectors.withColumnRenamed("set", "at"), [key, "at"], "left")
    fields = fields.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pre", "name", "type", "selector"))).alias("f"))
    whole = top.join(fields, key).join(selectors.where("set = -1").select(key, "selector"), key, "left")
    as_field = lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["selector"].alias("selector"))
    return whole.select(key, "structure", "count", F.transform("f", as_field).alias("fields"), "confidence", "selector")


def with_model(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], schema: str) -> DataFrame:
    """The seam for models: call gets batches of some columns and returns rows of the schema. It runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield call(batch)

    return rows.select(*columns).mapInPandas(run, schema)
