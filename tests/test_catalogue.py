"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import math
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(f"{float(v):.8g}")
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in plans.ORACLES:
        assert rows
        return
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall()) == rows


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "total_crawls", "successful", "avg_confidence"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_llm_subpackage():
    root = os.path.dirname(os.path.abspath(plans.__file__))
    for f in glob.glob(f"{os.path.dirname(root)}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            text = open(f).read()
            assert not re.search(r"\bllm\b", text), f
