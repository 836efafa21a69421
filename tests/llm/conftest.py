import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "fp", "size", "key", "src", "bucket", "score", "group", "piece", "__id", "__passes", "__place", "hashes", "n", "v", "component_id", "passes", "start")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, clashing columns."""
    words = "the of and thing erth ation ouble " * 30
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "de", None, 3), (4, words, "en", "b", 1), (4, words, "en", "b", 1), (5, words, "fr", "b", 1),
        (None, "one two three four five six", None, None, None), (None, None, None, None, None), (6, "ä" * 300_000, "de", "c", 9), (7, "word " * 60_000, "en", "c", 9), (8, "x", "en", "", 1), (9, "1 2 3 !!", "en", "d", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for i, c in enumerate(CLASHES):  # columns of every operator
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(i))
    return df


@pytest.fixture(scope="session")
def sql():
    def run(query, folder=SF, **views):
        c = duckdb.connect()
        for t in ("documents", "pages", "labels", "embeddings"):
            if t not in views:
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        for name, frame in views.items():
            c.register(name, frame)
        got = c.sql(query)
        return sorted(got.columns), {tuple(x for _, x in sorted(zip(got.columns, r, strict=True))) for r in got.fetchall()}

    return run


def as_set(df):
    cols = sorted(df.columns)
    return cols, {tuple(r[c] for c in cols) for r in df.collect()}
