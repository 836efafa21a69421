"""Numbering and look-back over ranges, boxes on a grid, PNG files: against loops and literal files."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import change, geometry, pictures as P, ranges, telemetry


@pytest.mark.parametrize("keys", [["hot"], ["a", None, "hot", "hot", "hot"]])
def test_numbers_and_rows_before(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice(keys), rng.randint(0, 300), i, f"v{i}" if i % 5 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v string").repartition(5)
    got = {r.i: r.place for r in ranges.numbered(df, ["k"], ["t", "i"], ranges=8).collect()}
    old = {r.i: (r.old_i, r.old_v) for r in ranges.looked_back(df, ["k"], ["t", "i"], ["i", "v"], ranges=8).collect()}
    for k in set(keys):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
        assert [old[r[2]] for r in own] == [(None, None), *((r[2], r[3]) for r in own[:-1])]
    sizes = [r["count"] for r in ranges.ranged(df, ["k"], ["t", "i"], 8).groupBy("__range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 300  # no task holds a key with all rows
    assert ranges.numbered(df.limit(0), ["k"], ["t"]).count() == 0 and ranges.looked_back(df.limit(0), ["k"], ["t"], ["v"]).count() == 0
    out = telemetry.batches(df.drop("v"), ["k"], ["t", "i"], 100, ranges=8).collect()
    hot = sum(r[0] == "hot" for r in rows)
    assert sorted(r.n for r in out if r.k == "hot") == sorted([100] * (hot // 100) + [hot % 100] * (hot % 100 > 0))


def greedy(boxes, threshold):
    group, n = [-1] * len(boxes), 0
    for i, a in enumerate(boxes):
        if group[i] >= 0:
            continue
        for j in range(i, len(boxes)):
            b = boxes[j]
            gaps = [max(0, b[k] - a[k] - a[k + 2], a[k] - b[k] - b[k + 2]) for k in (0, 1)]
            if group[j] < 0 and (gaps[0] ** 2 + gaps[1] ** 2) ** 0.5 <= threshold:
                group[j] = n
        n += 1
    return group


def test_boxes_on_a_grid(spark):
    rng = random.Random(6)
    pages = {p: [(rng.randint(-200, 900), rng.randint(-50, 900), rng.choice([0, 3, 20, 400]), rng.choice([1, 9, 60, 300])) for _ in range(rng.randint(1, 60))] for p in (1, 2, None)}
    pages[4] = [(0, 0, 10, 10)] * 5 + [(60, 0, 10, 10), (61, 0, 10, 10), (10, 60, 5, 5)]  # exactly at the threshold, and beyond
    df = spark.createDataFrame([(p, i, *b) for p, bs in pages.items() for i, b in enumerate(bs)], "page int, i int, x int, y int, width int, height int")
    for threshold in (50.0, 0.0, 7.5):
        got = {(r.page, r.i): r.grp for r in geometry.group_by_nearness(df, "page", "i", threshold).collect()}
        for p, bs in pages.items():
            assert [got[p, i] for i in range(len(bs))] == greedy(bs, threshold), (p, threshold)
    assert geometry.group_by_nearness(df.limit(0), "page", "i").count() == 0


def test_twenty_thousand_boxes_on_one_page(spark):
    boxes = spark.range(20_000).selectExpr("1 AS page", "CAST(id AS INT) AS i", "CAST(id % 200 * 70 AS INT) AS x", "CAST(id DIV 200 * 70 AS INT) AS y", "30 AS width", "30 AS height")
    out = geometry.group_by_nearness(boxes, "page", "i")
    assert out.count() == 20_000 and out.select("grp").distinct().count() == 10_000  # a box takes the neighbours beside and below it, none across
    assert geometry.near_pairs(boxes, "page", "i").count() < 100_000


def png(width, height, depth, colour, rows, filters, palette=None):
    """A file from raw rows, each told by a filter as the format defines it, byte by byte."""
    step = max(1, P.SAMPLES[colour] * depth // 8)
    raw, above = b"", bytes(len(rows[0]))
    for row, f in zip(rows, filters, strict=True):
        out = bytearray()
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))
            out.append((x - [0, a, b, (a + b) // 2, paeth][f]) % 256)
        raw += bytes([f]) + bytes(out)
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"")
    packed = zlib.compress(raw)
    return P.SIGNATURE + head + chunk(b"tEXt", b"x\0y") + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([(0, 8), (2, 8), (4, 8), (6, 8), (3, 8), (0, 1), (0, 4), (3, 2), (0, 16), (2, 16)]), st.integers(1, 9), st.integers(1, 6), st.data())
def test_every_filter_and_colour_type(kind, width, height, data):
    colour, depth = kind
    samples, rng = P.SAMPLES[colour], np.random.default_rng(data.draw(st.integers(0, 10**6)))
    values = rng.integers(0, 4 if colour == 3 else 1 << depth, (height, width, samples))
    palette = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    rows = []
    for line in values.reshape(height, -1).tolist():
        bits = "".join(f"{v:0{depth}b}" for v in line)
        bits += "0" * (-len(bits) % 8)
        rows.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    file = png(width, height, depth, colour, rows, data.draw(st.lists(st.integers(0, 4), min_size=height, max_size=height)), palette.tobytes() if colour == 3 else None)
    whole = {16: lambda v: v >> 8, 8: lambda v: v}.get(depth, lambda v: v * 255 // ((1 << depth) - 1))
    for y in range(height):
        for x in range(width):
            r, g, b = (palette[values[y, x, 0]].tolist() if colour == 3 else [int(whole(v)) for v in values[y, x, :3]] if samples >= 3 else [0, 0, 0])
            want = (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 if colour in (2, 3, 6) else int(whole(values[y, x, 0]))
            assert P.decode(file)[y, x] == want


def test_what_is_no_picture_is_null(spark):
    good = P.encode(np.arange(12).reshape(3, 4))
    assert P.decode(good).tolist() == np.arange(12).reshape(3, 4).tolist()
    broken = [None, b"", b"GIF8", good[:20], good[:-20], good[:40] + b"\0" + good[41:]]
    assert [P.decode(x) for x in broken] == [None] * len(broken)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([good, *broken])], "i int, f binary")
    assert [r.p for r in df.select("i", P.grey_pixels()("f").alias("p")).orderBy("i").collect()] == [list(map(float, range(12)))] + [None] * len(broken)


def test_area_means_and_the_hashes_behind_them(spark):
    x = np.arange(48, dtype=float).reshape(6, 8)
    assert P.area_means(x, 3, 4).tolist() == x.reshape(3, 2, 4, 2).mean(axis=(1, 3)).tolist() and P.area_means(x, 6, 8).tolist() == x.tolist()
    assert P.area_means(np.array([[0.0, 3.0, 6.0]]), 1, 2)[0] == pytest.approx([1.0, 5.0])  # the middle pixel is shared
    rng = np.random.default_rng(2)
    one, other = rng.integers(0, 256, (40, 50)), rng.integers(0, 256, (40, 50))
    df = spark.createDataFrame([(1, P.encode(one)), (2, P.encode(one)), (3, P.encode(other))], "i int, f binary")
    small = df.select("i", change.perceptual_hash(P.grey_pixels(32)("f")).alias("h"))
    a, b, c = (r.h for r in small.orderBy("i").collect())
    assert a == b != c
    close = small.alias("x").crossJoin(small.alias("y")).where("x.i = 1").select("y.i", change.perceptual_similarity(F.col("x.h"), F.col("y.h")).alias("s"))
    assert {r.i: r.s for r in close.collect()}[2] == 1.0


def test_quantiles_are_those_of_one_buffer(spark):
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), (None, 101), ("hot", 4000)) for v in [float(i * 7919 % 997) for i in range(n)]] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() if r.q}
    for n in (1, 8):
        got = {r.k: r.q for r in ranges.quantiles(df, ["k"], "v", shares, "q", n).collect()}
        assert got.keys() == want.keys() == {"a", "b", None, "hot"}
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert ranges.quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_sketches_against_exact_aggregates(spark):
    from pagemill.plans import QUERIES

    d = "/root/testdata/sf0.01"
    exact = lambda t, by, key, v: {r[0]: r for r in spark.read.parquet(f"{d}/{t}.parquet").groupBy(by).agg(F.count_distinct(key), F.percentile(v, F.array(F.lit(0.45), F.lit(0.55)))).collect()}
    for name, of, column in (("approximate_distinct", ("lineitem", "l_returnflag", "l_orderkey", "l_extendedprice"), "orders"), ("merged_sketches", ("events", "event_type", "user_id", "value"), "users")):
        want = exact(*of)
        got = QUERIES[name](spark, d).collect()
        assert len(got) == len(want)
        for r in got:
            _, n, (low, high) = want[r[0]]
            assert abs(r[column] - n) <= 0.06 * n and low <= r.p50 <= high


def test_sketches_stand_beside_exact_results(spark):
    from pagemill.plans import ORACLES, QUERIES

    for name, by, count in (("approximate_distinct", "l_returnflag", "orders"), ("merged_sketches", "event_type", "users")):
        rows = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert name in ORACLES and {by, count, f"{count}_close", "median_close", "p50"} <= set(rows.columns)
        assert all(r[f"{count}_close"] and r.median_close for r in rows.collect())


def test_sketches_of_small_groups_give_the_rows_of_their_sql(spark, tmp_path):
    """Groups of one to twelve values, of nulls, of NaN, of some NaN, and without a name."""
    import duckdb

    from pagemill.plans import ORACLES, QUERIES

    nan = float("nan")
    groups = {str(n): [i * i + 0.5 for i in range(n)] for n in range(1, 13)} | {"nulls": [None] * 4, "nan": [nan] * 3, "some": [nan, nan, 1.0, 2.0, None], None: [7.0, 8.0]}
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_extendedprice double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    events = spark.createDataFrame(rows, "event_type string, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("user_id") * 40_000))
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    text = lambda found: sorted(tuple(map(str, r)) for r in found)
    with duckdb.connect() as sql:
        for name, table in (("approximate_distinct", "lineitem"), ("merged_sketches", "events")):
            sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
            assert text(QUERIES[name](spark, folder).collect()) == text(sql.execute(ORACLES[name]).fetchall())
