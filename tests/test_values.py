"""Operators against literal values and loops that share none of their tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import analytics, change, html, state, telemetry

def test_tags_of_any_name_differ(spark):
    rows = [(["video", "canvas"], ["details", "summary"], 1.0), (["a", "b", "video"], ["a", "b", "audio"], 1 / 3), ([], [], 0.0), ([f"t{i}" for i in range(600)], [f"u{i}" for i in range(600)], 500 / 600), (["p"] * 3, ["p"] * 4, 0.25)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a array<string>, b array<string>")
    assert [r.d for r in df.select(change.structural_distance(F.col("a"), F.col("b")).alias("d")).collect()] == pytest.approx([w for *_, w in rows])


def test_null_and_empty_keys_are_two(spark):
    rows = [(k, t, True) for t, k in enumerate([None, None, "", "", ""])]
    got = state.circuit_breaker(spark.createDataFrame(rows, "k string, t long, failed boolean").withColumn("at", F.timestamp_seconds("t")), "k", "at", ["t"], "failed").collect()
    assert {(r.k, r.failures) for r in got} == {(None, 1), (None, 2), ("", 1), ("", 2), ("", 3)} and all(r.state == "closed" for r in got)


def test_deep_markup_renders(spark):
    depth = 5000
    rows = html.parse_nodes("<div>" * depth + "<p>deep <b>down</b></p>" + "</div>" * depth + "<ul><li>x</li></ul>")
    assert html.markdown_of([[*r[:6], r[6], *r[7:]] for r in rows]) == "deep **down**\n\n- x"


def test_tables_links_and_nesting():
    md = lambda h, **k: html.markdown_of(html.parse_nodes(h), **k)
    assert md("<table><tr><th>a<th>b</tr><tr><td>1|2<td><b>c</b> <a href=u>l</a></tr></table>") == "| a | b |\n| --- | --- |\n| 1\\|2 | **c** [l][1] |\n\n[1]: u"
    assert md("<table><thead><tr><td>h</td></tr></thead><tbody><tr><td>x</td><td>y</td></tr></tbody></table>tail") == "| h |  |\n| --- | --- |\n| x | y |\n\ntail"
    assert md("<td>loose</td><p>a<br>b <i>c</i></p><hr><blockquote>q</blockquote><img alt=i src=s>", citations=False) == "loose\n\na\nb *c*\n\n---\n\n> q\n\n![i](s)"
    assert md("<a href=u>one</a> <a href=v>two</a> <a href=u>three</a>") == "[one][1] [two][2] [three][1]\n\n[1]: u\n[2]: v"


def okapi(corpus, query, k1=1.5, b=0.75, floor=0.25):
    """Okapi scores of a corpus of word lists, as the method is published: rare words count more, common ones little."""
    df = Counter(w for words in corpus for w in set(words))
    raw = {w: math.log(len(corpus) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = floor * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else low for w, v in raw.items()}
    mean = sum(map(len, corpus)) / len(corpus)
    return [sum(idf.get(q, 0) * words.count(q) * (k1 + 1) / (words.count(q) + k1 * (1 - b + b * len(words) / mean)) for q in query) for words in corpus]


@pytest.mark.parametrize("query", ["the of and", "the the rare", "nothing", "rare of"])
def test_relevant_blocks_against_loops(spark, query):
    texts = ["the cat of the house and the dog", "rare birds of the north", "the and the and the", "of mice", "plain words only here", "the rare rare end of it"]
    blocks = spark.createDataFrame([(1, i, "p", t, len(t), 0.0, 0.1 * i) for i, t in enumerate(texts)] + [(2, 0, "p", "the of", 6, 0.0, 0.5)], "page_id long, pre int, tag string, text string, n_chars int, link_density double, score double")
    got = {(r.page_id, r.pre): r.score for r in html.relevant_blocks(blocks, query).collect()}
    for page, own in ((1, texts), (2, ["the of"])):
        scores = okapi([t.split() for t in own], query.split())
        most = max(scores) if max(scores) > 0 else 1
        for i, s in enumerate(scores):
            assert got[page, i] == pytest.approx(0.6 * (0.5 if page == 2 else 0.1 * i) + 0.4 * s / most)


def test_query_returns_every_row_or_says_so(spark):
    assert len(analytics.query(spark, "SELECT id FROM range(25000)").rows) == 25_000
    cut = analytics.query(spark, "SELECT id FROM range(10)", most=9)
    assert cut.rows == [] and "9" in cut.error


def test_bars(spark):
    got = telemetry.bars(spark.createDataFrame([("a", 1.0), ("b", 4.0), ("c", None)], "k string, v double"), "v").collect()
    assert {r.k: r.bar for r in got} == {"a": 0.25, "b": 1.0, "c": None}


def test_stored_folders_can_be_removed(spark, tmp_path):
    from pathlib import Path

    from pagemill import sources

    before = len(sources.STORED)
    df = sources.materialised(spark.range(3), "x")
    path = Path(sources.STORED[-1].removeprefix("file://").removeprefix("file:"))
    assert df.count() == 3 and path.is_dir()
    sources.forget(spark, before)
    assert not path.exists() and len(sources.STORED) == before


def test_runs_in_two_threads_discard_their_own_tables_only(spark):
    from threading import Barrier, Thread

    from pagemill import sources

    meet, made = Barrier(2), {}

    def run(name):
        with sources.recording() as paths:
            sources.materialised(spark.range(3), name)
            meet.wait()  # both have stored: places in one common list would be mixed
            with sources.recording() as inner:
                sources.materialised(spark.range(4), name)
            made[name] = (list(paths), list(inner))
        meet.wait()
        if name == "a":
            sources.discard(spark, paths)

    threads = [Thread(target=run, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [len(x) for n in "ab" for x in made[n]] == [2, 1, 2, 1] and made["a"][0][1:] == made["a"][1]
    assert not set(made["a"][0]) & (set(sources.STORED) | set(made["b"][0])) and set(made["b"][0]) <= set(sources.STORED)
    assert [spark.read.parquet(p).count() for p in made["b"][0]] == [3, 4]
    sources.discard(spark, made["b"][0])


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from pagemill import sources

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
        with pytest.raises(ValueError, match="shared|share"):
            sources.shared_folder(session)


TREE = "<body><div id=a class='x y'><p>one</p><p data-k='v-1'>two</p><h2>t</h2><p>three</p></div><div><p>four <i>i</i> &lt;</p><img src=s><ul><li>1<li>2<li>3<li>4</ul></div></body>"


@pytest.fixture(scope="module")
def tree(spark):
    return html.nodes(spark.createDataFrame([(1, TREE), (2, "<p>alone</p>")], "page_id long, html string")).cache()


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p, h2", ["one", "two", "t", "three", "four i <", "alone"]), ("h2, p:first-child", ["one", "t", "four i <", "alone"]), ("p ~ p", ["two", "three"]), ("h2 ~ p", ["three"]), ("p + h2", ["t"]),
        ("li:nth-child(odd)", ["1", "3"]), ("li:nth-child(2n)", ["2", "4"]), ("li:nth-child(3)", ["3"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:last-child", ["4"]), ("div.x.y > p:not([data-k])", ["one", "three"]),
        ("[data-k^=v]", ["two"]), ("[data-k$='1']", ["two"]), ("p[data-k*='-']", ["two"]), ("[class~=y] h2", ["t"]), ("[data-k|=v]", ["two"]), ("#a > p:last-child", ["three"]), ("i:only-child", ["i"]),
        ("//div/p[1]", ["one", "four i <"]), ("//p[2]", ["two"]), ("//li[last()]", ["4"]), ("//p[@data-k='v-1']", ["two"]), ("//p[contains(@data-k, 'v')]", ["two"]), ("//p[text()='three']", ["three"]), ("//p[contains(text(), 'our')]", ["four i <"]),
        ("(//p)[2]", ["two"]), ("/p", ["alone"]), ("/body//li[3]", ["3"]), ("//div[@id]/h2", ["t"]), ("p, p, #a p", ["one", "two", "three", "four i <", "alone"]),
    ],
)
def test_selectors(tree, selector, want):
    hits = html.selected(tree, selector)
    got = html.subtree_text(tree, "page_id", hits).orderBy("page_id", "pre").collect()
    assert [r.text for r in got] == want


@pytest.mark.parametrize("selector", ["p:hover", "p >", "> p", "p,,q", "p{", "li:nth-child(x)", "//p[position() > 1]", "//p/text()", "//p/@id", "p/../q", "", "a:has(b)", "//*[1]", "[a=", "p::before"])
def test_unknown_selectors_are_errors(tree, selector):
    with pytest.raises(ValueError, match="not understood"):
        html.selected(tree, selector)


def test_markup_of_elements(tree):
    got = html.extract_field(tree, "div:last-child > p, ul", kind="html", multiple=True).collect()
    assert [r.value for r in got] == [["<p>four <i>i</i> &lt;</p>", "<ul><li>1</li><li>2</li><li>3</li><li>4</li></ul>"]]
    with pytest.raises(ValueError, match="kind"):
        html.extract_field(tree, "p", kind="table")


CUT = '<head><script>a && b &amp; c</script></head><h1 title="x&ampy">R &amp;&lt; &amp</h1><p>&#65;&quo</p><h1>two</h1>'


def test_closed_references_alone_are_resolved(spark):
    pages = spark.createDataFrame([(1, "u", CUT), (2, "u", None)], "page_id int, url string, html string")
    for references, want in (("all", "R &< &"), ("closed", "R &< &amp"), ("none", "R &amp;&lt; &amp")):
        got = {r.page_id: r.title for r in html.extract(pages, {"title": {"selector": "h1"}}, references=references).collect()}
        assert got == {1: want, 2: None}
    rows = html.parse_nodes(CUT, "closed")
    assert [r[7] for r in rows if r[5] in ("script", "p")] == ["a && b &amp; c", "A&quo"]
    with pytest.raises(ValueError, match="references"):
        html.parse_nodes("", "some")


def test_headings_with_a_cut_reference_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from pagemill.plans import ORACLES, QUERIES

    heads = ["a &amp; b &amp", "c &am", "&quot;d&quot; &", "e", "f &amp;amp;"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body><h1>{h}</h1></body></html>") for i, h in enumerate(heads)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("h1_extract", "heading_markup"):
        want = {tuple(map(str, r)) for r in duckdb.sql(ORACLES[name]).fetchall()}
        assert {tuple(map(str, r)) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want and len(want) == 5


def test_markup_as_it_is_written(spark):
    tree = html.nodes(spark.createDataFrame([(1, CUT)], "page_id int, html string"), references="none")
    assert html.extract_field(tree, "h1", kind="written").first().value == '<h1 title="x&ampy">R &amp;&lt; &amp</h1>'


def test_pictures_against_loops(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 256, (9, 12)).astype(float), rng.integers(0, 256, (9, 12)).astype(float)
    values = []
    for i in range(9 - 6):
        for j in range(12 - 6):
            x, y = a[i : i + 7, j : j + 7].ravel(), b[i : i + 7, j : j + 7].ravel()
            c = np.cov(x, y)
            values.append((2 * x.mean() * y.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist()), (a.ravel().tolist(), a.ravel().tolist()), ([1.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.s for r in df.select(change.windowed_similarity(12)("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(np.mean(values)) and got[1:] == [pytest.approx(1.0), -1.0, -1.0]
    picture = rng.integers(0, 256, (32, 32)).astype(float)
    waves = [[sum(picture[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    middle = np.median(waves)
    want = sum(1 << (8 * u + v) for u in range(8) for v in range(8) if waves[u][v] > middle)
    rows = spark.createDataFrame([(picture.ravel().tolist(), (255 - picture).ravel().tolist())], "a array<double>, b array<double>").select(change.perceptual_hash("a").alias("a"), change.perceptual_hash("b").alias("b"))
    r = rows.select("a", change.perceptual_similarity(F.col("a"), F.col("a")).alias("same"), change.perceptual_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert r.a & (2**64 - 1) == want and r.same == 1.0 and r.s < 0.2


def test_nested_values(spark):
    rows = [("[1, 2.005]", "[1.0, 2]", True), ('{"a": [" X "], "b": 1}', '{"b": 1.001, "a": ["x"]}', True), ("[1]", "[1, 2]", False), ('{"a": 1}', '{"b": 1}', False), ('["x"]', "[1]", False), ("[null]", "[null]", True), ("{bad", "{bad", True), ("{bad", "[]", False), ("[" * 3000 + "]" * 3000, "[" * 2999 + "]" * 2999, False)]
    kinds = lambda i: spark.createDataFrame([(1, n, "f", "list" if r[0][0] == "[" else "dict", r[i]) for n, r in enumerate(rows[:8])], "k int, pos int, field string, type string, value string")
    same = change.field_changes(kinds(0), kinds(1).withColumn("type", F.when(F.col("pos").isin(1, 3, 6), "dict").when(F.col("pos") == 7, "dict").otherwise("list")), "k").collect()
    assert {r.pos: r.change == "unchanged" for r in same} == {n: r[2] for n, r in enumerate(rows[:8])}


def test_tfidf_against_loops(spark):
    import re

    texts = [("The cat sat on the mat", "the cat sat, on a mat!"), ("one two", "three four"), ("", "x"), ("same words same", "same words same"), ("a b c", "é è")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "k int, a string, b string")
    from pagemill.operators import text as T

    got = {r.k: r.similarity for r in T.tfidf_similarity(df, ["k"], "a", "b", stop_words=("on",)).collect()}
    for i, pair in enumerate(texts):
        x, y = (Counter(w for w in re.findall(r"\w\w+", t.lower()) if w != "on") for t in pair)
        idf = {w: math.log(3 / (1 + (w in x) + (w in y))) + 1 for w in {*x, *y}}
        norm = math.sqrt(sum((x[w] * v) ** 2 for w, v in idf.items())) * math.sqrt(sum((y[w] * v) ** 2 for w, v in idf.items()))
        assert got[i] == pytest.approx(sum(x[w] * y[w] * v * v for w, v in idf.items()) / norm if norm else 0.0)


def test_results_are_stored_under_references(spark, tmp_path):
    from pagemill import sources

    rows = spark.createDataFrame([("j1", 0.5), ("j2", None)], "job_id string, confidence double")
    refs = sources.store_results(rows, str(tmp_path / "blobs"))
    sources.store_blobs(spark.createDataFrame([("minio://shots/j1.png", b"\x89PNG")], "ref string, content binary"), str(tmp_path / "blobs"))
    blobs = spark.read.parquet(str(tmp_path / "blobs"))
    found = {r.job_id: bytes(r.content).decode() for r in sources.resolve_references(refs, blobs, "result_ref").collect()}
    assert found == {"j1": '{"job_id":"j1","confidence":0.5}', "j2": '{"job_id":"j2"}'} and blobs.count() == 3
    assert sources.read_blobs(spark, str(tmp_path / "blobs"), "*.parquet").count() > 0


def test_metadata_in_any_order(spark):
    page = """<html class="x" lang='de'><head><title>A &amp; B</title><meta content="Me &mdash; you" name="author"><meta property='article:published_time' content='2024-01-02'>
    <META NAME="Keywords" CONTENT="k, l"><meta name=description content="d"><link href="http://c/x" rel="canonical"><meta property="og:description" content="og"></head></html>"""
    r = html.metadata(spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].author, r[0].description, r[0].date, r[0].tags, r[0].language, r[0].url, r[0].sitename) == ("A & B", "Me \u2014 you", "d", "2024-01-02", "k, l", "de", "http://c/x", "")
    assert all(v == "" for v in list(r[1])[1:]) and all(v == "" for v in list(r[2])[1:])


def test_metadata_is_told_by_elements_alone(spark):
    page = """<!-- <meta name=author content=Comment> --><script>var m = '<meta name="author" content="Script">';</script><body><p>&lt;title&gt;no&lt;/title&gt;</p>
    <svg><a></svg><meta name=AUTHOR content="Element"><title>First</title><title>Second</title><link rel="alternate CANONICAL" href=/u>"""
    r = html.metadata(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (r.author, r.title, r.url) == ("Element", "First", "/u")


def test_grams_are_of_characters(spark):
    from pagemill import functions as fn

    texts = ["", "a", "ab", "abc", "aaaa", "añ日😀b😀", "x" * 2000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.grams(F.col("t"), 3).alias("g"), fn.grams(F.col("t"), 2).alias("h")).collect()
    for r in got:
        t = texts[r.i] or ""
        assert sorted(r.g) == sorted({t[k : k + 3] for k in range(len(t) - 2)}) and sorted(r.h) == sorted({t[k : k + 2] for k in range(len(t) - 1)})


def test_jobs_by_status_and_key(spark):
    from pagemill.operators import jobs

    rows = spark.createDataFrame([(1, "queued"), (2, "failed"), (3, "queued")], "job_id int, status string")
    assert jobs.get(rows, job_id=2).first().status == "failed" and jobs.get(rows, job_id=9).count() == 0
    assert {r.job_id for r in jobs.by_status(rows, "queued").collect()} == {1, 3}


def test_terms_are_counted_in_their_pair(spark):
    from pagemill.operators import text

    pairs = spark.createDataFrame([(1, "aa bb aa", "aa cc"), (2, None, "x"), (3, "dd", "dd"), (3, "ee", "dd")], "k int, a string, b string")
    found = text.tfidf_similarity(pairs, ["k"], "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    rare = 1 + math.log(1.5)
    third = 2 / math.sqrt(1 + rare**2) / 2  # dd once and twice, ee once
    assert sorted((r.k, round(r.similarity, 9)) for r in found.collect()) == [(1, round(2 / math.sqrt(4 + rare**2) / math.sqrt(1 + rare**2), 9)), (2, 0.0), (3, round(third, 9)), (3, round(third, 9))]
    few = text.tfidf_similarity(pairs.where("k = 1"), ["k"], "a", "b", most_terms=1)
    assert few.first().similarity == pytest.approx(1.0)


def test_records_meet_sums_not_texts(spark):
    import re

    from pagemill.plans import QUERIES

    plan = QUERIES["records_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter(.*\n)+?.*Aggregate \[lang", plan)
