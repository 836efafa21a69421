"""Operators against expectations written by hand or computed another way."""

import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill import functions as fn
from pagemill import sources
from pagemill.operators import analytics, change, chunk, classify, discover, drift, geometry, html, jobs, merge, routing, state, telemetry, text

T0 = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, want", [("night", "nacht", 0.25), ("", "", 1.0), ("a", "", 0.0), ("a", "a", 1.0), ("a", "b", 0.0), ("abab", "ab", 2 / 3)])
def test_dice(spark, a, b, want):
    assert one(spark, fn.dice(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_empty_and_unfilled_differ(spark):
    rows = spark.createDataFrame([(v,) for v in ("", " N/A ", "none", "Unknown", "-", "x", None)], "v string")
    assert [r[0] for r in rows.select(fn.is_empty(F.col("v"))).collect()] == [True] * 5 + [False, True]
    assert [r[0] for r in rows.select(fn.is_unfilled(F.col("v"))).collect()] == [True, True, False, False, False, False, True]
    assert rows.limit(1).select(fn.missing_fields({"a": F.lit(None).cast("string"), "b": F.lit("-"), "c": F.lit("ok"), "d": F.lit(None).cast("string")}, {"a"})).first()[0] == ["a", "b"]


def test_small_functions(spark):
    assert one(spark, fn.fenced_json(F.col("v")), v='so:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, fn.fenced_json(F.col("v")), v=" [1] ") == "[1]" and one(spark, fn.fenced_json(F.col("v")), v="no json {") is None
    assert one(spark, fn.clean_markdown(F.col("v")), v="  a  \n\n\n\nb&amp;c​ \t\n") == "a\n\nb&c"
    assert one(spark, fn.domain_of(F.col("v")), v="https://u@h.example:8080/p?q") == "u@h.example:8080"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (70_000).to_bytes(4, "big") + b"x"
    rows = spark.createDataFrame([(bytearray(png),), (bytearray(b"GIF8"),), (None,)], "v binary").select(fn.png_size(F.col("v")).alias("s")).collect()
    assert [(r.s.width, r.s.height) for r in rows] == [(640, 70_000), (1920, 1080), (1920, 1080)]
    assert [one(spark, fn.backoff_seconds(F.col("n")), n=float(n)) for n in (1, 2, 7, 30)] == [1, 2, 60, 60]


def test_markdown_resolves_all_character_references(spark):
    import html
    import re

    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text LIKE '%&%'").select("text").collect()]
    rows += ["a&mdash;b&#8217;s &#x41; &nbsp;x &amp;lt; &eacute &unknown; R&D &#8203;z", None, "&", "no reference"]
    clean = lambda t: re.sub(r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$", "", re.sub("[\u200b\u200c\u200d\ufeff\u00ad]", "", html.unescape("\n".join(x.rstrip(" \t\r\f\v") for x in re.sub(r"\n{3,}", "\n\n", t).split("\n")))))
    got = spark.createDataFrame(list(enumerate(rows)), "i int, v string").select("i", fn.clean_markdown(F.col("v")).alias("md")).collect()
    assert [r.md for r in sorted(got)] == [None if t is None else clean(t) for t in rows]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert sources.load_json(spark, "j", str(tmp_path / "*.json")).count() == 2 and spark.sql("SELECT SUM(a) AS s FROM j").first().s == 3
    assert sources.load_records(spark, "r", []) is None and sources.load_records(spark, "r", [{"a": 1, "b": "x"}]).count() == 1
    with pytest.raises(ValueError):
        sources.load_parquet(spark, "x; DROP TABLE y", "/root/testdata/sf0.001/region.parquet")
    refs = spark.createDataFrame([("minio://b/p/q.html",), ("minio://b/",), ("s3://b/p",), (None,)], "r string").select(sources.parse_reference(F.col("r")).alias("r")).collect()
    assert [(r.r.bucket, r.r.path) for r in refs] == [("b", "p/q.html"), (None, None), (None, None), (None, None)]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, raw_html_ref string")
    blobs = spark.createDataFrame([("x", "<p>")], "ref string, content string")
    assert {(r.id, r.content) for r in sources.resolve_references(rows, blobs).collect()} == {(1, "<p>"), (2, None)}
    sources.write_partitioned(rows, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    ref = one(spark, sources.blob_path("raw", F.lit(7), F.lit(T0), "html"), v="x")
    assert ref == "minio://raw-html/raw/7/20240101T000000.html"


def test_ad_hoc_sql_tells_errors(spark):
    got = analytics.query(spark, "SELECT 1 AS a, 'x' AS b")
    assert got.to_dicts() == [{"a": 1, "b": "x"}] and got.to_markdown() == "| a | b |\n| --- | --- |\n| 1 | x |"
    bad = analytics.query(spark, "SELEC")
    assert bad.error and not bad.rows and bad.to_markdown() == "_No results_"


def test_job_log(spark):
    log = spark.createDataFrame([(1, "pending", 0, 0), (1, "running", 5, 1), (1, "retry", 6, 2), (1, "completed", 9, 3), (2, "pending", 1, 0), (2, "completed", 2, 1)], "job_id int, status string, at int, seq int")
    got = {r.job_id: (r.status, r.retry_count, r.completed_at) for r in jobs.latest_state(log).collect()}
    assert got == {1: ("completed", 1, 9), 2: ("completed", 0, 2)}
    assert [(r.job_id, r.before, r.status) for r in jobs.illegal_moves(log.where("status <> 'retry'")).collect()] == [(2, "pending", "completed")]


def test_as_of_against_a_loop(spark):
    rng = random.Random(3)
    left = [(rng.randint(0, 3), rng.randint(0, 30), i) for i in range(60)]
    right = list({(rng.randint(0, 3), rng.randint(0, 30)): None for _ in range(25)})
    r = spark.createDataFrame([(k, t, t * 10 + k) for k, t in right], "k int, t int, v int")
    got = {x.i: x.last_v for x in jobs.as_of(spark.createDataFrame(left, "k int, t int, i int"), r, "k", "t", "t", "v").collect()}
    for k, t, i in left:
        before = [u for q, u in right if q == k and u <= t]
        assert got[i] == (max(before) * 10 + k if before else None)


def test_merge_labels(spark):
    h = spark.createDataFrame([(1, "a", "Red Shoe"), (1, "b", "10"), (1, "c", "n/a"), (1, "d", None), (1, "e", "left")], "item_id int, field string, value string")
    v = spark.createDataFrame([(1, "a", " red shoe"), (1, "b", "10.05"), (1, "c", "blue"), (1, "d", "-"), (1, "e", "right"), (1, "f", "only")], "item_id int, field string, value string")
    got = {r.field: (r.merged, r.source) for r in merge.merge_fields(h, v).collect()}
    assert got == {"a": ("Red Shoe", "agreed"), "b": ("10", "agreed"), "c": ("blue", "vision"), "d": (None, "html"), "e": ("left", "conflict_html"), "f": ("only", "vision")}
    s = merge.merge_summary(merge.merge_fields(h, v)).first()
    assert (s.total_fields, s.populated, s.agreed, s.conflicted) == (6, 5, 2, 1) and s.merge_confidence == pytest.approx(5 / 6 + 0.1 * 2 / 6)
    assert merge.merge_fields(h, v, prefer_html=False).where("field = 'e'").first().source == "conflict_vision"


def test_titles_with_sharp_s_agree(spark, tmp_path):
    from pagemill.plans import QUERIES

    pages = [(1, "http://h/1", "<h1>Chß Chß Chß</h1>"), (2, "http://h/2", "<h1>été</h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["merge_fields"](spark, str(tmp_path)).where("field = 'title'").collect()
    assert {(r.item_id, r.merged, r.source) for r in got} == {(1, "Chß Chß Chß", "agreed"), (2, "été", "agreed")}
    assert {r.agreed for r in QUERIES["merge_summary"](spark, str(tmp_path)).collect()} == {1}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["p", "div", "h1", "zzz", "td"]), max_size=12), st.lists(st.sampled_from(["p", "div", "h1", "zzz", "td"]), max_size=12))
def test_structural_distance(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(change.structural_distance(F.col("a"), F.col("b")).alias("d")).first().d == pytest.approx(min(1.0, levenshtein(a, b) / max(len(a), len(b), 1)))


def test_change_rules(spark):
    rows = [(0.0, 0.0, None, 0.0), (0.9, 0.9, 0.9, 0.9), (0.5, 0.1, None, 0.0), (0.1, 0.3, None, 0.4), (0.3, 0.4, None, 0.6), (None, None, None, None), (0.5, None, None, None)]
    got = [r.category for r in change.change_score(spark.createDataFrame(rows, "dom double, semantic double, visual double, entity double")).collect()]
    assert got == ["no_change", "major_redesign", "layout_change", "content_update", "new_content", "no_change", "layout_change"]


def test_pictures(spark):
    flat, half = [10.0] * 64, [0.0] * 32 + [200.0] * 32
    df = spark.createDataFrame([(half, half), (half, half[::-1]), (flat, half[:10])], "a array<double>, b array<double>")
    got = df.select(change.structural_similarity("a", "b").alias("s"), change.hash_similarity(F.col("a"), F.col("a")).alias("h")).collect()
    assert got[0].s == pytest.approx(1.0) and got[1].s < 0.1 and got[2].s == -1 and got[0].h == 1.0
    assert one(spark, change.visual_similarity(F.col("h"), F.col("s")), h=0.5, s=-1.0) == 0.5 and one(spark, change.visual_similarity(F.col("h"), F.col("s")), h=0.5, s=1.0) == pytest.approx(0.85)


def test_schema_history(spark):
    rows = spark.createDataFrame([("d", 1, {"a": "str"}, "add"), ("d", 2, {"a": "int", "b": "str"}, "edit"), ("d", 3, {"b": "str"}, "edit")], "domain string, at int, schema_data map<string,string>, change_type string")
    v = drift.versions(rows, ["domain"], ["at"])
    diffs = [(r.added, r.removed, r.modified, r.unchanged) for r in drift.schema_diff(v, "before", "schema_data").orderBy("version").collect()]
    assert diffs == [(["a"], [], [], []), (["b"], [], ["a"], []), ([], ["a"], [], ["b"])]
    back = drift.rollback(v, ["domain"], 1).orderBy("version").collect()
    assert [r.version for r in back] == [1, 2, 3, 4] and back[3].schema_data == {"a": "str"} and back[3].change_type == "rollback" and back[3].hash == back[0].hash
    p = spark.createDataFrame([({"a": "x"}, {"b": "x"}, 0.7), ({"a": "x"}, {"a": "x"}, 0.6)], "old_schema map<string,string>, new_schema map<string,string>, confidence double")
    assert [r.accepted for r in drift.accept_repair(p).collect()] == [True, False]


def test_challenges_vendors_and_endpoints(spark):
    pages = ["<div class='G-Recaptcha'>", "https://hcaptcha.com/1", "cf-turnstile", "x Just a moment... y", "plain", ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, h string")
    assert [r.c for r in df.orderBy("k").select(classify.challenge_kind(F.col("h")).alias("c")).collect()] == ["recaptcha_v2", "hcaptcha", "cloudflare_turnstile", "unknown", None, None]
    rows = [(1, {"CF-Ray": "x", "Server": "cloudflare"}, {"__cf_bm": "1"}, ""), (2, {"X-DataDome": "1"}, {"datadome": "1"}, "geo.captcha-delivery.com"), (3, None, None, "plain"), (4, {}, {"_px3": "1", "_pxvid": "2"}, "")]
    got = {r.k: (r.vendor, r.confidence) for r in classify.vendor_scores(spark.createDataFrame(rows, "k int, h map<string,string>, c map<string,string>, b string"), "k", "h", "c", "b").collect()}
    assert got == {1: ("cloudflare_basic", 7 / 8), 2: ("datadome", 6 / 8), 3: ("none", 1.0), 4: ("perimeterx", 1.0)}
    reqs = [("http://h/api/x?cursor=1", 200, "text/html", {"authorization": "Bearer t"}), ("http://h/graphql", 200, "application/json", {"Authorization": "Basic t"}), ("http://h/x.css", 200, "text/css", {}), ("http://h/data", 500, "", {}), ("http://h/q.json?offset=2", 301, None, {}), ("http://h/p", 200, "", {})]
    found = {r.url: (r.kind, r.paging, r.auth_type) for r in classify.endpoints(spark.createDataFrame([(u, "GET", s, m, h) for u, s, m, h in reqs], "url string, method string, status int, mime_type string, headers map<string,string>")).collect()}
    assert found == {"http://h/api/x?cursor=1": ("other", "cursor", "bearer"), "http://h/graphql": ("graphql", None, "custom"), "http://h/q.json?offset=2": ("json", "offset", None)}


def events(spark, outcomes, gap=1.0):
    return spark.createDataFrame([("k", T0 + dt.timedelta(seconds=gap * i), i, not ok, ok, blocked) for i, (ok, blocked) in enumerate(outcomes)], "k string, ts timestamp, i int, failed boolean, ok boolean, blocked boolean")


def test_breaker_opens_tries_and_closes(spark):
    bad, good = (False, True), (True, False)
    rows = state.circuit_breaker(events(spark, [bad] * 5 + [bad, good, good], gap=10.0), "k", "ts", ["i"], "failed", recovery=25.0).orderBy("i").collect()
    assert [(r.allowed, r.state) for r in rows] == [(True, "closed")] * 4 + [(True, "open"), (False, "open"), (False, "open"), (True, "closed")]
    rows = state.domain_tiers(events(spark, [bad, bad, bad, good, bad] + [bad] * 4), "k", "ts", ["i"], "ok", "blocked").orderBy("i").collect()
    assert [r.tier for r in rows] == [1, 2, 2, 2, 2, 2, 2, 2, 2] and [r.circuit_open for r in rows] == [False] * 8 + [True] and rows[3].failures == 0
    rows = state.token_bucket(events(spark, [good] * 6, gap=0.5), "k", "ts", ["i"], rate=1.0, burst=2).orderBy("i").collect()
    assert [r.allowed for r in rows] == [True, True, True, False, True, False]


def test_streaks_and_health(spark):
    outcome = [(True, False)] * 2 + [(False, True)] * 3
    health = telemetry.proxy_health(events(spark, outcome), "k", F.col("ok"), F.col("blocked"), F.lit(1000.0), ["ts", "i"]).first()
    assert health.failures_in_a_row == 3 and health.status == "degraded" and health.health == pytest.approx(0.4 * 0.4 + 0.3 * 0.4 + 0.3 * 0.9)


def test_markdown_sections_and_tables(spark):
    md = "intro\n# A\ntext\n## B\n| x | y |\n| 1 | 2 |\nend\n\n| z |"
    df = spark.createDataFrame([(1, md), (2, "\n# only"), (3, "none")], "k int, t string")
    got = [(r.k, r.section, r.level, r.heading) for r in text.sections(df, "k", "t").orderBy("k", "section").collect()]
    assert got == [(1, 0, 0, ""), (1, 1, 1, "A"), (1, 2, 2, "B"), (2, 1, 1, "only"), (3, 0, 0, "")]
    spans = [(r.start, r.end) for r in text.tables(df.where("k = 1"), "k", "t").orderBy("start").collect()]
    assert spans == [(s, min(e, len(md) + 1)) for s, e in chunk.table_spans(md)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# head\n", "## sub\n", "some words here. And more!\n", "\n\n", "| a | b |\n", "x" * 70 + "\n"]), max_size=40), st.integers(5, 40))
def test_chunks_hold_all_text(parts, most):
    body = "".join(parts)
    found = chunk.chunk_text(body, max_tokens=most, overlap=0)
    assert "".join("".join(c["content"].split()) for c in found) == "".join(body.split())
    assert all(c["tokens"] == int((c["end"] - c["start"]) / 4) for c in found)
    if len(found) > 1:
        # A paragraph's end counts the break after it, which may be that of the next section.
        assert all(body[c["start"] : c["end"]].strip().startswith(c["content"]) for c in found)
        assert all(a["end"] <= b["start"] + 2 for a, b in zip(found, found[1:], strict=False))
    heads = re.findall(r"(?m)^#{1,6}\s+(.+)$", body)
    assert {c["section"] for c in found} <= {None, "", *(h.strip() for h in heads)}


def test_tables_stay_whole_where_they_nearly_fit():
    table = "# Data\n\n" + "| a | b |\n" * 12  # 128 characters
    whole = chunk.chunk_text("# Intro\nsome words.\n" + table + "# End\nwords.\n", max_tokens=25, overlap=0)
    assert [(c["section"], c["has_table"]) for c in whole] == [("Intro", False), ("Data", True), ("End", False)] and whole[1]["content"] == table.strip()
    assert [c["tokens"] for c in whole] == [5, 32, 3]
    alone = chunk.chunk_text(table + "# End\nwords.\n", max_tokens=25, overlap=0)  # nothing is open before it, so it is cut at blank lines
    assert [c["content"].count("|") for c in alone] == [0, 36, 0]


def test_chunk_overlap_and_fast_path(spark):
    body = "# A\n" + "One. Two. Three. Four. " * 4 + "\n# B\n" + "Five. Six. Seven. " * 5 + "\n"
    df = spark.createDataFrame([(1, body), (2, "short"), (3, "  "), (4, None)], "k int, t string")
    rows = chunk.chunks(df, "k", "t", max_tokens=30).orderBy("k", "index").collect()
    assert [(r.k, r["index"], r.total) for r in rows] == [(1, 0, 2), (1, 1, 2), (2, 0, 1)]
    assert rows[1].content.startswith("[...continued] Three. Four.\n\n# B") and rows[1].section == "B" and rows[2].section is None


PAGE = """<html lang="en"><head><title>T</title><script>var t="</p>";</script></head><body><nav>menu</nav>after<main><h1>Head</h1><p>One <a href="/a">link</a> and <b>bold</b><p>Two <a href="/a">again</a> <a href="b">b</a></main>
<div class="card"><h3>A</h3><span>price $1.20 now and then</span></div><div class="card"><h3>B</h3><span>price $2.20 now and then</span></div><div class="card x"><h3>C</h3><span>price $3.20 now and then</span></div>
<div id="sidebar">s</div><div class="ad">kept</div><div style="display: none">hid</div><p aria-hidden="true">hid</p><div> </div><img src="i.png" alt="pic"><table><tr><th>k<th>v<tr><td>1<td>2|3</table><ul><li>x<li>y</ul></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://e.com/q/", PAGE), (2, "u", None), (3, "u", "<p>only text in a page that is long enough</p>"), (4, "u", "")], "page_id long, url string, html string")


def test_nodes_nest(pages):
    rows = [r for r in html.nodes(pages).collect() if r.page_id == 1]
    by = {r.pre: r for r in rows}
    for r in rows:
        assert r.post >= r.pre and (r.parent == -1 or by[r.parent].pre < r.pre <= by[r.parent].post)
        assert sum(1 for x in rows if x.pre < r.pre <= x.post) == r.depth
    assert [r.tag for r in rows if r.parent == next(x.pre for x in rows if x.tag == "tr")] == ["th", "th"]


def test_prune_and_markdown(pages):
    got = {r.page_id: r for r in html.preprocess(pages).collect()}
    md = got[1].markdown
    assert "menu" not in md and "hid" not in md and "var t" not in md and "after" in md and "kept" in md
    assert "# Head" in md and "[link][1]" in md and "[again][1]" in md and "[b][2]" in md and md.endswith("[1]: /a\n[2]: b")
    assert "| k | v |\n| --- | --- |\n| 1 | 2\\|3 |" in md and "- x" in md and "![pic](i.png)" in md and "**bold**" in md
    assert got[2].markdown == "" and got[4].markdown == "" and got[3].ratio == pytest.approx(46 / 39)


def test_selectors_and_extraction(pages):
    n = html.nodes(pages)
    tags = lambda s: [(r.tag, r.own_text) for r in html.selected(n, s).where("page_id = 1").orderBy("pre").collect()]
    assert tags("div.card > h3") == [("h3", "A"), ("h3", "B"), ("h3", "C")] and tags("//div[@class='card']/h3") == [("h3", "A"), ("h3", "B")]
    assert tags("#sidebar") == [("div", "s")] and tags("h1 + p") == [("p", "One ")] and len(tags("main a[href]")) == 3 and tags("nav p") == []
    fields = {"title": {"selector": "h1"}, "price": {"selector": ".card span", "transform": "strip_currency"}, "links": {"selector": "a", "kind": "attribute", "attr": "href", "transform": "to_absolute_url", "multiple": True}}
    rows = {r.page_id: (r.title, r.price, r.links) for r in html.extract(pages, fields).collect()}
    assert rows == {1: ("Head", "1.20", ["http://e.com/a", "http://e.com/a", "http://e.com/q/b"]), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3}


def test_blocks_and_structures(pages):
    blocks = html.scored_blocks(html.nodes(pages)).collect()
    assert all(0 <= r.score <= 1 and 0 <= r.link_density <= 1 for r in blocks)
    one_block = next(r for r in blocks if r.page_id == 3)
    assert one_block.score == pytest.approx(0.5 * 39 / 46 + 0.15)
    found = {(r.sample, r["count"]) for r in html.repeated_subtrees(html.nodes(pages)).collect()}
    assert found == {("Aprice $1.20 now and then", 3), ("price $1.20 now and then", 3)}
    top = html.relevant_blocks(html.scored_blocks(html.nodes(pages)), "nothing here").where("page_id = 1").orderBy("place").collect()
    assert [r.place for r in top] == list(range(1, len(top) + 1))


def test_routing(spark):
    md = ["# a\n" * 7 + "words here. " * 40, "tiny text", "- a\n- b\n- c. Done. x" + "w" * 300, "p. " + "word " * 20_000]
    rows = routing.complexity(spark.createDataFrame([(i, m) for i, m in enumerate(md)], "k int, t string"), "t").orderBy("k").collect()
    assert rows[0].repeats == 7 and rows[1].tier == "vision" and rows[2].structure == 1.0 and rows[3].tier == "frontier" and rows[3].complexity == pytest.approx(0.65)
    order = [r.model_id for r in routing.cascade_order(sources.models(spark), "fast").orderBy("place").collect()]
    assert order == ["gemini/gemini-2.0-flash", "gemini/gemini-2.5-flash", "gemini/gemini-2.5-pro"]
    want = {"gemini/new": (1_000_000, 0, 1.25), "other": (5, 5, 0.0), "openai/gpt-4o": (1000, 1000, 0.0125), "openai/gpt-4o-mini": (10**6, 10**6, 0.75), "openai-like/x": (10**6, 0, 2.5), "anthropic/new": (0, 10**6, 15.0), "anthropic/claude-haiku-3.5": (10**6, 10**6, 4.8), "ollama/x": (9, 9, 0.0)}
    calls = spark.createDataFrame([(m, *v[:2]) for m, v in want.items()] + [(None, 1, 1)], "model string, tokens_in long, tokens_out long")
    got = {r.model: r.cost_usd for r in routing.estimated_cost(calls, sources.prices(spark)).collect()}
    assert got == {**{m: pytest.approx(v[2]) for m, v in want.items()}, None: 0.0}
    a = spark.createDataFrame([(1, 1, "a", 0.2, 0.06), (1, 2, "b", 0.4, 0.06), (1, 3, "c", 0.9, 0.01), (2, 1, "a", 0.6, 0.0), (2, 2, "b", 0.9, 0.0)], "k int, place int, model_id string, confidence double, cost_usd double")
    got = {r.k: (r.attempts, r.final_model, r.all_failed) for r in routing.cascade_outcome(a, "k").collect()}
    assert got == {1: (2, "b", True), 2: (1, "a", False)}


def test_grouping_by_nearness(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "title"), (1, 1, 40, 0, 10, 10, "price"), (1, 2, 95, 0, 10, 10, "title"), (1, 3, 0, 30, 5, 5, "title")], "p int, n int, x int, y int, width int, height int, label string")
    grouped = geometry.group_by_nearness(boxes, "p", "n", 50)
    assert [r.grp for r in grouped.orderBy("n").collect()] == [0, 0, 1, 0]
    whole = geometry.assemble(grouped.join(boxes.withColumn("value", F.concat("label", F.col("n").cast("string"))), ["p", "n"]), "p", "label", "value", "n")
    assert {r.grp: r.entity for r in whole.collect()} == {0: {"title": "title3", "price": "price1"}, 1: {"title": "title2"}}
    d = spark.createDataFrame([(0, 0, 10, 10, 13, 14, 5, 5)], "ax int, ay int, awidth int, aheight int, bx int, by int, bwidth int, bheight int")
    assert d.select(geometry.box_distance("a", "b").alias("d")).first().d == 5.0


def test_discovery_and_schemas(spark, pages):
    r = discover.discover(html.nodes(pages)).collect()
    assert [(x.page_id, x["count"], [(f.name, f.type) for f in x.fields], x.confidence) for x in r] == [(1, 3, [("h3", "str"), ("span", "str")], 0.4)]
    fields = [{"name": "id", "type": "int", "required": True}, {"name": "tags", "type": "list[str]"}, {"name": "x", "type": "odd"}]
    assert discover.struct_type(fields).simpleString() == "struct<id:bigint,tags:array<string>,x:string>" and discover.type_name("product card_item") == "ProductCardItem"
    assert discover.type_source("a b", fields[:1]) == "AB STRUCT<id: bigint>"
    rows = spark.createDataFrame([('{"id": 1, "tags": ["a"], "x": "y"}',), ('{"tags": []}',), ("{bad",), (None,)], "j string")
    got = discover.typed(rows, "j", fields).collect()
    assert got[0].entity.id == 1 and [r.entity_valid for r in got] == [True, False, False, False]
    out = discover.with_model(rows, lambda b: b.assign(n=b["j"].str.len()), ["j"], "j string, n double").collect()
    assert out[0].n == 34
    v = drift.versions(spark.createDataFrame([("d", 1, {"b": "x", "a": "x"}, "add"), ("d", 2, {"b": "x"}, "edit")], "k string, at int, schema_data map<string,string>, change_type string"), ["k"], ["at"])
    assert drift.timeline(v, ["k"], "at").first().timeline == "v1 [add] 1: a, b\nv2 [edit] 2: b"
