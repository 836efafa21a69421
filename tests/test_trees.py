"""The relation of nodes against trees that are walked node by node, over whole tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from pagemill.operators import discover, html

SF = "/root/testdata/sf0.001"
ODD = [
    (9001, "u", "<div><p>one two three four five six seven eight nine <a href=x>ten eleven</a> twelve</p>tail</div><ul>" + "<li><b>item</b> of a list, the same shape</li>" * 4 + "</ul>"),
    (9002, "u", "<section><div class='promo'><p>short</p></div><div class='share-it'>" + "long words " * 60 + "</div><span> </span><div></div>after</section><div role=banner>x</div>text"),
    (9006, "u", "plain <b>bold</b> end<p>a</p>b"), (9003, "u", None), (9004, "u", ""), (9005, "u", "<article><article><article><p>deep text that is long enough to be scored here</p></article></article></article>"),
]


@pytest.fixture(scope="module")
def table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    return pages.union(spark.createDataFrame(ODD, pages.schema))


@pytest.fixture(scope="module")
def nodes(table):
    return html.nodes(table).cache()


class Tree:
    """A page's rows as a tree."""

    def __init__(self, rows):
        self.rows = {r.pre: r for r in rows}
        self.children = defaultdict(list)
        for r in sorted(rows, key=lambda r: r.pre):
            self.children[r.parent if r.parent in self.rows else -1].append(r.pre)

    def text(self, pre):
        r = self.rows[pre]
        return r.own_text + "".join(self.text(c) + self.rows[c].tail_text for c in self.children[pre])

    def below(self, pre):
        for c in self.children[pre]:
            yield c
            yield from self.below(c)

    def shape(self, pre):
        return f"({self.rows[pre].tag}" + "".join(self.shape(c) + ")" for c in self.children[pre])


def trees(nodes):
    pages = defaultdict(list)
    for r in nodes.collect():
        pages[r.page_id].append(r)
    return {k: Tree(v) for k, v in pages.items()}


def squeezed(text):
    return text.strip(" \t\n\r\f\v")


def test_texts_of_all_subtrees(nodes):
    want = {(k, pre): squeezed(t.text(pre)) for k, t in trees(nodes).items() for pre in t.rows}
    got = {(r.page_id, r.pre): r.text for r in html.subtree_text(nodes).collect()}
    assert got == want


def test_scored_blocks(nodes):
    got = {(r.page_id, r.pre): r for r in html.scored_blocks(nodes).collect()}
    seen = 0
    for k, t in trees(nodes).items():
        for pre, r in t.rows.items():
            text = squeezed(t.text(pre))
            if r.tag not in html.SCORED_TAGS or len(text) < 25:
                assert (k, pre) not in got
                continue
            below = [t.rows[c] for c in t.below(pre)]
            markup = r.size + len(r.own_text) + sum(x.size + len(x.own_text) + len(x.tail_text) for x in below)
            density = sum(len(squeezed(t.text(x.pre))) for x in below if x.tag == "a") / len(text)
            bonus = {"article": 0.25, "main": 0.25, "p": 0.15, "blockquote": 0.15, "h1": 0.1, "h2": 0.1, "h3": 0.1}.get(r.tag, 0)
            length = 0.15 if len(text) > 500 else 0.1 if len(text) > 200 else 0
            row = got[k, pre]
            seen += 1
            assert row.text == text and row.link_density == pytest.approx(density) and row.n_chars == len(text)
            assert row.score == pytest.approx(min(1, max(0, 0.5 * len(text) / markup - 0.3 * density + bonus + length)))
    assert seen == len(got) > 100


def test_pruning(nodes):
    """Subtrees go step by step, each step on what the one before it left; the text after a removed element stays."""
    import re

    got = {r.page_id: r.text for r in html.page_text(html.prune(nodes)).collect()}
    for k, t in trees(nodes).items():
        gone = set()

        def named(r):
            return re.search(f"(?i)({html.BOILERPLATE_NAMES})", f"{r.attrs.get('class', '')} {r.attrs.get('id', '')}")

        def text(pre):
            return t.rows[pre].own_text + "".join(("" if c in gone else text(c)) + t.rows[c].tail_text for c in t.children[pre])

        steps = [
            lambda r: r.tag in html.STRIP_TAGS,
            lambda r: r.tag in html.BOILERPLATE_TAGS or r.attrs.get("role", "").lower() in html.BOILERPLATE_ROLES or named(r) and len(squeezed(text(r.pre))) < 500,
            lambda r: re.search(html.HIDDEN_STYLES, r.attrs.get("style", "")) or r.attrs.get("aria-hidden", "").lower() == "true",
            lambda r: r.tag in html.CONTAINERS and not r.own_text.strip(" ") and all(c in gone and not t.rows[c].tail_text for c in t.children[r.pre]),
        ]
        for step in steps:
            now = [pre for pre, r in t.rows.items() if pre not in gone and step(r)]
            gone |= set(now)
        want = "\n".join(("" if c in gone else text(c)) + t.rows[c].tail_text for c in t.children[-1])
        assert squeezed(got.get(k, "")) == squeezed(want), k


def structures(t, least, shortest, deepest=10):
    found = defaultdict(list)
    for pre, r in sorted(t.rows.items()):
        text = squeezed(t.text(pre))
        if r.tag not in ("html", "body", "head") and r.depth <= deepest and len(text) >= shortest:
            found[hashlib.md5(f"{r.depth}:{t.shape(pre)}".encode()).hexdigest()[:12]].append((pre, text))
    return {s: (len(v), v[0][0], v[0][1][:500]) for s, v in found.items() if len(v) >= least}


def test_repeated_subtrees(nodes):
    got = defaultdict(dict)
    for r in html.repeated_subtrees(nodes, shortest=1).collect():
        got[r.page_id][r.structure] = (r["count"], r.first_pre, r["sample"])
    want = {k: s for k, t in trees(nodes).items() if (s := structures(t, 3, 1))}
    assert dict(got) == want and len(want) > 10


def test_structures_recur_at_any_depth(spark):
    """Nested deeper than ten: against trees walked node by node, a page without a key, and the schema of such a page."""
    rng = random.Random(4)

    def branch(left):
        inner = "".join(branch(left - 1) for _ in range(rng.choice([1, 1, 2]))) if left else rng.choice(["", "a ", " some words", "\n"])
        return f"<div>{inner}</div>" + rng.choice(["", "tail "]) if rng.random() < 0.9 else f"<span>{inner}</span>"

    pages = [(k, "<div>" * 9 + "".join(branch(6) for _ in range(5))) for k in range(8)]
    cards = "<section>" * 14 + "".join(f"<article><b>Title number {i}</b> and words</article>" for i in range(4))
    deep = html.nodes(spark.createDataFrame([*pages, (98, cards), (None, "<div>" * 12 + "<p>a</p>" * 3)], "page_id long, html string")).cache()
    got = defaultdict(dict)
    for r in html.repeated_subtrees(deep, shortest=1).collect():
        got[r.page_id][r.structure] = (r["count"], r.first_pre, r["sample"])
    walked = {k: (t, s) for k, t in trees(deep).items() if (s := structures(t, 3, 1, deepest=99))}
    assert dict(got) == {k: s for k, (_, s) in walked.items()}
    assert sum(t.rows[first].depth > 10 for t, s in walked.values() for _, first, _ in s.values()) > 20
    assert got[None] == {hashlib.md5(b"12:(p").hexdigest()[:12]: (3, 12, "a")}
    assert {r.page_id: (r["count"], r.selector) for r in discover.discover(deep).collect()}[98] == (4, "article")


def test_discovered_schemas_follow_the_most_frequent_structure(nodes):
    for r in discover.discover(nodes).collect():
        t = trees(nodes.where(f"page_id = {r.page_id}"))[r.page_id]
        found = structures(t, 3, 20) or structures(t, 3, 1)
        assert r["count"] in {n for n, *_ in found.values()}
        assert all(f.name and f.type for f in r.fields) and 0 <= r.confidence <= 1


def test_every_page_has_one_parse(table, nodes):
    tags = Counter(r.page_id for r in nodes.collect())
    assert set(tags) == {r.page_id for r in table.collect() if r.html}


def test_parsing_is_linear():
    import time

    n = 100_000
    pages = {
        "nested": "<div>" * n, "closed": "<div>" * n + "</div>" * n, "unmatched": "<div>" * n + "</b>" * n, "texts": "<p>" + "a</b>" * n,
        "paragraphs": "<table>" + "<p>x" * n, "items": "<ul>" + "<li>x" * n, "comments": "<b>" + "a<!-- -->" * n,
    }
    for name, page in pages.items():
        began = time.process_time()
        rows = html.parse_nodes(page)
        assert time.process_time() - began < 8, name  # under 2 s alone on the machine; it was minutes
        assert sum(len(r[7]) + len(r[8]) for r in rows) == (0 if name in ("nested", "closed", "unmatched") else n)


def test_selectors_of_discovered_fields_return_the_cluster(spark, nodes):
    """Every selector names the elements of its structure (or their leaves at one place) and nothing else of the page."""
    cards = '<div class="top"><p class="price">9</p></div>' + "".join(f'<div class="card c{i}"><h3>Title number {i}</h3><span class="price">{i}.50</span><p>some words {i}</p></div>' for i in range(4))
    plain = "".join(f"<div><h3>Title number {i}</h3><b>{i} and more words</b></div>" for i in range(4)) + "<div><i>alone</i></div>"
    odd = html.nodes(spark.createDataFrame([(990001, f"<body>{cards}</body>"), (990002, f"<body><section>{plain}</section></body>")], "page_id long, html string"))
    both = nodes.unionByName(odd).cache()
    told = {(r.page_id, r.pre): r.structure for r in html.structures(both).collect()}
    found = {r.page_id: r for r in discover.discover(both).collect()}
    assert found[990001].selector == "div.card" and [(f.name, f.type, f.selector) for f in found[990001].fields] == [("h3", "str", "h3"), ("price", "float", "span"), ("p", "str", "div.card > p")]
    assert found[990002].selector is None and [f.selector for f in found[990002].fields] == ["h3", "b"]  # one more div is not to be told apart
    checked = 0
    for page, r in found.items():
        own = both.where(F.col("page_id") == page)
        elements = sorted(pre for (k, pre), s in told.items() if (k, s) == (page, r.structure))
        assert len(elements) == r["count"]
        for selector, at in [(r.selector, 0)] + [(f.selector, None) for f in r.fields]:
            if selector and checked < 24:
                got = sorted(n.pre for n in html.selected(own, selector).collect())
                assert len(got) == len(elements) and len({g - e for g, e in zip(got, elements, strict=True)}) == 1, selector
                checked += 1
    assert checked > 5


def test_tasks_hand_on_nodes_and_texts_before_their_batch_ends(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(html, "NODES_AT_ONCE", 10)
    monkeypatch.setattr(html, "CHARS_AT_ONCE", 100)
    pages = ["<p>a<b>c</b></p>", None, "<p>x</p>" * 4] * 50
    whole = [(k, *r) for k, page in enumerate(pages) for r in html.parse_nodes(page)]
    out = list(html._parsed(iter([pa.record_batch({"k": pa.array(range(150)), "html": pa.array(pages)})]), "all"))
    assert max(b.num_rows for b in out) < 10 + 4
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert [(*r[:7], dict(r[7]), *r[8:]) for r in got] == whole
    names = ("pre", "post", "parent", "depth", "sib", "tag", "attrs", "own_text", "tail_text", "size")
    kind = pa.list_(pa.struct([(n, pa.string() if n.endswith("text") or n == "tag" else pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])) if n == "attrs" else pa.int32()) for n in names]))
    held = [[dict(zip(names, [*r[:6], [], *r[7:]], strict=True)) for r in html.parse_nodes(page)] for page in pages]
    texts = list(html._rendered(iter([pa.record_batch({"k": pa.array(range(150)), "rows": pa.array(held, kind)})]), True))
    assert len(texts) > 5 and [r["k"] for b in texts for r in b.to_pylist()] == list(range(150))
    assert [r["markdown"] for b in texts for r in b.to_pylist()] == [html.markdown_of(html.parse_nodes(page)) for page in pages]


def test_words_of_blocks_are_not_shuffled(spark):
    rows = [(1, 2, "p", "the a", 5, 0.0, 0.5), (1, 3, "p", "b b", 3, 0.0, 0.5), (1, 4, "p", "", 0, 0.0, 0.5)]
    found = html.relevant_blocks(spark.createDataFrame(rows, "page_id int, pre int, tag string, text string, n_chars int, link_density double, score double"), "b")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r.pre, r.place, round(r.score, 9)) for r in found.orderBy("place").collect()] == [(3, 1, 0.7), (2, 2, 0.3), (4, 3, 0.3)]
