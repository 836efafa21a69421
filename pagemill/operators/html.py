"""Pages as a relation of nodes, and the operators on it: prune, score, render, extract, mine.

A page is parsed once, into nodes with nested-set intervals: a node's subtree is the nodes of its page with
pre <= n.pre <= post. Everything after is joins and aggregates within a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import counted, once, strip_currency, strip_whitespace
from ..sources import materialised

# What pruning removes by tag, role, class or id, and style; what it may remove if empty.
STRIP_TAGS = ("script", "style", "noscript", "link", "meta", "iframe", "object", "embed", "applet", "svg", "canvas", "video", "audio", "source", "track", "template", "slot")
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside")
BOILERPLATE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "menu", "menubar", "toolbar", "status", "search")
BOILERPLATE_NAMES = "footer|sidebar|cookie|banner|popup|modal|overlay|social|share|widget|ad[s_-]|promo|sponsor|newsletter|signup|menu|breadcrumb|pagination|related|recommend|comment"
HIDDEN_STYLES = r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:[;\s]|$)|height\s*:\s*0(?:px)?(?:[;\s]|$)|overflow\s*:\s*hidden.*height\s*:\s*0"
SUBSTANTIAL = 500
CONTAINERS = ("div", "span", "section", "article")
SCORED_TAGS = ("p", "article", "main", "section", "div", "td", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that end where an element starts, and where the search for them stops.
CLOSES = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)),
}
P_STOPS = ("table", "td", "th", "button")
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

NODES = "pre int, post int, parent int, depth int, sib int, tag string, attrs map<string,string>, own_text string, tail_text string, size int"


class _Builder(HTMLParser):
    """Rows of the node relation in document order; void and implied ends as browsers have them.

    Open elements are also kept by tag, so the innermost of some tags is found without walking through the others, and
    texts are kept in pieces until the end: the time is linear in the markup, however deep or broken it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.depths: dict[str, list[int]] = {}  # by tag, where its open elements are among self.open
        self.children: list[int] = []
        self.last: int | None = None  # the node whose tail follows; None: text belongs to the open element

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end(("p",), P_STOPS)
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        parent = self.open[-1] if self.open else -1
        sib = self.children[parent] if parent >= 0 else 0
        if parent >= 0:
            self.children[parent] += 1
        at = len(self.rows)
        self.rows.append([at, at, parent, len(self.open), sib, tag, {k: v or "" for k, v in attrs}, [], [], len(self.get_starttag_text() or "")])
        self.children.append(0)
        if tag in VOID:
            self.last = at
        else:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(at)
            self.last = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _innermost(self, tags: tuple[str, ...]) -> int:
        return max((places[-1] for t in tags if (places := self.depths.get(t))), default=-1)

    def _end(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the innermost of `tags` and what is in it, unless one of `stops` lies between."""
        at = self._innermost(tags)
        if at >= 0 and at >= self._innermost(stops):
            self._close(at)

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            self.last = self.open.pop()
            row = self.rows[self.last]
            row[1] = len(self.rows) - 1
            row[9] += len(row[5]) + 3
            self.depths[row[5]].pop()

    def handle_endtag(self, tag):
        self._end((tag,), ())

    def handle_data(self, data):
        if self.last is not None:
            self.rows[self.last][8].append(data)
        elif self.open:
            self.rows[self.open[-1]][7].append(data)
        elif self.rows or data.strip():  # text before the first element, in a node of its own
            at = len(self.rows)
            self.rows.append([at, at, -1, 0, 0, "#text", {}, [data], [], 0])
            self.children.append(0)
            self.last = at

    def done(self) -> list[list]:
        self.close()
        self._close(0)
        for row in self.rows:
            row[7], row[8] = "".join(row[7]), "".join(row[8])
        return self.rows


REFERENCE = re.compile(r"&(#\d+;|#[xX][0-9a-fA-F]+;|\w+;)?")
#: Code points that no text has; one stands for an ampersand that is to be kept.
NO_CHARACTERS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def parse_nodes(html: str | None, references: str = "all") -> list[list]:
    """The rows of a page. references: which are resolved, all (as browsers do), closed (by a semicolon), or none."""
    if references not in ("all", "closed", "none"):
        raise ValueError(f"not a choice of references: {references!r}")
    html, builder, held = html or "", _Builder(), ""
    if references != "all" and "&" in html:
        held = next(c for c in NO_CHARACTERS if c not in html)
        known = lambda name: references == "closed" and name and (name[0] == "#" or name in html5)
        html = REFERENCE.sub(lambda m: m[0] if known(m[1]) else held + (m[1] or ""), html)
    builder.feed(html)
    rows = builder.done()
    for row in rows if held else ():
        row[5], row[7], row[8] = (row[i].replace(held, "&") for i in (5, 7, 8))
        row[6] = {k.replace(held, "&"): v.replace(held, "&") for k, v in row[6].items()}
    return rows


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", references: str = "all") -> DataFrame:
    """key and one row per element: pre, post, parent, depth, sib, tag, attrs, own_text, tail_text, size.

    own_text comes before the first child, tail_text follows the element inside its parent, size is the length of its
    own markup. A null or empty page has no nodes. references: see parse_nodes.
    """
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("html")).mapInArrow(lambda batches: _parsed(batches, references), f"k {kind}, {NODES}").withColumnRenamed("k", key)


#: A task parses or renders pages one by one and hands on what it has at this many nodes or characters, so its memory does not grow with its batch.
NODES_AT_ONCE, CHARS_AT_ONCE = 8192, 1 << 22


def _parsed(batches: Iterator[pa.RecordBatch], references: str) -> Iterator[pa.RecordBatch]:
    """Batches of key and html as batches of nodes."""
    for batch in batches:
        at, held, size = [], [], 0
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            rows = parse_nodes(text, references)
            at += [i] * len(rows)
            held += rows
            size += len(text or "")
            if held and (len(held) >= NODES_AT_ONCE or size >= CHARS_AT_ONCE):
                yield _node_batch(batch.column(0), at, held)
                at, held, size = [], [], 0
        if held:
            yield _node_batch(batch.column(0), at, held)


def _node_batch(keys: pa.Array, at: list[int], rows: list[list]) -> pa.RecordBatch:
    """Rows of parse_nodes as a batch; `at` tells the place of each one's page among the keys."""
    *numbers, tags, attrs, own, tails, sizes = zip(*rows, strict=True)
    arrays = [pa.array(c, pa.int32()) for c in numbers] + [pa.array(tags, pa.string()), pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string()))]
    arrays += [pa.array(own, pa.string()), pa.array(tails, pa.string()), pa.array(sizes, pa.int32())]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *arrays], ["k", *(c.split()[0] for c in NODES.split(", "))])


def _slices(all_nodes: DataFrame, key: str, tops: Column | DataFrame | None, pieces: dict[str, tuple[Column, Column]], told=lambda texts, depth: texts["text"]) -> DataFrame:
    """key, pre and text of the subtrees of `tops`: what their nodes write where they open and close, their own closing left out.

    A page becomes one row, with its pieces in the order of opening and closing and the places of its tops among them, so
    a text is put together from its own pieces alone. Everything is partitioned by page: one shuffle. pieces: what nodes
    write, by the name of a text; told: what is kept, as text, of a top's texts and its depth, so that no row holds more.
    """
    if isinstance(tops, DataFrame):
        all_nodes = all_nodes.join(tops.select(key, "pre", F.lit(True).alias("__top")), [key, "pre"], "left")
        tops = F.col("__top")
    wanted = F.coalesce(tops, F.lit(False)) if tops is not None else F.lit(True)
    end = lambda at, n, side: F.struct(at.alias("at"), n.alias("n"), F.col("pre"), F.col("depth"), *[p[side].alias(f"t_{name}") for name, p in pieces.items()], wanted.alias("top"), F.lit(side == 0).alias("opening"))
    ends = F.array(end(F.col("pre"), F.lit(0), 0), end(F.col("post"), 1_000_001 - F.col("depth"), 1))
    rows = all_nodes.select(key, F.explode(ends).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("ends"))

    def places(ends: Column, opening: bool) -> Column:
        """The tops' places among the ends, in the order of the nodes, which is that of their openings."""
        of = F.filter(F.transform(ends, lambda e, i: F.struct(e["pre"].alias("pre"), i.alias("i"), e["depth"].alias("depth"), (e["top"] & (e["opening"] == opening)).alias("ok"))), lambda e: e["ok"])
        return of if opening else F.array_sort(of)

    def texts(ends: Column) -> Column:
        joined = lambda pieces, s: F.array_join(F.slice(pieces, s["o"]["i"] + 1, s["c"]["i"] - s["o"]["i"]), "")
        written = lambda name: F.transform(ends, lambda e: e[f"t_{name}"]).alias(name)
        spans = F.arrays_zip(places(ends, True).alias("o"), places(ends, False).alias("c"))
        kept = lambda p, s: told({name: joined(p[name], s) for name in pieces}, s["o"]["depth"])
        return once(F.struct(*map(written, pieces)), lambda p: F.transform(spans, lambda s: F.struct(s["o"]["pre"].alias("pre"), kept(p, s).alias("text"))))

    return rows.select(key, F.explode(once(F.col("ends"), texts)).alias("s")).select(key, "s.pre", "s.text")


def subtree_text(all_nodes: DataFrame, key: str = "page_id", tops: Column | DataFrame | None = None) -> DataFrame:
    """key, pre and the text, trimmed, of the subtrees of `tops` (a condition, or some of the nodes; default: every node)."""
    return _slices(all_nodes, key, tops, {"text": (F.col("own_text"), F.col("tail_text"))}).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def subtree_sums(all_nodes: DataFrame, values: dict[str, Column], key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, pre and for each value its sum over the node's descendants, by running sums in the order of opening and closing; and the node's own `carry` columns."""
    ends = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("n"), F.lit(True).alias("opening")), F.struct(F.col("post").alias("at"), (1_000_001 - F.col("depth")).alias("n"), F.lit(False).alias("opening")))
    rows = all_nodes.select(key, "pre", *[v.alias(n) for n, v in values.items()], *carry, F.explode(ends).alias("p")).select("*", "p.*").drop("p")
    so_far = Window.partitionBy(key).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(F.when(F.col("opening"), F.col(n)).otherwise(0)).over(so_far) for n in values})
    sums = [(F.max(F.when(~F.col("opening"), F.col(n))) - F.max(F.when(F.col("opening"), F.col(n)))).alias(n) for n in values]
    return rows.groupBy(key, "pre").agg(*sums, *[F.first(c).alias(c) for c in carry])


def without(all_nodes: DataFrame, doomed: Column, key: str = "page_id") -> DataFrame:
    """all_nodes without the subtrees of the nodes for which `doomed` holds.

    A node goes if a doomed one opened at or before it has not closed: a running maximum, no join. Text that follows a
    removed element stays, in a node of its own with the tag #text.
    """
    w = Window.partitionBy(key).orderBy("pre")
    closes = F.when(F.coalesce(doomed, F.lit(False)), F.col("post"))
    marked = all_nodes.withColumn("__upto", F.max(closes).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("__outer", F.coalesce(F.max(closes).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("pre"), F.lit(False)))
    gone = F.coalesce(F.col("__upto") >= F.col("pre"), F.lit(False))
    marked = marked.withColumn("__gone", gone).where(~F.col("__gone") | ~F.col("__outer") & (F.col("tail_text") != ""))
    blank = {"post": F.col("pre"), "tag": F.lit("#text"), "attrs": F.create_map().cast("map<string,string>"), "own_text": F.lit(""), "size": F.lit(0)}
    return marked.withColumns({c: F.when(F.col("__gone"), v).otherwise(F.col(c)) for c, v in blank.items()}).select(*all_nodes.columns)


def attribute(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", F.lit(name)), F.lit(""))


def prune(all_nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes without noise tags, boilerplate, hidden elements and empty containers, in this order.

    Boilerplate goes by tag or role, or by a class or id that names it if it holds under SUBSTANTIAL characters.
    """
    left = without(all_nodes, F.col("tag").isin(*STRIP_TAGS), key)
    named = F.rlike(F.concat(attribute("class"), F.lit(" "), attribute("id")), F.lit(f"(?i)({BOILERPLATE_NAMES})"))
    certain = F.col("tag").isin(*BOILERPLATE_TAGS) | F.lower(attribute("role")).isin(*BOILERPLATE_ROLES)
    short = subtree_text(left, key, named & ~certain).where(F.length("text") < SUBSTANTIAL).select(key, "pre", F.lit(True).alias("__short"))
    left = without(left.join(short, [key, "pre"], "left"), certain | F.col("__short"), key).drop("__short")
    left = without(left, F.rlike(attribute("style"), F.lit(HIDDEN_STYLES)) | (F.lower(attribute("aria-hidden")) == "true"), key)
    childless = F.coalesce(F.lead("parent").over(Window.partitionBy(key).orderBy("pre")) != F.col("pre"), F.lit(True))
    left = left.withColumn("__childless", childless)
    return without(left, F.col("tag").isin(*CONTAINERS) & (F.trim("own_text") == "") & F.col("__childless"), key).drop("__childless")


def page_text(all_nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key and text of each page: its elements outside all others, and what follows them, a line each, trimmed."""
    tail = F.when(F.col("parent") == -1, F.concat("tail_text", F.lit("\n"))).otherwise(F.col("tail_text"))
    ends = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("n"), F.col("own_text").alias("t")), F.struct(F.col("post").alias("at"), (1_000_001 - F.col("depth")).alias("n"), tail.alias("t")))
    rows = all_nodes.select(key, F.explode(ends).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select(key, F.regexp_replace(F.array_join(F.transform("e", lambda e: e["t"]), ""), r"^\s+|\s+$", "").alias("text"))


def scored_blocks(all_nodes: DataFrame, key: str = "page_id", shortest: int = 25) -> DataFrame:
    """key, pre, tag, text, n_chars, link_density, score of content elements.

    Half the share of text in markup, less 0.3 of the share of text in links, plus bonuses for tag and length, within 0 and 1.
    """
    scored = F.col("tag").isin(*SCORED_TAGS)
    texts = subtree_text(all_nodes, key, scored | (F.col("tag") == "a")).withColumn("n_chars", F.length("text"))
    measured = all_nodes.join(texts, [key, "pre"], "left").withColumn("outer", F.col("size") + F.length("own_text"))
    linked = F.when(F.col("tag") == "a", F.col("n_chars")).otherwise(0)
    both = subtree_sums(measured, {"linked": linked, "inner": F.col("outer") + F.length("tail_text")}, key, ("tag", "text", "n_chars", "outer"))
    both = both.where(scored & (F.col("n_chars") >= shortest))
    both = both.withColumn("markup", F.col("inner") + F.col("outer"))
    density = F.col("linked") / F.greatest(F.col("n_chars"), F.lit(1))
    bonus = F.when(F.col("tag").isin("article", "main"), 0.25).when(F.col("tag").isin("p", "blockquote"), 0.15).when(F.col("tag").isin("h1", "h2", "h3"), 0.10).otherwise(0.0)
    length = F.when(F.col("n_chars") > 500, 0.15).when(F.col("n_chars") > 200, 0.10).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.col("n_chars") / F.greatest(F.col("markup"), F.lit(1)) - 0.3 * density + bonus + length))
    return both.select(key, "pre", "tag", "text", "n_chars", density.alias("link_density"), score.alias("score"))


def top_blocks(blocks: DataFrame, key: str = "page_id", k: int = 10) -> DataFrame:
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pre"))).where(F.col("place") <= k)


def relevant_blocks(blocks: DataFrame, query: str, key: str = "page_id", k: int = 10, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """The k best blocks of each page for a query: 0.6 of the block's score and 0.4 of its BM25, divided by the page's largest if that is above 0.

    The corpus of a page is its blocks, so all statistics are within a page, and a page's blocks become one row: no row
    stands for a word. A word in more than half of the blocks has `floor` times the mean inverse frequency of the page's
    words; a word that the query repeats counts each time.
    """
    asked = Counter(query.lower().split())
    names = [c for c in blocks.columns if c != key]
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    often = lambda w, a: F.size(F.filter(w, lambda x: x == a))
    told = once(words, lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(w).alias("words"), F.array(*[often(w, a) for a in asked]).cast("array<int>").alias("tf")))
    pages = blocks.select(key, F.struct(F.struct(*names).alias("block"), told.alias("own")).alias("b")).groupBy(key).agg(F.collect_list("b").alias("bs"))
    docs = F.size("bs")
    raw = lambda df: F.log((docs - df + 0.5) / (df + 0.5))
    mean = F.aggregate("bs", F.lit(0.0), lambda s, x: s + x["own"]["n"]) / docs
    every = counted(F.flatten(F.transform("bs", lambda x: x["own"]["words"])))
    mean_idf = once(F.transform(every, lambda w: raw(w["n"])), lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / F.size(r))
    own_idf = lambda i, m: once(raw(F.size(F.filter("bs", lambda x: x["own"]["tf"][i] > 0))), lambda r: F.when(r < 0, floor * m).otherwise(r))
    page = once(mean_idf, lambda m: F.struct(mean.alias("mean"), F.array(*[own_idf(i, m) for i in range(len(asked))]).cast("array<double>").alias("idf")))

    def worth(own: Column, of: Column) -> Column:
        part = lambda i, times: times * of["idf"][i] * own["tf"][i] * (k1 + 1) / (own["tf"][i] + k1 * (1 - b + b * own["n"] / of["mean"]))
        return sum((F.when(own["tf"][i] > 0, part(i, times)).otherwise(0.0) for i, times in enumerate(asked.values())), F.lit(0.0))

    weighed = once(page, lambda of: F.transform("bs", lambda x: F.struct(x["block"].alias("block"), worth(x["own"], of).alias("bm25"))))

    def ranked(rows: Column, most: Column) -> Column:
        score = lambda x: 0.6 * x["block"]["score"] + 0.4 * x["bm25"] / F.when(most > 0, most).otherwise(1.0)
        found = F.transform(rows, lambda x: F.struct((-score(x)).alias("order"), x["block"]["pre"].alias("pre"), score(x).alias("score"), x["block"].alias("block")))
        return F.slice(F.array_sort(found), 1, k)

    best = once(weighed, lambda rows: once(F.array_max(F.transform(rows, lambda x: x["bm25"])), lambda most: ranked(rows, most)))
    rows = pages.select(key, F.posexplode(best).alias("at", "b"))
    return rows.select(*[F.col(key) if c == key else F.col("b.score" if c == "score" else f"b.block.{c}").alias(c) for c in blocks.columns], (F.col("at") + 1).alias("place"))


def structures(all_nodes: DataFrame, key: str = "page_id", shortest: int = 20, least: int = 3) -> DataFrame:
    """key, pre, structure and sample (500 characters of the text) of the subtrees with some text that may recur `least` times on their page, at any depth.

    A structure is the hash of a subtree's tags, nested as they are, and of the depth it lies at. Equal structures have as
    many nodes, so a subtree without enough others of its depth, tag and size can't recur: what wraps a deep page is never put
    together. A page is one row of one shuffle, and of a text only its sample outlasts the row.
    """
    alike = F.count(F.lit(1)).over(Window.partitionBy(key, "depth", "tag", F.col("post") - F.col("pre")))
    rows = all_nodes.select(key, "pre", "post", "depth", "tag", "own_text", "tail_text").repartition(key).withColumn("__alike", alike)
    pieces = {"text": (F.col("own_text"), F.col("tail_text")), "shape": (F.concat(F.lit("("), F.col("tag")), F.lit(")"))}

    def told(texts: dict[str, Column], depth: Column) -> Column:
        structure = F.substring(F.md5(F.concat_ws(":", depth, texts["shape"])), 1, 12)
        found = lambda t: F.when(F.length(t) >= shortest, F.struct(structure.alias("structure"), F.substring(t, 1, 500).alias("sample")))
        return once(F.btrim(texts["text"], F.lit(" \t\n\x0b\f\r")), found)

    found = _slices(rows, key, ~F.col("tag").isin("html", "body", "head") & (F.col("__alike") >= least), pieces, told)
    return found.where("text IS NOT NULL").select(key, "pre", "text.structure", "text.sample")


def repeated_subtrees(all_nodes: DataFrame, key: str = "page_id", least: int = 3, shortest: int = 20, told: DataFrame | None = None) -> DataFrame:
    """Structures that recur on a page: key, structure, count, first_pre, sample (500 characters of the first), place (the most frequent first).

    told: structures() of the nodes, if it is at hand.
    """
    both = structures(all_nodes, key, shortest, least) if told is None else told
    found = both.groupBy(key, "structure").agg(F.count(F.lit(1)).alias("count"), F.min("pre").alias("first_pre"), F.min_by("sample", "pre").alias("sample"))
    return found.where(F.col("count") >= least).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first_pre")))


NAME = r"[\w-]+"
#: One piece of a compound CSS selector, and one predicate of an XPath step.
PIECE = re.compile(
    rf"""(?P<tag>^(?:\*|{NAME}))|\.(?P<cls>{NAME})|\#(?P<id>{NAME})|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[\w.-]+))\s*)?\]|:(?P<pseudo>{NAME})(?:\(\s*(?P<arg>[^()]*?)\s*\))?""",
    re.X,
)
PREDICATE = re.compile(
    r"""\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|(?P<has>@[\w:-]+)|(?P<left>@[\w:-]+|text\(\)|\.)\s*=\s*(?P<q>["'])(?P<value>.*?)(?P=q)|contains\(\s*(?P<part>@[\w:-]+|text\(\)|\.)\s*,\s*(?P<r>["'])(?P<piece>.*?)(?P=r)\s*\))\s*\]"""
)
RELATIONS = {" ": "inside", ">": "child", "+": "next", "~": "later"}


def _tokens(selector: str, pattern: str) -> list[str]:
    """selector cut at the matches of pattern outside brackets and quotes; the matches are kept."""
    out, held, depth, quote, at = [], "", 0, "", 0
    cut = re.compile(pattern)
    while at < len(selector):
        c = selector[at]
        m = None if depth or quote else cut.match(selector, at)
        if m:
            out += [held, m[0]]
            held, at = "", m.end()
            continue
        quote = "" if c == quote else quote or (c if c in "\"'" else "")
        depth += 0 if quote else (c in "[(") - (c in "])")
        held, at = held + c, at + 1
    return [*out, held]


def _nth(argument: str) -> Column:
    """Whether a node's place among its siblings is one that `argument` (n, odd, even, an+b) names."""
    text = {"odd": "2n+1", "even": "2n"}.get(argument.replace(" ", ""), argument.replace(" ", ""))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|(\d+)", text)
    if not m:
        raise ValueError(f"not understood: :nth-child({argument})")
    place = F.col("sib") + 1
    if m[3]:
        return place == int(m[3])
    step, first = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1]), int(m[2] or 0)
    return place == first if step == 0 else (F.pmod(place - first, F.lit(abs(step))) == 0) & (place >= first if step > 0 else place <= first)


def _compound(text: str) -> Column:
    """What a compound CSS selector asks of a node."""
    keep, at = F.lit(True), 0
    while at < len(text):
        m = PIECE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not understood: {text[at:]!r} in a selector")
        g, at = m.groupdict(), m.end()
        if g["tag"] is not None:
            keep = keep if g["tag"] == "*" else keep & (F.col("tag") == g["tag"].lower())
        elif g["cls"] is not None:
            keep = keep & F.array_contains(F.split(attribute("class"), r"\s+"), g["cls"])
        elif g["id"] is not None:
            keep = keep & (attribute("id") == g["id"])
        elif g["attr"] is not None:
            value, held, has = next((g[v] for v in ("v1", "v2", "v3") if g[v] is not None), None), attribute(g["attr"]), F.map_contains_key("attrs", g["attr"])
            tests = {None: has, "=": has & (held == value), "^=": F.startswith(held, F.lit(value)), "$=": F.endswith(held, F.lit(value)), "*=": F.contains(held, F.lit(value))}
            tests |= {"~=": F.array_contains(F.split(held, r"\s+"), value), "|=": has & ((held == value) | F.startswith(held, F.lit(f"{value}-")))}
            keep = keep & tests[g["op"]] & F.lit(value != "" or g["op"] in (None, "=", "|="))
        elif g["pseudo"] in ("first-child", "last-child", "only-child") and g["arg"] is None:
            first, last = F.col("sib") == 0, F.col("__last")
            keep = keep & {"first-child": first, "last-child": last, "only-child": first & last}[g["pseudo"]]
        elif g["pseudo"] == "nth-child" and g["arg"] is not None:
            keep = keep & _nth(g["arg"])
        elif g["pseudo"] == "not" and g["arg"]:
            keep = keep & ~_compound(g["arg"])
        else:
            raise ValueError(f"not understood: :{g['pseudo']} in a selector")
    return keep


def _css(selector: str) -> list[list[tuple[str, Column]]]:
    """Alternatives, each a chain of (relation to the step before, condition)."""
    chains = []
    for alternative in _tokens(selector, r"\s*,\s*")[::2]:
        parts = _tokens(alternative.strip(), r"\s*[>+~]\s*|\s+")
        if not all(parts[::2]):
            raise ValueError(f"not understood: {alternative!r}")
        relations = ["inside", *(RELATIONS[x.strip() or " "] for x in parts[1::2])]
        chains.append([(r, _compound(c)) for r, c in zip(relations, parts[::2], strict=True)])
    return chains


def _xpath(path: str) -> list[tuple[str, Column]]:
    """Steps of an XPath of /tag and //tag with predicates [n], [last()], [@a], [@a='v'], [text()='v'] and [contains(...)]."""
    parts = _tokens(path, r"//?")
    if parts[0] or not all(parts[2::2]):
        raise ValueError(f"not understood: {path!r}")
    chain = []
    for number, (slash, step) in enumerate(zip(parts[1::2], parts[2::2], strict=True)):
        name = re.match(rf"\*|{NAME}", step)
        if not name:
            raise ValueError(f"not understood: {step!r} in {path!r}")
        keep, at, numbered = F.lit(True) if name[0] == "*" else F.col("tag") == name[0].lower(), name.end(), False
        while at < len(step):
            m = PREDICATE.match(step, at)
            if not m or numbered or (m["n"] or m["last"]) and (name[0] == "*" or at > name.end()):
                raise ValueError(f"not understood: {step[at:]!r} in {path!r}")
            at = m.end()
            of = lambda x: F.col("own_text") if x in ("text()", ".") else attribute(x[1:])
            numbered = bool(m["n"] or m["last"])
            if m["n"]:
                keep = keep & (F.col("__nth") == int(m["n"]))
            elif m["last"]:
                keep = keep & F.col("__last_of_tag")
            elif m["has"]:
                keep = keep & F.map_contains_key("attrs", m["has"][1:])
            elif m["left"]:
                keep = keep & (of(m["left"]) == m["value"])
            else:
                keep = keep & F.contains(of(m["part"]), F.lit(m["piece"]))
        chain.append(("inside" if slash == "//" else "child" if number else "root", keep))
    return chain


def selected(all_nodes: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The nodes a CSS selector names, or an XPath if it begins with / or (.

    CSS: lists, descendants, > + ~, tags, classes, ids, attributes with all operators, :first-child, :last-child,
    :only-child, :nth-child() and :not(). XPath: see _xpath, and (path)[n] for the n-th in the page. Anything else raises a
    ValueError; nothing is passed over.
    """
    place = None
    if whole := re.fullmatch(r"\((.*)\)(?:\[(\d+)\])?", selector.strip(), re.S):
        selector, place = whole[1], whole[2] and int(whole[2])
    chains = [_xpath(selector.strip())] if selector.strip().startswith("/") else _css(selector)
    siblings, same_tag = Window.partitionBy(key, "parent").orderBy("pre"), Window.partitionBy(key, "parent", "tag").orderBy("pre")
    marks = {"__last": (r"(last|only)-child", F.lead("pre").over(siblings).isNull()), "__nth": (r"\[\s*\d", F.row_number().over(same_tag)), "__last_of_tag": (r"last\(", F.lead("pre").over(same_tag).isNull())}
    marked = all_nodes.withColumns({n: v for n, (sign, v) in marks.items() if re.search(sign, selector)})
    found = None
    for chain in chains:
        hits = None
        for relation, keep in chain:
            now = marked.where(keep & (F.col("parent") == -1) if relation == "root" else keep)
            if hits is not None:
                up = hits.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("pre", "post", "parent", "sib")])
                brother = F.col("parent") == F.col("__parent")
                link = {
                    "inside": (F.col("pre") > F.col("__pre")) & (F.col("pre") <= F.col("__post")), "child": F.col("parent") == F.col("__pre"),
                    "next": brother & (F.col("sib") == F.col("__sib") + 1), "later": brother & (F.col("sib") > F.col("__sib")),
                }[relation]
                now = now.join(up, (F.col(key) == F.col("__k")) & link, "left_semi")
            hits = now
        hits = hits.select(*all_nodes.columns)
        found = hits if found is None else found.unionByName(hits).dropDuplicates([key, "pre"])
    if place:
        found = found.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy("pre"))).where(F.col("__place") == place).drop("__place")
    return found


def subtree_html(all_nodes: DataFrame, key: str = "page_id", tops: Column | DataFrame | None = None, written: bool = False) -> DataFrame:
    """key, pre and the markup, written anew, of the subtrees of `tops`, with the text that follows them; written: texts and attributes are markup already."""
    safe = lambda c: c if written else F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pairs = F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(safe(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"')))
    opens = F.concat(F.lit("<"), "tag", F.array_join(pairs, ""), F.lit(">"), safe(F.col("own_text")))
    end = F.when(F.col("tag").isin(*VOID), "").otherwise(F.concat(F.lit("</"), "tag", F.lit(">")))
    closes = F.concat(end, safe(F.col("tail_text")))
    inside = _slices(all_nodes, key, tops, {"text": (opens, closes)})
    return inside.join(all_nodes.select(key, "pre", closes.alias("__end")), [key, "pre"]).select(key, "pre", F.concat("text", "__end").alias("text"))


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link, strict=True)])


def extract_field(all_nodes: DataFrame, selector: str, kind: str = "text", attr: str | None = None, transform: str | None = None, multiple: bool = False, urls: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """key and value: the first element's text, html or attribute (kind), or all of them as an array without empty ones.

    kind written: html of nodes whose references are not resolved (references="none"), with texts and attributes as the page has them.
    transform: strip_currency, strip_whitespace, parse_date (trims), or to_absolute_url, for which urls has key and url.
    Pages without a match are absent; join from the pages to give them null.
    """
    hits = selected(all_nodes, selector, key)
    if kind not in ("text", "html", "written", "attribute"):
        raise ValueError(f"not a kind of value: {kind!r}")
    if kind == "attribute":
        values = hits.select(key, "pre", F.element_at("attrs", F.lit(attr)).alias("value"))
    else:
        found = subtree_text(all_nodes, key, hits) if kind == "text" else subtree_html(all_nodes, key, hits, kind == "written")
        values = found.withColumnRenamed("text", "value")
    if transform == "to_absolute_url":
        values = values.join(urls.select(key, "url"), key).withColumn("value", absolute_url(F.col("url"), F.col("value")))
    elif transform:
        change = {"strip_currency": strip_currency, "strip_whitespace": strip_whitespace, "parse_date": F.trim}[transform]
        values = values.withColumn("value", change(F.col("value")))
    if multiple:
        rows = values.where("value <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pre", "value"))).alias("v"))
        return rows.select(key, F.transform("v", lambda x: x["value"]).alias("value"))
    return values.groupBy(key).agg(F.min_by("value", "pre").alias("value"))


def extract(pages: DataFrame, fields: dict[str, dict], key: str = "page_id", html: str = "html", url: str = "url", references: str = "all") -> DataFrame:
    """key and a column for each field of a schema: {name: {selector, kind?, attr?, transform?, multiple?}}. Pages are parsed once; references: see parse_nodes."""
    parsed = materialised(nodes(pages, key, html, references), "nodes")
    out = pages.select(key, url)
    for name, config in fields.items():
        out = out.join(extract_field(parsed, urls=pages.select(key, url), key=key, **config).withColumnRenamed("value", name), key, "left")
    return out.drop(url)


BLOCK_MARKS = {**{f"h{n}": "#" * n + " " for n in range(1, 7)}, "li": "- ", "blockquote": "> "}
MARKDOWN_BLOCKS = frozenset("p div section article main ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre body html dl dt dd figure figcaption".split())
INLINE_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


def markdown_of(rows: list[list], citations: bool = True) -> str:
    """A page's nodes as Markdown: ATX headings, - bullets, pipe tables, ![alt](src), and links as [text][n] with notes below."""
    links: dict[str, int] = {}
    children: dict[int, list[list]] = {}
    for row in rows:
        children.setdefault(row[2], []).append(row)

    def squeeze(text: str) -> str:
        return re.sub(r"\s+", " ", text)

    def cells_of(row: list) -> list[list[list]]:
        """The cells of a table, by row; rows inside cells are the cells' own."""
        found, todo = [], [row]
        while todo:
            node = todo.pop()
            if node[5] == "tr":
                found.append([c for c in children.get(node[0], ()) if c[5] in ("td", "th")])
            else:
                todo += reversed(children.get(node[0], []))
        return found

    def table(cells: list[list[str]]) -> str:
        if not cells:
            return ""
        width = max(map(len, cells))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
        return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"

    def finished(row: list, text: str) -> str:
        """An element whose inside is rendered."""
        tag, attrs = row[5], row[6]
        if tag in ("br", "hr"):
            return "\n" if tag == "br" else "\n\n---\n\n"
        if tag == "img":
            return f"![{attrs.get('alt', '')}]({attrs.get('src', '')})"
        if tag == "a" and attrs.get("href") and text.strip():
            if not citations:
                return f"[{text.strip()}]({attrs['href']})"
            return f"[{text.strip()}][{links.setdefault(attrs['href'], len(links) + 1)}]"
        if tag in INLINE_MARKS and text.strip():
            return INLINE_MARKS[tag] + text.strip() + INLINE_MARKS[tag]
        if tag in MARKDOWN_BLOCKS:
            end = "\n" if tag in ("li", "tr") else "\n\n"
            return f"{end}{BLOCK_MARKS.get(tag, '')}{text.strip(' ')}{end}" if text.strip() else ""
        return text

    def render(root: list) -> str:
        """An element and all it holds, with a stack of its own: markup may be nested deeper than calls."""
        grids: dict[int, list[list[list]]] = {}
        whole: dict[int, str] = {}
        stack = [(root, False)]
        while stack:
            row, opened = stack.pop()
            if not opened:
                if row[5] == "table":
                    grids[row[0]] = cells_of(row)
                    inner = [c for line in grids[row[0]] for c in line]
                else:
                    inner = children.get(row[0], [])
                stack.append((row, True))
                stack += [(c, False) for c in reversed(inner)]
            elif row[5] == "table":
                whole[row[0]] = table([[(squeeze(c[7]) + parts.pop(c[0], "")).strip().replace("|", "\\|") for c in line] for line in grids.pop(row[0])])
            else:
                inner = "".join(whole.pop(c[0]) + squeeze(c[8]) for c in children.get(row[0], ()) if c[0] in whole)
                if row[5] in ("td", "th"):
                    parts[row[0]] = inner
                whole[row[0]] = finished(row, squeeze(row[7]) + inner)
        return whole[root[0]]

    parts: dict[int, str] = {}  # what cells hold, before they are set in their table
    body = "".join(render(r) + squeeze(r[8]) for r in children.get(-1, ()))
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip(" ") for x in body.split("\n"))).strip()
    return body + ("\n\n" + "\n".join(f"[{n}]: {u}" for u, n in links.items()) if links else "")


def _rendered(batches: Iterator[pa.RecordBatch], citations: bool) -> Iterator[pa.RecordBatch]:
    """Batches of key and nodes as batches of key and Markdown."""
    for batch in batches:
        done, texts, size = 0, [], 0
        for i in range(batch.num_rows):
            rows = [list(r.values()) for r in batch.column(1)[i].as_py()]
            known = {r[0] for r in rows}
            for r in rows:
                r[2] = r[2] if r[2] in known else -1
                r[6] = {e["key"]: e["value"] for e in r[6]} if r[6] is not None else {}
            texts.append(markdown_of(rows, citations))
            size += len(texts[-1])
            if size >= CHARS_AT_ONCE or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(texts, pa.string())], ["k", "markdown"])
                done, texts, size = i + 1, [], 0


def markdown(all_nodes: DataFrame, key: str = "page_id", citations: bool = True) -> DataFrame:
    """key and markdown of each page, from its (pruned) nodes. A page is rendered by one task, which holds that page alone."""
    kind = all_nodes.schema[key].dataType.simpleString()

    node = F.struct("pre", "post", "parent", "depth", "sib", "tag", F.map_entries("attrs").alias("attrs"), "own_text", "tail_text", "size")
    pages = all_nodes.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(node)).alias("rows"))
    return pages.mapInArrow(lambda batches: _rendered(batches, citations), f"k {kind}, markdown string").withColumnRenamed("k", key)


# The keys of page metadata and the names of the meta elements that hold them, the first found first.
METADATA = {
    "author": ("author", "article:author"), "date": ("article:published_time", "date", "dc.date"), "description": ("description", "og:description"),
    "sitename": ("og:site_name",), "categories": ("article:section",), "tags": ("article:tag", "keywords"),
}


def metadata(pages: DataFrame, key: str = "page_id", html: str = "html", parsed: DataFrame | None = None) -> DataFrame:
    """title, author, date, description, sitename, categories, tags, language and url from a page's elements; '' where absent.

    The first element that names a thing tells it. What stands in comments, scripts and texts is no element. parsed: the
    pages' nodes, if they are at hand.
    """
    rows = nodes(pages, key, html) if parsed is None else parsed
    heads = rows.where(F.col("tag").isin("meta", "link", "title", "html"))
    kept = {n: attribute(n) for n in ("name", "property", "rel", "content", "href", "lang")}
    each = heads.select(key, F.struct("pre", "tag", F.col("own_text").alias("text"), *[c.alias(n) for n, c in kept.items()]).alias("e"))
    # A page without such elements has a row too.
    whole = each.unionByName(pages.select(key), allowMissingColumns=True).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))

    def first(value: str, test) -> Column:
        return F.nullif(F.get(F.transform(F.filter("es", test), lambda e: e[value]), F.lit(0)), F.lit(""))

    meta = lambda w, *by: first("content", lambda e: (e["tag"] == "meta") & F.array_contains(F.array(*[F.lower(F.trim(e[n])) for n in by]), w))
    found = {k: F.coalesce(*[meta(w, "name", "property") for w in names]) for k, names in METADATA.items()}
    found["title"] = first("text", lambda e: e["tag"] == "title")
    found["language"] = first("lang", lambda e: e["tag"] == "html")
    canonical = first("href", lambda e: (e["tag"] == "link") & F.array_contains(F.split(F.lower(e["rel"]), r"\s+"), "canonical"))
    found["url"] = F.coalesce(canonical, meta("og:url", "property"))
    return whole.select(key, *[F.trim(F.coalesce(v, F.lit(""))).alias(k) for k, v in found.items()])


def preprocess(pages: DataFrame, key: str = "page_id", html: str = "html", parsed: DataFrame | None = None) -> DataFrame:
    """markdown with its hash, the lengths before and after, and their ratio; `parsed`: the pages' nodes if they are stored."""
    text = markdown(prune(nodes(pages, key, html) if parsed is None else parsed, key), key)
    out = pages.select(key, F.length(html).alias("raw_chars")).join(text, key, "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))
    return out.withColumn("markdown_chars", F.length("markdown")).withColumn("ratio", F.col("raw_chars") / F.greatest(F.col("markdown_chars"), F.lit(1))).withColumn("hash", F.sha2("markdown", 256))
