"""XPath against definitions on the tree, node by node."""

import random
import re

import pytest

from pagemill.operators import html, xpath as X

PAGE = """<html><body><nav><ul><li><a href="/a" class="x">A</a></li><li><a href="/b">B</a> tail</li><li><a href="/c">C</a></li></ul></nav>
<div id="m"><h1>T</h1><p>one</p>text<p class="k">two <b>bold</b> end</p><p>three</p></div><div><p>four</p></div></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(8)
    pages = [(0, PAGE)]
    for i in range(1, 5):
        out, open_ = [], []
        for _ in range(45):
            if open_ and rng.random() < 0.45:
                out.append(f"</{open_.pop()}>")
            else:
                tag = rng.choice(["div", "b", "span", "i"])
                out.append(f"<{tag} n='{rng.randint(1, 3)}'>t{rng.randint(1, 3)}")
                open_.append(tag)
        pages.append((i, "".join(out)))
    return html.nodes(spark.createDataFrame(pages, "page_id int, html string")).cache()


def reached(nodes, path):
    return {(r.page_id, r.pre) for r in X.xpath(nodes, path).collect()}


AXES = {
    "child": lambda n, c: n.parent == c.pre, "parent": lambda n, c: n.pre == c.parent, "self": lambda n, c: n.pre == c.pre,
    "descendant": lambda n, c: c.pre < n.pre <= c.post, "descendant-or-self": lambda n, c: c.pre <= n.pre <= c.post,
    "ancestor": lambda n, c: n.pre < c.pre <= n.post, "ancestor-or-self": lambda n, c: n.pre <= c.pre <= n.post,
    "following-sibling": lambda n, c: n.parent == c.parent and n.pre > c.pre, "preceding-sibling": lambda n, c: n.parent == c.parent and n.pre < c.pre,
    "following": lambda n, c: n.pre > c.post, "preceding": lambda n, c: n.post < c.pre,
}


@pytest.mark.parametrize("axis", AXES)
def test_axes(nodes, axis):
    rows = nodes.collect()
    near = lambda c, tag: sorted((n for n in rows if n.page_id == c.page_id and n.tag == tag and AXES[axis](n, c)), key=lambda n: -n.pre if axis in X.REVERSE else n.pre)
    starts = [r for r in rows if r.tag == "b"]
    assert reached(nodes, f"//b/{axis}::div") == {(n.page_id, n.pre) for c in starts for n in near(c, "div")}
    assert reached(nodes, f"//b/{axis}::div[2]") == {(found[1].page_id, found[1].pre) for c in starts if len(found := near(c, "div")) > 1}
    assert reached(nodes, f"//b/{axis}::div[@n='1'][last()]") == {(found[-1].page_id, found[-1].pre) for c in starts if (found := [n for n in near(c, "div") if n.attrs.get("n") == "1"])}
    assert reached(nodes, f"//b[{axis}::div[@n='2']]") == {(c.page_id, c.pre) for c in starts if any(n.attrs.get("n") == "2" for n in near(c, "div"))}


def test_one_page(spark, nodes):
    page = nodes.where("page_id = 0")
    values = lambda path: [r.value for r in X.xpath(page, path).orderBy("pre", "turn").collect()]
    tags = lambda path: [(r.tag, r.own_text) for r in X.xpath(page, path).orderBy("pre").collect()]
    assert values("//li[position()=last()]/preceding-sibling::li[1]/a/text()") == ["B"]
    assert values("//a[not(@class)]/@href") == ["/b", "/c"] and values("//a/@*") == ["x", "/a", "/b", "/c"] or set(values("//a/@*")) == {"x", "/a", "/b", "/c"}
    assert values("//h1/following-sibling::p[2]/text()") == ["two ", " end"] and values("//div[@id='m']/text()") == ["text"] or values("//div[@id='m']/text()")[-1] == "text"
    assert tags("//p[. = 'two bold end']") == [("p", "two ")] and tags("//p[b]") == [("p", "two ")] and tags("//p[b = 'bold']/../h1") == [("h1", "T")]
    assert tags("//li[position() > 1 and position() < 3]/a") == [("a", "B")] and tags("//li[last() - 1]/a") == [("a", "B")]
    assert tags("//div[count(p) = 1]/p") == [("p", "four")] and tags("//div[count(p) > 1]/p[3]") == [("p", "three")]
    assert tags("//p[contains(., 'o') and not(ancestor::div[@id='m'])]") == [("p", "four")] and tags("//p[starts-with(text(), 'th') or @class='k']") == [("p", "two "), ("p", "three")]
    assert tags("/html/body/div[2]/p") == [("p", "four")] and tags("//p[normalize-space(.) = 'one']") == [("p", "one")] and tags("//p[string-length(.) = 3]") == [("p", "one")]
    assert tags("//h1 | //p[1]") == [("h1", "T"), ("p", "one"), ("p", "four")] and tags("//b/ancestor::div/h1") == [("h1", "T")]
    assert tags("//nothing") == [] and X.xpath(page.limit(0), "//p").collect() == []


@pytest.mark.parametrize("path", ["", "//", "//p[", "//p]", "//@href/p", "//p[last(1)]", "//p[unknown()]", "//up::p", "//p$", "//text()/p", "//p[count('x')]", "//p | //a/@href"])
def test_what_is_not_understood_is_refused(nodes, path):
    with pytest.raises(ValueError, match=re.escape("not understood")):
        X.xpath(nodes, path)
