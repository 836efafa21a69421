from html import escape
from time import process_time

from pagemill.llm import html_extract as H

SITE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{}</body></html>"


STORIES = ["Rain fell on the hills.", "A ship left at dawn with salt.", "Nobody saw the fox again.", "Prices of tin rose twice.", "Her letter came in May.", "They built it of clay and straw."]


def page(n, body):
    chrome = "<div><p>All our towns</p><p>Write to us</p></div>"
    return SITE.format(f"<div class='top'>Daily {chrome}</div>{body}<div><a href='/'>home</a> <a href='/x'>more</a></div>")


def test_template_subtrees_go_where_no_tag_names_them(spark):
    rows = [(i, f"http://news.example/{i}", page(i, f"<div><p>{STORIES[i]}</p><p>{i} more to come.</p></div>")) for i in range(6)]
    rows += [(9, "http://other.example/", page(9, "<div><p>Alone here.</p></div>")), (10, None, page(10, "<p>No host.</p>"))]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"{STORIES[i]}\n{i} more to come."
    assert "All our towns" in got[9].text and "All our towns" in got[10].text  # nothing recurs there


def extracted(spark, rows, **options):
    return {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_a_long_notice_goes_and_so_does_an_advert_on_a_fifth_of_the_pages(spark):
    notice = "<div><p>" + "We keep your data for the purposes that our partners name. " * 20 + "</p></div>"  # longer than every story
    advert = "<section><p>Two mattresses for one.</p></section>"
    told = lambda i: " ".join(f"{w}{i}" for w in "rain ship fox tin letter clay".split())
    story = lambda i: f"<div><h1>Title {i}</h1><p>{told(i)}.</p></div>"
    rows = [(i, "http://soup.example/", SITE.format(notice + story(i) + (advert if i % 5 == 0 else ""))) for i in range(30)]
    rows += [(100 + i, "http://article.example/", SITE.format(f"<article>{story(i)}{advert if i % 5 == 0 else ''}<p>The end.</p></article>{notice}")) for i in range(30)]
    got = extracted(spark, rows)
    for i in range(30):
        assert got[i].text == f"Title {i}\n{told(i)}." and got[i].n_templates == 1 + (i % 5 == 0)
        assert got[100 + i].text == f"Title {i}\n{told(i)}.\nThe end."  # the bare paragraph stays
    off = extracted(spark, rows, min_pages=10**6)  # no templates: their text stays
    assert all("partners" in off[i].text for i in range(30)) and "mattresses" in off[100].text and off[5].n_templates == 0


def test_copies_and_near_copies_of_a_story_are_no_template(spark):
    words = [f"word{i * i % 997}" for i in range(240)]
    paragraphs = lambda w: "".join(f"<div><p>{' '.join(w[k : k + 40])}</p></div>" for k in range(0, len(w), 40))
    rows = [(i, "http://copy.example/", SITE.format(f"<div>{paragraphs(words)}</div>")) for i in range(12)]
    for i in range(20):  # one word in sixty differs
        near = [f"edit{i}x{k}" if (k + 7 * i) % 60 == 0 else w for k, w in enumerate(words)]
        rows.append((50 + i, "http://near.example/", SITE.format(f"<div>{paragraphs(near)}</div>")))
    got = extracted(spark, rows)
    assert all(r.text.count("\n") == 5 and len(r.text.split()) == 240 and r.n_templates == 0 for r in got.values())


def test_whole_table_against_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import re
    from html import unescape

    for r in H.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        lines = re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)[^>]*>", "\n", article)).split("\n")
        assert r.text == "\n".join(" ".join(unescape(x).split()) for x in lines if x.strip())
        assert r.n_chars == len(r.text)


def test_furniture_and_markup():
    text = lambda h: H.main_text(H.parse(h).blocks)
    body = "<nav>n</nav><header>h</header><div class='cookie-banner'>c</div><article><h1>A &amp; B</h1><p>x<br>y&nbsp;z <b>q</b>r<p>s<aside>a</aside><form>f</form><div id='comments'><p>bad</p></div><div class='ad'>ad</div></article><div class=sidebar>s</div><footer>f</footer><!-- c --"
    assert text(body) == "A & B\nx y z qr\ns"
    assert text("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main><p>out</p>") == "a\nb\nc\nd"
    assert text("<div class='page sidebar-left'><article><p>kept</p></article></div>") == "kept"
    assert text("<p>cut of <a hre") == "cut of"
    assert text("<div hidden>x</div><div style='display: none'>y</div><p>z") == "z"
    assert text("plain") == "plain" and text("") == "" and text("<p></p>") == ""
    assert text("<p>" + escape("1 < 2 & 3") + "</p>") == "1 < 2 & 3"


def test_embedded_elements_and_names():
    text = lambda h: H.main_text(H.parse(h).blocks)
    assert text("<article><p>a</p><svg><path><p>b</p>") == "a\nb"
    assert text("<article><p>a</p><video><p>b</p></article>") == "a\nb"
    assert text("<article><p>a<svg><svg><text>t</text></svg><text>u</text></svg>b</p><video><p>no video</p></video></article>") == "ab"
    assert text("<article><p>a<svg><path></svg><p>b<svg/>c<svg><circle><p>d</article>") == "a\nbc\nd"
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> be.") == "Let x=1 be."
    assert text("<article><div class='share-price'>1</div><div id='social-history'>2</div><div class='notice-of-motion'>3</div><div class='share-buttons'>x</div><div class='ad ad-slot-3'>y</div></article>") == "1\n2\n3"
    assert text("<noscript><p>on?</p></noscript><p>a<select><option>o</select>b") == "ab"
    assert text("<div role='main'>a</div>b") == "a" and text("<div itemprop='articleBody'>a</div><main>b</main>") == "a"


def test_time_is_linear_in_the_markup():
    for html in ("<div>" * 100_000 + "x", "<b><i>" * 50_000 + "x" + "</b>" * 50_000, "<div><span>" * 50_000 + "x" + "</span></div>" * 50_000, "<svg>" * 100_000, "<li>x" * 100_000, "<table><tr><td>" * 30_000 + "x"):
        begun = process_time()
        H.parse(html)
        assert process_time() - begun < 2  # a third of that alone; quadratic code took minutes


def test_edges(spark):
    rows = [(1, "http://h/", None), (2, None, ""), (None, "http://h/", "<p>a</p>"), (3, "bad url", "<p>b"), (3, "bad url", "<p>b"), (4, "http://h/", "<p>" + "w " * 300_000 + "</p>"), (5, "http://h/", "<" * 5000), (6, "http://h/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, hashes int")
    got = sorted(((r.page_id, r.text[:9], r.n_chars) for r in H.extract(pages).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "a", 1), (3, "b", 1), (3, "b", 1), (4, "w w w w w", 599_999), (5, "<" * 9, 5000), (6, "deep", 4)], key=str)
    assert H.extract(pages.limit(0)).count() == 0


def brute_keys(text):
    from xxhash import xxh64_intdigest

    w = text.split()
    hashes = [xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))]
    return min(hashes), max(hashes)


def brute_templates(rows, names, min_pages=H.MIN_PAGES, min_share=H.MIN_SHARE, own_share=H.OWN_SHARE):
    """The votes written out: (host, hash as long) of (host, html) rows, page against page."""
    from collections import Counter, defaultdict

    by_host = defaultdict(list)
    for host, html in rows:
        by_host[host].append(H.parse(html or "", names))
    found = set()
    for host, pages in by_host.items():
        often = Counter(k for p in pages for t, _ in p.blocks for k in brute_keys(t))
        on, votes = Counter(), Counter()
        for p in pages:
            own = [i for i, (t, _) in enumerate(p.blocks) if all(often[k] < H.RECURRING for k in brute_keys(t))]
            seen = {}
            for h, lo, hi in p.candidates:
                seen.setdefault(h, (lo, hi))
            for h, (lo, hi) in seen.items():
                on[h] += 1
                votes[h] += any(i < lo or i >= hi for i in own)
        found |= {(host, h - (h >> 63 << 64)) for h in on if votes[h] >= max(min_pages, min_share * len(pages), own_share * on[h])}
    return found


def test_votes_of_a_whole_table_against_a_loop(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select(H.host_of(pages.url), "html").collect()]
    for names, options in ((True, {}), (False, {}), (False, {"min_pages": 2, "min_share": 0.3, "own_share": 0.6})):
        seen = H.parsed_pages(pages, "page_id", "url", "html", names)
        got = {tuple(r) for r in H.templates(seen, **options).collect()}
        assert got == brute_templates(rows, names, **options) and got


def test_a_subtree_that_one_page_repeats_has_one_vote(spark):
    ad = "<div><p>Two for one.</p></div>"
    rows = [(i, "http://shop.example/", SITE.format(f"<div><p>{STORIES[i]}</p></div>" + ad * (3 if i == 0 else 0))) for i in range(6)]
    assert extracted(spark, rows)[0].text == "\n".join([STORIES[0]] + ["Two for one."] * 3)
    rows = [(i, u, SITE.format(f"<div><p>{STORIES[i]}</p></div>" + ad * (i + 1))) for i, u in enumerate(["http://shop.example/"] * 4)]
    got = extracted(spark, rows)
    assert all(got[i].text == STORIES[i] and (got[i].n_templates, got[i].n_deleted, got[i].n_outside) == (i + 1, i + 1, 0) for i in range(4))


def test_templates_sent_or_joined_delete_the_same(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sent, joined = (sorted(map(tuple, H.extract(pages, names=False, most_sent=n).collect())) for n in (H.MOST_SENT, 0))
    assert sent == joined and len(sent) == pages.count() and any(r[4] for r in sent)


def test_places_that_nest():
    gone, n = H.without(6, [(1, 2), (0, 3), (0, 3), (4, 5), (5, 5)])
    assert list(gone) == [1, 1, 1, 0, 1, 0] and n == 3
