"""Main text of web pages by site template removal.

Every page is parsed once, in time linear in its markup. The hash of an element's subtree rolls up from its
tags and texts while it closes. Subtrees are counted by host in Spark, and those that recur on many pages of their
host are deleted. Elements whose tag, role, class or id names them as furniture go as well, for a menu or an advert
may be on one page only. What is left of the article, block by block, is the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from .common import stored

#: A template subtree is on at least so many pages that have text of their own besides it, on at least this share of its
#: host's, and this share of the pages it is on have such text: copies of one story are no template.
MIN_PAGES, MIN_SHARE, OWN_SHARE = 3, 0.005, 0.2
#: A block whose windows are on so many pages of a host is not a page's own.
RECURRING = 3
#: So many templates, of 8 bytes each, are sent to all tasks at most.
MOST_SENT = 500_000

# Names that HTML or common usage gives to blocks, void elements, raw text and page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dt dd td th tr tbody thead tfoot caption figcaption summary legend address hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
EMBEDDED = frozenset("svg object canvas audio video select template noscript annotation annotation-xml".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu search datalist input label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
LAYOUT_WORDS = frozenset("sidebar header nav navbar navigation menu banner masthead".split())
NOISE_WORDS = LAYOUT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription signup popup modal overlay comment comments commentlist disqus replies respond related "
    "recommended recommendations share sharing social widget widgets toolbar pagination pager login skip alert disclaimer copyright outbrain taboola toc".split()
)
#: Words that say where or how, not what: a name of these and at least one word above is furniture.
PLAIN_WORDS = frozenset(
    "site page global main top bottom left right inner outer upper lower first last primary secondary mobile desktop sticky fixed floating inline "
    "box block container wrapper wrap holder panel pane area region section zone slot unit row col column content body group item items list links link "
    "bar buttons button icons icon form thread title label text media post posts article articles story stories entry to us on by the and your our "
    "js id div v2 x large small wide narrow hidden visible show open closed active responsive container-fluid".split()
)
#: An open element of the first kind ends where one of the second kind starts; the search for it stops at the third.
IMPLIED_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
IMPLIED_ENDS = {k: (a.split(), b.split()) for k, (a, b) in IMPLIED_ENDS.items()}
P_SCOPE = "table td th caption button object html".split()
#: HTML elements that end an open drawing.
BREAK_OUT = BLOCKS | frozenset("b big br code em embed i img s small span strike strong sub sup tt u var".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTES = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")

_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15
_TAG_HASH: dict[str, int] = {}


def noise_names(names: str) -> set[str]:
    """The furniture words of the names that say nothing but furniture: `share-buttons` does, `share-price` does not."""
    found: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in NAME_PARTS.findall(name)]
        own = NOISE_WORDS.intersection(words)
        if own and all(w in own or w in PLAIN_WORDS or w.isdigit() for w in words):
            found |= own
    return found


def attributes_of(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTES.finditer(source)} if source else {}


def furniture(tag: str, found: dict[str, str], in_article: bool) -> str | None:
    """Why an element is page furniture: "layout" if only its layout name says so, else "noise"; None if it is not."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return "noise"
    if not found or tag in ("html", "body", "main"):
        return None
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return "noise"
    if found.get("role", "").lower() in NOISE_ROLES:
        return "noise"
    words = noise_names(f"{found.get('class', '')} {found.get('id', '')}")
    if in_article:
        words -= LAYOUT_WORDS - {"sidebar", "nav", "navigation", "menu", "navbar"}
    if tag == "article" and words <= LAYOUT_WORDS:
        return None
    return None if not words else "layout" if words <= LAYOUT_WORDS else "noise"


@dataclass
class Page:
    """What parsing finds: blocks, each a text with 2 inside an article, 1 inside main, else 0; and candidates.

    A candidate is an element that may be a template: the hash of its subtree and the blocks [lo, hi) it holds. It is
    furniture by its name if it holds none.
    """

    blocks: list[tuple[str, int]] = field(default_factory=list)
    candidates: list[tuple[int, int, int]] = field(default_factory=list)


def parse(html: str, names: bool = True) -> Page:
    """Blocks and template candidates of a page. names=False: no element is furniture by its name.

    Candidates are the block elements with text, whatever their length and level. Only the bare paragraphs, headings,
    items and cells of an article are none: a story may quote a passage that others quote, while what a site puts into
    its stories comes in an element of its own.
    """
    page = Page()
    blocks, candidates = page.blocks, page.candidates
    parts: list[str] = []
    # An open element: tag, why it is left out, level, blocks before it, and the hash of what is closed inside it so far.
    stack: list[list] = []
    open_at: dict[str, list[int]] = {}  # places of the open elements of each tag
    open_blocks: list[int] = []
    last_end: dict[str, int] = {}
    why, level, at, top = None, 0, 0, 0  # top: the hash of the innermost open element's inside

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((text, level))

    def say(text: str) -> None:
        nonlocal top
        bare = text.strip()
        if bare:
            top = (top * _STEP + xxh64_intdigest(bare)) & _MASK
        if why is None:
            parts.append(unescape(text) if "&" in text else text)

    def close(to: int) -> None:
        """Close the open elements from number `to` on."""
        nonlocal why, level, top
        while len(stack) > to:
            tag, own, here, n_blocks, outside = stack.pop()
            open_at[tag].pop()
            before = stack[-1] if stack else None
            if tag in BLOCKS:
                open_blocks.pop()
                flush()
                # Inside furniture only its root is a candidate.
                if top and tag not in ("html", "body", "main", "article") and (len(blocks) > n_blocks and (here < 2 or tag not in PROSE) or own == "noise" and (before is None or before[1] != "noise")):
                    candidates.append(((top ^ _tag_hash(tag)) * _STEP & _MASK, n_blocks, len(blocks)))
            if top:
                outside = (outside * _STEP + (top ^ _tag_hash(tag))) & _MASK
            top = outside
            why, level = (before[1], before[2]) if before else (None, 0)

    def last(tags) -> int:
        """The place of the innermost open element of some tags."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def innermost(tag: str) -> int:
        places = open_at.get(tag)
        return places[-1] if places else -1

    def ends_ahead(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>]|\Z)", html, re.I)), default=-1)
        return last_end[tag] >= at

    m = TOKEN.search(html)
    while m:
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            pass
        elif m[1]:
            tag = name.lower()
            i = innermost(tag)
            if tag in ("body", "html"):
                pass
            elif i >= 0 and (tag in BLOCKS or tag in EMBEDDED or i > (open_blocks[-1] if open_blocks else -1)):
                close(i)
            elif tag in BLOCKS:
                flush()
        else:
            tag = name.lower()
            alone = m[3].endswith("/")
            if open_at.get("svg") and tag in BREAK_OUT and innermost("svg") > innermost("foreignobject"):
                close(open_at["svg"][0])
            if tag in RAW:
                if not alone or tag in ("script", "style", "textarea", "title"):
                    end = RAW_END[tag].search(html, at)
                    at = end.end() if end else len(html)
            elif tag == "br":
                parts.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
            elif tag in EMBEDDED and (alone or not ends_ahead(tag)):
                pass  # nothing inside, or never closed: what follows is the page's
            else:
                if tag in BLOCKS:
                    i = innermost("p")
                    if i >= 0 and i > last(P_SCOPE):
                        close(i)
                    if tag in IMPLIED_ENDS:
                        ends, stops = IMPLIED_ENDS[tag]
                        while (i := last(ends)) >= 0 and i > last(stops):
                            close(i)
                    flush()
                found = attributes_of(m[3]) if names or level < 2 else {}
                role = found.get("role", "").lower()
                own = "noise" if tag in EMBEDDED else furniture(tag, found, level == 2) if names else None
                story = tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody"
                if (story or tag == "main") and own is None and why == "layout":
                    why = None
                if own is None:
                    own = why
                elif why == "noise":
                    own = "noise"
                here = level
                if own is None and story:
                    here = 2
                elif own is None and (tag == "main" or role == "main"):
                    here = max(level, 1)
                stack.append([tag, own, here, len(blocks), top])
                open_at.setdefault(tag, []).append(len(stack) - 1)
                if tag in BLOCKS:
                    open_blocks.append(len(stack) - 1)
                why, level, top = own, here, 0
        m = TOKEN.search(html, at)
    if at < len(html):
        say(html[at:])
    close(0)
    flush()
    return page


def _tag_hash(tag: str) -> int:
    h = _TAG_HASH.get(tag)
    if h is None:
        h = xxh64_intdigest(tag)
        if len(_TAG_HASH) < 10_000:
            _TAG_HASH[tag] = h
    return h


def without(n_blocks: int, places: list[tuple[int, int]]) -> tuple[bytearray, int]:
    """For each block whether it is in one of the places [lo, hi), and the number of the outermost places."""
    gone, n, end = bytearray(n_blocks), 0, 0
    for lo, hi in sorted(places, key=lambda at: (at[0], -at[1])):  # parents before their children
        if lo == hi:
            n += 1
        elif lo >= end:
            n, end = n + 1, hi
            gone[lo:hi] = b"\1" * (hi - lo)
    return gone, n


def main_text(blocks: list[tuple[str, int]]) -> str:
    """The blocks of the articles if there are any, else of main, else of the page, joined by line feeds."""
    least = max((v for _, v in blocks), default=0)
    return "\n".join(t for t, v in blocks if v >= least)


def block_keys(text: str) -> tuple[int, int]:
    """The least and the greatest hash of a block's three-word windows: a near copy has mostly one of them at least, another text hardly ever."""
    w = text.split()
    hashes = [xxh64_intdigest(text)] if len(w) < 3 else [*map(xxh64_intdigest, map(" ".join, zip(w, w[1:], w[2:], strict=False)))]
    return min(hashes), max(hashes)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, names: bool = True) -> DataFrame:
    """What one parse of every page finds, stored: all later steps read the columns they need of it.

    page (a number of the row), id, url, host, text (all blocks, joined by line feeds), levels (a byte a block), keys (two
    hashes a block), found (the candidates, each hash with its first place) and again (their other places).
    """
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), "html")
    place = "array<struct<hash: bigint, lo: int, hi: int>>"
    more = StructType.fromDDL(f"text string, levels binary, keys array<bigint>, found {place}, again {place}")
    kind = StructType(rows.drop("html").schema.fields + more.fields)
    at = pa.list_(pa.struct([("hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, levels, keys, found, again = [], [], [], [], []
            for html in batch.column(3):
                page = parse(html.as_py() or "", names)
                first: dict[int, tuple[int, int, int]] = {}
                others = []
                for h, lo, hi in page.candidates:
                    spot = (signed(h), lo, hi)
                    if first.setdefault(h, spot) != spot:
                        others.append(spot)
                text.append("\n".join(t for t, _ in page.blocks))
                levels.append(bytes(v for _, v in page.blocks))
                keys.append([signed(k) for t, _ in page.blocks for k in block_keys(t)])
                found.append(list(first.values()))
                again.append(others)
            made = [pa.array(text, pa.string()), pa.array(levels, pa.binary()), pa.array(keys, pa.list_(pa.int64())), spots(found), spots(again)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=kind.names)

    def spots(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
        flat = np.array([s for r in rows for s in r], np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        inner = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))], fields=list(at.value_type))
        return pa.ListArray.from_arrays(pa.array(ends), inner)

    return stored(rows.mapInArrow(parsed, kind).withColumn("page", F.monotonically_increasing_id()), "parsed_pages", compression="zstd")


def templates(seen: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, own_share: float = OWN_SHARE) -> DataFrame:
    """host, hash: the template subtrees of each host, from parsed_pages().

    A page votes once for a subtree, if it has a block of its own outside it: one whose windows do not recur on the host.
    So stories that are copied, with small changes or without, cast no votes, a notice that is longer than the stories
    loses none, and a subtree that one page repeats has one. A subtree is a template if it has min_pages votes, from
    min_share of the host's pages and own_share of the pages that it is on. All that is shuffled is hashes and places;
    counts are summed before they are shuffled.
    """
    seen = seen.where("host <> ''")
    key = seen.select("page", "host", F.posexplode("keys").alias("at", "key")).select("page", "host", F.shiftright("at", 1).alias("block"), "key")
    often = key.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECURRING).select("host", "key")
    shared = key.join(often, ["host", "key"]).groupBy("page").agg(F.collect_set("block").alias("shared"))
    blocks = F.shiftright(F.size("keys"), 1)
    every = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    own = F.array_except(every, F.coalesce("shared", F.array().cast("array<int>")))
    judged = seen.join(shared, "page", "left").select("host", "found", F.array_min(own).alias("first"), F.array_max(own).alias("last"))
    each = judged.select("host", "first", "last", F.inline("found"))
    vote = (F.col("first") < F.col("lo")) | (F.col("last") >= F.col("hi"))
    counts = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(vote).alias("votes"))
    counts = counts.where((F.col("votes") >= min_pages) & (F.col("votes") >= F.col("n") * own_share))
    total = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(total, "host").where(F.col("votes") >= F.col("pages") * min_share).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True, most_sent: int = MOST_SENT, **options) -> DataFrame:
    """id, url, text, n_chars, n_templates (template subtrees deleted, the outermost ones) and what became of the blocks
    of every page: n_deleted went with templates, then n_outside with the rule of the article.

    A null or empty page has an empty text, as has one without content; a page without a host has no template. Rows
    that repeat are extracted each. An empty table gives an empty one; other columns are ignored. Pages are parsed once
    and told which of their own candidates are templates: up to most_sent templates are sent to all tasks and no text is
    shuffled; if there are more, candidates are joined with templates by hash, and pages with what is found by page.
    """
    seen = parsed_pages(pages, id_col, url_col, html_col, names)
    found = stored(templates(seen, **options), "templates")
    if found.count() <= most_sent:
        lists = F.broadcast(found.groupBy("host").agg(F.collect_list("hash").alias("hashes")))
        joined = seen.join(lists, "host", "left").withColumn("doomed", F.array_intersect(F.col("found.hash"), "hashes"))
    else:
        each = seen.where("host <> ''").select("page", "host", F.inline("found")).join(found, ["host", "hash"])
        joined = seen.join(each.groupBy("page").agg(F.collect_list("hash").alias("doomed")), "page", "left")
    joined = joined.select("id", "url", "text", "levels", "found", "again", "doomed")
    more = StructType.fromDDL("text string, n_chars bigint, n_templates int, n_deleted int, n_outside int")
    kind = StructType(joined.select("id", "url").schema.fields + more.fields)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text, levels, found, again, doomed in zip(*batch.columns[2:], strict=True):
                levels, places = levels.as_py(), []
                if doomed.is_valid:
                    hashes = set(doomed.as_py())
                    places = [(c["lo"], c["hi"]) for c in found.as_py() + again.as_py() if c["hash"] in hashes]
                gone, n = without(len(levels), places)
                blocks = list(zip(text.as_py().split("\n"), levels, strict=False))  # the text of no block is one empty line
                kept = [b for b, g in zip(blocks, gone, strict=False) if not g]
                out.append(main_text(kept))
                counts.append((len(out[-1]), n, len(levels) - len(kept), len(kept) - (out[-1].count("\n") + 1 if out[-1] else 0)))
            made = [pa.array([c[i] for c in counts], pa.int64() if i == 0 else pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string()), *made], names=kind.names)

    result = joined.mapInArrow(texts, kind)
    return result.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_templates", "n_deleted", "n_outside")
