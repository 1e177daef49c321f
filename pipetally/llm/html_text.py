"""HTML extraction by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Words score positive and tags negative, and words below an
element whose class, id or role marks another part of the page score negative too; the weights are
log-odds estimated from labelled pages (pages whose markup says where the article is).  One linear
scan finds the contiguous region of the greatest sum, and its bounds are those of the article: only
their ends are put right, by the smallest container that holds the region.  Elements that are never
the article's (menus, footers, sidebars, forms and the like) are left out inside of it.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipetally.llm.shared import pieces, reach_workers, text_sample

#: Labelled pages to learn from (the bound of the sample).
SAMPLE_PAGES = 2000
#: The weight from which the words of a marked element are another part's, and the share of the region's words that its container holds.
APART_AT, HELD = -2.5, 0.9
#: What a word of MARKING counts before any page is seen: words outside of an article, and inside.
PRIOR_OUTSIDE, PRIOR_INSIDE = 200.0, 0.5

# HTML's elements without content, with raw text, and with a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article, and such whose own class says nothing about their text.
OUTSIDE = frozenset("nav aside footer head button select option datalist template svg math object audio video canvas dialog menu search".split())
UNMARKED = frozenset("html body main p h1 h2 h3 h4 h5 h6 pre blockquote a b i em strong td th".split())
#: Blocks that are a part of a text and never the whole of it.
LINES = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 caption legend figcaption summary pre hr".split())
#: Elements that only group others, whose tags stand at every kind of bound: the least weight of such a tag.
GROUPS, LEAST_GROUP = frozenset("div section article main span other".split()), -1.0
#: Words of a class, id or role that mark another part before any page is seen, and such that say nothing beside one.
MARKING = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead topbar toolbar banner widget widgets modal overlay popup drawer breadcrumb breadcrumbs "
    "pagination pager complementary contentinfo search login signup skip ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted "
    "promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription paywall share sharing social related recommended recommendations "
    "teaser comment comments commentlist feedback responses respond reply replies disqus discussion disclaimer copyright hidden".split()
)
NEUTRAL = frozenset("user users reader readers area bar block box button buttons bottom container form group inner item items left links list main page posts right section site top wrap wrapper".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|[\"'][^\"']*[\"']?")  # a name, then its value
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NEXT = re.compile(r"<(?=[a-zA-Z/!?])")


class _Element:
    """``outside``: in an element that never holds the article; ``mark``: the least weight of the classes around."""

    __slots__ = ("name", "up", "outside", "form", "inside", "mark", "words")

    def __init__(self, name: str, up: "_Element | None"):
        self.name, self.up, self.words = name, up, 0
        self.outside, self.form, self.inside, self.mark = (up.outside, up.form, up.inside, up.mark) if up else (False, False, False, 0.0)


    @property
    def own(self) -> bool:
        """Whether nothing around its words says that they are another part's."""
        return not self.outside and not self.form and self.mark > APART_AT


class _Block:
    """A run of text in the block element ``at``: its own words, and the places of their first and last event."""

    __slots__ = ("at", "texts", "linked", "words", "first", "last")

    def __init__(self, at: _Element):
        self.at, self.texts, self.linked, self.words, self.first, self.last = at, [], 0, 0, -1, -1

    def text(self) -> str:
        return " ".join("".join(self.texts).split())


def class_weight(token: str, weight: dict[str, float]) -> float:
    """The weight of one class, id or role: its own if it was learned, else the mean of its words'; 0 for what is unknown."""
    known = weight.get(f"c:{token.lower()}")
    if known is not None:
        return known
    parts = [p.lower() for p in _PART.findall(token)]
    if not parts or parts[0] in ("no", "has", "with", "without"):
        return 0.0
    parts = [p for p in parts if p not in NEUTRAL and not p.isdigit()]
    return sum(weight.get(f"c:{p}", 0.0) for p in parts) / len(parts) if parts else 0.0


def _enter(e: _Element, attrs: str, weight: dict[str, float], classes: list[str] | None) -> None:
    """Set what a new element means for its text; ``classes`` gets the names it has."""
    name = e.name
    if name in ("article", "main"):
        # an article inside a form, or inside something weakly marked, is an article still
        e.inside, e.form = True, False
        e.mark = e.mark if e.mark <= APART_AT else 0.0
    if name in OUTSIDE or name == "header" and not e.inside:
        e.outside = True
    if name == "form":
        e.form = True
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = (m[1] or "").lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            e.outside = True
        elif key in ("class", "id", "role") and name not in UNMARKED:
            for one in value.split():
                e.mark = min(e.mark, class_weight(one, weight))
                if classes is not None:
                    classes.append(one.lower())


class Page:
    """The (feature, words) events of a page in order, its blocks of text, and its elements.

    Each word is judged by the element that it is in, whatever else its block holds: ``apart`` has the
    events of words of other parts, which no block has.

    Comments, declarations and raw text elements are passed over; end tags that nothing opened are
    ignored; what HTML lets stay open is closed; depth has no limit.
    """

    def __init__(self, page: str, weight: dict[str, float], named: dict[str, list] | None = None):
        """``named``: gets the elements of each class, id or role."""
        self.events: list[tuple[str, int]] = []
        self.blocks: list[_Block] = []
        self.apart: set[int] = set()
        self.words: list[tuple[_Element, int, bool]] = []
        self.elements = [_Element("#", None)]
        events, blocks, elements = self.events, self.blocks, self.elements
        at, block, links, pos, size = elements[0], None, 0, 0, len(page)
        counts: dict[str, int] = {}

        def leave(to: _Element) -> None:
            nonlocal at, links
            while at is not to:
                counts[at.name] -= 1
                links -= at.name == "a"
                at = at.up

        def text(raw: str) -> None:
            nonlocal block
            n, own = len(raw.split()), at.own
            if n:
                self.words.append((at, n, own))
                if not own:
                    self.apart.add(len(events))
            if own:
                if block is None and n:
                    e = at
                    while e.up is not None and e.name not in BLOCK:
                        e = e.up
                    block = _Block(e)
                    blocks.append(block)
                if block is not None:
                    block.texts.append(html.unescape(raw) if "&" in raw else raw)
                    if n:
                        block.words += n
                        block.linked += n if links else 0
                        block.first = len(events) if block.first < 0 else block.first
                        block.last = len(events)
            if n:
                events.append(("w:link" if links else "w:text", n))

        while pos < size:
            m = _NEXT.search(page, pos)
            if not m:
                text(page[pos:])
                break
            if m.start() > pos:
                text(page[pos : m.start()])
            pos = m.start()
            if page.startswith("<!--", pos):
                end = page.find("-->", pos + 4)
                pos = size if end < 0 else end + 3
                continue
            tag = _TAG.match(page, pos)
            if not tag:
                end = page.find(">", pos)
                if end < 0:
                    break
                if page[pos + 1] in "!?" or not re.match(r"</?[a-zA-Z]", page[pos : pos + 3]):
                    if page.startswith("<![CDATA[", pos):
                        end = max(page.find("]]>", pos) + 2, end)
                    pos = end + 1
                    continue
                tag = re.match(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", page[pos : end + 1])
                pos = end + 1
            else:
                pos = tag.end()
            name, closing = tag[2].lower(), tag[1] == "/"
            if name == "br":
                if block is not None:
                    block.texts.append(" ")
                continue
            events.append((f"t:{name}" if len(name) < 12 else "t:other", 0))
            if name in RAW and not closing:
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, pos)
                pos = size if not end else page.find(">", end.start()) + 1 or size
                continue
            if closing:
                if counts.get(name):
                    e = at
                    while e.name != name:
                        e = e.up
                    leave(e.up)
                if name in BLOCK:
                    block = None
                continue
            if name in BLOCK:
                block = None
                if counts.get("p"):  # a block ends an open paragraph
                    e = at
                    while e.up is not None and e.name not in ("p", "td", "th", "li", "div", "section", "article", "main", "body", "button"):
                        e = e.up
                    if e.name == "p":
                        leave(e.up)
            if name in _CLOSES and any(counts.get(n) for n in _CLOSES[name][0]):
                same, stop = _CLOSES[name]
                e, last = at, None
                while e.up is not None and e.name not in stop:
                    if e.name in same:
                        last = e
                    e = e.up
                if last is not None:
                    leave(last.up)
            if name not in VOID and not (tag[3] or "").endswith("/"):
                if name == "a" and links:  # links do not nest
                    e = at
                    while e.name != "a":
                        e = e.up
                    e.name = "span"
                    counts["a"] -= 1
                    counts["span"] = counts.get("span", 0) + 1
                    links = 0
                at = _Element(name, at)
                counts[name] = counts.get(name, 0) + 1
                links += name == "a"
                elements.append(at)
                classes: list[str] | None = [] if named is not None else None
                _enter(at, tag[3], weight, classes)
                for c in classes or ():
                    named.setdefault(c, []).append(at)


def labelled(page: str | None) -> bool:
    """Whether the markup says where the article is: one article or main element."""
    low = (page or "").lower()
    return low.count("<article") == 1 or low.count("<article") == 0 and low.count("<main") == 1


def feature_counts(page: str) -> dict[tuple[str, bool], int]:
    """How often each feature is inside and outside of the article of a labelled page; classes count the words below them."""
    named: dict[str, list] = {}
    p = Page(page, PRIOR, named)
    mine = [b for b in p.blocks if b.at.inside]
    lo, hi = (mine[0].first, mine[-1].last) if mine else (1, 0)
    out: dict[tuple[str, bool], int] = {}
    for i, (f, n) in enumerate(p.events):
        key = (f, lo <= i <= hi)
        out[key] = out.get(key, 0) + (n or 1)
    for side in (True, False):
        words = _below(p, [(e, n) for e, n, own in p.words if (own and e.inside) == side])
        for c, elements in named.items():
            n = sum(words[id(e)] for e in elements)
            if n:
                out[f"c:{c}", side] = out.get((f"c:{c}", side), 0) + n
    return out


def _below(p: Page, words: list[tuple[_Element, int]]) -> dict[int, int]:
    """The words of ``words`` below each element (by identity)."""
    out = {id(e): 0 for e in p.elements}
    for e, n in words:
        out[id(e)] += n
    for e in reversed(p.elements):  # elements stand in order of their start, parents first
        if e.up is not None:
            out[id(e.up)] += out[id(e)]
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of being inside; at least a little above 0 for words, below 0 for tags, and 0 at most for classes."""
    out = {}
    a = sum(n for (f, i), n in counts.items() if i and f[0] != "c") + 1
    b = sum(n for (f, i), n in counts.items() if not i and f[0] != "c") + 1
    for f in {f for f, _ in counts if f[0] != "c"} | {"w:text", "w:link", "t:other"}:
        odds = math.log((counts.get((f, True), 0) + 1) / a) - math.log((counts.get((f, False), 0) + 1) / b)
        out[f] = min(max(odds, 0.05), 3.0) if f == "w:text" else min(max(odds, 0.01), 0.2) if f == "w:link" else max(min(odds, -0.2), LEAST_GROUP if f[2:] in GROUPS else -4.0)
    for f in {f for f, _ in counts if f[0] == "c"} | {f"c:{w}" for w in MARKING}:
        prior = f[2:] in MARKING
        inside, outside = counts.get((f, True), 0) + (PRIOR_INSIDE if prior else 20), counts.get((f, False), 0) + (PRIOR_OUTSIDE if prior else 20)
        out[f] = max(min(math.log(inside / outside), 0.0), -4.0)
    return out


#: The weights before any page is seen.
PRIOR = weights({})


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run with the greatest positive sum; (0, -1) if none."""
    best, total, start, out = 0.0, 0.0, 0, (0, -1)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, out = total, (start, i)
    return out


def _reach(gains: list[float]) -> int:
    """How many of the first ``gains`` have the greatest positive sum; the more of equals."""
    best, total, out = 0.0, 0.0, 0
    for i, g in enumerate(gains):
        total += g
        if total >= best and total > 0:
            best, out = total, i + 1
    return out


def _region(p: Page, weight: dict[str, float]) -> list[_Block]:
    """The blocks of the article: those of the best region, its ends put right by the container that holds it.

    In an ``article`` or ``main`` the ends move on over blocks of the container as long as these score: their
    words against the tags that are theirs (a group's tag, which stands at every kind of bound, does not count).
    """
    scores = [weight.get(f, weight["t:other"]) * (n or 1) for f, n in p.events]
    for i in p.apart:  # words of other parts count like the markup that they are
        scores[i] = min(scores[i], weight["t:other"])
    lo, hi = best_region(scores)
    at = [k for k, b in enumerate(p.blocks) if b.last >= lo and b.first <= hi]
    if not at:
        return []
    words = _below(p, [(p.blocks[k].at, p.blocks[k].words) for k in at])
    part = holder = p.elements[0]
    need = HELD * words[id(holder)]
    for e in p.elements:  # children come after their parents, so this ends at the smallest
        if e.up is holder and words[id(e)] >= need:
            holder = e
            if e.name in BLOCK and e.name not in LINES:
                part = e
    below = {id(part)}
    for e in p.elements:
        if e.up is not None and id(e.up) in below:
            below.add(id(e))
    mine = [k for k, b in enumerate(p.blocks) if id(b.at) in below]
    if part.name in ("article", "main"):
        grouping = weight["t:other"]
        own = [sum(scores[i] for i in range(b.first, b.last + 1) if i not in p.apart) + max(weight.get(f"t:{b.at.name}", grouping), LEAST_GROUP) for b in p.blocks]
        before, after = [k for k in mine if k < at[0]], [k for k in mine if k > at[-1]]
        first, last = _reach([own[k] for k in reversed(before)]), _reach([own[k] for k in after])
        chosen = [*before[len(before) - first :], *[k for k in mine if at[0] <= k <= at[-1]], *after[:last]]
        return [p.blocks[k] for k in chosen]
    if part.name in ("html", "body", "#"):
        # no container: headings before the region are its own, lists of links at its ends are not
        first = at[0]
        while first > 0 and re.fullmatch("h[1-6]", p.blocks[first - 1].at.name):
            first -= 1
        out = p.blocks[first : at[-1] + 1]
        while len(out) > 1 and out[0].linked * 3 > out[0].words * 2:
            out.pop(0)
        while len(out) > 1 and out[-1].linked * 3 > out[-1].words * 2:
            out.pop()
        return out
    # a container of any other kind: what it holds before and after the region, up to a list of links
    first, last = min(at[0], mine[0]), max(at[-1], mine[-1])
    linked = lambda k: p.blocks[k].linked * 3 > p.blocks[k].words * 2
    for k in range(at[0] - 1, first - 1, -1):
        if linked(k):
            first = k + 1
            break
    for k in range(at[-1] + 1, last + 1):
        if linked(k):
            last = k - 1
            break
    return p.blocks[first : last + 1]


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The article's text; empty for null and for pages without words outside of menus, forms, adverts, comments and the like.

    Of regions with one sum the first is taken.
    """
    return "\n".join(b.text() for b in _region(Page(page, weight), weight)) if page else ""


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, seed: int = 1) -> dict[str, float]:
    """Weights from at most ``sample`` different labelled pages of ``pages``."""
    reach_workers(pages.sparkSession)
    rows = text_sample(pages.select(F.col("html").cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(article|main)")), "html", sample, seed)

    def count(batches):
        total: dict[tuple[str, bool], int] = {}
        for b in pieces(batches):
            for page in b.column(0).to_pylist():
                if labelled(page):
                    for k, n in feature_counts(page).items():
                        total[k] = total.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["f", "inside", "n"])

    counted = rows.mapInArrow(count, "f string, inside boolean, n long").groupBy("f", "inside").agg(F.sum("n").alias("n"))
    return weights({(r.f, r.inside): r.n for r in counted.collect()})  # the features of the sample's pages


def extracted(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty html give an empty text; null and repeated ids and urls are carried along; other
    columns are not looked at; an empty table gives an empty result.
    """
    reach_workers(pages.sparkSession)

    def work(batches):
        for b in pieces(batches):
            texts = [extract(h, weight) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, fit(pages))


QUERIES = {"op1_html_extraction": op1_html_extraction}
