import html
import re

import pytest

from pipetally.llm import html_text as H


@pytest.fixture(scope="module")
def weight(spark, small):
    return H.fit(spark.read.parquet(f"{small}/pages.parquet"))


def test_words_score_positive_and_tags_negative(weight):
    assert all(w > 0 for f, w in weight.items() if f.startswith("w:")) and all(w < 0 for f, w in weight.items() if f.startswith("t:"))


def test_best_region_is_the_best_of_all():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.choice((-3, -1, 0.5, 2)) for _ in range(rnd.randrange(12))]
        lo, hi = H.best_region(s)
        best = max([sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)] + [0])
        assert sum(s[lo : hi + 1]) == max(best, 0)


def test_articles_of_the_table(spark, small, weight):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extracted(pages, weight).collect()}
    for r in pages.collect():
        a = re.split(r"</article>|<footer", r.html.split("<article>")[1])[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", a)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


CASES = {
    "<html><body class='has-sidebar'><div id=header><a href=/>Home</a> Site</div><div class=wrap><div class=content><h2>Title here</h2><p>One two three four five six seven.</p>"
    "<div class=ad>Buy now</div><p>Eight &amp; nine<br>ten   eleven.</p><ul><li>item one<li>item two</ul></div><div class='sidebar'><p>Latest things and so on</p></div></div>"
    "<section id=comments><article class=comment><p>I really liked it very much indeed my friend</p></article></section><footer>(c) 2020</footer></body></html>":
    "Title here\nOne two three four five six seven.\nEight & nine ten eleven.\nitem one\nitem two",
    "<body><header><h1>Site</h1></header><main><article><header><h1>Art</h1></header><p>Text a b c d e f g.</p><aside>Related: x</aside><form><input>Subscribe<button>Go</button></form>"
    "</article><div class=comments><p>hi there</p></div></main>": "Art\nText a b c d e f g.",
    "<p>plain para one two three</p><p>and another<script>var a='<p>x</p>'</script> one</p><nav><a href=1>a</a></nav>": "plain para one two three\nand another one",
    "just text &lt;&nbsp;nothing else": "just text < nothing else",
    "<div class='cookie-notice'>We use cookies on this site and more</div><article><p>Body words</p><!-- <p>no</p> --><style>p{}</style></article>": "Body words",
    "<a title='x>y' href=b>link</a> text <b attr=\"unclosed> more</b> rest of it": "link text more rest of it",
    "<form id=all><div class='no-comments'><article><p>whole page in a form</p><form>x</form></article></div></form>": "whole page in a form",
    "<article><p>one<p>two<table><tr><td>a<td>b<tr><td>c</table>": "one\ntwo\na\nb\nc",
    "<body><nav><a href=1>a</a></nav><article class='post featured-promo'><h1>One</h1><p>two three four</p></article></body>": "One\ntwo three four",
    "<body><div class='related-content'><article><h1>One</h1><p>two three four</p></article></div></body>": "One\ntwo three four",
    "<body><div id='discussion-paper'><article><p>two three four</p></article></div></body>": "two three four",
    "<body><article><p>one two three</p><p class='social'>four five</p><div class='notice-period'>six seven eight</div><p>nine</p></article></body>": "one two three\nfour five\nsix seven eight\nnine",
    "<body><div class=site-header>Site name</div><div class=posts><h1>Head</h1><div class=post><p>one two three four</p></div><div class=post><p>five six seven eight nine ten</p></div></div></body>":
    "Head\none two three four\nfive six seven eight nine ten",
    "<body><main><article><p>one two three four five</p></article><article><p>six seven eight nine ten eleven twelve</p></article></main></body>": "one two three four five\nsix seven eight nine ten eleven twelve",
    "<body><div class=cookie-notice>we use cookies here and there</div><div class=content><h2>Words</h2><p>one two three four five six.</p><p>x</p></div><div class=share-buttons>Share this</div><div class=comments><p>I like it a lot</p></div></body>":
    "Words\none two three four five six.\nx",
    "<body><div class=comments><p>only comments are on this page</p></div></body>": "",
    "<body><form><label>Name</label><p>Enter your address here</p></form></body>": "",
    "<body><div class=ad>Buy this now and here</div></body>": "",
    # names inside of values are no attributes
    '<article data-menu="hidden"><p>one two three</p></article>': "one two three",
    '<div title="hidden gems" data-x=\'class="ad"\'><p>one two three</p></div>': "one two three",
    '<article><p><a href="/hidden-places">link</a> words of it</p></article>': "link words of it",
    # a word is judged by its own element
    "<article><p><button>Listen</button> text of it all</p></article>": "text of it all",
    "<article><p><span hidden>x</span> text <span style='display:none'>SECRET</span>more <select><option>a</select> <svg>q</svg>end</p></article>": "text more end",
    "<article><p>One two <span class='ad'>BUY NOW</span>three <b class='ad'>four</b></p></article>": "One two three four",
    "<body><article><p>one two three</p></article><div class='user-feedback'><p>I like it very much</p></div><div id=responses><p>me too</p></div></body>": "one two three",
    "<body><font><div class=story><p>one two three</p></div></font><ul><li><a href=1>other</a><li><a href=2>things</a></ul></body>": "one two three",
}


@pytest.mark.parametrize("page", list(CASES))
def test_other_pages(page, weight):
    assert H.extract(page, weight) == CASES[page]


def test_weights_decide(small, spark):
    """The region follows the weights: with others, other words are the page's text."""
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    learned = H.fit(spark.read.parquet(f"{small}/pages.parquet"))
    without = {**learned, **{f: 0.0 for f in learned if f[0] == "c"}}  # classes say nothing
    assert sum(H.extract(p, learned) != H.extract(p, without) for p in CASES) >= 2
    # on the table's own pages too, inside their article elements: short blocks stay only while words outweigh tags
    small_words = {**learned, "w:text": 0.001, "w:link": 0.001}
    few_words = {**learned, "w:text": 0.2}
    texts = [H.extract(p, learned) for p in pages]
    assert all(len(H.extract(p, small_words)) < len(t) for p, t in zip(pages, texts))
    changed = [(t, H.extract(p, few_words)) for p, t in zip(pages, texts)]
    assert sum(t != c for t, c in changed) >= 1 and all(c in t for t, c in changed)
    flat = {f: 1.0 if f[0] == "w" else -0.001 for f in learned if f[0] != "c"}
    page = "<body><div><p>a short lead</p></div>" + "<hr>" * 30 + "<div><p>" + "words of the text " * 9 + "</p></div></body>"
    assert H.extract(page, learned) != H.extract(page, flat) and "lead" in H.extract(page, flat)
    upside = {**learned, "w:text": -0.1, "w:link": 3.0}
    page = "<body><div><p>" + "plain words " * 9 + "</p></div>" + "<hr>" * 9 + "<div><p><a href=x>" + "linked words " * 9 + "</a></p></div></body>"
    assert H.extract(page, learned).startswith("plain") and H.extract(page, upside).startswith("linked")
    assert pages


def test_learned_classes(spark):
    """A class that labelled pages have outside of their articles marks another part where there is no article."""
    page = "<body><div class='zz'>" + "offers of the day " * 9 + "</div><article><p>" + "words of the text " * 20 + "</p></article></body>"
    w = H.fit(spark.createDataFrame([(page + " " * i,) for i in range(8)], "html string"))
    bare = "<body><div class='zz'><p>" + "other offers here " * 20 + "</p></div><div class='yy'><p>some words of a text</p></div></body>"
    assert H.extract(bare, w) == "some words of a text" and H.extract(bare, H.PRIOR).startswith("other offers")


def test_pages_without_article_elements(spark, small, weight):
    """Held pages with their article in a div give the same text."""
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        bare = r.html.replace("<article>", "<div class='content'>").replace("</article>", "</div>")
        assert H.extract(bare, weight) == H.extract(r.html, weight)


def test_deep_and_long_pages(weight):
    import time

    assert H.extract("<body>" + "<div>" * 600 + "<nav>menu menu</nav>" + "<p>text of the page</p>" + "</div>" * 600, weight) == "text of the page"
    began = time.time()
    assert H.extract("<div>" * 500 + "<p>a paragraph of words</p>" * 3000, weight).count("\n") == 2999
    H.extract("<p>" + "<b>" * 20_000 + "x" + "</i>" * 20_000, weight)
    assert time.time() - began < 5


def test_ties_and_repeated_rows(spark, weight):
    page = "<body><div><p>one two three</p></div>" + "<hr>" * 50 + "<div><p>four five six</p></div></body>"
    assert H.extract(page, weight) == "one two three"  # of equal regions the first
    df = spark.createDataFrame([(1, "u", page)] * 3, "page_id long, url string, html string")
    assert [r.text for r in H.extracted(df, weight).collect()] == ["one two three"] * 3


def test_odd_rows(spark, weight):
    long = "<article>" + "<p>words of a paragraph</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (2, None, "<><<>&<"), (3, "u", "<script>only"), (4, "u", long), (5, "u", "<div>" * 50_000 + "deep"), (6, "u", "<nav>menu</nav>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extracted(df, weight).collect()]
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and by[1] == "" and by[None] == "x" and by[3] == "" and by[5] == "deep" and by[6] == ""
    assert by[4] == "\n".join(["words of a paragraph"] * 20_000) and all(n == len(t) for _, t, n in got)
    assert H.extracted(df.limit(0), weight).count() == 0
    assert H.fit(df.limit(0))["w:text"] > 0


def plain_blocks(weight, events):
    """The texts of a page of (tag, words) blocks in one article: the best run of all, then the best growth at both ends."""
    scores = []
    for tag, words in events:
        scores += [weight.get(f"t:{tag}", weight["t:other"]), weight["w:text"] * len(words), weight.get(f"t:{tag}", weight["t:other"])]
    scores = [weight["t:article"], *scores, weight["t:article"]]
    runs = [(sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    total, a, b = max(runs)
    if total <= 0:
        return []
    places = [2 + 3 * k for k in range(len(events))]
    inside = [k for k, at in enumerate(places) if -a <= at < -b]
    own = [weight["w:text"] * len(w) + max(weight.get(f"t:{t}", weight["t:other"]), H.LEAST_GROUP) for t, w in events]
    first, last = inside[0], inside[-1]
    up = max(range(first + 1), key=lambda k: (round(sum(own[k:first]), 9), -k))
    down = max(range(last, len(events)), key=lambda k: (round(sum(own[last + 1 : k + 1]), 9), k))
    return [" ".join(w) for _, w in events[up : down + 1]]


def test_articles_by_brute_force():
    """Random weights and blocks: the whole operator against trying every run."""
    import random

    rnd = random.Random(3)
    ended = 0
    for _ in range(300):
        weight = {**H.PRIOR, "w:text": rnd.choice([0.07, 0.31, 1.03]), "t:p": -rnd.choice([0.2, 1, 3]), "t:h2": -rnd.choice([0.2, 2, 4]), "t:article": -1.0}
        events = [(rnd.choice(["p", "p", "h2"]), [f"w{rnd.randrange(99)}" for _ in range(rnd.choice([1, 2, 5, 20]))]) for _ in range(rnd.randrange(1, 9))]
        page = "<article>" + "".join(f"<{t}>{' '.join(w)}</{t}>" for t, w in events) + "</article>"
        want = plain_blocks(weight, events)
        assert H.extract(page, weight).split("\n") == (want or [""])
        ended += 0 < len(want) < len(events)
    assert ended > 30
