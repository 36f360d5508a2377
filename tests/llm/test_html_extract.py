"""HTML extraction: the scan against all runs, pages of several makes, broken and very long ones, and the given pages against their articles."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from chronolith.llm import html_extract as h


def got(page, weights=h.PLAIN):
    return "\n\n".join(h.article(page, weights))


def test_best_run_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(300):
        v = [rng.choice((-3, -1, -0.5, 0, 0.5, 1, 4)) for _ in range(rng.randrange(0, 14))]
        a, b = h.best_run(v)
        assert sum(v[a:b]) == max([0, *[sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]])


SAID = "This sentence has quite a few words in it, as sentences of articles do."
PAGES = {
    "article": (f"<body><header>Site</header><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{SAID}<p>Be.</article><section id='comments'><p>{SAID} I think.</p></section></body>", f"Title\n\n{SAID}\n\nBe."),
    "advert inside": (f"<article><p>{SAID}</p><div class='ad-slot ad'>Buy {SAID}</div><aside>More {SAID}</aside><p>End</p></article>", f"{SAID}\n\nEnd"),
    "no article": (f"<html><body><div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class=content><h2>Head</h2><p>{SAID} <i>x</i>y</p><p>{SAID}</p><p>So.</p></div><div class='site-footer'>(c) us and all the others of the firm, with many words here</div></body></html>", f"Head\n\n{SAID} xy\n\n{SAID}\n\nSo."),
    "body only": (f"<ul><li><a href=1>A b c</a></li><li><a href=2>D e</a></li></ul><p>Hm.</p><p>{SAID}</p><p>{SAID}</p><form><p>Your name, please, in this field {SAID}</p></form>", f"Hm.\n\n{SAID}\n\n{SAID}"),
    "links unmarked": (f"<div><a href=1>A b c</a> <a href=2>D e f g</a></div><div><p>{SAID}</p></div><div><a href=1>h i j k</a></div>", SAID),
    "references": ("<article><p>a &amp; b&nbsp;&nbsp;c &#233;&#x41; &lt;p&gt; &bogus; &am</p></article>", "a & b c éA <p> &bogus; &am"),
    "comment article": (f"<article><p>{SAID} {SAID}</p><article class='comment'><p>No, {SAID}</p></article></article>", f"{SAID} {SAID}"),
    "cookie": (f"<body class='has-sidebar'><div class='cookieNotice'>{SAID} {SAID}</div><main><p>{SAID}</p></main>", SAID),
    "scripts": (f"<article><script>var x = '<p>{SAID}</p>';</script><style>p {{}}</style><!-- <p>no</p> --><p>{SAID}</p><noscript>{SAID}</noscript></article>", SAID),
    "breaks": (f"<article><p>one<br>two <b>th</b>ree\n\t four</p><div>{SAID}<p>five</div>six</article>", f"one two three four\n\n{SAID}\n\nfive\n\nsix"),
    "upper case and odd quotes": (f"<ARTICLE CLASS=\"it's > that\"><P TITLE='a>b\"'>{SAID}</P></ARTICLE>", SAID),
    "not closed": (f"<article><p>{SAID}<p>{SAID} <a href=\"x>y", f"{SAID}\n\n{SAID} y"),
    "hidden": (f"<article><p>{SAID}</p><p hidden>no</p><p style='display: none'>no</p><div role=dialog>no</div></article>", SAID),
    "plain text": ("3 < 4 and 5 > 4", "3 < 4 and 5 > 4"),
    "nothing": ("<nav><a>Home</a></nav>", ""), "empty": ("", ""), "null": (None, ""), "white": (" \n ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert got(page) == want


@pytest.mark.parametrize("page", ["<" * 200_000, "<a href=\"" * 50_000, "<div>" * 30_000 + "</x>" * 30_000, "<b>" * 30_000 + "</i>" * 30_000 + "x", "<script>" * 50_000, "<!--" * 50_000, "<p 'x " * 60_000, "<li>x" * 30_000, "&" * 100_000])
def test_odd_pages_take_linear_time(page):
    import time

    began = time.process_time()
    got(page)
    assert time.process_time() - began < 10


def test_scores_have_their_signs():
    w = h.scores(*h.tallies(PAGES["article"][0]))
    assert all((v < 0) == k.startswith("tag") for k, v in w.items())
    assert h.scores({}, {}) == h.PLAIN


def plain_article(page):
    """The article's text by cutting the page at its tags; right for the given pages only."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    cut = re.split(r"</?(?:p|h1)[^>]*>", m[1]) if m else []
    out = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", c))).split()) for c in cut]
    return "\n\n".join(t for t in out if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    d = f"/root/testdata/{sf}"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = h.op13_html_extract(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = plain_article(pages[r["page_id"]]["html"])
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


def test_odd_tables(spark):
    long = "<article>" + f"<p>{SAID}</p>" * 20_000 + "</article>"
    d = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", PAGES["article"][0]), (2, "v", ""), (3, "w", long)], "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "kind", "inside", "__html")})
    out = h.html_extract(d.drop("__html"), h.learn(d)).collect()
    assert len(out) == 5 and [r["text"] for r in out if r["page_id"] is None] == [PAGES["article"][1]]
    assert [len(r["text"].split("\n\n")) for r in out if r["page_id"] == 3] == [20_000] and sum(r["n_chars"] for r in out if r["page_id"] in (1, 2)) == 0
    assert h.html_extract(d.where("false"), h.learn(d.where("false"))).count() == 0
    with pytest.raises(ValueError):
        h.html_extract(d, h.PLAIN, keep=("page_id", "text"))
