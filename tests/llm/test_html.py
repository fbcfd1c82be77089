"""Pages whose names, forms and nesting mislead, and what the minimum cut adds to the classifier."""

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_extract as H

T = "A first paragraph of an article that has quite a few words in it, and they go on and on."
WRAPPED = ["content has-sidebar", "post comments-open", "single legal-news", "search-results", "no-sidebar post-12", "content-sidebar layout"]


@pytest.mark.parametrize("name", WRAPPED)
def test_one_name_does_not_veto_an_article(name):
    assert H.extract(f'<div class="{name}"><article><p>{T}</p><p>Short.</p></article></div>') == f"{T}\nShort."
    assert H.extract(f'<div class="{name}"><p>{T}</p><p>{T}</p><p>Short.</p></div>') == f"{T}\n{T}\nShort."


LONG = "It was said of the place that nobody had gone there in a long time, and those who had gone came back with little to tell of it. " * 3
MISLEADING = ["navy", "cookie-recipes", "social-science", "legal", "shareholders", "promo-page", "related-work", "newsletter", "search", "overlay", "discussion", "widget", "header", "menus-2024"]


@pytest.mark.parametrize("name", MISLEADING)
def test_an_article_that_is_all_there_is_stays_whatever_it_is_called(name):
    inner = f"<h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p>"
    want = "\n".join(["Title of it", LONG.strip(), LONG.strip()])
    assert H.extract(f'<body><div class="{name}">{inner}</div></body>') == want
    assert H.extract(f'<body><nav><a href=x>Home</a> <a href=y>Other</a></nav><div class="{name}"><div class="entry-content">{inner}</div></div><footer>Copyright of ours</footer></body>') == want
    comments = f'<div id="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>'
    assert H.extract(f'<body><div class="{name}">{inner}</div>{comments}</body>') == want


def cheapest(found, elements):
    """The labels of a page's blocks by trying every labelling of blocks and elements; content where it costs less, boilerplate in a tie."""
    nodes, costs, edges = H.graph(found, elements)
    best = (float("inf"), 0, ())
    for bits in range(1 << len(costs)):
        cost = sum(max(0.0, c) if not bits >> i & 1 else max(0.0, -c) for i, c in enumerate(costs))
        cost += sum(w for (a, b), w in edges.items() if (bits >> a & 1) != (bits >> b & 1))
        best = min(best, (round(cost, 6), bits.bit_count(), bits))
    return [bool(best[2] >> n & 1) for n in nodes]


@pytest.mark.parametrize(
    "page",
    [
        f"<div class=menu><a href=x>Home</a></div><article><h1>T</h1><p>{T}</p></article><aside><p>{T}</p></aside>",
        f"<div class=legal><p>{LONG}</p><ul><li><a href=x>One</a></li></ul></div><footer>Rights</footer>",
        f"<div><p>{T}</p><p>Yes</p><div class=share><a href=x>Share it</a></div></div><div id=comments><p>{T}</p></div>",
        f"<section><article><a href=x>Read more</a></article></section><div><p>{T}</p></div>",
    ],
)
def test_the_labels_are_those_of_the_cheapest_labelling(page):
    found, elements = H.blocks(page)
    H._forms(elements)
    assert H.label(found, elements) == cheapest(found, elements)


def test_forms_around_a_page_and_forms_to_fill_in():
    page = f'<form id=aspnet><div class=nav><a href=x>Home</a></div><div class=content><p>{T}</p><p>Yes.</p></div></form>'
    assert H.extract(page) == f"{T}\nYes."
    assert H.extract(f"<article><p>{T}</p><div><form><fieldset><p>Sign up now. {T}</p></fieldset></form></div></article>") == T
    assert H.extract(f"<form><h1>Title of it</h1><p>{T}</p><p>{T}</p><form><p>Log in</p></form></form>").startswith("Title of it")


@pytest.mark.parametrize("name", ["user-comments", "site-footer", "post-comments", "related-posts", "sponsored-content", "comment-content", "cookie-banner", "sidebar-left", "ad-slot", "footer-links", "newsletter-signup", "main-nav"])
def test_bad_names_go(name):
    assert H.extract(f'<div class=page><p>{T} A</p><div class="{name}"><p>{T}</p><p>{T}</p></div><p>Two.</p></div>') == f"{T} A\nTwo."


def test_comments_inside_an_article():
    page = f'<article><header class="entry-header"><h1>Tit</h1><div class=entry-meta>By Jo</div></header><p>{T}</p><section id=comments><h3>2 comments</h3><article class=comment><p>C {T}</p></article><ol class=comment-list><li>{T}</li></ol></section></article>'
    assert H.extract(page) == f"Tit\nBy Jo\n{T}"
    assert H.extract(f"<article><p>{T}</p><ul><li><a href=x>Ref one</a></li><li><a href=y>Ref two</a></li></ul></article>") == f"{T}\nRef one\nRef two"


def test_the_cut_changes_what_the_classifier_says():
    links = "".join(f"<li><a href={k}>Go there {k}</a></li>" for k in range(4))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title of it</h2><p>{T}</p><p>Be it</p><p>{T}</p></div><div><h3>See these pages too, they are good</h3><ul>{links}</ul></div></body>"
    found, elements = H.blocks(page)
    alone = [b.text for b in found if H.score(b) > 0]
    kept = [b.text for b, keep in zip(found, H.label(found, elements), strict=True) if keep]
    assert "Be it" not in alone and "Title of it" not in alone  # short ones between long ones come back
    assert kept == ["Title of it", T, "Be it", T]


def test_deep_and_broken_pages_take_linear_memory():
    peaks = []
    for n in (10_000, 40_000):
        tracemalloc.start()
        H.extract("<div>" * n + "x" + "</p></section>" * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 60_000_000
    began = time.time()
    H.extract("<div>x" * 30_000 + T)
    H.extract('<div class="a' * 2000 + "<p" * 2000 + "<" * 2000)
    assert time.time() - began < 30


def test_training(spark):
    page = f"<nav><a href=x>Home page here</a></nav><article><h1>T</h1><p>{T}</p></article><footer>All rights</footer>"
    rows = [(k, f"u{k}", page) for k in range(40)] + [(None, None, None), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = H.train(pages)
    assert weights == H.train(pages.repartition(3)) and weights != H.WEIGHTS and weights[H.FITTED :] == H.WEIGHTS[H.FITTED :]
    assert H.train(pages.limit(0)) == H.WEIGHTS and H.train(pages.withColumn("html", F.lit(f"<p>{T}</p>"))) == H.WEIGHTS
    clash = pages.withColumns({c: F.lit(1) for c in ("text", "n_chars", "x", "n", "blocks", "element")})
    got = H.extract_pages(clash, weights).collect()
    assert sorted(r["text"] for r in got) == sorted([f"T\n{T}"] * 40 + ["", ""])
