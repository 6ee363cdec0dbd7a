"""Class names that describe a page's layout take no article away; comments and sidebars go all the same."""

import pytest

from fieldspark.llm import mincut_html

LONG = [f"Paragraph {k} of the article tells at some length what happened, who was there, and why it matters to the people of the town in question." for k in range(3)]
BODY = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize(
    "page",
    [
        '<div class="has-sidebar content">{}</div>',
        '<div id="page" class="layout sidebar-right"><div class="content">{}</div></div>',
        '<div class="menu-page"><article>{}</article></div>',
        '<div class="nav-wrapper main-wrapper">{}</div>',
        '<div class="ads-free content">{}</div>',
        '<div class="search-content">{}</div>',
        '<div class="subscribe-post">{}</div>',
        '<div class="site-header-fixed no-comments"><h1>The title of the page</h1>{}</div>',
        '<body class="menu-open"><div class="with-toolbar"><main>{}</main></div></body>',
    ],
)
def test_layout_names_of_wrappers(page):
    text = mincut_html.main_text("<html>" + page.format(BODY) + "</html>")
    assert all(p in text for p in LONG)


@pytest.mark.parametrize(
    "extra",
    [
        '<div class="sidebar"><p>{}</p></div>',
        '<div class="cookie-consent"><p>{}</p></div>',
        '<ol class="thread"><li><b>Ann</b> <time>May 3</time><p>{}</p></li><li><b>Bob</b> <time>May 4</time><p>{}</p></li></ol>',
        '<div id="discussion"><p>{}</p><p>{}</p></div>',
        '<section class="comments"><article><p>{}</p></article><article><p>{}</p></article></section>',
        '<div class="ads"><p>{}</p></div>',
    ],
)
def test_what_is_not_the_article_goes(extra):
    other = "I have to say that this is not what I expected to read here, and a good many other readers will feel the same about the whole affair."
    text = mincut_html.main_text(f'<html><div class="has-sidebar"><div class="content">{BODY}</div>{extra.format(other, other)}</div></html>')
    assert all(p in text for p in LONG) and other not in text


def test_long_pages_and_deep_trees():
    page = "<div class='content'>" + "".join(f"<p>{LONG[k % 3]} Number {k}.</p>" for k in range(2000)) + "</div>"
    assert mincut_html.main_text(page).count("Number") == 2000
    deep = "<div>" * 5000 + BODY + "</div>" * 5000
    assert all(p in mincut_html.main_text(deep) for p in LONG)


def test_empty_table(spark):
    assert mincut_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
