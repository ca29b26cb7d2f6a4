"""Pages whose article a container's name or an omitted tag must not take away."""

import pytest

from gridgauge.llm import html


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><p>text</p></body></html>", "text"), ("<head><title>t</title><p>text</p>", "text"), ("<head><title>t</title>text", "text"),
        ("<div class='content has-sidebar'><p>text</p></div>", "text"), ("<div id='main-no-sidebar'><p>text</p></div>", "text"), ("<div class='post social-news'><p>text</p></div>", "text"),
        ("<div class='legal-article'><p>text</p></div>", "text"), ("<p>a <svg/> b</p><p>c <svg></svg> d</p>", "a b\n\nc d"), ("<p>a <math /> b</p>", "a b"),
        ("<body><form action=x><nav>m</nav><h1>H</h1><p>text</p></form></body>", "H\n\ntext"),
        ("<div class='article-footer'>x</div><div class='related-posts'>y</div><div class='social-share'>z</div><form><p>mail</p></form><h1>H</h1>", "H"),
    ],
)
def test_whole_article(page, want):
    assert html.main_text(page) == want
