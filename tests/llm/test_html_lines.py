"""Line-block distribution: pages built from known parts, broken pages, and time on deep ones."""

import random
import time

import pytest

from gridgauge.llm import html

LONG = "This is a long paragraph of the story that goes on and says many things about the world. " * 4


def sentence(rng, n):
    return " ".join(rng.choice("river stone light under seven markets walk slowly through open green winter".split()) for _ in range(n)).capitalize() + "."


def built(rng):
    """(page, main text): a story in unmarked or neutrally named ``div``s, with what isn't the story around and between."""
    story = [sentence(rng, rng.choice((3, 8, 40, 90))) for _ in range(rng.randint(3, 9))] + [sentence(rng, 80)]
    rng.shuffle(story)
    advert = lambda: rng.choice(("<div class='ad'>Buy now</div>", "<div id='ad-banner'><p>Cheap things. Buy them now.</p></div>", "<aside>More</aside>", "<div class='cookie-notice'><p>We use cookies.</p></div>", "<form><p>Mail</p></form>"))
    inner = "".join(f"<p>{x}</p>" + (advert() if rng.random() < 0.4 else "") for x in story)
    menu = rng.choice(("<div><a href=/>Home</a><br><a href=/b>About</a></div>", "<ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul>", "<div>Home | About | Contact</div>", "<nav>Home</nav>", ""))
    box = rng.choice(("<div>Weather: 21</div>", "<div class=sidebar><p>About the author. They live in a town.</p></div>", "<td>Top 10</td>", ""))
    comments = rng.choice(("<div class='reader-comments'><p>I liked this. Thank you.</p></div>", ""))
    wrap = rng.choice(("<div>{}</div>", "<div class='hidden-gem search-tips'>{}</div>", "<section id=has-sidebar>{}</section>", "<main>{}</main>", "<article>{}</article>", "<table><tr><td>{}</td></tr></table>"))
    return f"<html><body>{menu}{box}{wrap.format(inner)}{comments}<footer>Imprint</footer></body></html>", "\n\n".join(story)


def test_built_pages():
    rng = random.Random(5)
    pages = [built(rng) for _ in range(400)]
    for page, want in pages:
        assert html.main_text(page) == want, page
    # Without the surge every line that stands outside marked regions would stay.
    without = sum(html.main_text(page, surge=0.0) != want for page, want in pages)
    assert without > 100
    assert not any(html.main_text(page, surge=1e6) for page, _ in pages)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (" ", ""), ("<p></p>", ""), ("<html></html>", ""), ("<!-- x -->", ""), ("<script>x</script>", ""), ("<a href='", ""), ("<p>a <a href='x>b</p>", "a b"),
        (f"<div><p>{LONG}</p><div class=ad>Buy</div><p>Short closing paragraph.</p></div>", f"{LONG.strip()}\n\nShort closing paragraph."),
        (f"<article class=teaser>Teaser</article><div><p>{LONG}</p></div>", LONG.strip()), (f"<body><h1>T</h1><div><p>{LONG}</p></div>", f"T\n\n{LONG.strip()}"),
        (f"<body><div>{LONG}</div><div class=ad>Buy</div><div>Short closing paragraph.</div><div>Imprint</div>", f"{LONG.strip()}\n\nShort closing paragraph."),
        (f"<div>Home About</div><div>{LONG}<br>{LONG}</div>", (LONG * 2).strip()), ("<p><a href=x>only a link</a></p>", "only a link"),
        (f"<body><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><h1>T</h1><p>{LONG}</p><p>end</p><ul><li><a href=x>Next</a><li><a href=y>Last</a></ul>", f"T\n\n{LONG.strip()}\n\nend"),
        (f"<div class='sidebar-left-content'><main><p>{LONG}</p></main></div>", LONG.strip()), (f"<div class=comments><article><p>{LONG}</p></article></div><p>x</p>", "x"),
    ],
)
def test_lines(page, want):
    assert html.main_text(page) == want


def test_broken_pages():
    rng = random.Random(1)
    parts = ["<div>", "</div>", "<p>", "<", ">", "'", '"', "<a href='", "<a href=x>", "</a>", "text ", "<svg>", "</svg>", "<li>", "<ul>", "</section>", "<article>", "</article>", "<td>", "<tr>", "<form>", "&amp;", "&#xd800;", "&#0;", "<!--", "-->", "<![CDATA[", "<h1>", "<span class=ad>", "</span>", "<br/>", "<head>", "<div class=", "\x00", "é", "<main>", "<textarea>"]
    for _ in range(10_000):
        html.main_text("".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))).encode()


@pytest.mark.parametrize("part", ["<div>", "<svg>", "<a href='", "<a '''", "<form>", "<span class=ad>", "<div class=ad>x", "<ul><div>", "<p>x"])
@pytest.mark.parametrize("ends", ["", "</section>", "<li></li>"])
def test_time_in_proportion(part, ends):
    t = time.process_time()
    html.main_text(part * 12_000 + ends * 12_000)
    assert time.process_time() - t < 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "x", "y")], "page_id long, html string, text string, url string")
    assert html.extract(df).first().text == "a"
    with pytest.raises(ValueError):
        html.extract(df, keep=("url", "text"))
