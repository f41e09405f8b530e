"""Golden pages for every step of the cascade of titles and contents, and for the scored main area."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridex.functions import content as c

LONG = "A sentence with some words in it, and a comma. " * 6
SHORT = "Too short to be it."
MENU = "<nav><ul><li><a href='/a'>Home of all</a><li><a href='/b'>About the site</a></ul></nav>"


def parts(html):
    return c.page_parts(html)


TITLES = [
    ("<title> A long title </title><h1>Heading one</h1>", "A long title"),
    ("<title>Tiny</title><h1>Heading <b>one</b></h1>", "Heading"),
    ("<title>Fives</title><h1>12345</h1><h2> Heading two </h2>", "Heading two"),
    ("<h1></h1><h2>x</h2><div class='headline'>By its class</div>", "By its class"),
    ("<div class='headline big'>No exact class</div><p id=title>By its <i>id</i></p>", "By its"),
    ("<div class=title>short</div><span id='headline'>By its id only</span>", "By its id only"),
    ("<p>Nothing</p>", c.NO_TITLE), ("", c.NO_TITLE), (None, c.NO_TITLE),
    ("<title>Fish &amp; chips &lt;now&gt;</title>", "Fish & chips <now>"),
]


@pytest.mark.parametrize(("html", "want"), TITLES)
def test_titles(html, want):
    assert parts(html)["title"] == want


CONTENTS = [
    ("article", f"{MENU}<article><header>Head</header><p>{LONG}<script>x('</p>')</script><footer>Foot</footer></article><main>{LONG * 2}</main>", LONG),
    # the second article of its parent isn't the first, but one in another parent is
    ("article", f"<div><article>{LONG}</article><article>second {LONG}</article></div><section><article>third</article></section>", LONG + " third"),
    ("main", f"<article>{SHORT}</article><main><nav>menu</nav><header>Head</header>{LONG}</main>", "Head " + LONG),
    ("class", f"<main>{SHORT}</main><div class='blog-post x'><nav>menu</nav>{LONG}<style>p{{}}</style></div><div class='contents'>too</div>", "menu " + LONG + " too"),
    ("class", f"<div class='Content'>{LONG}</div><div class=article-body>{LONG * 2}</div>", LONG * 2),
    ("id", f"<div class=post>{SHORT}</div><div id=main-column>{LONG}</div><div id=x>{LONG}</div>", LONG),
    ("paragraphs", f"<div id=main>{SHORT}</div><div>{LONG}</div><p>One <b>two</b><p>three<ul><li>four</ul>", "One two three"),
    ("paragraphs", f"<div>{LONG}</div><p> </p>", ""),
    ("visible", f"<title>T</title>{MENU}<div>{SHORT}</div><footer>Foot</footer><script>no</script>", "T " + SHORT + " Foot"),
    ("visible", "", ""), ("visible", None, ""), ("visible", "plain & text <", "plain & text <"),
    ("article", f"<article><article>{LONG}</article></article>", LONG),
    ("main", f"<main>{LONG}<!-- a comment -->and<!-- b --> more</main>", LONG + " and more"),
]


@pytest.mark.parametrize(("strategy", "html", "want"), CONTENTS)
def test_contents(strategy, html, want):
    got = parts(html)
    assert (got["strategy"], got["text"]) == (strategy, " ".join(want.split()))


def test_exactly_enough_is_not_enough():
    assert parts(f"<article>{'x' * 200}</article>")["strategy"] == "visible"
    assert parts(f"<article>{'x' * 201}</article>")["strategy"] == "article"


def test_main_area():
    body = "".join(f"<p>{LONG}</p>" for _ in range(3))
    page = f"<body>{MENU}<div class=sidebar><p>Read this too, it is related, we think, you know.</p></div><div class=story>{body}<ul><li><a href=x>Another story, told elsewhere</a></li></ul></div><footer><p>{LONG}</p></footer></body>"
    assert parts(page)["main_text"] == " ".join((LONG * 3).split())
    # many links, few words of its own
    links = "".join(f"<p><a href=/{i}>A long line that is a link, and no more, at all {i}</a></p>" for i in range(30))
    assert parts(f"<div>{links}</div><div>{body}</div>")["main_text"] == " ".join((LONG * 3).split())
    assert parts("<p>short</p>")["main_text"] == "" and parts(None)["main_text"] == ""


def test_unclosed_elements():
    got = parts(f"<table><tr><td class=content><p>{LONG}<td>next<tr><td>last</table>after")
    assert got["text"] == " ".join(LONG.split()) and got["strategy"] == "class"
    assert parts("<p>a<div>b</div>c</p>")["text"] == "a"
    assert parts("<p>a</i>b</p>d</article>")["text"] == "a b"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<![x", "<!-", "<a href=x>", "</a>", "&amp", "&#x110000;", "<", ">", "text ", "<script>", "</script>", "<br/>", "<div class>", "\x00", "<main id=content>"]), max_size=40))
def test_any_page_can_be_read(pieces):
    got = parts("".join(pieces))
    assert set(got) == {"title", "strategy", "text", "main_text"}


def test_pages_in_spark(spark):
    rows = [(i, h) for i, (_, h, _) in enumerate(CONTENTS)]
    d = spark.createDataFrame(rows, "i int, html string").repartition(3)
    got = {r["i"]: (r["strategy"], r["text"]) for r in d.select("i", c.page_parts_udf(F.col("html")).alias("p")).select("i", "p.*").collect()}
    assert got == {i: (s, " ".join(w.split())) for i, (s, _, w) in enumerate(CONTENTS)}
