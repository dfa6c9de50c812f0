import time

from assayer.llm.html_text import Page, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B, c, d</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, cheap, good, fast.</div><div class="cookie-notice"><p>We use cookies, yes, really.</p></div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph,
with an <a href="x">inline link</a>&nbsp;and&#8212;a dash.<br><p>Second one, unclosed<ul><li>item one<li>item two</ul><blockquote>Quoted.</blockquote>
<table><tr><td>a<td>b</table><form><p>Your mail, please</p><input></form><div id="comments"><p>Nice, great, long comment, thanks, a lot.</p></div></article>
<aside><p>Related, more, text</p></aside><footer>&copy; me</footer></body></html>"""


def test_article_alone():
    assert Page(PAGE).text().split("\n") == ["Head & line", "First paragraph, with an inline link and—a dash.", "Second one, unclosed", "item one", "item two", "Quoted.", "a", "b"]


def test_container_without_semantic_elements():
    long = "Some words, and more of them, to make a paragraph that is long enough to count for something. " * 3
    page = f"<div><div><a href=1>x, y</a> <a href=2>z, w</a></div><div id=c1><div><p>{long}</p><p>{long}</p></div><div><p>{long}</p></div></div><div><a href=3>more, and, more, links</a></div></div>"
    assert Page(page).text() == "\n".join([long.strip()] * 3)


def test_odd_pages():
    assert Page("just text, no markup").text() == "just text, no markup"
    assert Page("<p>unclosed <b>a < b & c").text() == "unclosed a < b & c"
    assert Page("<nav>only a menu</nav>").text() == "" and Page("<!-- never ends <p>x").text() == "" and Page("<script>x").text() == ""
    started = time.time()
    assert Page("<div>" * 30000 + "deep").text() == "deep"
    assert Page("<p>" + "word, " * 200000).text() == ("word, " * 200000).strip()
    assert Page("<a x='" * 3000 + "<p>t</p>").text() is not None
    assert time.time() - started < 20


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<p>x</p>", "t"), (3, "w", "<p>x</p>", "t")]
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got[0] == (0, "v", "", 0) and got[2] == (2, None, "", 0) and got[3] == got[4] == (3, "w", "x", 1) and got[1][3] == len(got[1][2]) > 60
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "Some words, and more of them, to make a paragraph that is long enough to count for something. " * 3


def test_whole_article_around_its_best_node():
    page = f"""<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><div class="entry-content"><p>{LONG}</p><p>{LONG}</p></div>
    <section><h2>Second</h2><p>Short one.</p></section><figure><img><figcaption>A figure</figcaption></figure><table><tr><td>a<td>b</table><ul><li>item</ul><p>End.</p>
    <div><a href=1>more</a> <a href=2>links</a></div><div class=share>Share this</div></article><div>Site, by me</div></body>"""
    assert Page(page).text().split("\n") == ["Title", LONG.strip(), LONG.strip(), "Second", "Short one.", "A figure", "a", "b", "item", "End."]


def test_blocks_beside_prose_without_semantic_elements():
    page = f"<body><div id=x><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><p>Brief.</p><ul><li>item</ul><ul><li><a href=1>link</a></ul></div><div>Imprint</div></body>"
    assert Page(page).text().split("\n") == ["Title", LONG.strip(), LONG.strip(), "Brief.", "item"]


def test_class_of_what_holds_most_takes_nothing_out():
    for name in ("layout has-sidebar", "no-sidebar", "with-sidebar", "legal", "alert"):
        page = f'<body><div class="{name}"><h1>Title</h1><div class=text><p>{LONG}</p></div><div class="sidebar"><p>Other, things</p></div></div><div class="ad">Buy</div></body>'
        assert Page(page).text().split("\n") == ["Title", LONG.strip()], name
    halves = f"<div class=alert><p>{LONG}</p></div><div class=notice><p>{LONG}</p></div>"
    assert Page(halves).text() == f"{LONG.strip()}\n{LONG.strip()}"
    assert Page("<article><p>Brief, but it.</p></article><div class=ad>Buy now, cheap, good, fast.</div>").text() == "Brief, but it."
    assert Page(f"<div><p>One, two, three.</p><p>Four.</p></div><div class=comments><p>{LONG}</p><p>{LONG}</p></div>").text() == "One, two, three.\nFour."


LONG = "Prose that goes on, and on, for well over eighty characters, so that it counts as a paragraph. " * 2


def text_of(html):
    return Page(html).text()


def test_broken_pages_take_time_in_proportion():
    pages = ["<b " * 350_000, "<!x" * 350_000, "<b" * 500_000, '<b "' * 250_001, "<b \"'" * 200_001 + ">", "<div>" * 40_000 + "</span>" * 120_000, "<ul>" + "<b>" * 40_000 + "<li></li>" * 60_000, "<a href=" * 120_000 + "<!--"]
    began = time.perf_counter()
    found = [text_of(p) for p in pages]
    assert time.perf_counter() - began < 20 and found[5] == "" and len(found[1]) == 1_050_000


def test_tags_end_outside_quotes():
    assert text_of("<article><p title='a > b' id=x>one</p><p title=\"it's > so\">two</p>1 < 2<p>three</article>") == "one\ntwo\n1 < 2\nthree"
    assert text_of('<p>one<a href="x>two</p>') == 'one<a href="x>two'


def test_a_form_around_the_page_and_classes_of_heads_and_prose_take_nothing_out():
    prose = " ".join(LONG.split())
    assert text_of(f"<form><article><h1>T</h1><p>{LONG}</p></article></form>") == f"T\n{prose}"
    assert text_of(f"<article><div class='entry-header'><h1>T</h1></div><p>{LONG}</p></article>") == f"T\n{prose}"
    assert text_of(f"<article><h1 class='search'>T</h1><p class='social'>{LONG}</p><p>{LONG}</p></article>") == f"T\n{prose}\n{prose}"
    assert text_of(f"<article><p>{LONG}</p><div class='social'>share</div><form><p>sign up</p></form><div class='comments'><p>{LONG}</p></div></article>") == prose
