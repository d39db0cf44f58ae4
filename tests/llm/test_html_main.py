import pytest

from tracewright.llm import html_main as H

PAGE = "page_id long, url string, html string, text int, n_chars string"
BODY = "".join(f"<p>Sentence {i} has a few words of prose in it, as an article does.</p>" for i in range(8))
WANT = "Title &amp; more".replace("&amp;", "&") + "".join(f"\n\nSentence {i} has a few words of prose in it, as an article does." for i in range(8))
FULL = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies to make this site work for you and for us.</div><aside class=sidebar><p>Popular posts of the week and of the month</p></aside>"
    f"<article><h1>Title &amp; more</h1>{BODY}<div class=ad><p>Buy one get one free while it lasts today.</p></div></article>"
    "<section id=comments><h2>Comments</h2><div class=comment><p>I liked this article very much, thank you for it.</p></div></section>"
    "<form><label>Mail</label><input name=x><button>Send</button></form><footer>&copy; 2024 Someone. All rights reserved by them.</footer><script>var x = '<p>no</p>';</script></body></html>"
)


def test_full_page():
    assert H.main_text(FULL, H.Weights()) == WANT


def test_without_article_element():
    assert H.main_text(FULL.replace("<article>", "<div>").replace("</article>", "</div>"), H.Weights()) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain words", "plain words"), ("<p>a\n  b\t<b>c</b>d</p>", "a b cd"), ("<p>a<br>b</p><p>c", "a b\n\nc"), ("<p>x &amp;amp; y &lt;b&gt; &#8364; &eacute;</p>", "x &amp; y <b> € é"),
        ("<p>one</p><!-- <p>no</p> --><p>two</p>", "one\n\ntwo"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("<p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"), ("<p title='a>b'>x</p>", "x"),
        ("<script>never closed <p>x</p>", ""), ("<head><title>x<body><p>text</p>", "text"), ('<head><script>document.write("<body>");</script></head><body><p>a b</p>', "a b"), ("<p>a b</p><svg width=1/><p>c d</p><svg><text>no</text></svg><p>e f</p>", "a b\n\nc d\n\ne f"), ("<div><option>x<option>y</div><p>shown text</p>", "shown text"), ("<div><p>a b c</p><button>press</div><p>d e f</p>", "a b c\n\nd e f"),
        ("<p>one two<textarea>never closed<p>x</p>", "one two"), ("<html><head><meta charset=x><link rel=y></head><p>text of it</p>", "text of it"), ("<!-- never closed <p>x</p>", ""), ("<p title=\"it's>a</p>x y z", "a\n\nx y z"),
        ("<p>shown</p><p hidden>not</p><p style='display: none'>nor this</p>", "shown"), ("<p>" + "word " * 50000 + "</p>", ("word " * 50000).strip()), ("<P>Upper</P><DIV CLASS=AD>buy</DIV>", "Upper"),
    ],
)
def test_small_pages(page, want):
    assert H.main_text(page, H.Weights()) == want


def test_articles_of_the_table(spark, sf):
    """Every page of the table marks its article: the extracted text is that article's."""
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.op9_html_main(spark, sf).collect()}
    for p in pages:
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"<(?!br)[^>]*>", "", b))).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inside)]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_table_without_article_elements(spark, sf):
    """Weights learned from marked pages find the same texts where the marks are taken away."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = H.fit(pages)
    rows = pages.collect()
    same = sum(H.main_text(p.html.replace("<article>", "<div>").replace("</article>", "</div>"), weights) == H.main_text(p.html, weights) for p in rows)
    assert same >= 0.95 * len(rows)


PROSE = " ".join(f"Sentence number {i} of a longer argument goes here." for i in range(30))


@pytest.mark.parametrize("name", ["my-related-work", "comments-on-the-theory"])
@pytest.mark.parametrize("element", ["article", "div"])
def test_long_names_decide_little(name, element):
    page = f"<body><nav><a href=/>Home</a></nav><{element}><h1>The title</h1><p>Some words first.</p><div class={name}><p>{PROSE}</p></div><p>A short end.</p></{element}></body>"
    assert H.main_text(page, H.Weights()) == f"The title\n\nSome words first.\n\n{PROSE}\n\nA short end."


@pytest.mark.parametrize("name", ["comment-list", "site-footer-inner", "cookieNotice", "ad-top-2", "widget_area"])
def test_built_names_decide(name):
    page = f"<div><h1>The title of this page</h1><p>{PROSE}</p><div class={name}><p>I liked this very much, thank you.</p></div><p>An end that closes the text with some more words than were left out.</p></div>"
    assert H.main_text(page, H.Weights()) == f"The title of this page\n\n{PROSE}\n\nAn end that closes the text with some more words than were left out."


def test_references_are_decoded_in_each_run():
    assert H.main_text("<p>AT&<b>amp;</b> x</p>", H.Weights()) == "AT&amp; x" and H.main_text("<p>a &lt<i>;</i></p>", H.Weights()) == "a <;"


def test_long_adverts_dont_cut_an_article():
    advert = f"<div class=ad><p>{PROSE}</p></div>"
    for a, b in (("<article>", "</article>"), ("<div>", "</div>")):
        page = f"<body><nav><a>x</a></nav>{a}<p>{'one two three ' * 20}</p>{advert}<p>{'four five six ' * 20}</p>{b}</body>"
        assert H.main_text(page, H.Weights()) == ("one two three " * 20).strip() + "\n\n" + ("four five six " * 20).strip()


def test_only_the_article_where_there_is_one():
    page = f"<body><div><p>{PROSE}</p></div><article><p>Short one.</p><ul><li><a href=/x>x</a></li></ul></article><p>{PROSE}</p></body>"
    assert H.main_text(page, H.Weights()) == "Short one.\n\nx"


def test_best_stretch_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        lo, hi = H.best_stretch(s)
        every = [sum(s[i:j]) for i in range(len(s) + 1) for j in range(i, len(s) + 1)]
        assert sum(s[lo:hi]) == max(every) and (hi > lo or max(every) == 0)


def test_nesting_costs_linear_time():
    import time

    began = time.perf_counter()
    n = 30_000
    H.main_text("<div><b>" * n + "x" + "</i>" * n, H.Weights())
    H.main_text("<p>" + "<b>" * n + "<div></div>" * n, H.Weights())
    H.Counts().add("<article>" + "".join(f"<div class=a{k}>w " for k in range(n)))
    H.main_text("<option>x" * n + "<p>text", H.Weights())
    H.main_text("<p it's \"q>x" * n, H.Weights())
    assert time.perf_counter() - began < 20


def test_weights_are_learned(spark):
    rows = [(i, None, f"<body><div class=zork>{'boiler plate words here ' * 3}</div><article><p>{'prose of the page ' * 20}</p></article></body>", 0, "") for i in range(50)]
    df = spark.createDataFrame(rows, PAGE)
    assert H.fit(df).odds(".zork") < -1
    unmarked = f"<body><div class=zork>{'boiler plate words here ' * 3}</div><div><p>{'prose of the page ' * 20}</p></div></body>"
    assert H.main_text(unmarked, H.fit(df)) == ("prose of the page " * 20).strip()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1, "a"), (None, "u", "<p>x</p>", None, None), (2, "u", FULL, 1, "b"), (2, "u", FULL, 1, "b")], PAGE)
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [(0, "u", "x", 1), (1, None, "", 0), (2, "u", WANT, len(WANT)), (2, "u", WANT, len(WANT))]
    assert H.extract(spark.createDataFrame([], PAGE)).count() == 0


@pytest.mark.parametrize("around", ["<body class='has-sidebar comments-open'><div id=page class='site with-sidebar'>{}</div></body>", "<body><div class=widget>{}</div></body>", "<body class=sidebar>{}</body>"])
def test_states_and_wrappers(around):
    """What a page has or allows says nothing of an element that holds everything; an article counts wherever it is."""
    inside = f"<article id=post-1 class='post status-publish comments-open hentry'><h1>The title of it</h1><p>{PROSE}</p></article>"
    page = around.format("<nav><a href=/>Home</a></nav>" + inside + "<div class=comments><p>So true, thank you all for it.</p></div>")
    assert H.main_text(page, H.Weights()) == f"The title of it\n\n{PROSE}"
    if "widget" not in around:
        plain = page.replace("<article", "<div").replace("</article", "</div")
        assert H.main_text(plain, H.Weights()) == f"The title of it\n\n{PROSE}"


def test_an_article_that_is_a_comment_is_no_label():
    page = f"<body><div><h1>The title of it</h1><p>{PROSE}</p></div><article class=comment><p>So true, thank you all for it.</p></article></body>"
    assert H.main_text(page, H.Weights()) == f"The title of it\n\n{PROSE}"
