"""Page text: what belongs to an article stays, what doesn't goes by the ratio where no name tells it, on the test pages and on made-up ones."""

import html
import random
import re

import pytest

from chronoweave.llm import html_text as H
from chronoweave.llm import registry
from tests.llm.conftest import prose

LONG = ["A long paragraph of the article, with many words, some of them <b>bold</b>, that goes on for a while and then some more.", "Another long paragraph that tells the rest of the story in as many words as the first one did, or even a few more of them.", "The third long paragraph ends what the article has to say about it, not without a word on everything that came before it."]
TEXT = [re.sub("<.*?>", "", x) for x in LONG]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


def blocks(page):
    return H.extract(page).split("\n\n")


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div id=x>", "</div>"), ("", "")])
def test_what_belongs_to_the_text_stays(open_, close):
    own = '<div class="related-work"><p>Related work.</p></div>' + '<p class="social-history">Social history.</p>' if open_ != "" else ""
    page = f"<html><body class='has-menu'><nav><a>Home</a></nav>{open_}<h1>Title</h1>{BODY}{own}<p>Short.</p>{close}<footer>us</footer></body></html>"
    assert blocks(page) == ["Title", *TEXT, *(["Related work.", "Social history."] if own else []), "Short."]


def test_an_article_keeps_its_header_and_a_last_line_in_a_box_of_its_own():
    page = f"<body><header><h2>Site</h2></header><article><header><h1>Title</h1></header>{BODY}<div><p>End.</p></div></article></body>"
    assert blocks(page) == ["Title", *TEXT, "End."]


def test_adverts_comments_and_menus_go():
    within = '<div class="ad">Buy.</div><div class="ad-box"><p>Buy more.</p></div><aside>Side.</aside><section id="comments"><p>' + "A reader's long comment with as many words as a paragraph of the article, or more. " * 2 + "</p></section><form><p>Name</p></form><script>x()</script><p hidden>Not shown.</p>"
    page = f"<body><div class='cookie-notice'>We store.</div><article>{BODY}{within}</article><div role='navigation'>More</div><ul class='site-menu'><li>One</li></ul></body>"
    assert blocks(page) == TEXT


def test_noise_without_telling_names_goes_by_the_ratio():
    """No element or class says what is what: a wrapper of a menu, an advert, the text and a line of contact."""
    menu = "<div><ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6)) + "</ul></div>"
    page = f"<html><body><p>Buy now!</p>{menu}<div><div><h1>Title</h1>{BODY}<p>Short.</p></div></div><div><a href='/c'>contact</a> us</div></body></html>"
    assert blocks(page) == ["Title", *TEXT, "Short."]
    flat = f"<html><body>{menu}<h1>Title</h1>{BODY}<p>Short.</p><div>contact us</div></body></html>"
    assert blocks(flat) == ["Title", *TEXT, "Short."]
    one_box = f"<html><body><div>{menu}<h1>Title</h1>{BODY}<div><p>Last.</p></div></div></body></html>"
    assert blocks(one_box) == ["Title", *TEXT, "Last."]


def test_ties_one_line_and_long_pages():
    assert H.extract("<p>one</p>") == "one" and H.extract("<p>a</p><p>b</p>") == "a\n\nb" and H.extract(None) == H.extract("<nav>x</nav>") == ""
    rng = random.Random(1)
    words = [prose(rng, 40) for _ in range(3000)]
    page = "<body><nav>" + "<a>x</a>" * 2000 + "</nav><article>" + "".join(f"<p>{w}</p>" for w in words) + "</article></body>"
    assert H.extract(page) == "\n\n".join(words)
    assert H.extract("<div>" * 5000 + prose(rng, 5) + "<p>" * 5000).count(" ") == 4
    assert H.extract("<p>a &lt;b&gt; &amp;\n\n c&nbsp;d<br>e") == "a <b> & c d e"


def article(page):
    """The text of the one <article> of a test page, by regular expressions."""
    a = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    a = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", re.sub(r"<br\s*/?>", " ", a))
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h\d|div|ul|li|article)\b[^>]*>", a))
    return "\n\n".join(p for p in parts if p)


def test_the_query_gives_the_articles_and_the_ratio_finds_them_without_their_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in registry.QUERIES["op8_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (t := article(p), len(t)) for i, p in pages.items()}
    unnamed = [(p, re.sub("article>", "div>", p)) for p in pages.values()]
    assert all(H.extract(q) == article(p) for p, q in unnamed)
    bare = [(p, re.sub(r"(</?)(nav|footer)>", r"\1div>", q).replace('class="ad"', "")) for p, q in unnamed]
    assert sum(H.extract(q) == article(p) for p, q in bare) >= 0.95 * len(bare)
