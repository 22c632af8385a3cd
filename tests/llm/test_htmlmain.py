import html as H
import random

from slotforge.llm import htmlmain
from slotforge.llm.queries import op7_html_main_text

SENTENCE = "The quick brown fox of the northern woods jumped over a very lazy dog while nobody was looking."
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8)) + "</ul></nav>"


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_among_boilerplate():
    body = (
        f"<header><h1>Site</h1></header>{NAV}<div class='cookie-notice'>We use cookies. {SENTENCE}</div><div class=ad>{SENTENCE}</div>"
        f"<article><h1>Head &amp; line</h1><p>{SENTENCE}</p><p>Short.</p><p>A <b>bo</b>ld\n  word<br>next {SENTENCE}</p><form><input><button>Send</button></form>"
        f"<section id='comments'><p>{SENTENCE}</p></section></article><aside>{SENTENCE}</aside><div class='sidebar'>{SENTENCE}</div><footer>&copy; me</footer>"
    )
    assert htmlmain.main_text(page(body)) == f"Head & line {SENTENCE} Short. A bold word next {SENTENCE}"


def test_without_article_element():
    body = NAV + "<div class='menu'>x</div>" + "<div>" + "".join(f"<p>{SENTENCE}</p>" for _ in range(6)) + "</div><div>" + "".join(f"<a href=x>link {i}</a><br>" for i in range(12)) + "</div><footer>f</footer>"
    assert htmlmain.main_text(page(body)) == " ".join([SENTENCE] * 6)


def test_malformed_and_small():
    assert htmlmain.main_text("") == ""
    assert htmlmain.main_text("just text &amp;amp; more") == "just text &amp; more"
    assert htmlmain.main_text("<article><h1>T</h1><p><b>One<br><p>Two &am") == "T One Two &am"
    assert htmlmain.main_text("<p>a<p>b</i></b></p></div>c") == "a b c"
    assert htmlmain.main_text("<div>" * 20_000 + "x" + "</span>" * 20_000) == "x"
    for cut in ("</artic", "<p", "<b cl", "<!-- note <p>y</p>", "<!"):
        assert htmlmain.main_text("<article><p>abc" + cut) == "abc"
    assert htmlmain.main_text("<article>1 < 2 <") == "1 < 2 <"
    assert htmlmain.main_text(page("<article>" + "<p>w</p>" * 3 + "</article>")) == "w w w"
    assert htmlmain.main_text("<article>a&nbsp;b\x0bc \x85 d</article>") == "a\xa0b c \x85 d"


def test_every_planted_article_is_whole():
    rng = random.Random(3)
    for _ in range(60):
        blocks = [" ".join(rng.choice(["amp & co", "<b>", "word", "x", SENTENCE]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        body = NAV + f"<div class=ad>{SENTENCE}</div><article>" + "".join(f"<p>{H.escape(b)}</p>" for b in blocks) + "</article><footer>&copy; x</footer>"
        assert htmlmain.main_text(page(body)) == " ".join(blocks)


def test_query_and_odd_rows(spark, sf):
    import re

    rows = {r["page_id"]: r for r in op7_html_main_text(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        text = rows[p["page_id"]]["text"]
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", p["html"], re.S).group(1)
        inner = re.sub(r"<[^<>]*>", " ", re.sub(r"</?b>", "", inner))
        assert text == " ".join(H.unescape(inner).split()) and rows[p["page_id"]]["n_chars"] == len(text)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (1, None, "", "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r["id"]), r["text"], r["n_chars"]) for r in htmlmain.extract(odd).collect()) == [("1", "", 0), ("1", "", 0), ("None", "x", 1)]
    assert htmlmain.extract(odd.limit(0)).count() == 0


PROBES = [
    "<div class='container with-sidebar'><article><h1>Head</h1><p>{s}</p></article></div>",
    "<div id=page class='no-sidebar'><article><h1>Head</h1><p>{s}</p></article></div>",
    "<div class='post comments-open'><h1>Head</h1><p>{s}</p></div>",
    "<article><div class='article-header'><h1>Head</h1></div><p>{s}</p></article>",
    "<article><header><h1>Head</h1></header><p>{s}</p></article>",
    "<div class='sidebar'><article><h1>Head</h1><p>{s}</p></article></div>",
    "<h1>Head</h1><div><p>{s}</p></div>",
    "<h1>Head</h1><p>{s}</p>",
    "<p class=ad>Buy it now, it is cheap and good and here.<article><h1>Head</h1><p>{s}</p></article>",
    "<ul class=menu><li>One<li>Two</ul><h1>Head</h1><p>{s}",
]


def test_wrappers_keep_their_text():
    for probe in PROBES:
        for paragraphs in (1, 5):
            body = probe.format(s="</p><p>".join([SENTENCE] * paragraphs))
            assert htmlmain.main_text(page(NAV + body + "<footer>f</footer>")) == " ".join(["Head"] + [SENTENCE] * paragraphs), probe


def test_names():
    for name in ("ad", "cookie-notice", "siteHeader", "comment-list", "left_sidebar", "x related-posts"):
        assert htmlmain.named_beside(name), name
    for name in ("no-sidebar", "with-sidebar", "comments-open", "has-menu", "article-header", "container", "advice", "content"):
        assert not htmlmain.named_beside(name), name


def test_comment_marks_that_are_no_comments():
    head = "<title>a <!-- b</title><script>if (x <!--y) {}</script><style>/* <!-- */</style>"
    assert htmlmain.main_text(page(f"<article title='<!-- t'><p>{SENTENCE}</p></article>", head)) == SENTENCE
    assert htmlmain.main_text(f"<head><title>T</title><p>{SENTENCE}</p>") == SENTENCE  # the head ends where the body must have begun
    assert htmlmain.main_text(f"<table><tr><td class=ad>{SENTENCE}<td>{SENTENCE}</table>") == SENTENCE


BARE = (
    "<div>" + "".join(f"<a href=/{i}>Go to {i}</a><br>" for i in range(12)) + "</div><div><div>Log in</div><div>Cart</div><div>EUR</div><div>Help</div>" + "".join(f"<div>Topic {i}</div>" for i in range(40)) + "</div>"
    "<div><h1>Head</h1>" + f"<p>{SENTENCE} {SENTENCE}</p><p>{SENTENCE}</p>" * 4 + "<p>End.</p></div><div><div>Jobs</div><div>Terms</div><div>Press</div><div>Map</div><div>Mail</div></div>"
)


def test_density_alone_finds_the_article(monkeypatch):
    """No element or class tells anything here: the clusters of smoothed densities pick the part, and others pick another."""
    want = " ".join(["Head"] + [f"{SENTENCE} {SENTENCE} {SENTENCE}"] * 4 + ["End."])
    assert htmlmain.main_text(page(BARE)) == want
    smooth = htmlmain.smoothed
    monkeypatch.setattr(htmlmain, "smoothed", lambda v: smooth(0 * v))
    assert "Cart" in htmlmain.main_text(page(BARE))
    monkeypatch.setattr(htmlmain, "smoothed", lambda v: smooth(-v))
    assert htmlmain.main_text(page(BARE)) != want and "Cart" in htmlmain.main_text(page(BARE))


def test_pages_without_article_elements(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same = sum(htmlmain.main_text(p["html"]) == htmlmain.main_text(p["html"].replace("<article", "<div").replace("</article", "</div")) for p in rows)
    assert same >= 0.99 * len(rows)
