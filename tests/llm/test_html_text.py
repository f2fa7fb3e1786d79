"""Main text of planted pages, of the given pages, and of broken ones."""

import html
import math
import random
import re
import time

import pytest

from scriptsift.llm.html_text import blocks, extract_pages, main_text, measure, parse


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_pages(pages).collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.sub(r"<[^>]+>", " ", re.sub(r"</?(?:p|h1)>", "\0", body)).split("\0")
        want = "\n\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if t)
        assert r["text"] == want and r["n_chars"] == len(want)


ARTICLE = "<h1>A &amp; B</h1><p>First  paragraph\nwith <b>bold</b> and <a href='/x'>a link</a>.</p><p>Tiny.</p><p>Second one &eacute;.</p>"
TEXT = "A & B\n\nFirst paragraph with bold and a link.\n\nTiny.\n\nSecond one é."
NOISE = (
    "<header><h1>Site</h1><p>Slogan of this site, quite long, in the page head.</p></header><nav><ul><li><a href=/>Home</a></ul></nav>",
    "<aside class=x><p>Something beside the text that is long enough to count.</p></aside>",
    "<div class='cookie-notice'>We use cookies and tell you so at length, again and again.</div>",
    "<form><label>Mail</label><input><p>Subscribe to all of our letters today and tomorrow.</p></form>",
    "<section id=comments><div class=comment><p>What a nice text, I like all of it very much!</p></div></section>",
    "<script>if (a < b) document.write('</p>')</script><style>p > a {}</style><!-- <p>no</p> -->",
    "<footer><p>Imprint and more, a long line at the foot of the page.</p></footer>",
)


@pytest.mark.parametrize("tag", ["article", "main", "div", "div id=content"])
def test_noise_goes_and_text_stays(tag):
    name = tag.split()[0]
    for before in range(len(NOISE) + 1):
        page = f"<html><body>{''.join(NOISE[:before])}<{tag}>{ARTICLE}</{name}>{''.join(NOISE[before:])}</body></html>"
        assert main_text(page) == TEXT


def test_sections_of_one_article_stay_together():
    page = f"<body><nav><a href=/>x</a></nav><article><h1>T</h1><section>{ARTICLE}</section><section><p>More.</p><p>And more.</p></section></article>"
    assert main_text(page) == f"T\n\n{TEXT}\n\nMore.\n\nAnd more."


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("name", [
    "section id=side-effects", "section id='related-work'", "p id=share-prices", "figure aria-label='side view'",
    "div class=search-results-explained", "div class='text side-effects'", "div id=social", "section aria-label=Comments",
    "p id=formNotes"])
def test_names_with_a_marking_word_are_text_inside_an_article(tag, name):
    page = f"<body><{tag}>{ARTICLE}<{name}>Ten words of text about the side effects of it.</{name.split()[0]}></{tag}></body>"
    assert main_text(page) == TEXT + "\n\nTen words of text about the side effects of it."


@pytest.mark.parametrize("name", ["div class=ad", "div class='box Related'", "div role=search", "nav id=x", "aside", "form", "div hidden"])
def test_whole_marks_go_inside_an_article(name):
    page = f"<body><article>{ARTICLE}<{name}><p>Something beside the text that is long enough to count.</p></{name.split()[0]}></article></body>"
    assert main_text(page) == TEXT


def test_open_tags_and_comments_inside():
    assert main_text("<article><p><b>One<br><p>Two<ul><li>a<li>b</ul><!-- x --><p>Three") == "One\n\nTwo\n\na\n\nb\n\nThree"
    assert main_text("<p>a<br>b</p>") == "a b"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "</p>", "<script>", "<body></body>", "<img>", "<a href='"])
def test_pages_without_text(page):
    assert main_text(page) in ("", "<")


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert len(main_text("<article>" + "<p>some words here</p>" * 20000)) == 20000 * 17 - 2
    assert main_text("plain text without tags") == "plain text without tags"


@pytest.mark.parametrize("part", [
    "<div class='side-effects'>{}</div>", "<h2 id='share-prices'>{}</h2>", "<p id='search-results'>{}</p>", "<div class='search-results'>{}</div>",
    "<p aria-label='side view'>{}</p>", "<section id=comments>{}</section>", "<p class='related-work'>{}</p>", "<p><math><mi>{}</mi></math></p>"])
def test_names_with_a_marking_word_are_text_in_plain_divs(part):
    words = "Five sentences about it. " * 5
    para = "<p>A paragraph of the text that is long enough to be kept by itself.</p>"
    text = main_text(f"<body><nav><a href=/>x</a></nav><div>{para}{part.format(words)}{para}</div></body>")
    assert text.split("\n\n") == ["A paragraph of the text that is long enough to be kept by itself.", words.strip(), "A paragraph of the text that is long enough to be kept by itself."]


@pytest.mark.parametrize("name", ["cookie-notice", "siteFooter footer", "share-sidebar", "Advert_Banner"])
def test_names_made_of_marking_words_go(name):
    assert main_text(f"<body><div>{ARTICLE}</div><div class='{name}'><p>Something that is no text but quite long, long, long.</p></div></body>") == TEXT


def test_formulas_stay():
    page = f"<article>{ARTICLE}<p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p><svg><text>no</text></svg></article>"
    assert main_text(page) == TEXT + "\n\nSo a=b holds."


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + "deep" + "</span>" * 100_000, "<div>" * 50_000 + "deep" + "</b>" * 100_000 + "</p>" * 100_000,
    "<b><div>" + "<span>" * 50_000 + "deep" + "</b>" * 100_000, "<span>" * 50_000 + "deep" + "<h1></h1>" * 50_000])
def test_parsing_is_linear(page):
    start = time.process_time()
    assert main_text(page) == "deep"
    assert time.process_time() - start < 6


def _brute(node, page_chars, page_links):
    """(characters, tags, link characters, link tags, density, sum of child densities) worked out anew for one node."""
    def text(n):
        return "".join(c if isinstance(c, str) else text(c) for c in n.children if isinstance(c, str) or not c.cut)

    def below(n):
        return [x for c in n.children if not isinstance(c, str) and not c.cut for x in (c, *below(c))]

    def size(t):
        return len(re.sub(r"\s", "", t))

    def links(n):
        return sum(size(text(c)) if c.tag == "a" else links(c) for c in n.children if not isinstance(c, str) and not c.cut)
    chars, tags = size(text(node)), len(below(node))
    lc, lt = links(node), sum(n.tag == "a" for n in below(node))
    if not chars:
        return chars, tags, lc, lt, 0.0
    base = math.log(chars / max(chars - lc, 1) * lc + page_links / page_chars * chars + math.e)
    density = chars / max(tags, 1) * math.log(max(chars / max(lc, 1) * max(tags, 1) / max(lt, 1), 1) + 1) / base
    return chars, tags, lc, lt, density


def test_densities_like_brute_force():
    rng = random.Random(3)

    def piece(depth):
        tag = rng.choice(["div", "p", "section", "span", "a", "ul", "b"])
        inner = "".join(rng.choice([piece(depth + 1) if depth < 5 else "x ", "some words of text ", " ", "link"]) for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"
    for _ in range(60):
        root = parse("<body>" + "".join(piece(0) for _ in range(6)) + "</body>")
        nodes = measure(root)
        page = _brute(root, 1, 0)
        best = 0.0
        for n in nodes:
            want = _brute(n, max(page[0], 1), page[2])
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == want[:4]
            assert n.density == pytest.approx(want[4])
            total = sum(_brute(c, max(page[0], 1), page[2])[4] for c in n.children if not isinstance(c, str) and not c.cut)
            if any(isinstance(c, str) and c.strip() for c in n.children) or not total:
                total = max(total, want[4])  # text of its own counts as a child
            assert n.total == pytest.approx(total)
            best = max(best, total)
        assert max(n.total for n in nodes) == pytest.approx(best)


def test_blocks():
    assert blocks(parse("<body><div><p>0123456789</p><p>0123456789</p></div><p><a>0123</a></p></body>")) == ["0123456789", "0123456789", "0123"]


def test_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, None), (2, "v", "", "y")],
        "page_id long, url string, html string, n_chars string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(pages).collect()]
    assert got == [(1, TEXT, len(TEXT))] * 2 + [(None, "", 0), (2, "", 0)]
    assert extract_pages(pages.filter("false")).collect() == []
