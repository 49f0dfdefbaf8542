"""Articles that odd markup must not lose, and blocks against a second parser."""

from html import unescape
from html.parser import HTMLParser

import pytest

from quirelake.llm import html_extract as H

ARTICLE = "It was the best of times and it was the worst of times, and all of us were there for the whole of the winter. " * 2
OTHER = "The house of the family is on the hill by the sea, and they will stay in it for as long as they want to be there. " * 2
FRAME = '<nav><a href="/">Home</a><a href="/x">More</a></nav>'


def text(html):
    return H.main_text(html)[0]


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="page no-js">{FRAME}<div class="layout has-sidebar"><p>{ARTICLE}</p></div></body>',
        f'{FRAME}<div class="content no-sidebar"><p>{ARTICLE}</p></div>',
        f'{FRAME}<p title="the hidden truth">{ARTICLE}</p>',
        f'{FRAME}<section data-id="related work" data-role="navigation"><p>{ARTICLE}</p></section>',
        f"{FRAME}<svg width=3><circle><path><p>{ARTICLE}</p>",
        f"{FRAME}<svg>{'<g>' * 40}<div><p>{ARTICLE}</p></div><svg></svg>",
        f'{FRAME}<div class="social history"><p>{ARTICLE}</p></div>',
        f'{FRAME}<div id="menu-of-the-day"><article><p>{ARTICLE}</p></article></div>',
        *(f"{FRAME}<div><form><select>{'<option>x' * n}</select></form><p>{ARTICLE}</p></div>" for n in (1, 11, 12, 13, 500)),
        f"{FRAME}<div><p>{ARTICLE}<select><option>a</p></div>",
        f"<html><head><title>T</title><meta charset=x>{FRAME}<div><p>{ARTICLE}</p></div>",
        f"{FRAME}<p><span hidden>gone</span>{ARTICLE}</p>",
        f"{FRAME}<p style='color:red;display:block'>{ARTICLE}</p>",
        f"{FRAME}<object><p>{ARTICLE}</p>",
        f"{FRAME}<p>{'<b><i>' * 200}{ARTICLE}</b></p>",
    ],
)
def test_the_article_stays(page):
    assert H.unescape(ARTICLE).strip() in " ".join(text(page).split())
    assert "Home" not in text(page) and "gone" not in text(page)


def test_heads_of_articles_stay():
    page = f'{FRAME}<article><div class="entry-header"><h1>The headline</h1></div><p>{ARTICLE}</p><div class="entry-share">Share</div></article><div class="post-header"><h2>Next one</h2></div><p>{OTHER}</p>'
    assert text(page).split("\n\n")[0] == "The headline" and "Next one" in text(page)


@pytest.mark.parametrize(
    "away",
    [
        f'<div class="sidebar"><p>{OTHER}</p></div>', f'<div id="site-footer"><p>{OTHER}</p></div>', f'<div class="comment-list"><article><p>{OTHER}</p></article></div>', f'<div class="x cookie_banner"><p>{OTHER}</p></div>', f'<div role="complementary"><p>{OTHER}</p></div>',
        f"<div hidden><p>{OTHER}</p></div>", f'<div aria-hidden="true"><p>{OTHER}</p></div>', f'<p style="margin:0; display : none">{OTHER}</p>', f'<div class="pop-up"><p>{OTHER}</p></div>', f"<footer><p>{OTHER}</p></footer>", f"<template><p>{OTHER}</p></template>", f'<div class="related"><article><p>{OTHER}</p></article></div>',
    ],
)
def test_what_is_not_the_article_goes(away):
    for page in (f"{FRAME}<div><p>{ARTICLE}</p></div>{away}", f"{away}<main><p>{ARTICLE}</p></main>"):
        assert " ".join(text(page).split()) == ARTICLE.strip()


def test_comments_alone_are_no_article():
    assert text(f'{FRAME}<div class="comments"><p>{OTHER}</p></div>') == ""


def test_end_tags_of_inline_elements_do_not_close_blocks():
    assert H.blocks("<div><b>one<p>two</b></p>three</div>four") == [("one", 0, 0), ("two", 0, 0), ("three", 0, 0), ("four", 0, 0)]
    assert H.blocks("<a href=x>link<p>still</p></a><a>new<a>est</a> plain") == [("link", 4, 0), ("still", 5, 0), ("newest plain", 6, 0)]
    deep = f"{'<div>' * 30_000}<p>in</p>{'<span>' * 30_000}x{'</div>' * 30_000}out"
    assert [b[0] for b in H.blocks(deep)] == ["in", "x", "out"]


class Reader(HTMLParser):
    """Texts between block-level tags by the standard library's parser, for pages whose elements are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.texts, self.parts, self.skip, self.open = [], [], 0, []

    def flush(self):
        said = " ".join(unescape("".join(self.parts)).split())
        self.texts += [said] if said else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK:
            self.flush()
        if tag == "br" and not self.skip:
            self.parts.append(" ")
        if tag not in H.VOID:
            names = dict(attrs)
            away = tag in H.SKIP or tag in H.RAW or "hidden" in names or names.get("aria-hidden") == "true" or bool(H.INVISIBLE.search(names.get("style") or ""))
            self.open.append((tag, away))
            self.skip += away

    def handle_startendtag(self, tag, attrs):
        if tag in H.VOID:
            self.handle_starttag(tag, attrs)
        elif tag in H.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in H.BLOCK:
            self.flush()
        if any(t == tag for t, _ in self.open):
            while True:
                last, away = self.open.pop()
                self.skip -= away
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_blocks_equal_those_of_a_second_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    same = 0
    for html in pages:
        reader = Reader()
        reader.feed(html)
        reader.close()
        reader.flush()
        same += reader.texts == [b[0] for b in H.blocks(html)]
        kept = text(html).split("\n\n") if text(html) else []
        assert set(kept) <= {b[0] for b in H.blocks(html)}
    assert same == len(pages)
