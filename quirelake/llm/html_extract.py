"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass 1 decides blocks by link density, stop-word density and length:
much linked text is boilerplate, long text with many stop words is main text. Some things are prose and still not the
article (readers' comments, notices, adverts, side bars): those are told by the elements around them and count as
boilerplate whatever their density. Elements are told by their tag, role, and whole class and id tokens; a wrapper that
only its name makes part of the frame is none if no prose stands outside of it. An article or main element decides nothing by itself; inside it the density and
length that make a block main text are lower. All other blocks, most of them short, stay open. Pass 2 gives an open
block the label of the nearest decided blocks of its own section (the article, or what is outside): if both sides agree
theirs, else the nearer one's (at equal distance it is main text). Where a section has no decided block, an article's open blocks are main text and others
look beyond the section.

Nulls and edge cases: a null or empty page has an empty text; page_id and url may be null; equal rows give equal
results; other columns are ignored; a page without markup is one block; a `<` that starts no tag, or a tag that never
ends, is text. Pages are read whole, each on its own (no shuffle), in time linear in their length; unclosed and stray
tags are tolerated at any depth: an end tag closes its own element unless a block-level element stands between (and
that, too, where it is block-level itself); a drawing, head or list of choices left open ends where the page goes on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of the languages in the corpus.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more my no not of on one or our she so "
    "that the their there they this to was we were what when which who will with would you your "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur "
    "al como con de del el ella en entre era es esta este fue ha la las le lo los más mi muy no o para pero por que se si sin sobre su sus también un una y ya "
    "au aux avec ce ces cette dans de des du elle est et eu il ils je la le les leur lui mais me ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous".split()
)
#: Elements by what they do to the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template svg math iframe object canvas head title select textarea audio video map".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu button dialog fieldset".split())
CONTENT = frozenset("article main".split())
ENDS_P = BLOCK - {"html", "body", "head", "option", "optgroup"}
#: Skipped elements that end, if left open, where a block-level element other than these begins.
LEFT_OPEN = {"head": frozenset(), "svg": frozenset({"title", "desc"}), "math": frozenset(), "select": frozenset({"option", "optgroup", "hr"})}
#: Words in class and id that tell what an element is for: what others wrote or what interrupts, and the frame
#: of the page. A token counts by its parts between hyphens and underscores.
OTHERS = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|reply|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|hidden", re.IGNORECASE)
FRAME = re.compile(
    r"banner|sidebar|nav|navbar|navigation|navlist|menu\w*|breadcrumbs?|footer|foot|header|masthead|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|search", re.IGNORECASE
)
#: Pairs of parts that count as one word; first parts that say what a page has or has not; those of an article's
#: own parts, with what they may be followed by; values of role.
JOINED = {("pop", "up"): "popup", ("side", "bar"): "sidebar", ("sign", "up"): "signup", ("log", "in"): "login"}
STATES = frozenset("has have no not with without is in".split())
OWN, OWN_PARTS = frozenset("entry post article story content section".split()), frozenset("header head banner nav share social".split())
ROLES = {"navigation": "frame", "banner": "frame", "complementary": "frame", "contentinfo": "frame", "search": "frame", "menu": "frame", "menubar": "frame", "dialog": "others", "alertdialog": "others", "alert": "others"}
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
WORD = re.compile(r"[^\W\d_]+")

#: Blocks with fewer characters than SHORT stay open unless links decide; from LONG on fewer stop words are enough.
SHORT = 70
LONG = 200
LINKED = 0.33
#: Stop-word densities that make a block main text: outside an article (any length, long), and inside one.
STOP_HIGH, STOP_LOW, STOP_ARTICLE = 0.32, 0.30, 0.10

GOOD, BAD, OPEN = 1, -1, 0
#: What the elements around a block say: it is no part of the article (AWAY), is so by the name of a wrapper alone (NAMED),
#: is inside one (WITHIN) or in one of such a wrapper (NAMED_WITHIN), or nothing.
AWAY, NAMED, NAMED_WITHIN, WITHIN, PLAIN = -1, -2, -3, 1, 0
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long, n_density long, n_links long, n_place long, n_inherited long"


class Finder:
    """str.find that remembers which needles have no further occurrence, so repeated searches stay linear."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()

    def __call__(self, needle: str, at: int) -> int:
        if needle in self.gone:
            return -1
        if (found := self.text.find(needle, at)) < 0:
            self.gone.add(needle)
        return found


def tag_end(html: str, at: int, find: Finder) -> int:
    """Place of the > that ends a tag whose name ends at `at`, -1 if none does; > inside quotes does not count."""
    while True:
        at = UNQUOTED.match(html, at).end()
        if at == len(html):
            return -1
        if html[at] == ">":
            return at
        close = find(html[at], at + 1)
        if close < 0:  # a quote that is never closed is no quote
            return find(">", at)
        at = close + 1


def markup(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of each tag in order; comments and declarations have an empty tag."""
    find, at, raw = Finder(html), 0, {}
    while (start := find("<", at)) >= 0:
        if find(">", start) < 0:  # no tag ends from here on; a comment may begin
            if (start := find("<!--", start)) >= 0:
                yield start, len(html), False, "", ""
            return
        m = TAG.match(html, start)
        if m:
            end = tag_end(html, m.end(), find)
            if end < 0:
                at = start + 1
                continue
            tag, at = m[2].lower(), end + 1
            yield start, at, bool(m[1]), tag, html[m.end() : end]
            if tag in RAW and not m[1]:  # its text is no markup: go to its own end tag
                close = None if raw.get(tag) else re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                raw[tag] = close is None
                stop = close.start() if close else len(html)
                yield at, stop, False, "", ""
                at = stop
        elif html.startswith("<!--", start):
            end = find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            yield start, at, False, "", ""
        elif html.startswith(("<!", "<?", "</"), start) and (end := find(">", start)) >= 0:
            at = end + 1
            yield start, at, False, "", ""
        else:
            at = start + 1


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def purpose(token: str) -> str:
    """What a class or id token says of its element: others, frame, or nothing."""
    parts = [x for x in re.split(r"[-_]+", token) if x]
    if parts and parts[0].lower() in STATES:
        return ""
    words = list(parts)
    for one, two in zip(parts, parts[1:], strict=False):
        if joined := JOINED.get((one.lower(), two.lower())):
            words.append(joined)
    if len(parts) > 1 and parts[0].lower() in OWN:  # the head of an article is the article's
        words = [x for x in words if x.lower() not in OWN_PARTS]
    if any(OTHERS.fullmatch(x) for x in words):
        return "others"
    return "frame" if any(FRAME.fullmatch(x) for x in words) else ""


def blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, characters in links, place) of each block in page order; place: what its ancestors say."""
    found: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []  # open elements and the place they give
    opened: dict[str, list[int]] = {}  # their places in the stack by tag
    scopes: list[int] = []  # places of block-level and skipped elements: ends of inline elements do not reach beyond
    parts: list[str] = []
    linked, at, skipping = 0, 0, 0
    closes: dict[str, int] = {}  # the next end tag of each skipped element, -1 if there is none

    def depth(tag: str) -> int:
        return len(opened.get(tag, ()))

    def place() -> int:
        return stack[-1][1] if stack else PLAIN

    def push(tag: str, now: int, skipped: bool = False) -> None:
        nonlocal skipping
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK or tag in SKIP:
            scopes.append(len(stack))
        stack.append((tag, now))
        if skipped and not skipping:
            skipping = len(stack)

    def pop() -> str:
        nonlocal skipping
        if len(stack) == skipping:
            skipping = 0
        tag, _ = stack.pop()
        opened[tag].pop()
        if scopes and scopes[-1] == len(stack):
            scopes.pop()
        return tag

    def ends(tag: str, start: int) -> bool:
        """Whether an end tag of a skipped element follows."""
        known = closes.get(tag, 0)
        if known >= 0 and known < start:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, start)
            known = closes[tag] = m.start() if m else -1
        return known >= 0

    def end_block() -> None:
        nonlocal linked
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            found.append((text, linked, place()))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not skipping:
            parts.append(text)
            if depth("a"):
                linked += len(text.strip())

    for start, end, closing, tag, text in markup(html):
        say(html[at:start])
        at = end
        if not tag or tag in RAW:
            continue
        if not closing:
            if tag == "br":
                say(" ")
            if tag in BLOCK:
                # a head, drawing or list of choices that is left open ends where the page goes on
                while skipping and stack[skipping - 1][0] in LEFT_OPEN and tag not in LEFT_OPEN[stack[skipping - 1][0]]:
                    while len(stack) > skipping:
                        pop()
                    pop()
                end_block()
                if tag in ENDS_P and scopes and stack[scopes[-1]][0] == "p":  # an open paragraph ends here
                    while pop() != "p":
                        pass
            if tag in VOID or text.rstrip().endswith("/") and tag not in BLOCK:
                continue
            if tag == "a" and depth("a") and (not scopes or opened["a"][-1] > scopes[-1]):
                while pop() != "a":  # links don't nest
                    pass
            now = place()
            attributes = attributes_of(text) if text else {}
            if tag in SKIP:
                if tag == "head" or ends(tag, end):
                    push(tag, AWAY, True)
                continue
            if attributes and ("hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or INVISIBLE.search(attributes.get("style", ""))):
                push(tag, AWAY, tag not in ("html", "body"))
                continue
            if tag in BOILERPLATE:
                now = AWAY
            elif attributes and now != AWAY and tag not in ("body", "html", *CONTENT):
                says = {purpose(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()} | {ROLES.get(x.lower(), "") for x in attributes.get("role", "").split()}
                now = AWAY if "others" in says or "frame" in says and now == WITHIN else NAMED if "frame" in says else now
            if tag == "header" and not any(depth(t) for t in CONTENT):
                now = AWAY
            elif tag in CONTENT and now != AWAY:
                # readers' comments are often articles of their own inside a comment list, which is AWAY already
                now = WITHIN if tag == "main" or now in (PLAIN, WITHIN) else NAMED_WITHIN
            push(tag, now)
        else:
            if tag in BLOCK:
                end_block()
            if depth(tag) and (tag in BLOCK or tag in SKIP or not scopes or opened[tag][-1] > scopes[-1]):
                while pop() != tag:
                    pass
    say(html[at:])
    end_block()
    return released(found)


def released(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Blocks with NAMED and NAMED_WITHIN settled: such a wrapper is the frame of the page if there is prose outside, else
    it holds the article."""
    outside = any(place == WITHIN or place == PLAIN and first_pass(text, linked, place)[0] == GOOD for text, linked, place in found)
    return [(text, linked, AWAY if outside and place in (NAMED, NAMED_WITHIN) else {NAMED: PLAIN, NAMED_WITHIN: WITHIN}.get(place, place)) for text, linked, place in found]


def first_pass(text: str, linked: int, place: int) -> tuple[int, str]:
    """Label of a block and what gave it: links, place, density, or nothing if it stays open."""
    if linked > LINKED * len(text) and not (place == WITHIN and len(text) >= SHORT):
        words = WORD.findall(text.lower())
        # a sentence that is one link is still a sentence of an article
        if place != WITHIN or linked > 0.8 * len(text) and sum(w in STOP_WORDS for w in words) < STOP_LOW * len(words):
            return BAD, "links"
    if place == AWAY:
        return BAD, "place"
    if len(text) < SHORT:
        return (BAD, "links") if linked and place != WITHIN else (OPEN, "")
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    enough = STOP_ARTICLE if place == WITHIN else STOP_LOW if len(text) > LONG else STOP_HIGH
    return (GOOD, "density") if density >= enough else (OPEN, "")


def nearest(labels: list[int], among: list[int]) -> list[tuple[int, int]]:
    """For each block (label, distance) of the nearest decided one of `among` before it."""
    out, label, since = [], OPEN, 0
    here = set(among)
    for i, x in enumerate(labels):
        since += 1
        out.append((label, since))
        if x and i in here:
            label, since = x, 0
    return out


def decide(found: list[tuple[str, int, int]]) -> list[tuple[bool, str]]:
    """Whether each block is main text, and what decided: density, links, place or inherited."""
    first = [first_pass(*x) for x in found]
    labels = [x[0] for x in first]
    if not any(labels):  # nothing is decided: the page has only text of one kind
        inside = any(place == WITHIN for _, _, place in found)
        return [(not inside or place == WITHIN, "inherited") for _, _, place in found]
    inherited = {}
    for section in (WITHIN, PLAIN):
        own = [i for i, (_, _, place) in enumerate(found) if place == section]
        if all(labels[i] for i in own):
            continue
        among = own if any(labels[i] for i in own) else range(len(found))
        if section == WITHIN and among is not own:  # an article of which nothing is decided
            inherited |= dict.fromkeys(own, GOOD)
            continue
        before, after = nearest(labels, among), nearest(labels[::-1], [len(found) - 1 - i for i in among])[::-1]
        for i in own:
            if not labels[i]:
                (left, l_far), (right, r_far) = before[i], after[i]
                inherited[i] = left if left == right or not right else right if not left else GOOD if l_far == r_far else left if l_far < r_far else right
    return [(inherited[i] == GOOD, "inherited") if i in inherited else (label == GOOD, why) for i, (label, why) in enumerate(first)]


def main_text(html: str | None) -> tuple[str, int, int, int, int, int, int]:
    """The text, and the numbers of blocks, of kept ones, and of those that density, links, place and pass 2 decided."""
    found = blocks(html or "")
    decided = decide(found)
    kept = [text for (text, _, _), (keep, _) in zip(found, decided, strict=True) if keep]
    by = Counter(why for _, why in decided)
    return "\n\n".join(kept), len(found), len(kept), by["density"], by["links"], by["place"], by["inherited"]


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks, n_kept, and what decided how many blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_text(cell.as_py()) for cell in batch.column(2)]
            text, *numbers = zip(*rows, strict=True) if rows else [()] * 7
            counts = [pa.array(n, pa.int64()) for n in (tuple(map(len, text)), *numbers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), *counts], [x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
