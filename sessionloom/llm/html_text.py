"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides what it can from a block alone: its link density, its length, and its stop-word density
against that of the whole page; blocks in containers that never hold the article (navigation, footers, forms, adverts, comments and the like) are
bad. Class and id names are bad as a whole only; a bad word within another name counts with links beside it, and names of headings and of
what holds the article don't count. Pass 2 gives ambiguous blocks (short ones, and those that pass 1 can't tell) the label of the nearest decided
neighbours. Containers say nothing about their neighbours, so only blocks decided by their text pass labels on.

An article or main element is one feature among these: a poor block inside it is ambiguous rather than bad, its ambiguous blocks look for
neighbours inside it, and beside such an element that has good text, blocks outside have no good neighbours to inherit from.

Stop words are listed for four languages. A block of another script, or on a page whose text as a whole has few listed words, has no list that
applies: there, length and link density decide. A page on which the text of no block decides anything, short pages that is, keeps its ambiguous unlinked blocks.

Null or empty html, and pages without a good block: empty text. Broken markup: unclosed comments, tags and scripts run to the end of the page; unclosed
elements end with their parents. Repeated rows are extracted each. Pages of any length are whole; the scan is linear. Empty table: empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

#: Frequent function words.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could did do for from had has have he her his if in into is it its more no not of on one or our she so some than that the their them there they this to up us was we were what when which who will with would you your",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nos notre nous on ou où par pas pour que qui sa se ses son sont sur un une vous être",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist kann man mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wie wir wird zu zum zur",
    "es": "a al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también un una uno y ya",
}
#: Elements that never hold the article.
BAD_TAGS = frozenset("nav footer aside form menu button select dialog fieldset label datalist".split())
MAIN_TAGS = frozenset(["article", "main"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class and id names that mark such parts.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription popup modal overlay widget login signup signin register copyright legal pagination pager tags search form".split()
)
#: Words that say nothing beside those.
PLAIN_WORDS = frozenset("site page main post entry wrap wrapper container box list bar block area inner links buttons item items".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template xmp svg math object canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "html head body article main section nav footer header aside form menu dialog fieldset legend address blockquote center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol ul p pre summary table caption colgroup col tbody thead tfoot tr td th select option optgroup button".split()
)
#: Elements that a following one of the same name ends.
_SIBLINGS = frozenset("li dt dd tr td th option p".split())
_ENDS_P = BLOCK_TAGS - frozenset(["html", "head", "body", "button"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

SHORT, LONG = 70, 200
#: Below this density over all its text, a page is in no listed language.
LOW_STOP = 0.15
#: A block is poor if it has fewer stop words than its length at the page's density lets expect, by so many standard deviations; and rich
#: with this share of the page's density.
POOR, RICH = 3.0, 0.8
MAX_LINK, SOME_LINK = 0.5, 0.25

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LATIN = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
_WORD_EDGES = re.compile(r"^\W+|\W+$")
_STOP_SETS = [frozenset(words.split()) for words in STOP_WORDS.values()]
_ANY_STOP = frozenset().union(*_STOP_SETS)

GOOD, BAD, NEAR, BRIEF = "good", "bad", "near", "short"


class Name:
    """A bad word in the class or id of an element. whole: the name says nothing else. around: an article or main stands inside."""

    __slots__ = ("whole", "around")

    def __init__(self, whole: bool) -> None:
        self.whole, self.around = whole, False


class Block:
    __slots__ = ("text", "link", "bad", "main", "heading", "label", "names")

    def __init__(self, text: str, link: int, bad: bool, main: int, heading: bool, names: tuple[Name, ...] = ()) -> None:
        self.text, self.link, self.bad, self.main, self.heading, self.label, self.names = text, link, bad, main, heading, "", names


def _marked_bad(tag: str, attributes: str, in_main: bool) -> bool | Name:
    """True for what the element itself says, a Name for what its class and id suggest."""
    if tag in BAD_TAGS or tag == "header" and not in_main:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    some = whole = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role" and value.strip().lower() in BAD_ROLES:
            return True
        if name in ("class", "id") and tag not in HEADINGS:
            for part in value.split():
                words = {w.lower() for w in _NAME_WORDS.findall(part)}
                found = words & BAD_WORDS if in_main else {w for w in words if w in BAD_WORDS or w == "header"}
                some = some or bool(found)
                whole = whole or bool(found) and words - found <= PLAIN_WORDS
    return Name(whole) if some else False


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page, in order, with the flags of their containers."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool | Name, bool]] = []  # tag, bad, main
    names: list[Name] = []
    bad = mains = main_id = links = link_chars = breaks = 0
    heading, pattern, at, n = False, _TAG, 0, len(html)

    def flush() -> None:
        nonlocal parts, link_chars, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(link_chars, len(text)), bad > 0, main_id if mains else 0, heading, tuple(names)))
        parts, link_chars, breaks = [], 0, 0

    def pop() -> None:
        nonlocal bad, mains
        _, was_bad, was_main = stack.pop()
        if isinstance(was_bad, Name):
            names.pop()
        else:
            bad -= was_bad
        mains -= was_main

    def data(raw: str) -> None:
        nonlocal link_chars, breaks
        if raw:
            text = unescape(raw)
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if links:
                    link_chars += len(" ".join(text.split()))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            data(html[at:])
            break
        follows = html[lt + 1 : lt + 2]
        if not (follows.isascii() and (follows.isalpha() or follows in ("/", "!", "?"))) or not follows:
            data(html[at : lt + 1])
            at = lt + 1
            continue
        data(html[at:lt])
        if follows in ("!", "?"):
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            at = n if end < 0 else end + (3 if html.startswith("<!--", lt) else 1)
            continue
        m = pattern.match(html, lt)
        if m is None and pattern is _TAG and html.find(">", lt) >= 0:
            pattern = _LOOSE_TAG  # a quote is never closed: from here on, tags end at the first >
            m = pattern.match(html, lt)
        if m is None:
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        if tag == "br":
            breaks += 1
            if breaks >= 2:
                flush()
            else:
                parts.append(" ")
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
                heading = heading and tag not in HEADINGS
            if tag == "a":
                links = 0
            if any(s[0] == tag for s in reversed(stack)):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW_TAGS:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK_TAGS:
            flush()
            links = 0
            if stack and (stack[-1][0] == "p" and tag in _ENDS_P or stack[-1][0] == tag and tag in _SIBLINGS):
                pop()
            heading = tag in HEADINGS
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if tag == "a":
            links = 1
            continue
        if tag not in BLOCK_TAGS and "class" not in attributes and "id" not in attributes and "role" not in attributes and "hidden" not in attributes and "style" not in attributes and tag not in BAD_TAGS:
            continue  # a plain inline element carries no flag
        own_bad, own_main = _marked_bad(tag, attributes, mains > 0), tag in MAIN_TAGS or 'role="main"' in attributes
        if isinstance(own_bad, Name) and not own_bad.whole and tag not in BLOCK_TAGS:
            own_bad = False  # part of a paragraph: only a whole name cuts it
        if own_bad or own_main:
            if tag not in BLOCK_TAGS:
                flush()  # an advert inside a paragraph is a block of its own
            main_id += own_main
        if own_main:
            for name in names:
                name.around = True
        stack.append((tag, own_bad, own_main))
        if isinstance(own_bad, Name):
            names.append(own_bad)
        else:
            bad += own_bad
        mains += own_main
    flush()
    _weigh_names(out)
    return out


def _weigh_names(blocks: list[Block]) -> None:
    """Marks the blocks that names make bad. A name around an article or main counts only where the page has another one that isn't
    named so, as beside comments that are articles of their own."""
    named = [b for b in blocks if b.names and not b.bad]
    if not named:
        return
    other = any(b.main and not b.bad and len(b.text) >= SHORT and not any(n.whole for n in b.names) for b in blocks)
    for b in named:
        if any(n.whole and (other or not n.around) for n in b.names):
            b.bad = True
        elif b.link > SOME_LINK * len(b.text) and not b.heading:
            b.bad = any(not n.whole and not n.around for n in b.names)


def stop_words(text: str) -> tuple[int, int]:
    """Words of a text, and how many of them the list of one language holds, the one that holds most."""
    words = [_WORD_EDGES.sub("", w) for w in text.lower().split()]
    hits = [w for w in words if w in _ANY_STOP]
    return len(words), max(sum(w in s for w in hits) for s in _STOP_SETS) if hits else 0


def other_script(text: str) -> bool:
    """Whether most letters are not Latin, the script of every list."""
    letters = sum(map(str.isalpha, text))
    return letters > 0 and 2 * len(_LATIN.findall(text)) < letters


def page_density(blocks: list[Block]) -> float:
    """The share of stop words in the page's unlinked text of Latin script, blocks of SHORT characters or more; below LOW_STOP no list fits the page."""
    counts = [stop_words(b.text) for b in blocks if not b.bad and len(b.text) >= SHORT and b.link <= MAX_LINK * len(b.text) and not other_script(b.text)]
    return sum(h for _, h in counts) / max(1, sum(n for n, _ in counts))


def first_pass(block: Block, density: float) -> str:
    """A label from the block alone, on a page of that density of stop words."""
    if block.bad:
        return BAD
    link, size = block.link / len(block.text), len(block.text)
    if link > MAX_LINK:
        return BRIEF if block.main or block.heading else BAD
    if size < SHORT:
        return BAD if not block.main and (link > SOME_LINK or "©" in block.text) else BRIEF
    if density < LOW_STOP or other_script(block.text):
        return GOOD if link <= SOME_LINK else NEAR
    words, hits = stop_words(block.text)
    expected = density * words
    if expected - hits > POOR * (expected * (1 - density)) ** 0.5:
        return NEAR if block.main else BAD
    return GOOD if link <= SOME_LINK and (size >= LONG or hits >= RICH * expected) else NEAR


def second_pass(blocks: list[Block]) -> None:
    """Labels for ambiguous blocks from the nearest neighbours that their text decided: the nearer one, and of two at one distance the good one inside
    an article or for a block of some substance, else the bad one."""
    n = len(blocks)
    before: list[int] = [-1] * n
    after: list[int] = [n] * n
    for places, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            places[i] = last.get(blocks[i].main, places[i])
            if blocks[i].label in (GOOD, BAD) and not blocks[i].bad:
                last[blocks[i].main] = i
    decided = [b.label for b in blocks]
    somewhere = GOOD in decided
    for i, b in enumerate(blocks):
        if b.label in (GOOD, BAD):
            continue
        left, right = before[i], after[i]
        sides = {decided[k] for k in (left, right) if 0 <= k < n}
        linked = b.link > MAX_LINK * len(b.text)
        if b.main:
            b.label = GOOD if GOOD in sides or not sides and not linked else BAD
        elif not sides:
            b.label = BAD if linked or somewhere else GOOD
        elif len(sides) == 1:
            b.label = sides.pop()
        elif i - left != right - i:
            b.label = decided[left if i - left < right - i else right]
        else:
            b.label = GOOD if decided[i] == NEAR or b.heading and decided[right] == GOOD else BAD


def main_text(html: str | None) -> str:
    """Good blocks of a page, a line each."""
    blocks = blocks_of(html or "")
    density = page_density(blocks)
    for b in blocks:
        b.label = first_pass(b, density)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages(page_id, url, html). No exchange."""
    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), _extract, "page_id long, url string, text string, n_chars long")


def op10_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
