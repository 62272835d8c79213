"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides every block that is not page furniture by its length, its
link density and its density of stop words: long blocks that are rich in stop words are text, blocks that are mostly links
and long blocks with hardly a stop word are not; short blocks, and those in between, stay open. In pass two an open block
takes the label of its nearest decided neighbours: of the nearer one, if they differ.

Tags and names say only what the page says of itself: what is a menu, header, footer, sidebar, notice, advert, form or
reader comment is furniture, whatever its words, and is skipped; and where a page marks its article (an article or main
element), a block's neighbours are looked for in there, a block in there is not dropped for want of stop words (lists,
tables and headings are text too; it stays open), and the article's edges count as decided text. Blocks outside
of a marked article are not its text. Where a page marks none, furniture counts as decided neighbours.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
one newline. Markup that is cut off at the end of a page is left out. Nulls: a null html is empty and gives an empty text.
Repeated rows are extracted each. An empty table gives an empty result. Other columns are ignored. Time is linear in the
page: every character is passed once, however tags nest and whatever is left open. Memory: one Arrow batch of pages. No
shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvar.llm.common import sliced

SCHEMA = "page_id long, url string, text string, n_chars long, n_decided long, n_inherited long"

#: A tag to its end; a quoted value may hold `>`, a stray quote is a character. Possessive: it never goes back.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in "script style noscript template textarea svg iframe object select title".split()}
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?+""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CHROME_TAGS = frozenset("head nav footer aside form button menu dialog fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Names of menus, headers, footers, sidebars, notices and forms. They hold outside of a marked article: within one, a `header` is its title.
CHROME_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination header masthead footer sidebar cookie cookies consent notice notices banner popup modal login signup subscribe newsletter".split())
#: Names of adverts and reader comments; they hold everywhere.
FIRM_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments reply replies disqus".split())
CONTENT = frozenset(("article", "main"))  # as tags and as roles
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Tags that end an open element of the same kind.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}

#: The most frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with he be at by this from or not have an they but his which you we "
    "der die das und ist nicht von mit ein eine auf für im zu den des sich dem in es auch als an "
    "le la les de et un une des que est dans pour qui sur pas avec au du il elle en "
    "el los las que y del se por con para una no es al lo como su más".split()
)
WORD = re.compile(r"[^\W\d_]+")
MIN_WORDS, STOP_LOW, STOP_HIGH, LINKS_MAX = 10, 0.08, 0.2, 0.5
GOOD, BAD, OPEN, FURNITURE = 1, 0, -1, 2


class Block:
    __slots__ = ("parts", "linked", "chars", "inside", "out")

    def __init__(self, inside: bool, out: bool):
        self.parts, self.linked, self.chars, self.inside, self.out = [], 0, 0, inside, out

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def place(tag: str, attrs: str, inside: bool, out: bool) -> tuple[bool, bool]:
    """(within marked content, furniture) of what an element holds, given the same of its parent."""
    if tag in CHROME_TAGS or (tag == "header" and not inside):
        return inside, True
    role, words, hidden = "", [], False
    for m in ATTRIBUTE.finditer(attrs) if attrs.strip() else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            words += re.split(r"[^a-z0-9]+", value)
        elif name == "role":
            role = value
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            hidden = True
    content = tag in CONTENT or role in CONTENT
    if hidden or role in CHROME_ROLES or tag not in ("html", "body") and FIRM_WORDS.intersection(words):
        return inside, True
    if not inside and not content and tag not in ("html", "body") and CHROME_WORDS.intersection(words):
        return inside, True
    return inside or content, out


def blocks(page: str) -> list[Block]:
    """Blocks in page order, with what holds them."""
    out: list[Block] = []
    # open block-level elements: tag, within content, furniture, furniture by name alone (an article in there lifts it)
    stack: list[tuple[str, bool, bool, bool]] = []
    open_: Counter[str] = Counter()
    now = Block(False, False)
    links = 0

    def flush() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(*stack[-1][1:3]) if stack else Block(False, False)

    def text(s: str) -> None:
        if s:
            s = entities.unescape(s) if "&" in s else s
            now.parts.append(s)
            n = len(s.strip())
            now.chars += n
            now.linked += n if links else 0

    def push(tag: str, attrs: str) -> None:
        _, inside, furniture, named = stack[-1] if stack else ("", False, False, False)
        content, held = place(tag, attrs, inside, furniture)
        if not furniture:
            # furniture by its names, not by its tag: it may be a wrapper of the whole page
            named = held and not inside and tag not in CHROME_TAGS and tag != "header"
        elif named and content and not inside:
            named, held = False, place(tag, attrs, inside, False)[1]
        stack.append((tag, content, held, named))
        open_[tag] += 1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        at = lt
        follow = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if follow in ("!", "?") or follow == "/" and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        if not (follow == "/" or follow.isascii() and follow.isalpha()):
            text("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            break  # markup that is cut off at the end
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = RAW[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            continue  # an inline element is text of its block, whatever its names
        if closing:
            if open_[tag]:
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == tag:
                        break
            flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                now.parts.append(" ")
            continue
        if stack and tag in SELF_CLOSING and SELF_CLOSING.get(stack[-1][0]) == SELF_CLOSING[tag]:
            open_[stack.pop()[0]] -= 1
        if not m[3].rstrip().endswith("/") or tag in ("p", "div"):
            push(tag, m[3])
        links = 0
        flush()
    flush()
    return out


def first_pass(block: Block, text: str, marked: bool) -> int:
    """By length, link density and stop-word density; `marked`: the page marks its article."""
    if block.out:
        return FURNITURE
    words = text.split()
    links = block.linked / max(block.chars, 1)
    stops = sum(w in STOP_WORDS for w in WORD.findall(text.lower())) / max(len(words), 1)
    within = marked and block.inside
    if marked and not block.inside:
        return BAD
    if links > LINKS_MAX:
        # a linked heading or sentence of an article is its text, a list of links in one block is a menu
        return BAD if not within or len(words) >= MIN_WORDS and stops < STOP_LOW else OPEN
    if len(words) < MIN_WORDS:
        return OPEN
    if stops >= STOP_HIGH:
        return GOOD
    return OPEN if within or stops >= STOP_LOW else BAD


def second_pass(labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbours; with none on either side they are out."""
    n = len(labels)
    left, right = [None] * n, [None] * n
    for order, side in ((range(n), left), (range(n - 1, -1, -1), right)):
        last = None
        for k in order:
            if labels[k] != OPEN:
                last = k
            side[k] = last
    out = list(labels)
    for k, x in enumerate(labels):
        if x == OPEN:
            a, b = left[k], right[k]
            near = {labels[j] for j in (a, b) if j is not None}
            if len(near) < 2:
                out[k] = near.pop() if near else BAD
            else:
                out[k] = labels[a] if k - a <= b - k else labels[b]
    return out


def judged(page: str | None) -> tuple[list[str], list[int], list[int]]:
    """(texts of all blocks, labels of pass one, labels of pass two)."""
    found = [(b, t) for b in blocks(page or "") if (t := b.text())]
    marked = any(b.inside and not b.out for b, _ in found)
    first = [first_pass(b, t, marked) for b, t in found]
    second = list(first)
    if marked:  # neighbours within the article, whose edges count as decided text
        part = [k for k, (b, _) in enumerate(found) if b.inside and not b.out]
        for k, x in zip(part, second_pass([GOOD, *(first[k] for k in part), GOOD])[1:]):
            second[k] = x
    else:
        second = second_pass([BAD if x == FURNITURE else x for x in first])
    return [t for _, t in found], first, second


def main_text(page: str | None) -> str:
    texts, _, labels = judged(page)
    return "\n".join(t for t, x in zip(texts, labels) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; n_decided: blocks that pass one decided by their densities, n_inherited: those left to pass two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, decided, inherited = [], [], []
            for x in batch.column(2):
                blocks_, first, second = judged(x.as_py())
                texts.append("\n".join(t for t, label in zip(blocks_, second) if label == GOOD))
                decided.append(sum(label in (GOOD, BAD) for label in first))
                inherited.append(sum(label == OPEN for label in first))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(decided, pa.int64()), pa.array(inherited, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_decided", "n_inherited"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
