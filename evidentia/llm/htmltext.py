"""Main-text extraction from flat text blocks.

A page becomes a flat list of blocks. Each block has its word count and link density, those of its neighbours, whether it stands in an
article and in page furniture, and how much of the page these hold; a decision tree grown on the labelled blocks of the small pages below
keeps or drops it. Names and elements of furniture are features like the others: none of them drops a block by itself.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from evidentia.llm.common import map_chunks

EXTRACTED = "page_id long, url string, text string, n_chars long"

# HTML elements by what they do to blocks.
UNREAD = frozenset("script style noscript template title textarea iframe".split())
DRAWN = frozenset("svg object canvas video audio".split())
BLOCKS = frozenset("address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body button datalist details dialog div dl fieldset figure footer form header hgroup main menu nav ol section select table ul".split())
FURNITURE = frozenset("nav footer aside form button datalist dialog menu fieldset select label legend head option".split())
NAMES_OF_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal newsletter subscribe subscription sidebar related recommended recommendations"
    " share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer masthead login signin signup pagination pager complementary contentinfo search toolbar widget".split()
)
NAMES_OF_COMMENTS = frozenset("comment comments commentlist replies reply respond disqus".split())
#: Furniture that may also be the frame of a whole page.
FRAMES = frozenset("form fieldset header banner masthead search login signin signup widget modal popup notice alert promo footer".split())
#: Parts of a name that say what an element has or lacks, not what it is.
ABOUT = frozenset("has have with without no not is show hide".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_CLOSING = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in UNREAD | DRAWN}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def named(attrs: str, whole: bool) -> str:
    """What class, id and role say: "comments", "furniture" or nothing. With ``whole`` only a name, or its last part, counts, else its first part too."""
    if "=" not in attrs and "hidden" not in attrs:
        return ""
    if _HIDDEN.search(attrs):
        return "furniture"
    for found in _NAMES.findall(attrs):
        for name in "".join(found).split():
            parts = [p for p in re.split(r"[-_]+", _CAMEL.sub("-", name).lower()) if p]
            if parts and parts[0] not in ABOUT:
                told = {parts[-1]} if whole else {parts[0], parts[-1]}
                if told & NAMES_OF_COMMENTS:
                    return "comments"
                if told & NAMES_OF_FURNITURE:
                    return "furniture"
    return ""


def _words_of(attrs: str) -> set[str]:
    return {p for found in _NAMES.findall(attrs) for p in re.split(r"[-_\s]+", _CAMEL.sub("-", "".join(found)).lower())}


@dataclass
class Place:
    """An open container, with what it is within."""

    tag: str
    mark: int = -1  # the innermost furniture since the innermost article, as a number
    outer: int = -1  # furniture around the innermost article
    article: int = -1
    comments: bool = False


@dataclass
class Block:
    """A run of text between block-level marks."""

    text: str
    words: int
    link_words: int
    mark: int
    outer: int
    article: int

    @property
    def links(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def blocks_of(page: str | None) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page that have text, in page order, decoded, white space folded; and of each numbered element its words, and 1 if it may frame a page.

    Markup that is cut off or unclosed ends with the page. Drawn elements end at their own end tag, or where there is none at once.
    """
    page = page or ""
    out: list[Block] = []
    stack = [Place("")]
    sizes = [0]  # of the page, then of marked elements and articles
    frames = [0]
    owners: list[list[int]] = [[0]]  # by place: the numbered elements around it
    pieces: list[str] = []
    links: list[str] = []
    own = anchor = False  # the block element itself is marked; inside a link
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal own
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                words, place = len(text.split()), stack[-1]
                around = owners[-1]
                mark = place.mark
                if own:
                    sizes.append(0)
                    frames.append(0)
                    mark = len(sizes) - 1
                    around = [*around, mark]
                for k in around:
                    sizes[k] += words
                out.append(Block(text, words, min(words, len("".join(links).split())), mark, place.outer, place.article))
            pieces.clear()
            links.clear()
        own = False

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchor:
                links.append(text)

    def enter(tag: str, attrs: str) -> None:
        last = stack[-1]
        told = named(attrs, False) if tag != "body" else ""
        comments = last.comments or told == "comments"
        place, around = Place(tag, last.mark, last.outer, last.article, comments), owners[-1]
        if tag in ("article", "main") and not told and not comments:
            if last.mark >= 0:
                place.outer = last.mark
            place.mark = -1
            sizes.append(0)
            frames.append(0)
            place.article = len(sizes) - 1
            around = [*around, place.article]
        elif told or tag in FURNITURE or tag == "header" and last.article < 0:
            sizes.append(0)
            frames.append(tag in FRAMES or tag in ("div", "section") and told == "furniture" and not FRAMES.isdisjoint(_words_of(attrs)))
            place.mark = len(sizes) - 1
            around = [*around, place.mark]
        stack.append(place)
        owners.append(around)

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag in UNREAD or tag in DRAWN:
            if not m["end"]:
                add(" ")
                ends = None
                if tag not in unclosed and not (tag in DRAWN and m["attrs"].endswith("/")) and not (ends := _CLOSING[tag].search(page, at)):
                    unclosed.add(tag)
                if ends:
                    at = ends.end()
                elif tag in UNREAD:
                    at = len(page)
        elif tag == "a":
            anchor = not m["end"]
            add(" ") if not anchor else None
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            flush()
            if tag not in CONTAINERS:
                own = not m["end"] and (tag in FURNITURE or bool(named(m["attrs"], True)))
            elif m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:], owners[k:]
                        break
                anchor = False
            else:
                enter(tag, m["attrs"])
    add(page[at:])
    flush()
    return out, np.array([sizes, frames], float)


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "article_share", "in_furniture", "furniture_share", "furniture_around_article", "in_frame", "bare_share")


def features(blocks: list[Block], elements: np.ndarray) -> np.ndarray:
    """A row a block, in the order of FEATURES; neighbours beyond the ends have 0. Shares are of the words of all articles, or of the page for furniture.

    ``bare_share`` is how much of the page's unlinked words stands neither in furniture nor in an article.
    """
    sizes, frames = elements
    plain = np.array([[0, 0], *[[b.words, b.links] for b in blocks], [0, 0]], float)
    share = sizes / max(1, sizes[0])
    articles = max(1, sum(b.words for b in blocks if b.article >= 0))
    unlinked = [b.words - b.link_words for b in blocks]
    bare = sum(n for n, b in zip(unlinked, blocks, strict=True) if b.article < 0 and b.mark < 0) / max(1, sum(unlinked))
    marks = [[b.article >= 0, sizes[b.article] / articles if b.article >= 0 else 0, b.mark >= 0, share[b.mark] if b.mark >= 0 else 0, b.outer >= 0, b.mark >= 0 and frames[b.mark], bare] for b in blocks]
    return np.hstack([plain[1:-1], plain[:-2], plain[2:], np.array(marks, float).reshape(-1, 7)])


# The labelled table, as small pages. {n} stands for n words; a block that starts with + is main text, one with - is not.
LABELLED = (
    "<nav><ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{1}</a></ul></nav><div class=ad>-{9}</div><article><h1>+{8}</h1><p>+{80}</p><p>+{3}</p><p>+{40}</p></article><footer>-{8}</footer>",
    "<header>-{3}<p>-{12}</p></header><main><h1>+{5}</h1><p>+{60}</p><p>+{1}</p><p>+{20} <a>{8}</a></p></main><aside><h2>-{2}</h2><p>-{30}</p></aside><footer><p>-{25}</p></footer>",
    "<article><header><h1>+{6}</h1><p>+{4}</p></header><p>+{120}</p><aside><p>-{25}</p></aside><p>+{90}</p><form>-{3}<p>-{9}</p></form><p>+{2}</p></article><div class=comments><p>-{40}</p><p>-{60}</p></div>",
    "<article><p>+{50}</p><div class=newsletter><p>-{12}</p></div><p>+{30}</p><p>+<a>{9}</a></p><p>+{45}</p><div class=share><a>-{1}</a></div></article>",
    "<article><p>+{70}</p><ul><li>+{6}</li><li>+{2}</li><li>+{11}</li></ul><blockquote>+{15}</blockquote><table><tr><td>+{1}<td>+{2}</table></article>",
    "<article><p>+{33}</p><p>+<a>{5}</a></p><p>+{70}</p><p>+<a>{14}</a></p></article><section id=comments><article><p>-{50}</p></article><article><p>-{70}</p></article></section>",
    "<article><p>+{40}</p><ul><li><a>-{3}</a><li><a>-{4}</a><li><a>-{2}</a><li><a>-{5}</a></ul></article><nav><a>-{2}</a></nav>",
    "<article><h1>+{7}</h1><p>+{200}</p><ul><li><a>-{1}</a></ul></article>", "<article><h1>+{2}</h1><p>+{1}</p></article>", "<article><p>+{4}</p></article><footer>-{9}</footer>",
    "<form id=f><nav><a>-{1}</a><p><a>-{2}</a></nav><article><h1>+{6}</h1><p>+{90}</p><p>+{5}</p></article><footer>-{7}</footer></form>",
    "<nav><ul><li><a>-{1}</a><li><a>-{1}</a></ul><article><h1>+{5}</h1><p>+{60}</p><p>+{9}</p></article>",
    "<aside><p>-{6}</p><article><h1>+{3}</h1><p>+{150}</p><p>+{12}</p></article>", "<div class=banner><article><p>+{44}</p><p>+{2}</p></article></div>",
    "<article><p>+{160}</p><p>+{30}</p></article><aside class=related><article><h3>-{6}</h3><p>-{14}</p></article><article><h3>-{5}</h3><p>-{18}</p></article></aside>",
    "<article><h2>+{4}</h2><p>+{60}</p></article><article><h2>+{5}</h2><p>+{50}</p></article><article><p>+{45}</p></article><footer>-{6}</footer>",
    "<div><h1>+{5}</h1><p>+{60}</p><p>+{30} <a>{2}</a></p><p>+{14}</p><p>+{6}</p><p>+{80}</p></div><div class=footer>-{10}</div>",
    "<div><p><a>-{1}</a></p><p><a>-{2}</a></p><p><a>-{1}</a></p></div><div><h2>+{4}</h2><p>+{90}</p><p>+{1}</p><p>+{40}</p></div><p><a>-{3}</a></p><p>-{3}</p>",
    "<div>-{2}</div><div><a>-{1}</a></div><div><p>+{120}</p></div><div><a>-{4}</a></div><div>-{3}</div><div><a>-{2}</a></div>", "<p>+{16}</p>", "<p>+{14}</p><p>+{12}</p><p>+{20}</p>", "<footer><p>-{9}</p><p>-{30}</p></footer>", "<div class=ad>-{9}</div><article><h1>+{3}</h1><p>+{3}</p></article><footer>-{40}</footer>",
    "<div>-{1}</div><div>-{1}</div><div>+{50}</div><div>+{1}</div><div>+{60}</div>", "<div>-{1}</div><div>-{2}</div><div>-{1}</div><div>+{30}</div>", "<nav><a>-{1}</a><p>-{40}</p></nav><div class=menu>-{6}</div>",
    "<article><h1>+{3}</h1><p>+<a>{20}</a></p><p>+{40}</p></article>", "<article><p>+{40}</p><p>+<a>{11}</a></p></article>", "<article><h1>+<a>{6}</a></h1><p>+{2}</p><p>+{60}</p></article>", "<article><p>+{4}</p><p>+<a>{6}</a></p><p>+{6}</p></article>",
    "<div><ul><li><a>-{2}</a><li><a>-{12}</a><li><a>-{8}</a></ul></div><div><p>+{55}</p><p>+{70}</p></div><p><a>-{9}</a></p><p><a>-{10}</a></p>", "<article><p>+{66}</p><p><a>-{9}</a></p><p><a>-{11}</a></p><p><a>-{7}</a></p><p><a>-{12}</a></p></article>",
    "<div class=page-footer><h1>+{6}</h1><p>+{70}</p><p>+{30}</p><p>+{22}</p></div><nav><a>-{2}</a></nav>", "<form><h1>+{5}</h1><p>+{80}</p><p>+{50}</p></form><footer>-{12}</footer>",
    "<div class=cookie-notice><p>-{15}</p></div><div class=sidebar><p>-{30}</p><ul><li>-{4}<li>-{3}</ul></div><div><h1>+{6}</h1><p>+{75}</p><p>+{42}</p></div>",
    "<article><p>+{50}</p><p class=notice>-{9}</p><p>+{25}</p><figure><figcaption>+{7}</figcaption></figure><button>-{1}</button></article>", "<p>-{2}</p><p><a>-{1}</a></p><p>-{3}</p><p><a>-{2}</a></p>",
    "<form id=f><div><h1>+{5}</h1><p>+{60}</p><p>+{60}</p></div></form>", "<form><div><h1>+{6}</h1><p>+{50}</p><p>+{70}</p></div></form><footer>-{30}</footer>", "<form id=f><div><h1>+{5}</h1><p>+{60}</p><p>+{60}</p></div></form><div>-{1}</div>",
    "<div class=search-results><p>+{80}</p></div>", "<div class=search-results><h2>+{3}</h2><p>+{25}</p><p>+{30}</p></div><footer>-{9}</footer>", "<div class=login-layout><div class=content><p>+{60}</p></div></div>",
    "<div class=login-layout><div class=content><h1>+{4}</h1><p>+{35}</p><p>+{8}</p></div></div><nav><a>-{2}</a><a>-{3}</a></nav>", "<form><nav><a>-{1}</a><a>-{2}</a></nav><h1>+{5}</h1><p>+{45}</p><p>+{6}</p><footer>-{12}</footer></form>",
    "<div class=masthead><p>+{70}</p><p>+{9}</p></div><aside>-{20}</aside>", "<form><p>-{4}</p><p>-{6}</p></form><div><p>+{60}</p><p>+{40}</p></div>", "<div class=login-box><p>-{9}</p></div><div><h1>+{4}</h1><p>+{40}</p><p>+{30}</p></div>",
    "<div class=search><p>-{5}</p></div><div><p>+{25}</p><p>+{33}</p></div><div class=banner>-{12}</div>", "<header><div>-{3}</div><p>-{8}</p></header><div><p>+{44}</p></div>", "<form><div>-{2}</div><div>-{3}</div><div>-{2}</div></form>",
    "<article><p>+{30}</p></article><form><p>-{40}</p><p>-{35}</p></form>", "<article><p>+{50}</p></article><div class=login-layout><p>-{60}</p></div>", "<nav><p>-{60}</p><p>-{50}</p></nav><p>+{20}</p>",
    "<div class=login-layout><div class=content><p>+{60}</p></div></div><footer>-{20}</footer>", "<form><p>+{40}</p><p>+{20}</p></form><footer>-{20}</footer>", "<div class=widget><p>+{50}</p></div><nav><a>-{2}</a><a>-{3}</a></nav><footer>-{14}</footer>",
)


def labelled() -> np.ndarray:
    """The feature rows of all labelled blocks, the label last."""
    rows = []
    for page in LABELLED:
        blocks, sizes = blocks_of(re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * int(m[1])), page))
        rows.append(np.hstack([features(blocks, sizes), np.array([[b.text[0] == "+"] for b in blocks], float)]))
    return np.vstack(rows)


def grow(rows: np.ndarray, depth: int = 8) -> tuple | float:
    """A CART tree by Gini impurity: (feature, threshold, left, right) or the share of kept rows; ties go to the first feature and lowest threshold."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = (impurity(y) - 1e-9, None)
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= t
            cost = impurity(y[left]) + impurity(y[~left])
            if cost < best[0] - 1e-9:
                best = (cost, (f, float(t)))
    if best[1] is None:
        return float(y.mean())
    f, t = best[1]
    left = rows[:, f] <= t
    return f, t, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)


def share(tree: tuple | float, row: np.ndarray) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree: tuple | float) -> str:
    """The kept blocks of a page, joined by one space; empty for a null or empty page."""
    blocks, sizes = blocks_of(page)
    return " ".join(b.text for b, x in zip(blocks, features(blocks, sizes), strict=True) if share(tree, x) >= 0.5) if blocks else ""


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page; a null or empty page has the empty text, an empty table gives no rows.

    Pages of any length are read whole. Repeated rows repeat; columns other than page_id, url and html are not read.
    """

    def make():
        tree = grow(labelled())

        def step(rows: dict) -> dict:
            text = [main_text(p, tree) for p in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": list(map(len, text))}

        return step

    return map_chunks(pages.select("page_id", "url", "html"), make, EXTRACTED)
