"""Main text of web pages by tag-path ratios.

Every block of text belongs to its path of tags from the root (with the class or id of each element,
so that equal tags of different parts stay apart). Text length and punctuation are summed per path;
long, punctuated text that fills few blocks marks content, many short blocks mark menus. The ratios are
smoothed over the page order, length and punctuation ratios are fused, the smoothed value is tempered by
the path's own, and paths that reach a part of the page's mean are selected.

The content root is the deepest element that holds most of the selected text; it grows to the article around
it, and to a parent with headings or selected paragraphs of its own. Below the root, named containers
and link lists without any selected path go. Tags and names that never are content (menus, headers, footers, asides,
forms, scripts, styles, adverts, notices, comments) are left out before; a name counts for
nothing where its element holds an article or main part and more text than all that has no such name.

Defined results: null, empty and text-free pages give an empty text; open and misnested tags are closed and
quotes in attributes read as browsers do (a quote without an end takes the rest of the page);
whole pages are read, nothing is cut off, and work is linear in the page however deep it nests;
repeated pages give equal texts; other columns pass through, a column named like the result is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import _text as t
from fieldloom.llm._tables import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; the first two hold no text of the page.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
SKIPPED = frozenset("script style noscript iframe noembed noframes template head title nav header footer aside form button select textarea menu dialog svg canvas object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that name parts beside the content.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|hidden|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|consent|gdpr|skip)(?:$|[\s_-])", re.I)
#: An open element of the first kind is closed by a start tag of the second.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: For each start tag, the open elements that it may close.
CLOSES = {tag: tuple(x for x, by in CLOSED_BY.items() if tag in by) for tag in frozenset().union(*CLOSED_BY.values())}
LISTS = frozenset("ul ol dl menu".split())
CONTAINERS = frozenset("div section".split())
#: Elements that hold a part of a text, never a whole one.
HOLDERS = HEADINGS | frozenset(CLOSED_BY) | LISTS | frozenset("table tbody thead tfoot caption pre blockquote figure figcaption details address".split())
OWN_TEXT = HEADINGS | frozenset(["p"])
LIST_SCOPE = frozenset(["ul", "ol", "menu", "table", "body", "html", "article", "div", "section", "main"])
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*>?|<[!?][^>]*>?|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"\s+")
MARKS = re.compile(r"[.,;:!?。，？！…]")


class Element:
    """An element; path numbers its path of tags and names, beside tells why it is no content: 0 it may be, 1 by its name, 2 by its tag."""

    __slots__ = ("beside", "block", "has_article", "here", "inside", "linked", "named", "parent", "path", "picked", "size", "tag")

    def __init__(self, tag: str, path: int, parent: Element | None, beside: int, named: bool):
        self.tag, self.path, self.parent, self.beside, self.named = tag, path, parent, beside, named
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.size, self.linked, self.picked, self.here, self.inside, self.has_article = 0, 0, 0.0, False, False, False


def _beside(tag: str, attributes: str) -> tuple[int, str]:
    """Whether an element never is content, and its names."""
    if not attributes or attributes.isspace():
        return 2 * (tag in SKIPPED), ""
    got = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    names = f"{got.get('class', '')} {got.get('id', '')} {got.get('role', '')}".strip()
    if tag in SKIPPED or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        return 2, names
    return int(bool(names and tag not in ("html", "body", "article", "main") and ASIDE.search(names))), names


def text_nodes(page: str, elements: list[Element]) -> Iterator[tuple[Element, str | None]]:
    """(element, decoded text) in page order; the text None marks a break between blocks. Elements are listed parents first."""
    paths: dict[tuple[int, str], int] = {}
    root = here = Element("", 0, None, 0, False)
    elements.append(root)
    opened: dict[str, int] = defaultdict(int)
    lower = None
    at, n = 0, len(page)

    def close(last: Element) -> None:
        nonlocal here
        while True:
            opened[here.tag] -= 1
            done = here is last
            here = here.parent
            if done:
                return

    while at < n:
        found = TOKEN.search(page, at)
        begin = found.start() if found else n
        if begin > at:
            yield here, html.unescape(page[at:begin])
        if not found:
            return
        at = found.end()
        name = found[2]
        if name is None or page[at - 1] != ">":
            continue
        tag = name.lower()
        if found[1]:
            if opened[tag] > 0:
                up = here
                while up.tag != tag:
                    up = up.parent
                if tag not in INLINE:
                    yield here, None
                close(up)
            elif tag in ("p", "br"):
                yield here, None
            continue
        if tag not in INLINE:
            yield here, None
        if tag in VOID:
            continue
        if any(opened[x] > 0 for x in CLOSES.get(tag, ())):
            up = here
            while up is not root:
                if tag in CLOSED_BY.get(up.tag, ()):
                    close(up)
                    break
                if up.tag in LIST_SCOPE or (up.tag not in INLINE and up.tag not in CLOSED_BY):
                    break
                up = up.parent
        beside, names = _beside(tag, found[3])
        path = paths.setdefault((here.path, f"{tag}.{names}" if names else tag), len(paths) + 1)
        child = Element(tag, path, here, max(beside, 2 * (here.beside == 2)), bool(names))
        elements.append(child)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            stop = n if end < 0 else end
            if tag in ("textarea", "title"):
                yield child, html.unescape(page[at:stop])
            close_at = n if end < 0 else page.find(">", end)
            at = n if close_at < 0 or end < 0 else close_at + 1
            continue
        if found[3].rstrip().endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        here = child
        opened[tag] += 1


def path_values(blocks: list[tuple[int, int, int]], width: int) -> dict[int, float]:
    """The fused, smoothed and tempered ratio of each path, from (path, length, marks) of the blocks in page order."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, size, points in blocks:
        length[path] += size
        marks[path] += points
        count[path] += 1
    ratio = np.array([length[p] / count[p] for p, _, _ in blocks])
    points = np.array([(marks[p] + 1) / count[p] for p, _, _ in blocks])
    window = np.ones(min(2 * width + 1, len(blocks)))
    smooth = lambda v: np.convolve(v, window, "same") / np.convolve(np.ones(len(v)), window, "same")
    near = np.sqrt(smooth(ratio) * smooth(points))
    total: dict[int, float] = defaultdict(float)
    for (p, _, _), f in zip(blocks, near.tolist()):
        total[p] += f
    return {p: math.sqrt(total[p] / count[p] * math.sqrt(length[p] / count[p] * (marks[p] + 1) / count[p])) for p in count}


def _unnamed(elements: list[Element]) -> None:
    """Names count for nothing on elements that hold an article or main part and more text than all that has no such name; children inherit what is left."""
    for e in reversed(elements[1:]):
        e.parent.has_article |= e.has_article or e.tag in ("article", "main")
    plain = elements[0].size
    for e in elements[1:]:
        e.inside = e.parent.inside or e.beside == 1  # below a name, for the sum alone
        if e.beside == 1 and not e.parent.inside:
            plain -= e.size
    for e in elements:
        if e.beside == 1 and e.has_article and e.size > plain:
            e.beside = 0
        if e.parent is not None and e.parent.beside:
            e.beside = e.parent.beside


def main_text(page: str, width: int = 1, threshold: float = 0.35, hold: float = 0.6) -> str:
    """The content blocks of a page, one a line.

    width: blocks on either side that are smoothed over; threshold: part of the mean path value (weighted by
    length) that a path must reach; hold: share of the selected text that the content root must keep.
    """
    elements: list[Element] = []
    nodes = [(e, x if x is None else SPACE.sub(" ", x)) for e, x in text_nodes(page, elements)]
    for e, x in nodes:
        if x is not None and e.beside < 2:
            e.size += len(x.strip())
    links = [e.tag == "a" or False for e in elements]
    index = {id(e): k for k, e in enumerate(elements)}
    for k, e in enumerate(elements):
        links[k] = links[k] or (e.parent is not None and links[index[id(e.parent)]])
        e.linked = e.size if links[k] else 0
    for e in reversed(elements[1:]):
        e.parent.size += e.size
        e.parent.linked += e.linked
    _unnamed(elements)

    # blocks of text: path of the block's element, length, marks
    blocks: list[tuple[int, int, int]] = []
    of: list[Element] = []
    size = points = 0
    last: Element | None = None
    for e, x in [*nodes, (elements[0], None)]:
        if size and (x is None or e.block is not last):
            blocks.append((last.path, size, points))
            of.append(last)
            size = points = 0
        if x is not None and not e.beside and x.strip():
            last = e.block
            size += len(x.strip())
            points += len(MARKS.findall(x))
    if not blocks:
        return ""
    value = path_values(blocks, width)
    limit = threshold * sum(value[p] * n for p, n, _ in blocks) / sum(n for _, n, _ in blocks)
    for (p, n, _), e in zip(blocks, of):
        if value[p] >= limit:
            e.picked += n
        if (value[p] >= limit or e.tag in ("h1", "h2")) and e.parent is not None and e.tag in OWN_TEXT:
            e.parent.here = True
    for e in reversed(elements[1:]):
        e.parent.picked += e.picked

    root = elements[0]
    for e in elements:
        if e.picked >= hold * elements[0].picked and e.tag not in INLINE and not e.beside:
            root = e  # parents come first, and only one child of an element can hold most
    while root.parent is not None and (root.tag in HOLDERS or root.parent.here):
        root = root.parent
    up = root
    while up.parent is not None and up.tag != "article":
        up = up.parent
    if up.tag == "article" and not up.beside:
        root = up

    # below the root: named containers and link lists without a selected path go
    for e in elements:
        inside = e is root or (e.parent is not None and e.parent.inside)
        if inside and e is not root and not e.picked and ((e.named and e.tag in CONTAINERS) or (e.tag in LISTS and 2 * e.linked > e.size)):
            inside = False
        e.inside = inside and not e.beside
    out, part = [], []

    def flush() -> None:
        block = SPACE.sub(" ", "".join(part)).strip()
        if block:
            out.append(block)
        part.clear()

    for e, x in nodes:
        if x is None:
            flush()
        elif e.inside:
            part.append(x)
    flush()
    return "\n".join(out)


def extracted(pages: DataFrame, html: str = "html", name: str = "text", **options) -> DataFrame:
    """Every page's row with its main text; no shuffle."""
    pages = pages.drop(name) if name != html else pages
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, html):
            texts = [main_text(x, **options) if x else "" for x in t.column(batch, html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, name])

    return pages.mapInArrow(run, t.arrow_type(pages, f"{name} string"))


def op6_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_tag_paths": op6_tag_paths}
ORACLE_SQL: dict[str, str] = {}
