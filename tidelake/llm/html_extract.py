"""Main text of web pages by tag-path ratios.

A page is a row of text nodes, each with the path of its open tags from the
root.  For each path, text length and punctuation are added up and divided by
the number of its nodes: articles have long, punctuated nodes under few paths,
menus short bare ones.  Both ratios are smoothed along the page over neighbouring
nodes with like paths, fused to one score, and held against a threshold from the
page's own spread.

Blocks with a node over the threshold are the content, wherever they stand.  Blocks
under it (headings, short paragraphs, list items) come along if they lie between
content blocks, or head them, in the deepest element that holds nearly all of the
content; in an ``article`` or ``main``, if they are text elements, or have a path that
content has too.  But not rows of links, which paths under the threshold make a menu,
and no division, like an unmarked advert, whose path is all under the threshold.  Tags,
roles, classes and ids are what is known before: parts that they name as something
else (a menu, a form, a notice, a reader's comment, ...) are left out, and an
``article`` or ``main`` that holds much of the content is the element to look in.

Work is linear in the page: paths are numbers in a tree, and sums go up it once.

Defined results: a null or empty page gives an empty text; so does one without
text outside such parts, unless one such part, by its class, id or as a form, wraps
nearly all sentences of the page; broken markup and cut-off pages are read as browsers do
it: an open paragraph ends at the next block, unknown references stay as they
are; very long and very deep pages are read whole; repeated rows give repeated
results; an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelake.llm.runtime import free_name

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}}
SCOPE = frozenset("ul ol table td th article section div body html nav aside footer header form".split())

#: Elements that say nothing of their text.
BARE = frozenset("div section center details figure fieldset address hgroup dialog".split())
#: Elements, roles, and words in class or id that are not the article.
OUTSIDE_TAGS = frozenset("nav header footer aside form button select option input menu dialog head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|adbox|banner|promo|promoted|sponsor|sponsored|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|header|masthead|topbar|footer|"
    r"comment|comments|commentlist|disqus|reply|replies|respond|notice|notices|alert|cookie|cookies|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|related|recommended|recommendations|widget|toolbar|pagination|pager|copyright|legal|disclaimer|form|search|tags|hidden)(?:$|[\s_-]|\d)", re.IGNORECASE
)

#: Says what stands beside an element, not what it is.
_BESIDE = re.compile(r"\b(?:no|has|with|without)[-_][A-Za-z]+", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？；：]")

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PAGE = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("n_nodes", T.LongType(), False), T.StructField("n_kept", T.LongType(), False)])


@dataclass
class Page:
    """Text nodes in order, and the elements they stand in; element 0 is the page, path 0 that of no tag.

    ``mark`` is the nearest element around, itself included, that its class or id, or being a form,
    names as no part of the article; ``outside`` says so for certain."""

    text: list[str] = field(default_factory=list)
    element: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    mark: list[int] = field(default_factory=lambda: [0])
    outside: list[bool] = field(default_factory=lambda: [False])
    link: list[bool] = field(default_factory=lambda: [False])
    article: list[bool] = field(default_factory=lambda: [False])
    #: Of each path: the one above, and its depth.
    above: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])

    def open(self, tag: str, parent: int, paths: dict[tuple[int, str], int], outside: bool, marked: bool) -> int:
        path = paths.setdefault((self.path[parent], tag), len(self.above))
        if path == len(self.above):
            self.above.append(self.path[parent])
            self.depth.append(self.depth[self.path[parent]] + 1)
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(path)
        self.mark.append(k if marked else self.mark[parent])
        self.outside.append(self.outside[parent] or outside)
        self.link.append(self.link[parent] or tag == "a")
        self.article.append(self.article[parent] or tag == "article")
        return k

    def above_inline(self, element: int) -> int:
        """The nearest element around, itself included, that is no part of a line."""
        while self.tag[element] in INLINE:
            element = self.parent[element]
        return element


def _is_outside(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Is the element outside the article: for certain, and by its class, id or as a form?"""
    if tag == "header" and in_article:  # the heading of an article, not of the page
        return False, False
    marked = tag == "form"
    if tag in OUTSIDE_TAGS and not marked:
        return True, False
    if not attributes.strip() or tag in ("body", "html", "article", "main"):
        return False, marked
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id"):
            words = _BESIDE.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1-\2", value))
            marked = marked or bool(OUTSIDE_WORDS.search(words.replace("header", "") if in_article else words))
        if name == "role" and value.lower() in OUTSIDE_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True, marked
    return bool(re.search(r"\bhidden\b(?!\s*=)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes))), marked


def parse(page: str) -> Page:
    """Text nodes and elements of a page."""
    out = Page()
    stack, names, paths = [0], Counter(), {}  # open elements, how many of each tag, paths by the one above and tag
    block, at = 0, 0

    def leave(k: int) -> None:
        names.subtract(out.tag[e] for e in stack[k:])
        del stack[k:]

    def close(tags: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        if not any(names[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = out.tag[stack[k]]
            if tag in tags:
                leave(k)
                return
            if tag in scope:
                return

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[:2] not in ("<!", "<?"):
                out.text.append(text)
                out.element.append(stack[-1])
                out.block.append(block)
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if m[1]:
            if names[tag]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if out.tag[stack[k]] == tag))
            continue
        attributes = m[3] or ""
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P:
            close({"p"}, SCOPE - {"p"})
        if tag in IMPLIED:
            close(IMPLIED[tag], frozenset({"ul", "ol", "table", "dl", "select"}))
        if tag in VOID or attributes.endswith("/") and tag not in ENDS_P:
            continue
        stack.append(out.open(tag, stack[-1], paths, *_is_outside(tag, attributes, out.article[stack[-1]])))
        names[tag] += 1
    return out


def path_ratios(page: Page, nodes: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Paths of the text nodes ``nodes``, and the ratios of text and of punctuation of each one's path."""
    texts = [page.text[k] for k in nodes]
    lengths = np.array([len(_SPACE.sub(" ", t).strip()) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    path = [page.path[page.element[k]] for k in nodes]
    _, of = np.unique(path, return_inverse=True)
    filled = np.maximum(np.bincount(of, lengths > 0), 1)
    ratio, pointed = np.bincount(of, lengths) / filled, np.bincount(of, marks) / filled
    spread = np.sqrt(np.maximum(np.bincount(of, lengths**2) / filled - ratio**2, 0))
    return path, (ratio + spread)[of], pointed[of]


def path_scores(page: Page, nodes: np.ndarray, ratios: tuple[list[int], np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Smoothed and fused tag-path ratios of the text nodes ``nodes``."""
    path, first, second = path_ratios(page, nodes) if ratios is None else ratios

    def shared(a: int, b: int) -> int:
        """Depth to which two paths are one; no longer than the tags between them."""
        while a != b:
            if page.depth[a] >= page.depth[b]:
                a = page.above[a]
            else:
                b = page.above[b]
        return page.depth[a]

    # Gaussian weights over two nodes each side, less for paths that share less.
    sums, weights = np.stack([first, second]), np.ones(len(path))
    values = sums.copy()
    for step, w in ((1, 0.6), (2, 0.15)):
        if len(path) <= step:
            break
        like = np.array([w if a == b else w * shared(a, b) / max(page.depth[a], page.depth[b], 1) for a, b in zip(path, path[step:])])
        sums[:, :-step] += like * values[:, step:]
        sums[:, step:] += like * values[:, :-step]
        weights[:-step] += like
        weights[step:] += like
    return sums[0] / weights * (1 + sums[1] / weights)


def opened(page: Page, nodes: np.ndarray, small: float = 0.1) -> set[int]:
    """Marked elements that are the page and not beside it: while a ``small`` part of the weight of
    its sentences is left, the outermost one that holds most of that weight."""
    lengths = np.array([len(page.text[k].strip()) * bool(_PUNCTUATION.search(page.text[k])) for k in nodes], float)
    mark = np.array([page.mark[page.element[k]] for k in nodes], np.int64)
    if not len(nodes) or lengths[mark == 0].sum() >= small * lengths.sum():
        return set()
    weights = path_scores(page, nodes) * lengths
    total = weights.sum()
    own: dict[int, float] = {0: 0.0}
    for m, w in zip(mark.tolist(), weights.tolist()):
        own[m] = own.get(m, 0.0) + w
    marked = [k for k in range(1, len(page.mark)) if page.mark[k] == k]
    held, inner = {k: own.get(k, 0.0) for k in (0, *marked)}, defaultdict(list)
    for k in reversed(marked):
        around = page.mark[page.parent[k]]
        held[around] += held[k]
        inner[around].append(k)
    out: set[int] = set()
    free, at = own[0], 0
    while free < small * total and inner[at]:
        best = max(inner[at], key=held.__getitem__)
        if held[best] <= 0.5 * total:
            break
        out.add(best)
        free += own.get(best, 0.0)
        at = best
    return out


def _inside(page: Page) -> np.ndarray:
    """Text nodes that no part outside the article holds."""
    certain = np.array([k for k in range(len(page.text)) if not page.outside[page.element[k]]], np.int64)
    ignored = opened(page, certain)
    shut = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        shut[e] = shut[page.parent[e]] or page.mark[e] == e and e not in ignored
    return np.array([k for k in certain if not shut[page.element[k]]], np.int64)


def _container(page: Page, elements: np.ndarray, weights: np.ndarray) -> tuple[int, bool]:
    """The element to look in, and is it an article by its tag: the outermost one that holds much of
    the content's weight, or else the deepest that holds nearly all of it."""
    held = [0.0] * len(page.tag)
    for e, w in zip(elements.tolist(), weights.tolist()):
        held[e] += w
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    for e in range(1, len(held)):
        if page.tag[e] in ("article", "main") and held[e] >= 0.4 * held[0]:
            return e, True
    return max(e for e in range(len(held)) if held[e] >= 0.95 * held[0]), False


def main_text(html_text: str | None) -> tuple[str, int, int]:
    """(text, number of text nodes, of those kept)."""
    page = parse(html_text or "")
    nodes = _inside(page)
    lengths = np.array([len(page.text[k].strip()) for k in nodes], float)
    if not lengths.sum():
        return "", len(page.text), 0
    ratios = path_ratios(page, nodes)
    scores = path_scores(page, nodes, ratios)
    content = (scores >= 0.5 * np.std(scores)) & (lengths > 0)
    elements = np.array([page.element[k] for k in nodes])
    container, named = _container(page, elements, np.where(content, scores * lengths, 0.0))
    within = [False] * len(page.tag)
    for e in range(container, len(page.tag)):
        within[e] = e == container or within[page.parent[e]]
    inside = np.array([within[e] for e in elements])

    # Blocks: has each a node over the threshold, how much of its text are links, is it a heading?
    numbers, of = np.unique([page.block[k] for k in nodes], return_inverse=True)
    over = np.bincount(of, content & (inside | (not named))) > 0
    filled = np.bincount(of, lengths) > 0
    linked = np.array([page.link[e] for e in elements])
    links = filled & ~over & (np.bincount(of, lengths * linked) >= 0.8 * np.bincount(of, lengths))
    holder = np.zeros(len(numbers), np.int64)
    holder[of[::-1]] = np.arange(len(nodes))[::-1]
    heading = np.array([page.tag[elements[k]] in _HEADINGS for k in holder])
    several = np.bincount(of, linked & (lengths > 0)) > 1
    # A row of links: more than one in a block, or in blocks next to each other.
    rows = np.flatnonzero(filled)
    beside = np.zeros(len(numbers), bool)
    near = links[rows]
    beside[rows[1:]] |= near[:-1]
    beside[rows[:-1]] |= near[1:]
    menu = links & (several | beside)
    whole = np.flatnonzero(over)
    if named:
        # In an article, text elements come along.  What stands in a bare division comes only if the ratio of its own
        # path is over the threshold, whatever stands beside it, or content has such a division.
        element = [page.above_inline(elements[k]) for k in holder]
        bare = np.array([page.tag[e] in BARE for e in element], bool)
        own = np.zeros(len(numbers), bool)
        np.logical_or.at(own, of, (ratios[1] * (1 + ratios[2]) >= 0.5 * np.std(scores)) & (lengths > 0))
        paths = {page.path[element[b]] for b in np.flatnonzero(own & over)}
        low = ~bare | own | np.array([page.path[e] in paths for e in element], bool)
        if not low[over].any():
            low[:] = True
        over &= low
    else:
        # Between the first and the last content block; before them, the headings next to it.
        low = np.zeros(len(numbers), bool)
        low[whole[0] : whole[-1] + 1] = True
        for b in rows[rows < whole[0]][::-1]:
            if not heading[b]:
                break
            low[b] = True
        # What follows the last under the same element as some content block, in a path of its own kind, ends the article.
        paths = {page.path[elements[holder[b]]] for b in whole}
        for b in rows[rows > whole[-1]]:
            if page.path[elements[holder[b]]] not in paths:
                break
            low[b] = True
    keep = over | low & ~menu & ((np.bincount(of, inside) > 0) | (not named))
    blocks: dict[int, list[str]] = {}
    for k, b in zip(nodes.tolist(), of.tolist()):
        if keep[b]:
            blocks.setdefault(b, []).append(page.text[k])
    lines = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks.values())
    return "\n".join(x for x in lines if x), len(page.text), int(np.sum(keep[of] & (lengths > 0)))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with a struct column ``main`` (underscores in front if the name is taken) instead of the markup."""
    name = free_name(pages, "main")
    at = pages.columns.index(column)
    rest = [i for i in range(len(pages.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes, kept = zip(*map(main_text, batch.column(at).to_pylist())) if batch.num_rows else ((), (), ())
            out = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(nodes, pa.int64()), pa.array(kept, pa.int64())], fields=[pa.field(f.name, pa.string() if f.name == "text" else pa.int64(), False) for f in PAGE])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), out], names=[*(batch.schema.names[i] for i in rest), name])

    return pages.mapInArrow(run, T.StructType([*(pages.schema.fields[i] for i in rest), T.StructField(name, PAGE, False)]))
