"""Main-text extraction by tag-path ratios (operator 8).

A page becomes a list of text blocks, each with its root-to-leaf path of block-level tags.  For every
path the length of text, the punctuation and the part of the text in links are summed over the page:
text per block (text-to-path ratio) and punctuation per block are smoothed over the page's order of
blocks, fused with the share of text that is not in links, and gathered for the containers above.
The container with the best fused score that still holds most of the page's score is the article;
its paths are content; lists that are mostly bare links go where no article or main element names it.
What is boilerplate by its element (nav, header, footer, aside, script, style, ...) or hidden never
enters a path.  A class, id or role that is a word for boilerplate (ad, menu, sidebar, ...) as a whole
marks the element: its text counts less, and stays only if it is much richer than the rest of the
article.  Forms, and reader comments by any part of a class or id, are marked too, and their text counts
nothing.  A mark is void on what holds an article or main element, or, where there is none elsewhere,
most of the page's score (for comments, all of its punctuation).

One pass over the pages, a page at a time, no shuffle; memory is bounded by the longest page, and so is time:
paths are nodes of a tree, whose sums are taken from the leaves up, so nesting costs no more than length.

Defined results: null or empty html, and pages without text, give an empty text; unclosed and
truncated markup is read as far as it goes; repeated rows are all kept.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
DROP = frozenset("head script style title noscript template iframe noframes svg math canvas object audio video nav header footer aside button select option textarea dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CONTAINERS = frozenset("html body main article section div center".split())
#: Block elements that the next of their kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What text in a marked element counts.
MARKED = 0.25
# Marks that count nothing at all: forms, and reader comments, whose word may be a part of a class or id.
FORMS = frozenset("form fieldset".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
# Words in class, id and role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer reply cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " signup login share sharing social related recommended recommendations pagination pager widget toolbar complementary contentinfo search skip".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？«»\"“”]")
SPACE = re.compile(r"\s+")


def mark(attributes: str) -> str:
    """"hidden", or the word for boilerplate that is a whole class, id or role, or ""."""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name in ("class", "id", "role"):
            if any(part in COMMENTS for x in value.split() for part in (x, *re.split(r"[-_]", x))):
                return "comments"
            found = found or next((x for x in value.split() if x in MARKS), "")
    return found


class Paths:
    """Tag paths as nodes of a tree: each knows its parent and its last tag, and comes after its parent."""

    def __init__(self) -> None:
        self.parent, self.label, self.at = [0], [""], {}

    def child(self, parent: int, label: str) -> int:
        node = self.at.setdefault((parent, label), len(self.parent))
        if node == len(self.parent):
            self.parent.append(parent)
            self.label.append(label)
        return node

    def above(self, values: list) -> list:
        """Sums over each node and all below it."""
        out = list(values)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def below(self, flags: list) -> list:
        """Whether a node or one above it is flagged."""
        out = list(flags)
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parent[node]]
        return out


def blocks_of(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """(path, text, characters in links) of each block of text outside boilerplate, in page order."""
    found: list[tuple[int, str, int]] = []
    paths = Paths()
    stack: list[tuple[str, int, bool]] = []  # tag, path, whether it is boilerplate
    open_: Counter[str] = Counter()
    bad = 0  # boilerplate elements open
    links = 0
    text: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
            if joined:
                found.append((stack[-1][1] if stack else 0, joined, linked))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal bad
        tag, _, boiler = stack.pop()
        open_[tag] -= 1
        bad -= boiler

    while at < n:
        m = TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at and not bad:
            text.append(page[at:upto])
            if links:
                linked += upto - at
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            if m[0].startswith("<![CDATA[") and not bad:
                text.append(htmllib.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = bool(m[1])
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if tag == "span" and not closing and mark(m[3]) and not m[3].rstrip().endswith("/"):
                at = after_span(page, at)
            continue
        if tag == "br" or tag in VOID:
            if tag in ("br", "hr"):
                if not bad:
                    text.append(" ")
                if tag == "hr":
                    flush()
            continue
        flush()
        links = 0
        if closing:
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        closes = SELF_CLOSING.get(tag, frozenset())
        if tag in ENDS_P:
            closes = {*closes, "p"}
        for i in range(len(stack) - 1, -1, -1) if any(open_[x] for x in closes) else ():
            if stack[i][0] in closes:
                while len(stack) > i:
                    pop()
                break
            if stack[i][0] not in ("p", "li", "dt", "dd", "td", "th", "tr"):
                break
        if tag == "body":
            while bad and stack:
                pop()
        if tag not in ("html",) or not stack:
            word = "" if tag in ("body", "html", "main", "article") else "form" if tag in FORMS else mark(m[3])
            boiler = tag in DROP or word == "hidden"
            stack.append((tag, paths.child(stack[-1][1] if stack else 0, f"{tag}!{word}" if word else tag), boiler))
            open_[tag] += 1
            bad += boiler
    flush()
    return paths, found


def after_span(page: str, at: int) -> int:
    """Where the span that was opened before `at` ends; `at` where it doesn't."""
    depth = 1
    for m in re.compile(r"<(/?)span(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return at


def per_path(paths: Paths, values: Iterable[tuple[int, float]]) -> list[float]:
    out = [0.0] * len(paths.parent)
    for path, x in values:
        out[path] += x
    return out


def own_score(size: float, points: float, linked: float) -> float:
    """Text and punctuation, less what is in links."""
    return size * (1 + points) * (1 - linked / max(1, size)) ** 2


def unmarked(paths: Paths, blocks: list[tuple[int, str, int]], threshold: float) -> tuple[Paths, list[tuple[int, str, int]]]:
    """Paths and blocks without the marks of elements that hold the article."""
    if not any("!" in x for x in paths.label):
        return paths, blocks
    points = [len(PUNCTUATION.findall(text)) for _, text, _ in blocks]
    scores = [own_score(len(text), p, min(linked, len(text))) for (_, text, linked), p in zip(blocks, points, strict=True)]
    held, pointed = (paths.above(per_path(paths, ((path, x) for (path, _, _), x in zip(blocks, xs, strict=True)))) for xs in (scores, points))
    full = paths.above(per_path(paths, ((path, 1) for path, _, _ in blocks)))
    name = [x in ("article", "main") for x in paths.label]
    holds = paths.above([int(x and f > 0) for x, f in zip(name, full, strict=True)])  # article and main elements below
    named = any(paths.below(name)[path] for path, _, _ in blocks)
    new, to = Paths(), [0] * len(paths.label)
    for node, label in enumerate(paths.label[1:], 1):
        tag, _, word = label.partition("!")
        # a mark of comments is taken for the page's own only where no sentence stands elsewhere
        most = pointed[node] == pointed[0] if word == "comments" else held[node] >= threshold * held[0]
        void = holds[node] or not named and pointed[node] and most
        to[node] = new.child(to[paths.parent[node]], tag if void else label)
    return new, [(to[path], text, linked) for path, text, linked in blocks]


def main_text(page: str | None, window: int = 2, threshold: float = 0.5) -> str:
    """The article's blocks, joined by one space."""
    if not page:
        return ""
    paths, blocks = unmarked(*blocks_of(page), threshold)
    if not blocks:
        return ""
    every = range(len(paths.label))
    # sums over each root-to-leaf path
    count, size, points, linked = (per_path(paths, ((path, f(text, in_links)) for path, text, in_links in blocks)) for f in (lambda t, _: 1, lambda t, _: len(t), lambda t, _: len(PUNCTUATION.findall(t)), lambda t, x: min(x, len(t))))
    # text and punctuation per block of a path, smoothed over the order of blocks
    low = paths.below(["!" in x for x in paths.label])
    lost = paths.below([x.partition("!")[2] in ("form", "comments") for x in paths.label])

    def smooth(x: list[float]) -> list[float]:
        return [sum(part) / len(part) for i in range(len(x)) for part in [x[max(0, i - window) : i + window + 1]]]

    length = smooth([0 if lost[p] else size[p] / count[p] * (MARKED if low[p] else 1) for p, _, _ in blocks])
    pointed = smooth([points[p] / count[p] for p, _, _ in blocks])
    fused = per_path(paths, ((p, 0 if lost[p] else a * (1 + b) * (1 - linked[p] / max(1, size[p])) ** 2) for (p, _, _), a, b in zip(blocks, length, pointed, strict=True)))
    # the deepest container that holds most of the page's score is the article
    containers = paths.above(fused)
    most = threshold * containers[0]
    own = [own_score(size[p], points[p] / count[p], linked[p]) if count[p] else 0.0 for p in every]
    # an article or main element needs most of the score, or most of what no mark speaks against before smoothing
    clear = paths.above([0.0 if low[p] else own[p] for p in every])
    depth = [0] * len(paths.label)
    for p in every[1:]:
        depth[p] = depth[paths.parent[p]] + 1
    full = paths.above(count)
    named = [p for p in every if full[p] and paths.label[p] in ("article", "main") and (containers[p] >= most or clear[p] >= threshold * clear[0] > 0)]
    held = [p for p in every if not p or full[p] and paths.label[p] in CONTAINERS and containers[p] >= most]
    best = max(named or held, key=depth.__getitem__)
    inside = paths.below([p == best for p in every])
    blocks_inside = sum(count[p] for p in every if inside[p])
    mean = sum(fused[p] for p in every if inside[p]) / max(1, blocks_inside)
    plain = [p for p in every if inside[p] and count[p] and not low[p]]
    rich = sum(own[p] for p in plain) / sum(count[p] for p in plain) if plain else None

    def content(p: int) -> bool:
        if lost[p] or low[p] and (rich is None or MARKED * own[p] / count[p] < threshold * rich):
            return False
        in_links = linked[p] >= 0.5 * size[p]
        if inside[p]:  # without a named article, lists and cells that are mostly bare links are left out
            bare = in_links and points[p] < count[p]
            return bool(named) or not (bare and paths.label[p] in ("li", "td", "dd"))
        # elsewhere a path needs the article's score with its neighbours, and a fair share of it by itself
        return not named and not in_links and fused[p] / count[p] >= threshold * mean and own[p] / count[p] >= MARKED * (rich or 0)

    keep = [count[p] > 0 and content(p) for p in every]
    return " ".join(text for path, text, _ in blocks if keep[path])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: its id, url, text, n_chars (code points of text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text = [main_text(x) for x in col(part, "_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([col(part, "_id"), col(part, "_url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], [id_col, url_col, "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kinds = [picked.schema[x].dataType.simpleString() for x in ("_id", "_url")]
    return picked.mapInArrow(work, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
