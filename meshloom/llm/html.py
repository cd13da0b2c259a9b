"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block's features are word count, link density and
text density (words a line of 80 characters), its own and those of the two blocks before and after it, and weak hints:
whether it is a heading or list item; whether the nearest enclosing part that by its tag (nav, aside, footer, form ...)
or its class, id or role isn't of the article holds the page's article or title, and the share of all words in it; and
whether an article or main element encloses it. So a form around the page or a body called after its sidebar tells
nothing, as it holds all of the text. A decision tree decides, grown on the labelled blocks of pages in thirteen layouts
(``layouts.py``), whose class names mislead on purpose.

Two plain rules come before the tree, as comments of running text look like an article's: where an article element holds
the page's first h1, nothing outside of it is kept; and where the article or the title is known, parts called after
readers' replies that don't hold it aren't. Comments that neither tag nor name nor place marks are kept.

Character references are decoded, white space within a block becomes one space, kept blocks are joined by line feeds
in page order. Scripts, styles and other elements that hold no text for readers never form blocks.

Defined cases: a null or empty page has an empty text; markup that is never closed ends with the page; a "<" that
begins no tag is text; very long pages and malformed tags are read whole, in time linear in their length; equal pages
(ties, repeated rows) have equal texts, as often as they came; null ids and urls stay; extra columns may have any name
and are left out; empty tables give no rows.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .layouts import labelled_pages

#: Elements that end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no markup and no text for readers.
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg canvas audio video head".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that aren't part of an article.
ASIDE = frozenset("nav aside footer form header menu dialog search select button fieldset label".split())
#: Words of class, id and role that may name such parts.
PART = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent"
    " contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header login masthead menu message modal nav navbar"
    " navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply"
    " respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split()
)
#: Words of class and id that name what readers wrote.
REPLIES = frozenset("comment comments commentlist discussion disqus replies reply respond".split())

OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names(attributes: str) -> set[str]:
    return {w.lower() for m in NAMED.finditer(attributes) for w in NAME.findall(m[2] or m[3] or m[4] or "")}


def tags_of(page: str):
    """(text before the tag, closing, name, attributes, end of the tag) of every tag, and a last one without name.

    A tag ends at the first ">" outside of quotes. Where a quote is never closed, quotes count for nothing from there on,
    and where no ">" is left the rest is text, so that the time is linear in the page.
    """
    at = begin = 0
    quotes = True
    while True:
        begin = page.find("<", begin)
        close = page.find(">", begin) if begin >= 0 else -1
        if begin < 0 or close < 0 and page[begin : begin + 2] not in ("<!", "<?"):
            skip = yield page[at:], False, "", "", len(page)
            return
        if page[begin + 1 : begin + 2] in ("!", "?"):
            mark = next((m for m in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(m[0], begin)), ("<", ">"))
            end = page.find(mark[1], begin + len(mark[0]))
            end = len(page) if end < 0 else end + len(mark[1])
            if mark[0] == "<!--" and page.startswith((">", "->"), begin + 4):  # an abrupt comment
                end = close + 1
            skip = yield page[at:begin], False, "", "", end
            at = begin = end
            continue
        m = OPEN.match(page, begin + 1)
        if not m:
            begin += 1
            continue
        end = m.end()
        if quotes and not (close <= end):
            cursor = end
            while True:
                gap = page.find(">", cursor)
                if gap < 0:
                    quotes, end = False, close
                    break
                marks = [q for q in (page.find('"', cursor, gap), page.find("'", cursor, gap)) if q >= 0]
                if not marks:
                    end = gap
                    break
                after = page.find(page[min(marks)], min(marks) + 1)
                if after < 0:
                    quotes, end = False, close
                    break
                cursor = after + 1
        else:
            end = close
        skip = yield page[at:begin], bool(m[1]), m[2].lower(), page[m.end() : end], end + 1
        at = begin = skip if skip is not None else end + 1


class Page:
    """The blocks of a page (text, words, words in links, heading, item, element) and its elements, parents first."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, int, bool, bool, int]] = []
        #: parent, enclosing part by tag, by name, enclosing article (numbers of elements, 0 for none), words, whether it
        #: holds the first article or main, whether it holds the first h1
        self.parent, self.by_tag, self.by_name, self.article = [0], [0], [0], [0]
        self.replies = [0]  # enclosing part called after readers' replies
        self.first_article = self.first_h1 = self.main = 0
        self.read(page)
        n = len(self.parent)
        self.words = [0] * n
        for _, words, _, _, _, element in self.blocks:
            self.words[element] += words
        self.holds = [False] * n
        for goal in {self.main or self.first_article, self.first_article, 0 if self.first_article else self.first_h1} - {0}:
            while goal and not self.holds[goal]:
                self.holds[goal] = True
                goal = self.parent[goal]
        for i in range(n - 1, 0, -1):
            self.words[self.parent[i]] += self.words[i]

    def read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        opened: dict[str, int] = {}
        pieces: list[str] = []
        linked = 0
        in_link = heading = item = False
        mine = 0

        def flush():
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                words = text.count(" ") + 1
                self.blocks.append((text, words, min(words, linked), heading, item, mine))
            pieces.clear()
            linked = 0

        tags = tags_of(page)
        skip = None
        ahead: dict[str, re.Match | None] = {}

        def search(mark: str, at: int) -> re.Match | None:
            """The first tag beginning with ``mark`` from ``at`` on; what was found once is kept, so all searches together are linear."""
            if mark not in ahead or ahead[mark] and ahead[mark].start() < at:
                ahead[mark] = re.compile(rf"{re.escape(mark)}\b", re.I).search(page, at)
            return ahead[mark]

        def after(mark: str, at: int) -> int | None:
            """Where the first end tag ``mark`` from ``at`` on ends."""
            found = search(mark, at)
            close = page.find(">", found.end()) if found else -1
            if found and close < 0:
                ahead[mark] = None  # nothing ends after it
            return close + 1 if close >= 0 else None

        while True:
            try:
                data, closing, name, attributes, at = tags.send(skip)
            except StopIteration:
                break
            skip = None
            if data:
                data = entities.unescape(data) if "&" in data else data
                pieces.append(data)
                if in_link:
                    linked += len(data.split())
            if not name:
                continue
            if not closing and name in RAW and not attributes.endswith("/"):
                end = after(f"</{name}", at)
                if name == "head":  # its end tag may be left out
                    body = search("<body", at)
                    skip = min((x for x in (end, body and body.start()) if x is not None), default=at)
                else:
                    skip = len(page) if end is None else end
                continue
            if name == "a":
                in_link = not closing
            elif name == "br":
                pieces.append(" ")
            if name in BLOCK:
                flush()
                heading, item = (not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()), not closing and name == "li"
                if name in ("p", "li", "td"):
                    in_link = False
            if name in VOID or attributes.endswith("/"):
                continue
            if closing:
                if opened.get(name):
                    flush()
                    while True:
                        last, _ = stack.pop()
                        opened[last] -= 1
                        if last == name:
                            break
                    mine = stack[-1][1]
            elif name in BLOCK or name in ASIDE or "=" in attributes and name in ("span", "b", "i", "em", "strong"):
                if name in ("p", "li", "td", "dd", "dt", "option") and "=" not in attributes:
                    continue
                if name not in BLOCK:
                    flush()
                parent, new = stack[-1][1], len(self.parent)
                self.parent.append(parent)
                within = self.article[parent]
                part = name in ASIDE and not (name == "header" and within and self.by_tag[parent] <= within)
                self.by_tag.append(new if part else self.by_tag[parent])
                called = names(attributes) if "=" in attributes else set()
                self.by_name.append(new if called & PART else self.by_name[parent])
                self.replies.append(new if called & REPLIES else self.replies[parent])
                self.article.append(new if name in ("article", "main") else within)
                if name == "main":
                    self.main = self.main or new
                elif name == "article" and not self.by_tag[new]:
                    self.first_article = self.first_article or new
                elif name == "article" and self.by_tag[new] and not self.first_article:
                    self.spare = getattr(self, "spare", 0) or new
                elif name == "h1":
                    self.first_h1 = self.first_h1 or new
                stack.append((name, new))
                opened[name] = opened.get(name, 0) + 1
                mine = new
        flush()
        # an article within such a part (a form around the page) is the page's article if there is no other
        self.first_article = self.first_article or getattr(self, "spare", 0) or self.main


FEATURES = (
    *(f"{kind} {at}" for kind in ("words", "links", "density") for at in ("two before", "before", "own", "after", "two after")),
    *"heading item tag tag-holds tag-share name name-holds name-share article article-holds any-article".split(),
)


def outside(page: Page) -> np.ndarray:
    """The blocks that the two rules leave out."""
    up = page.first_h1
    while up and up != page.first_article:
        up = page.parent[up]
    titled = up > 0  # an article element holds the first h1
    known = any(page.holds)
    out = []
    for *_, e in page.blocks:
        article, replies = page.article[e], page.replies[e]
        out.append(titled and not (article and page.holds[article]) or known and replies > 0 and not page.holds[replies])
    return np.array(out, bool)


def features(page: Page) -> np.ndarray:
    n = len(page.blocks)
    own = np.array([(w, links / w, w / (1 + len(text) // 80)) for text, w, links, *_ in page.blocks], float).reshape(-1, 3)
    padded = np.concatenate([np.zeros((2, 3)), own, np.zeros((2, 3))])
    near = np.stack([padded[i : i + n] for i in range(5)], 2).reshape(n, 15)
    total = max(1, page.words[0])
    any_article = float(page.first_article > 0)
    rows = []
    for _, _, _, heading, item, e in page.blocks:
        tag, name, article = page.by_tag[e], page.by_name[e], page.article[e]
        rows.append((heading, item, tag > 0, tag > 0 and page.holds[tag], page.words[tag] / total if tag else 0, name > 0, name > 0 and page.holds[name], page.words[name] / total if name else 0, article > 0, article > 0 and page.holds[article], any_article))
    return np.concatenate([near, np.array(rows, float).reshape(n, 11)], 1)


class Tree:
    """A binary decision tree over numbers, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self.least = least
        self.grow(np.asarray(x, float), np.asarray(y, bool), depth)

    def grow(self, x, y, depth) -> int:
        here, n = len(self.nodes), len(y)
        self.nodes.append((-1, 0.0, 0, 0, bool(y.mean() >= 0.5) if n else False))
        best = (y.mean() * (1 - y.mean()) * n - 1e-9, None) if n else (0.0, None)
        if depth and best[0] > 0:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                value, ones = x[order, f], np.cumsum(y[order])
                size = np.arange(1, n)
                left, right = ones[:-1] / size, (ones[-1] - ones[:-1]) / (n - size)
                loss = left * (1 - left) * size + right * (1 - right) * (n - size)
                loss[(value[1:] == value[:-1]) | (size < self.least) | (n - size < self.least)] = np.inf
                if len(loss) and loss.min() < best[0] - 1e-9:
                    i = int(loss.argmin())
                    best = (loss[i], (f, (value[i] + value[i + 1]) / 2))
        if best[1]:
            f, cut = best[1]
            left = x[:, f] < cut
            self.nodes[here] = (f, cut, self.grow(x[left], y[left], depth - 1), self.grow(x[~left], y[~left], depth - 1), False)
        return here

    def keep(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            f, cut, a, b, verdict = self.nodes[node]
            if f < 0:
                out[at] = verdict
            elif len(at):
                left = x[at, f] < cut
                todo += [(a, at[left]), (b, at[~left])]
        return out


def labelled_blocks(pages) -> tuple[np.ndarray, np.ndarray]:
    """Features of all blocks of labelled pages, and whether each belongs to the main text."""
    x, y = [], []
    for _, html, kept in pages:
        page, left = Page(html), list(reversed(kept))
        x.append(features(page))
        for text, *_ in page.blocks:
            mine = bool(left) and left[-1] == text
            if mine:
                left.pop()
            y.append(mine)
        assert not left, "a labelled block isn't one of the page's"
    return np.concatenate(x), np.array(y)


@functools.cache
def default_tree(seed: int = 1, each: int = 40) -> Tree:
    return Tree(*labelled_blocks(labelled_pages(seed, each)))


def main_text(html: str, tree: Tree) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    return "\n".join(b[0] for b, keep in zip(page.blocks, tree.keep(features(page)) & ~outside(page)) if keep)


def extracted(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = tree or default_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
