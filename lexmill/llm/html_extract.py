"""Main text of web pages by wrapper induction over the pages of a host.

A page is parsed to a tree of block elements whose leaves are runs of text. Pages of a host whose upper elements
are the same have one layout. One page of each layout, chosen by hash, is its exemplar (layouts of very few pages
take that of the host's commonest one); every other tree of the layout is aligned with the exemplar by simple tree
matching (Yang 1991: the largest order-preserving mapping of equal labels from the roots down). An aligned
leaf sits in the exemplar's slot; other leaves count for the lowest element above them that is aligned. Over all distinct pages
of a layout each slot has its texts, their length and the share of links in it:

- A slot whose text is the same on most distinct pages is template.
- The lowest element of the exemplar that holds most of the varying running text is the content element.
- Elements in it that mostly hold links are lists of links.
- Where the content element has no name of its own for an article, content begins at its first heading.

A page's text is what stands in its node that is aligned with the content element, without template, lists of links
and what the markup itself marks as something else (menus, forms, adverts, comments, ...), in page order.
Pages of hosts with too few pages, or without such a node, are read by their own markup: article or main element, else the element
that holds most running text.

Only skeletons (labels), text hashes and lengths are shuffled for induction, and every page takes part in the counts.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick
from .hashing import small_batches

# Element names by their part in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNREAD = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title map datalist".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation navigationbar menu menubar breadcrumb breadcrumbs masthead topbar banner footer colophon sidebar sidebars aside rail complementary contentinfo "
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promoted promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup signin login register search searchbox "
    "share sharing social related recommended recommendations popular trending comment comments disqus discussion reply replies respond responses "
    "widget widgets toolbar pagination pager copyright skip hidden tags".split()
)
# Words that name a box and say nothing of what is in it.
BOXES = frozenset("area bar block body bottom box btn button buttons card col column container content control group head header heading holder inner item items js layout left link links list listing main module outer page panel post primary region right row secondary section side site slot small title top unit wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+").findall
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)

#: A leaf is template if its slot has this text on so large a share of the layout's distinct pages, and on so many.
SHARE, LEAST_PAGES = 0.6, 4
#: Characters from which a text that is not mostly links is running text, and share of it that is constant on a page that is repeated.
RUNNING, COPIES = 60, 0.9
#: Constant texts of all layouts up to which their table is broadcast.
FEW_TEXTS = 1_000_000
#: Share of the varying running text that the content element holds, and share that may stand before its first heading.
MOST, BEFORE = 0.7, 0.2
#: Pairs of different shapes among two lists of siblings up to which each is weighed by itself; more are weighed by ``Place``, to the same numbers.
SHAPES = 64
#: Numbers of a table of alignments, or of weights, that are held at once; what is beyond is made again.
CELLS = 1 << 21
#: Characters of skeletons whose trees and alignments are kept.
SMALL = 10_000
#: Elements that are part of running text and no place for it.
TEXT_TAGS = frozenset("p blockquote pre li ul ol dl table h1 h2 h3 h4 h5 h6".split())


class Node:
    """A block element; a leaf has text and the label "#"."""

    __slots__ = ("label", "tag", "kids", "text", "linked", "aside", "up")

    def __init__(self, tag: str, label: str, up: Node | None, aside: bool = False):
        self.tag, self.label, self.up, self.aside = tag, label, up, aside
        self.kids: list[Node] = []
        self.text, self.linked = "", 0


def _marks(tag: str, attrs: str) -> tuple[str, bool]:
    """(label suffix, whether marked as not part of the article)."""
    names, told, aside, label = [], False, tag in ASIDE_TAGS, ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            aside = True
        elif key in ("class", "id", "role"):
            for name in value.split():
                words = {w.lower() for w in _WORD(name)}
                names += words
                # A name tells if all its words are marks or boxes: "comment-list" does, "comment-free" does not.
                told = told or bool(words & MARKS) and all(w in MARKS or w in BOXES or w.isdigit() for w in words)
            if key == "class":
                label = "." + ".".join(sorted(re.sub(r"\d+", "", value).split()))
    if tag not in ("html", "body", "main") and told:
        aside = True
    if "header" in names and tag not in ("h1", "h2"):
        aside = aside or tag != "article" and not {"article", "post", "entry", "content"}.intersection(names)
    return label, aside


def parse(page: str) -> Node:
    """The tree of a page's blocks. Inline elements leave their text; an open p ends before another block."""
    root = at = Node("#root", "#root", None)
    words: list[str] = []
    linked = link = 0
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(words)).split())
        words.clear()
        if text:
            leaf = Node("#", "#", at)
            leaf.text, leaf.linked = text, min(linked, len(text))
            at.kids.append(leaf)
        linked = 0

    while pos < n:
        m = _TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            words.append(page[pos:end])
            if link:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                words.append(html_lib.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                flush()
                up = at
                while up is not root and up.tag != tag:
                    up = up.up
                if up is not root:
                    at = up.up
            elif tag == "p" or tag == "br":
                words.append(" ")
            continue
        if tag in UNREAD:
            if tag in RAW or tag == "head":
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                body = re.compile(r"<body[\s>]", re.I).search(page, pos) if tag == "head" else None
                pos = min([x for x in (close and close.end(), body and body.start()) if x] or [n if tag in ("script", "style") else pos])
            else:
                depth, close = 1, re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
                for c in close.finditer(page, pos):
                    depth += -1 if c[1] else 1
                    if not depth:
                        pos = c.end()
                        break
            words.append(" ")
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            words.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag != "p" or at.tag == "p":
                up = at
                while up is not root and up.tag not in ("p", "article", "section", "div", "td", "li", "main", "body"):
                    up = up.up
                if up.tag == "p":
                    at = up.up
            for other in CLOSES.get(tag, ()):
                if at.tag == other:
                    at = at.up
            suffix, aside = _marks(tag, m[3])
            node = Node(tag, tag + suffix + "!" * aside, at, aside)
            at.kids.append(node)
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                at = node
    flush()
    return root


def preorder(root: Node) -> list[Node]:
    """All nodes, parents before their children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.kids))
    return out


def skeleton(root: Node) -> str:
    """Labels in brackets, leaves as #."""
    out, stack = [], list(reversed(root.kids))
    while stack:
        node = stack.pop()
        if node is None:
            out.append("</>")
        elif node.tag == "#":
            out.append("#")
        else:
            out.append(f"<{node.label}>")
            stack.append(None)
            stack.extend(reversed(node.kids))
    return "".join(out)


def layout(node: Node) -> int:
    """Hash of the labels down to the first element of several blocks and of those blocks, runs of equal ones as one."""
    labels = []
    while True:
        blocks = [k for k in node.kids if k.tag != "#"]
        labels += ["/", *(k.label for i, k in enumerate(blocks) if not i or k.label != blocks[i - 1].label)]
        if len(blocks) != 1:
            return text_hash(" ".join(labels))
        node = blocks[0]


class Tree:
    """A skeleton: for each node in preorder its label, parent, children and number of nodes below and including it."""

    def __init__(self, text: str):
        self.label, self.up, self.kids, at = ["#root"], [-1], [[]], 0
        for m in re.finditer(r"#|<([^>]*)>", text):
            if m[1] == "/":
                at = self.up[at]
                continue
            n = len(self.label)
            self.kids[at].append(n)
            self.label.append("#" if m[0] == "#" else m[1])
            self.up.append(at)
            self.kids.append([])
            if m[0] != "#":
                at = n
        self.size = [1] * len(self.label)
        for n in range(len(self.label) - 1, 0, -1):
            self.size[self.up[n]] += self.size[n]

    def tag(self, n: int) -> str:
        return re.split(r"[.!]", self.label[n], maxsplit=1)[0]


@lru_cache(maxsize=256)
def _tree(text: str) -> Tree:
    return Tree(text)


def tree(text: str) -> Tree:
    """Kept for small skeletons only, so that what a task keeps is bounded."""
    return _tree(text) if len(text) <= SMALL else Tree(text)


class _Matching:
    """The largest mapping of two trees. Nodes of one shape (label and all below) are one class, so each pair of
    classes is weighed once; children at either end that are of one class map to each other in some largest mapping.
    """

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, table = a, b, {}
        self.label, self.size, self.kids, sides = [], [], [], []
        for t in (a, b):
            of = [0] * len(t.label)
            for n in range(len(t.label) - 1, -1, -1):
                key = (t.label[n], tuple(of[k] for k in t.kids[n]))
                of[n] = table.setdefault(key, len(table))
                if of[n] == len(self.label):
                    self.label.append(key[0])
                    self.kids.append(key[1])
                    self.size.append(t.size[n])
            sides.append(of)
        self.of_a, self.of_b = sides
        self.weight: dict[tuple[int, int], int] = {}
        self.last: tuple = (None, None)

    @staticmethod
    def _ends(x: tuple, y: tuple) -> tuple[int, int]:
        """How many children at the beginning and at the end are of one class."""
        most, lead, tail = min(len(x), len(y)), 0, 0
        while lead < most and x[lead] == y[lead]:
            lead += 1
        while tail < most - lead and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return lead, tail

    def _lacking(self, x: Iterable[int], y: Iterable[int]) -> list[tuple[int, int]]:
        """Pairs of the classes x and y that have to be weighed before the two lists are aligned; long lists weigh their own."""
        left, right = set(x), set(y)
        if len(left) * len(right) > SHAPES:
            return []
        return [(p, q) for p in left for q in right if p != q and self.label[p] == self.label[q] and (p, q) not in self.weight]

    def _weights(self, x: list[int], y: list[int], place: Place | None) -> tuple[Callable[[int], np.ndarray], Place | None]:
        """Sizes of the mappings between a class of x, by its number, and the classes y, 0 where labels differ; and the place that gave them.

        ``place``: one that holds the classes y; it is asked if it still knows all x, as below a long list that was weighed.
        """
        if place is None or not place.knows(x):
            place = Place(self, y) if len(x) * len(y) > SHAPES else None
        if place is not None:
            at = np.searchsorted(place.classes, y)
            return lambda i: place.row(x[i])[at], place
        for pair in self._lacking(x, y):
            self.weigh(*pair)
        w = np.zeros((len(x), len(y)), np.int64)
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                if self.label[u] == self.label[v]:
                    w[i, j] = self.size[u] if u == v else self.weight[u, v]
        return w.__getitem__, None

    def weigh(self, u: int, v: int) -> int:
        stack = [(u, v)]
        while stack:
            pair = stack[-1]
            if pair in self.weight:
                stack.pop()
                continue
            x, y = self.kids[pair[0]], self.kids[pair[1]]
            lead, tail = self._ends(x, y)
            inner = x[lead : len(x) - tail], y[lead : len(y) - tail]
            todo = self._lacking(*inner)
            if todo:
                stack += todo
                continue
            self.weight[pair] = 1 + sum(self.size[c] for c in (*x[:lead], *x[len(x) - tail :])) + self._best(*inner)
        return self.weight[u, v]

    def _coded(self, x: tuple, y: tuple, place: Place | None = None):
        if self.last[0] != (x, y):  # lists are weighed, then aligned
            ux, ix = np.unique(np.array(x, np.int64), return_inverse=True)
            uy, iy = np.unique(np.array(y, np.int64), return_inverse=True)
            w, place = self._weights(ux.tolist(), uy.tolist(), place)
            self.last = (x, y), (w, ix, iy, place)
        return self.last[1]

    @staticmethod
    def _rows(w: Callable[[int], np.ndarray], ix: np.ndarray, iy: np.ndarray, row: np.ndarray):
        """Rows of the table of best alignments of the children before i with those before j, from its row ``row`` on."""
        yield row
        for i in ix:
            # Where labels differ the step is 0, and a row never falls.
            new = np.maximum(row[1:], row[:-1] + w(i)[iy])
            row = np.concatenate([[0], np.maximum.accumulate(new)])
            yield row

    def _best(self, x: tuple, y: tuple) -> int:
        if not x or not y:
            return 0
        w, ix, iy, _ = self._coded(x, y)
        for row in self._rows(w, ix, iy, np.zeros(len(iy) + 1, np.int64)):
            pass
        return int(row[-1])

    def _pairs(self, w: Callable[[int], np.ndarray], ix: np.ndarray, iy: np.ndarray) -> list[tuple[int, int]]:
        """Places of children that map to each other, traced from the end. Of a large table some rows are held and those
        between are made again on the way back, so that ties fall alike at every size.
        """
        out, j = [], len(iy)
        todo = [(0, len(ix), np.zeros(j + 1, np.int64))]
        while todo and j:
            low, high, first = todo.pop()
            rows = self._rows(w, ix[low:high], iy[:j], first[: j + 1])
            if (high - low) * (j + 1) > CELLS and high - low > 1:
                step = -(-(high - low) // min(high - low, max(2, CELLS // (j + 1))))
                for k, row in zip(range(low, high), rows):
                    if (k - low) % step == 0:
                        todo.append((k, min(k + step, high), row))
                continue
            rows, i = np.stack(list(rows)), high - low
            while i and j:
                if rows[i, j] == rows[i - 1, j]:
                    i -= 1
                elif rows[i, j] == rows[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((low + i, j))
        return out[::-1]

    def mapping(self) -> dict[int, int]:
        out, stack = {}, [(0, 0, None)]
        while stack:
            m, n, place = stack.pop()
            if self.of_a[m] == self.of_b[n]:  # below them all is the same
                out.update(zip(range(m, m + self.a.size[m]), range(n, n + self.b.size[n])))
                continue
            out[m] = n
            place = place and place.part(self.label[self.of_a[m]]).below
            p, q = self.a.kids[m], self.b.kids[n]
            x, y = tuple(self.of_a[k] for k in p), tuple(self.of_b[k] for k in q)
            lead, tail = self._ends(x, y)
            stack += [(i, j, None) for i, j in (*zip(p[:lead], q[:lead]), *zip(p[len(p) - tail :], q[len(q) - tail :]))]
            p, q, x, y = (v[lead : len(v) - tail] for v in (p, q, x, y))
            if len(x) == len(y) == 1:
                stack += [(p[0], q[0], place)] if self.label[x[0]] == self.label[y[0]] else []
            elif x and y:
                w, ix, iy, place = self._coded(x, y, place)
                stack += [(p[i], q[j], place) for i, j in self._pairs(w, ix, iy)]
        return out


class Part(NamedTuple):
    """The classes of a place that have one label: where they are, and the alignments of their children in one row."""

    at: np.ndarray
    full: np.ndarray  #: where those with children are
    first: np.ndarray  #: the first child of each
    last: np.ndarray
    none: np.ndarray  #: the row before any child is aligned
    flat: np.ndarray  #: the children, by their number below
    below: Place


class Place:
    """Classes of the second tree that stand in one place, in ascending order, to be weighed against any classes of the first.

    The children of a class are aligned with those of all classes here at once, child by child, so that as many numbers
    are needed as there are nodes below the place, however many the pairs are.
    """

    def __init__(self, matching: _Matching, classes: list[int], top: Place | None = None):
        self.matching, self.classes, self.top = matching, classes, top or self
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.count = 0
        self.at: dict[str, list[int]] = {}
        for k, c in enumerate(classes):
            self.at.setdefault(matching.label[c], []).append(k)
        self.parts: dict[str, Part] = {}

    def part(self, label: str) -> Part:
        if label not in self.parts:
            at = np.array(self.at.get(label, []), np.int64)
            kids = [self.matching.kids[self.classes[k]] for k in at]
            n = np.array([len(k) for k in kids], np.int64)
            full = n > 0
            below, flat = np.unique(np.array([c for k in kids for c in k], np.int64), return_inverse=True)
            ends = n.cumsum()[full]
            # Each class's alignments stand above all that those before it can reach, so that one running maximum serves all.
            none = np.repeat(np.arange(len(ends)) * (self.matching.b.size[0] + 1), n[full])
            self.parts[label] = Part(at, at[full], ends - n[full], ends - 1, none, flat, Place(self.matching, below.tolist(), self.top))
        return self.parts[label]

    def knows(self, classes: list[int]) -> bool:
        return all((id(self), c) in self.top.held for c in classes if self.matching.label[c] in self.at)

    def row(self, u: int) -> np.ndarray:
        """Sizes of the mappings between class u and each class here; 0 where labels differ."""
        m, held, stack = self.matching, self.top.held, [(self, u, 0, None)]
        if (id(self), u) in held:
            return held[id(self), u]
        while stack:
            place, c, i, best = stack.pop()
            part = place.part(m.label[c])
            kids, best = m.kids[c] if len(part.full) else (), part.none if best is None else best
            while i < len(kids):
                if m.label[kids[i]] in part.below.at:
                    step = held.get((id(part.below), kids[i]))
                    if step is None:
                        break
                    new = np.empty_like(best)
                    new[1:] = best[:-1]
                    new[part.first] = part.none[part.first]
                    new += step[part.flat]
                    best = np.maximum.accumulate(np.maximum(new, best, out=new), out=new)
                i += 1
            if i < len(kids):
                stack += [(place, c, i, best), (part.below, kids[i], 0, None)]
                continue
            out = np.zeros(len(place.classes), np.int64)
            out[part.at] = 1
            out[part.full] += (best - part.none)[part.last]
            self.top.count += len(out)
            if self.top.count > CELLS:
                held.clear()
                self.top.count = len(out)
            held[id(place), c] = out
        return out


@lru_cache(maxsize=512)
def _aligned(page: str, exemplar: str) -> dict[int, int]:
    return _Matching(tree(page), tree(exemplar)).mapping()


def align(page: str, exemplar: str) -> dict[int, int]:
    """Node of the page to node of the exemplar, both in preorder; kept for small skeletons only."""
    return _aligned(page, exemplar) if len(page) + len(exemplar) <= SMALL else _Matching(tree(page), tree(exemplar)).mapping()


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url):
    """Host of a url in lower case without port; what has none is its own host under the empty name."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Wrapper:
    """What induction has found for a layout: exemplar, template leaves (slot, text hash), content element, lists of links, first heading."""

    def __init__(self, exemplar: str, template, content: int, links, start: int):
        self.exemplar, self.content, self.start = exemplar, content, start
        self.template, self.links = {(x["slot"], x["hash"]) for x in template}, frozenset(links)

    def leaves(self, root: Node) -> list[Node] | None:
        """The content leaves of a page; None where it has no such element."""
        at = align(skeleton(root), self.exemplar)
        nodes, out, constant = preorder(root), [], []
        place = {id(x): k for k, x in enumerate(nodes)}
        top = next((k for k, n in at.items() if n == self.content), None)
        if top is None:
            return None
        first = next((k for k, n in at.items() if n == self.start), 0) if self.start else 0
        dropped = {id(nodes[top]): False}
        for k in range(top + 1, len(nodes)):
            x = nodes[k]
            if id(x.up) not in dropped:
                break
            gone = dropped[id(x.up)] or x.aside or at.get(k) in self.links
            dropped[id(x)] = gone
            if x.tag == "#" and not gone and place[id(x.up)] >= min(first, k):
                (constant if (at.get(k), text_hash(x.text)) in self.template else out).append(x)
        return out or constant


def main_text(page: str | None, wrapper: Wrapper | None) -> str:
    """The article of a page, by its layout's wrapper or by its own markup."""
    if not page:
        return ""
    root = parse(page)
    found = wrapper.leaves(root) if wrapper else None
    return "\n\n".join(x.text for x in found or _marked(root))


def _marked(root: Node) -> list[Node]:
    """The leaves of the outermost article elements, else of main, else of the densest element, without what is marked as another thing."""
    state = {id(root): (False, None, None)}
    leaves, tops = [], {"article": set(), "main": set()}
    for x in preorder(root)[1:]:
        gone, article, main = state[id(x.up)]
        inside = article is not None or main is not None
        gone = gone or x.aside or x.tag == "header" and not inside
        if not gone and x.tag in tops:
            article, main = (article or id(x), main) if x.tag == "article" else (article, main or id(x))
        state[id(x)] = gone, article, main
        if x.tag == "#" and not gone:
            leaves.append(x)
    for k in (1, 2):
        found = [x for x in leaves if state[id(x)][k] is not None]
        if found:
            return found
    return _densest(_unlinked(leaves))


def _unlinked(found: list[Node]) -> list[Node]:
    """Leaves without those that are mostly links and stand in a list or next to others of that kind."""
    return [x for x in found if not (x.linked * 2 > len(x.text) and (x.up.tag in ("li", "td", "div", "ul", "dd") or len(x.text) < 25))]


def _densest(found: list[Node]) -> list[Node]:
    """Leaves below the lowest element that holds most of the running text, and headings before it."""
    weight: dict[int, int] = {}
    total = 0
    for x in found:
        n = len(x.text) if x.up.tag in ("p", "blockquote", "pre", "li") or len(x.text) > 80 else 0
        total += n
        up = x.up
        while up is not None:
            weight[id(up)] = weight.get(id(up), 0) + n
            up = up.up
    if not total:
        return found
    top = found[0]
    while top.up is not None:
        top = top.up
    while True:
        down = [k for k in top.kids if k.tag != "#" and weight.get(id(k), 0) * 10 >= total * 7]
        if not down or down[0].tag in ("p", "blockquote", "pre", "li", "ul", "ol"):
            break
        top = down[0]

    def under(x: Node) -> bool:
        while x is not None and x is not top:
            x = x.up
        return x is top

    inner = [x for x in found if under(x)]
    before = found[: found.index(inner[0])] if inner else []
    return [x for x in before if x.up.tag == "h1"] + inner


def _shape(batches):
    for batch in small_batches(batches, "html"):
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for page in batch.column("html").to_pylist():
            root = parse(page) if page else Node("#root", "#root", None)
            found = [x for x in preorder(root) if x.tag == "#"]
            running = sorted({text_hash(x.text) for x in found if len(x.text) >= RUNNING and 2 * x.linked <= len(x.text)})
            for x, v in zip(out, (layout(root), text_hash(" ".join(map(str, running))), skeleton(root), [text_hash(x.text) for x in found], [len(x.text) for x in found], [x.linked for x in found])):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["host", "layout", "whole", "shape", "hashes", "chars", "linked"])


def told_apart(shapes: DataFrame) -> DataFrame:
    """Adds ``sig``, by which pages of a layout are one: their two longest running texts that are not constant.

    A text is constant if it is on ``SHARE`` of the layout's pages, those with the same running texts counted once. On a page
    nearly all of whose running text is constant it is the page that is repeated, not a notice on it: all its texts count.
    """
    running = F.filter(F.arrays_zip("hashes", "chars", "linked"), lambda x: (x["chars"] >= RUNNING) & (2 * x["linked"] <= x["chars"]))
    pages = shapes.groupBy("host", "layout").agg(F.countDistinct("whole").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    texts = shapes.select("host", "layout", "whole", F.explode(F.array_distinct(F.transform(running, lambda x: x["hashes"]))).alias("h")).distinct()
    seen = texts.groupBy("host", "layout", "h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).join(pages, ["host", "layout"])
    # A page's length over SHARE bounds how many there are of a layout.
    same = seen.where(F.col("n") >= SHARE * F.col("pages")).groupBy("host", "layout").agg(F.collect_list("h").alias("same"))
    same = materialize(same, "same")
    held = same.agg(F.coalesce(F.sum(F.size("same")), F.lit(0))).first()[0]
    rows = shapes.join(F.broadcast(same) if held <= FEW_TEXTS else same, ["host", "layout"], "left").withColumn("run", running)
    fresh = F.filter("run", lambda x: ~F.array_contains("same", x["hashes"]))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    usual = F.col("same").isNotNull() & (size(fresh) > (1 - COPIES) * size(F.col("run")))
    order = lambda xs: F.slice(F.array_sort(F.transform(xs, lambda x: F.struct((-x["chars"]).alias("c"), x["hashes"].alias("h")))), 1, 2)
    every = F.arrays_zip("hashes", "chars", "linked")
    longest = F.when(usual, order(fresh)).otherwise(order(F.when(F.size("run") > 0, F.col("run")).otherwise(every)))
    return materialize(rows.withColumn("sig", F.xxhash64(longest)).drop("same", "run", "whole"), "apart")


def _slots(batches):
    names = ["host", "like", "sig", "shape", "hashes", "chars", "linked", "exemplar"]
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for host, like, sig, shape, hashes, chars, linked, exemplar in zip(*(batch.column(c).to_pylist() for c in names)):
            at, page = align(shape, exemplar), tree(shape)
            for leaf, h, n, m in zip((k for k, x in enumerate(page.label) if x == "#"), hashes, chars, linked):
                k = leaf
                while k not in at:
                    k = page.up[k]
                for x, v in zip(out, (host, like, at[k], h, sig, n, m)):
                    x.append(v)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["host", "like", "slot", "hash", "sig", "chars", "linked"])


def wrap(exemplar: str, slots: list[dict]) -> tuple[list[dict], int, list[int], int] | None:
    """(template leaves, content element, lists of links, first heading or 0) from the counts of all slots; None without running text.

    ``slots``: slot, texts (distinct pages and texts), top (times of the commonest), hash (of that), chars and linked (in all).
    """
    t = tree(exemplar)
    template = [{"slot": x["slot"], "hash": x["hash"]} for x in slots if t.label[x["slot"]] == "#" and x["top"] >= LEAST_PAGES and x["top"] >= SHARE * x["texts"]]
    constant = {x["slot"] for x in template}
    seen = max((x["texts"] for x in slots if t.label[x["slot"]] == "#"), default=0)
    chars, linked, mass, texts = ([0] * len(t.label) for _ in range(4))
    for x in slots:
        n = x["slot"]
        chars[n], linked[n], texts[n] = x["chars"], x["linked"], x["texts"]
        mass[n] = 0 if n in constant or 2 * linked[n] > chars[n] else chars[n] - linked[n]
    for n in range(len(t.label) - 1, 0, -1):
        if not t.label[n].endswith("!"):
            for v in (chars, linked, mass):
                v[t.up[n]] += v[n]
    if not mass[0] or seen < LEAST_PAGES:
        return None
    content = 0
    while True:
        down = [k for k in t.kids[content] if mass[k] >= MOST * mass[0] and t.label[k] != "#" and not t.label[k].endswith("!") and t.tag(k) not in TEXT_TAGS]
        if not down:
            break
        content = down[0]
    inner = range(content + 1, content + t.size[content])
    links = [k for k in inner if t.label[k] != "#" and 2 * linked[k] > chars[k] > 0]
    start = 0
    if t.tag(content) not in ("article", "main"):
        for tag in ("h1", "h2"):
            heads = [k for k in inner if t.tag(k) == tag and 2 * max((texts[i] for i in t.kids[k]), default=0) >= seen]
            if heads:
                before = sum(mass[k] for k in range(content + 1, heads[0]) if t.label[k] == "#")
                start = heads[0] if before <= BEFORE * mass[content] else 0
                break
    return template, content, links, start


def _wrap(batches):
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        keep = []
        for i, (exemplar, slots) in enumerate(zip(batch.column("exemplar").to_pylist(), batch.column("slots").to_pylist())):
            found = wrap(exemplar, slots)
            if found:
                keep.append(i)
                for x, v in zip(out, (exemplar, *found)):
                    x.append(v)
        take = pa.array(keep, pa.int64())
        kinds = (pa.string(), pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64())])), pa.int32(), pa.list_(pa.int32()), pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("host", "like")), *(pa.array(x, k) for x, k in zip(out, kinds))], ["host", "like", "exemplar", "template", "content", "links", "start"])


def induce(pages: DataFrame) -> DataFrame:
    """Wrappers of ``pages(host, html)`` by (host, layout), for layouts that have one: see ``Wrapper``.

    Pages that ``told_apart`` takes for copies of one page count once, so copies do not make content look constant. A layout
    without a wrapper of its own, as those of small hosts are, takes that of the largest layout of its kind on another host.
    """
    shapes = materialize(pages.mapInArrow(_shape, "host string, layout long, whole long, shape string, hashes array<long>, chars array<int>, linked array<int>"), "shapes")
    read, shapes = shapes, told_apart(shapes.where("size(hashes) > 0 and host <> ''"))
    discard(read)
    # Ties and the choice go by hash, never by order.
    each = shapes.groupBy("host", "layout").agg(F.min(F.struct(F.xxhash64("sig").alias("h"), F.col("shape"))).alias("m"), F.count("*").alias("n"))
    each = materialize(each.select("host", "layout", "n", F.col("m.shape").alias("exemplar")), "layouts")
    common = each.groupBy("host").agg(F.max(F.struct("n", "layout", "exemplar")).alias("c"), F.sum("n").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    own = lambda c: F.when(F.col("n") >= LEAST_PAGES, F.col(c)).otherwise(F.col(f"c.{c}"))
    first = materialize(each.join(common, "host").select("host", "layout", own("layout").alias("like"), own("exemplar").alias("exemplar")), "exemplars")
    placed = shapes.join(first, ["host", "layout"]).mapInArrow(_slots, "host string, like long, slot int, hash long, sig long, chars int, linked int").distinct()
    counts = placed.groupBy("host", "like", "slot", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    best = counts.groupBy("host", "like", "slot").agg(F.sum("n").alias("texts"), F.max(F.struct("n", "hash")).alias("m"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    # As many rows as the exemplar has nodes come together.
    slots = best.groupBy("host", "like").agg(F.collect_list(F.struct("slot", "texts", F.col("m.n").alias("top"), F.col("m.hash").alias("hash"), "chars", "linked")).alias("slots"))
    whole = slots.join(first.where("layout = like").select("host", "like", "exemplar"), ["host", "like"]).select("host", "like", "exemplar", "slots")
    found = whole.mapInArrow(_wrap, "host string, like long, exemplar string, template array<struct<slot:int,hash:long>>, content int, links array<int>, start int")
    own = materialize(found.join(first.select("host", "layout", "like"), ["host", "like"]), "wrappers")
    parts = ["exemplar", "template", "content", "links", "start"]
    # One for each kind of layout: the most pages, then the least host.
    sized = own.where("layout = like").join(each.select("host", "layout", "n"), ["host", "layout"])
    shared = sized.groupBy("layout").agg(F.max_by(F.struct(*parts), F.struct("n", F.xxhash64("host"))).alias("w"))
    lacking = each.select("host", "layout").join(own.select("host", "layout"), ["host", "layout"], "left_anti").join(shared, "layout")
    return own.select("host", "layout", *parts).unionByName(lacking.select("host", "layout", *[f"w.{p}" for p in parts]))


def _layouts(batches):
    for batch in small_batches(batches, "html"):
        kinds = [layout(parse(page)) if page else None for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.int64())], [*batch.schema.names, "layout"])


def _read(batches):
    known: dict[tuple[str, int], Wrapper] = {}
    names = ["host", "layout", "html", "exemplar", "template", "content", "links", "start"]
    for batch in small_batches(batches, "html"):
        texts = []
        for host, kind, page, exemplar, *rest in zip(*(batch.column(c).to_pylist() for c in names)):
            wrapper = known.get((host, kind))
            if exemplar and wrapper is None:
                if len(known) > 256:
                    known.clear()
                wrapper = known[host, kind] = Wrapper(exemplar, *rest)
            texts.append(main_text(page, wrapper))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: (page_id, url, text, n_chars).

    ``text`` is the article's blocks joined by an empty line, character references decoded and white space within
    a block made one space; empty for null and empty pages and for pages without an article.
    Pages with a null or odd url, and those of hosts with too few pages, are read without a wrapper. Repeated rows are
    returned as often as given, rows with a null id like others; pages of any depth and width are read whole. Further columns
    are ignored; an empty table gives an empty result.
    """
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induce(rows.select("host", "html"))
    placed = rows.mapInArrow(_layouts, "page_id long, url string, html string, host string, layout long")
    columns = ["page_id", "url", "host", "layout", "html", "exemplar", "template", "content", "links", "start"]
    return placed.join(wrappers, ["host", "layout"], "left").select(columns).mapInArrow(_read, "page_id long, url string, text string, n_chars long")
