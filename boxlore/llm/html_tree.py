"""One page as a tree of block elements with its text blocks, and the matching of two such trees."""

from __future__ import annotations

import html
import re
from functools import lru_cache

#: element names by kind (fixed values of the HTML language)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an element of this name ends open ones of these names
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
} | {h: HEADINGS for h in HEADINGS}
KEEPS_IN = frozenset("table ul ol dl td th article section div body".split())
#: elements, and words in class, id and role, of what is no article text (fixed values)
NO_TEXT_TAGS = frozenset("nav aside footer form button dialog menu search fieldset".split())
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social sidebar related "
    "recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation pagination pager comment comments reply replies "
    "respond disqus footer header masthead toolbar widget login signup search complementary contentinfo dialog skip".split()
)
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CUT_TAG = re.compile(r"</?[a-zA-Z][^>]*\Z")  # a tag that the end of the page cuts off
#: elements nested deeper hang on the one at this depth; their text stays
DEEPEST = 200
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "words", "hidden", "parent", "children", "index", "number")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children, self.index, self.number = tag, parent, [], -1, -1
        self.words, self.hidden = frozenset(), False
        if attributes:
            words = set()
            for name, *values in _ATTRIBUTE.findall(attributes):
                value, name = "".join(values).lower(), name.lower()
                if name in ("class", "id", "role"):
                    words.update(_WORD.findall(value))
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.hidden = True
                elif name == "style" and re.search(r"display\s*:\s*none", value):
                    self.hidden = True
            self.words = frozenset(words)
        if parent is not None:
            parent.children.append(self)


class Page:
    """``nodes`` in page order; ``blocks`` are (node, text, characters inside links)."""

    def __init__(self, source: str):
        self.nodes = [Node("html", "", None)]
        self.blocks: list[tuple[Node, str, int]] = []
        self._read(source)
        self.skeleton = self._fold()

    def _read(self, source: str) -> None:
        open_nodes, text, linked, in_link, at = [self.nodes[0]], [], 0, False, 0

        def flush() -> None:
            nonlocal linked
            joined = " ".join("".join(text).split())
            if joined:
                self.blocks.append((open_nodes[-1], joined, min(linked, len(joined))))
            text.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                linked += len(piece) if in_link else 0

        while (found := _TAG.search(source, at)) is not None:
            add(source[at : found.start()])
            at = found.end()
            closing, tag, attributes = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not closing and not attributes.rstrip().endswith("/"):
                    if tag == "head":  # ends at its end tag or where the body begins
                        end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(source, at)
                    else:
                        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else (at if tag == "head" else len(source))
                    text.append(" ")
            elif tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = not closing
            elif tag in BLOCKS:
                flush()
                if closing:
                    for k in range(len(open_nodes) - 1, 0, -1):
                        if open_nodes[k].tag == tag:
                            del open_nodes[k:]
                            break
                elif tag in ("html", "body"):
                    if tag == "body" and len(open_nodes) == 1:
                        open_nodes.append(self._new(tag, attributes, open_nodes[-1]))
                elif tag != "hr":
                    ended = ENDS.get(tag, frozenset())
                    for k in range(len(open_nodes) - 1, 0, -1):
                        if open_nodes[k].tag == "p" or open_nodes[k].tag in ended:
                            del open_nodes[k:]
                        elif open_nodes[k].tag in KEEPS_IN:
                            break
                    open_nodes.append(self._new(tag, attributes, open_nodes[min(len(open_nodes), DEEPEST) - 1]))
                in_link = False
        add(_CUT_TAG.sub("", source[at:]))
        flush()

    def _new(self, tag: str, attributes: str, parent: Node) -> Node:
        node = Node(tag, attributes, parent)
        self.nodes.append(node)
        return node

    def _fold(self) -> tuple:
        """The tree as (signature, children); neighbours of equal structure become one. Nodes get its numbering."""
        shapes: dict[Node, tuple] = {}
        for node in reversed(self.nodes):  # children come after their parent
            folded: list[tuple] = []
            for child in node.children:
                if not folded or folded[-1] != shapes[child]:
                    folded.append(shapes[child])
            shapes[node] = (".".join([node.tag, *sorted(node.words)]), tuple(folded))
        sizes: dict[tuple, int] = {}

        def size(shape: tuple) -> int:
            if shape not in sizes:
                sizes[shape] = 1 + sum(map(size, shape[1]))
            return sizes[shape]

        self.nodes[0].index = 0
        for node in self.nodes:
            at, before = node.index + 1, None
            for child in node.children:
                if before is not None and shapes[child] != shapes[before]:
                    at += size(shapes[before])
                child.index = at
                before = child
        return shapes[self.nodes[0]]


def numbered(tree: tuple) -> list[tuple]:
    """The nodes of a skeleton in page order."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node[1]))
    return out


def parents(tree: tuple) -> list[int]:
    """For each number of a skeleton that of its parent; -1 for the root."""
    out: list[int] = []

    def walk(node: tuple, parent: int) -> None:
        number = len(out)
        out.append(parent)
        for child in node[1]:
            walk(child, number)

    walk(tree, -1)
    return out


@lru_cache(maxsize=4096)
def align(page: tuple, reference: tuple) -> dict[int, int]:
    """Simple tree matching: numbers of the page's nodes -> those of the reference, most pairs, in order.

    Roots of different signatures don't match; children are matched in order by
    dynamic programming over the sizes of their own matchings.
    """
    sizes: dict[tuple, int] = {}

    def size(tree: tuple) -> int:
        if tree not in sizes:
            sizes[tree] = 1 + sum(map(size, tree[1]))
        return sizes[tree]

    done: dict[tuple, tuple[int, list]] = {}

    def match(a: tuple, b: tuple) -> tuple[int, list]:
        """Number of pairs, and which children are paired."""
        if a[0] != b[0]:
            return 0, []
        if (known := done.get((a, b))) is not None:
            return known
        rows, columns = a[1], b[1]
        best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
        for i, x in enumerate(rows, 1):
            for j, y in enumerate(columns, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + match(x, y)[0])
        paired, i, j = [], len(rows), len(columns)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                paired.append((i, j))
        done[a, b] = 1 + best[-1][-1], paired[::-1]
        return done[a, b]

    out: dict[int, int] = {}

    def walk(a: tuple, b: tuple, x: int, y: int) -> None:
        out[x] = y
        starts = [[at + 1 + sum(map(size, tree[1][:k])) for k in range(len(tree[1]))] for tree, at in ((a, x), (b, y))]
        for i, j in match(a, b)[1]:
            walk(a[1][i], b[1][j], starts[0][i], starts[1][j])

    if match(page, reference)[0]:
        walk(page, reference, 0, 0)
    return out
