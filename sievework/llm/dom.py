"""DOM trees of pages, reduced for alignment, and simple tree matching between them.

A reduced node stands for an element that has text below it; inline elements
count as part of their block. Siblings of one label whose subtrees match are one
node, so a list has one node however long it is. A node's label is its tag with
the words of its class, id and role.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?![a-z0-9])", re.I) for tag in _RAW}
_IN_HEAD = frozenset("meta link title style script base noscript template".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul button select option label noscript template object svg canvas video audio map".split())
_CLOSES_P = _BLOCK - frozenset("button select option label noscript template object svg canvas video audio map td th tr tbody thead tfoot caption li dd dt".split())
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Elements nested deeper lie beside each other.
_DEEPEST = 120
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("hidden", "kids", "label", "tag")

    def __init__(self, tag: str, label: str, hidden: bool = False):
        self.tag, self.label, self.hidden = tag, label, hidden
        self.kids: list[Element | str] = []


def _named(tag: str, raw: str) -> Element:
    if not raw or "=" not in raw and "hidden" not in raw:
        return Element(tag, tag)
    found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)}
    words = {w.lower() for k in ("class", "id") for w in _WORD.findall(found.get(k, ""))}
    role = found.get("role", "").lower().split()
    parts = [tag, *sorted(words)] + ([f"role-{role[0]}"] if role and role[0].isalpha() else []) + (["role-main"] if "articlebody" in found.get("itemprop", "").lower() else [])
    style = found.get("style", "").replace(" ", "").lower()
    return Element(tag, ".".join(parts), "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style)


def parse(page: str) -> Element:
    """The tree of a page: tags may be missing, misplaced or cut off; nothing but markup is lost."""
    root = Element("html", "html")
    stack, at = [root], 0

    def add(text: str) -> None:
        if text:
            stack[-1].kids.append(text)

    def close(tags, bounds=frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in bounds:
                return

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag in _BLOCK:
                close({tag})
            elif tag != "br":
                close({tag}, _BLOCK)
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            stack.pop()
        if tag in _RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in _IMPLIED:
            for _ in range(3):
                before = len(stack)
                close(*_IMPLIED[tag])
                if len(stack) == before:
                    break
        elif tag in _CLOSES_P:
            close({"p"}, _BLOCK - {"p"})
        node = _named(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag not in _VOID and len(stack) < _DEEPEST:
            stack.append(node)
    add(page[at:])
    return root


class Node:
    """A reduced node: its label, its nodes below, and the numbers of the blocks whose text is its own."""

    __slots__ = ("blocks", "kids", "label", "size")

    def __init__(self, label: str, kids: list[Node], blocks: list[int]):
        self.label, self.kids, self.blocks = label, kids, blocks
        self.size = 1 + sum(k.size for k in kids)


def _align(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of the nodes below a and b: the number of matched nodes, and which of them match."""
    shared = {x.label for x in a.kids} & {x.label for x in b.kids}
    left = [i for i, x in enumerate(a.kids) if x.label in shared]
    right = [j for j, x in enumerate(b.kids) if x.label in shared]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    weight = {}
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if a.kids[x].label == b.kids[y].label:
                weight[i, j] = matched(a.kids[x], b.kids[y])
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + weight[i, j])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if (i, j) in weight and best[i][j] == best[i - 1][j - 1] + weight[i, j]:
            pairs.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def matched(a: Node, b: Node) -> int:
    """How many nodes of two trees simple tree matching pairs; 0 where the roots' labels differ."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    return 1 + _align(a, b)[0]


def union(a: Node, b: Node) -> Node:
    """One tree of two with equal roots: matched nodes once, the others where they stand."""
    if not b.kids:
        return Node(a.label, a.kids, a.blocks + b.blocks)
    kids, done = [], 0
    at = 0
    for i, j in [*_align(a, b)[1], (len(a.kids), len(b.kids))]:
        kids += a.kids[at:i] + b.kids[done:j]
        if i < len(a.kids):
            kids.append(union(a.kids[i], b.kids[j]))
        at, done = i + 1, j + 1
    return Node(a.label, kids, a.blocks + b.blocks)


def alike(a: Node, b: Node) -> bool:
    return 4 * matched(a, b) >= a.size + b.size


def _folded(kids: list[Node]) -> list[Node]:
    """Siblings that match joined into the first of them."""
    out: list[Node] = []
    where: dict[str, list[int]] = {}
    for k in kids:
        for i in where.get(k.label, ()):
            if alike(out[i], k):
                out[i] = union(out[i], k)
                break
        else:
            where.setdefault(k.label, []).append(len(out))
            out.append(k)
    return out


class Page:
    """The blocks of a page (text, and characters of it in links) in page order, and its reduced tree."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        self._parts: list[str] = []
        self._linked = 0
        self.tree = self._reduce(parse(page)) or Node("html", [], [])

    def _flush(self, own: list[int]) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            own.append(len(self.texts))
            self.texts.append(text)
            self.links.append(min(self._linked, len(text)))
        self._parts, self._linked = [], 0

    def _inline(self, node: Element, own: list[int], kids: list[Node], linked: bool) -> None:
        for x in node.kids:
            if isinstance(x, str):
                text = html.unescape(x)
                self._parts.append(text)
                self._linked += len(" ".join(text.split())) if linked else 0
            elif x.tag == "br":
                self._flush(own)
            elif x.tag in _BLOCK:
                self._flush(own)
                kid = None if x.hidden else self._reduce(x)
                if kid is not None:
                    kids.append(kid)
            elif not x.hidden:
                self._inline(x, own, kids, linked or x.tag == "a")

    def _reduce(self, node: Element) -> Node | None:
        own: list[int] = []
        kids: list[Node] = []
        self._inline(node, own, kids, False)
        self._flush(own)
        return Node(node.label, _folded(kids), own) if own or kids else None


def nodes(tree: Node) -> list[Node]:
    """All nodes, each before those below it."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.kids[::-1]
    return out


def written(tree: Node) -> str:
    """A tree as text: a line a node, its depth and label."""
    out, todo = [], [(0, tree)]
    while todo:
        d, x = todo.pop()
        out.append(f"{d} {x.label}")
        todo += [(d + 1, k) for k in x.kids[::-1]]
    return "\n".join(out)


def read(text: str) -> Node:
    lines = [line.split(" ", 1) for line in text.split("\n")]
    made = [Node(label, [], []) for _, label in lines]
    path: list[Node] = []
    for (depth, _), x in zip(lines, made, strict=True):
        del path[int(depth) :]
        if path:
            path[-1].kids.append(x)
        path.append(x)
    for x in reversed(made):
        x.size = 1 + sum(k.size for k in x.kids)
    return made[0]


def mapping(tree: Node, template: Node) -> list[int]:
    """For each node of tree, in order, the number of the template's node it is aligned with, or -1."""
    number = {id(x): i for i, x in enumerate(nodes(template))}
    found: dict[int, int] = {}
    todo = [(tree, template)]
    while todo:
        a, b = todo.pop()
        found[id(a)] = number[id(b)]
        todo += [(a.kids[i], b.kids[j]) for i, j in _align(a, b)[1]]
    return [found.get(id(x), -1) for x in nodes(tree)]
