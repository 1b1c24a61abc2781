"""Main text of web pages by composite text density.

A page is parsed to a tree (raw text of scripts, implied end tags, unclosed elements, broken
markup). Elements that never hold an article's text by their tag (scripts, styles, nav, footer, aside, controls, a header outside
of an article) or that are hidden are left out. Every remaining node has characters C, tags T, link characters LC and
link tags LT of its subtree, zero divisors read as one, and the density

    C/T * ln(C/LC * T/LT) / ln(ln(C/(C - LC) * LC + LCbody/Cbody * C + e))

times a prior: class, id and role names of boilerplate lower it, the more if the whole name says so than if its first or last word
does, and article and main elements raise it. Names alone decide nothing.

The node with the largest sum of its children's densities (its own text counts as a child) is the main subtree; the
threshold is the least density on its path from the body. Every node at or above the threshold gives the
subtree of largest sum in it. If the main subtree stands in an article or main element, only subtrees in that element count, and
it is taken whole if they hold half of its characters; elsewhere a subtree grows to the parents of which it is most, and
takes the headings before it. In what is taken, what is named as boilerplate and lies below the
threshold goes, except where the main subtree is, and so do lists of links; but in the article (or, without one, the main subtree) a list of links
that follows text and is not named as boilerplate stays, as references do.

Blocks keep page order; white space in a block is one space. Null or empty html, or a page without text: empty text. Pages of any
length are read whole; of equal sums the outermost, first node is the main subtree.
Repeated rows repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

# Element names by role in the tree.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What a start tag ends if it is open, up to the element at which that stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LEFT_OUT = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "iframe", "button", "select", "option", "textarea", "input", "svg", "canvas", "object", "audio", "video", "menu", "dialog", "title", "xmp"}
_NAMES = re.compile(r"^(?:ad|ads|adv|advert|adverts|advertisement|adsense|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|aside|footer|header|masthead|topbar|toolbar|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|disqus|reply|replies|respond|discussion|widget|pagination|pager|copyright|legal|complementary|contentinfo|search|form|disclaimer|skip|tags|hidden)$")
#: Before such a word a name says what an element has or lacks, not what it is.
_ABOUT = {"has", "have", "with", "without", "no", "not", "non", "by", "is", "show", "hide", "enable", "disable", "use", "sans"}
#: Prior of a node that is named as boilerplate as a whole, and by a word of its name; of an article or main element.
WHOLE, PART, SCOPED = 1 / 16, 1 / 4, 2.0
#: Only of these a part of the name tells: text elements are what they hold.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "blockquote", "pre", "b", "i", "em", "strong", "q", "code", "a", "tr", "tbody", "html", "body", "article", "main"}
#: A list of links: so many at least, with such a share of the text.
LINKS, LINKED = 3, 0.6
_SCOPE = {"article", "main"}
_QUOTE = re.compile(r"=\s*([\"'])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "items", "scope", "out", "prior", "chars", "tags", "link_chars", "link_tags", "density", "total", "top")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, prior: float = 1.0):
        self.tag, self.parent, self.items, self.out, self.prior = tag, parent, [], out, prior
        self.scope = tag in _SCOPE or parent is not None and parent.scope
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.top = self

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and not x.out]


def _tag_end(html: str, at: int) -> int:
    """Just after the > of a tag that begins before at, quotes honoured; the end of the text if it never closes."""
    while True:
        end = html.find(">", at)
        if end < 0:
            return len(html)
        quote = _QUOTE.search(html, at, end)
        if not quote:
            return end + 1
        close = html.find(quote[1], quote.end())
        if close < 0:
            return end + 1
        at = close + 1


def _judged(tag: str, attributes: str, scope: bool) -> tuple[bool, float]:
    """Whether it is left out, and its prior."""
    if tag in LEFT_OUT or tag == "header" and not scope:
        return True, 1.0
    prior = WHOLE if tag == "form" else SCOPED if tag in _SCOPE and not scope else 1.0
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return True, 1.0
            if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
                prior = min(prior, *(_named(tag, part) for part in value.split()), 1.0 if scope and tag in _TEXT else prior)
    return False, prior


def _named(tag: str, name: str) -> float:
    """The prior that a name gives: by all of it, or by its first or last word, unless it says what an element has or lacks."""
    if _NAMES.match(name.lower()):
        return WHOLE
    words = [w.lower() for w in _SPLIT.split(name[:1].lower() + name[1:]) if w]
    if len(words) < 2 or tag in _TEXT or _ABOUT.intersection(words[:-1]):
        return 1.0
    return PART if _NAMES.match(words[0]) or _NAMES.match(words[-1]) else 1.0


def parse(html: str) -> Node:
    """The tree; items of a node are texts and nodes in order."""
    root = Node("#root", None)
    here, at, n = root, 0, len(html)
    depth: Counter[str] = Counter()  # open elements by tag

    def left(to: Node) -> Node:
        """Ends what is open inside of to."""
        up = here
        while up is not to:
            depth[up.tag] -= 1
            up = up.parent
        return to

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            here.items.append(html[at:lt])
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(html, lt + 1)
        if not name:
            if html[lt + 1 : lt + 2] in ("!", "?") or html[lt + 1 : lt + 3] == "</":
                at = _tag_end(html, lt + 1)
            else:
                here.items.append("<")
                at = lt + 1
            continue
        tag, closing = name[1].lower(), html[lt + 1] == "/"
        at = _tag_end(html, name.end())
        if closing:
            if depth[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = left(up.parent)
            continue
        if tag in ENDS and any(depth[x] for x in ENDS[tag][0]):
            which, stop = ENDS[tag]
            up, last = here, None
            while up is not root and up.tag not in stop:
                if up.tag in which:
                    last = up
                up = up.parent
            if last:
                here = left(last.parent)
        elif tag in BLOCK and depth["p"]:
            up = here
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "article", "section", "main", "body", "blockquote"):
                up = up.parent
            if up is not root and up.tag == "p":
                here = left(up.parent)
        attributes = html[name.end() : at - 1]
        node = Node(tag, here, *_judged(tag, attributes, here.scope))
        here.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else n
            node.items.append(html[at:stop])
            at = _tag_end(html, stop + 2) if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
            depth[tag] += 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All that is not left out, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children()))
    return out


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Of characters, tags, link characters and link tags; share: of link characters in the body."""
    if not c:
        return 0.0
    t, links, lt = max(t, 1), max(lc, 1), max(lt, 1)
    return c / t * math.log(c / links * t / lt) / math.log(math.log(c / max(c - lc, 1) * links + share * c + math.e))


def measure(root: Node) -> tuple[list[Node], Node]:
    """All nodes, measured, and the body."""
    nodes, own = _nodes(root), {}
    for node in reversed(nodes):
        own[node] = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        node.chars += own[node]
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags += 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    body = next((x for x in nodes if x.tag == "body"), root)
    share, weight = body.link_chars / max(body.chars, 1), {None: 1.0}
    for node in nodes:
        weight[node] = weight[node.parent] * node.prior
        node.density = weight[node] * density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(nodes):
        linked = own[node] if node.tag == "a" else 0
        children = node.children()
        node.total = sum(x.density for x in children) + weight[node] * density(own[node], 0, linked, linked and 1, share)
        for x in reversed(children):
            if x.top.total > node.top.total or node.top is not node and x.top.total == node.top.total:
                node.top = x.top
    return nodes, body


def _chosen(nodes: list[Node], body: Node) -> tuple[list[Node], set[Node], float]:
    """The subtrees of the text, in page order; the main subtree's path; the threshold."""
    best, path = body.top, []
    up = best
    while up is not None:
        path.append(up)
        up = up.parent if up is not body else None
    threshold = min(x.density for x in path)
    scope = next((x for tag in ("article", "main") for x in reversed(path) if x.tag == tag), body)
    inside, dense = {scope}, {best}
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
        if node in inside and node.chars and node.density >= threshold:
            dense.add(node.top)
    if scope is not body:
        covered = _covered([x for x in nodes if x in inside], dense)
        held = sum(x.chars for x in dense if x.parent not in covered)
        if 2 * held >= scope.chars:
            dense = {scope}
    else:
        grown = set()
        for x in dense:
            while x is not body and x.parent not in (None, body) and 10 * x.chars >= 7 * x.parent.chars:
                x = x.parent
            grown.add(x)
        dense = grown | {h for x in grown if x is not body and x.parent is not None for h in _headings(x)}
    covered = _covered(nodes, dense)
    return [x for x in nodes if x in dense and x.parent not in covered], set(path), threshold


def _covered(nodes: list[Node], tops: set[Node]) -> set[Node]:
    """The nodes in the subtrees. nodes: parents first."""
    out: set[Node] = set()
    for node in nodes:
        if node in tops or node.parent in out:
            out.add(node)
    return out


def _headings(node: Node) -> list[Node]:
    """h1 and h2 just before it."""
    out = []
    for x in node.parent.children():
        if x is node:
            return out
        out = [*out, x] if x.tag in ("h1", "h2") else []
    return out


def main_nodes(root: Node) -> list[Node]:
    """The subtrees of the text; what goes in them is marked as left out."""
    nodes, body = measure(root)
    tops, path, threshold = _chosen(nodes, body)
    own, said = _covered(nodes, {x for x in path if x.scope} or {body.top}), 0
    for node in nodes:
        if node not in path and node.chars:
            listed = node.link_tags >= LINKS and node.link_chars >= LINKED * node.chars and node.tag not in ("p", "a")
            node.out = listed and not (node in own and node.prior >= 1 and said) or node.prior < 1 and node.density < threshold
        if node in own:
            said += not node.link_chars and any(isinstance(x, str) and x.strip() for x in node.items)
    return [x for x in tops if not x.out]


def texts(nodes: list[Node]) -> list[str]:
    """The blocks of the subtrees in page order."""
    blocks: list[list[str]] = [[]]
    for top in nodes:
        stack: list[tuple[object, bool]] = [(top, False)]
        while stack:
            x, leaving = stack.pop()
            if isinstance(x, str):
                blocks[-1].append(unescape(x) if "&" in x else x)
                continue
            if x.tag in BLOCK and blocks[-1]:
                blocks.append([])
            elif x.tag == "br":
                blocks[-1].append(" ")
            if not leaving:
                stack.append((x, True))
                stack.extend((y, False) for y in reversed(x.items) if isinstance(y, str) or not y.out)
    return [b for b in (" ".join("".join(parts).split()) for parts in blocks) if b]


def extract(html: str | None) -> str:
    return "\n".join(texts(main_nodes(parse(html)))) if html else ""


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def make():
        def one(page_id, url, html):
            text = extract(html)
            return page_id, url, text, len(text)

        return one

    return map_rows(pages, ["page_id", "url", "html"], OUT, make)
