"""Main text of web pages by tree scoring.

A page is cut into tags and text, made into a tree with HTML's implied end tags, and freed
of parts that are not prose (menus, forms, scripts, adverts, comments and the like). Each
paragraph passes points for its length and commas to its ancestors, less at each step; a
container's points are discounted by the share of its text that is in links. The best container
is kept, with siblings that score well, and its blocks are written in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.workspace import ship

ship()

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("script style noscript template svg math head title nav header footer aside form button select option input textarea iframe object embed canvas video audio dialog menu map noembed noframes applet label fieldset".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption fieldset form header footer nav aside hgroup search".split()
)
#: What a start tag closes, and the elements at which the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Names in class or id that mark parts outside the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|modal|popup|overlay|comment|comments|commentlist|respond|reply|replies|disqus|discussion|"
    r"share|sharing|social|sidebar|side|aside|rail|widget|widgets|menu|nav|navbar|navigation|topbar|breadcrumb|breadcrumbs|pager|pagination|footer|foot|masthead|header|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|toolbar|skip|paywall|disclaimer|legal|copyright|outbrain|taboola|tags|tagcloud)(?:$|[\s_-]|\d)",
    re.I,
)
#: Names that mark the article itself, whatever else is there.
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|main|post|story|entry|body|text|prose)(?:$|[\s_-]|\d)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status tooltip".split())
STATES = ("has-", "with-", "no-", "without-", "js-", "is-")
_CAMEL = re.compile(r"([a-z])([A-Z])")
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 section div article main body".split())
#: Points: one for a block of FULL characters or more, one for each comma, up to three for length.
FULL, PER, MOST = 25, 100, 3.0
STEPS = 5
SIBLING = 0.2
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WANTED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))
_SPACE = re.compile(r"\s+")
_COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "score", "chars", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def _attributes(source: str) -> dict[str, str]:
    if not source.strip(" /\n\t"):
        return {}
    return {n.lower(): html.unescape(a or b or c) for n, a, b, c in _ATTR.findall(source) if n.lower() in _WANTED}


def _unwanted(tag: str, attrs: dict[str, str], by_name: bool) -> bool:
    """Parts that are no article text."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if (style := attrs.get("style")) and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I):
        return True
    if not by_name:
        return False
    # state of the page, not the name of a part: has-sidebar, with-comments
    said = [n for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if not n.lower().startswith(STATES)]
    names = _CAMEL.sub(r"\1-\2", " ".join(said))
    return bool(UNLIKELY.search(names)) and not (tag in ("article", "main") and LIKELY.search(names) and not re.search("comment", names, re.I))


def parse(source: str, by_name: bool = True) -> Node:
    """The page's tree, without unwanted parts and without markup comments. Anything is accepted; what is cut off inside a tag is dropped."""
    root = Node("html", {}, None)
    node, at, skip = root, 0, 0  # skip: depth inside an unwanted part
    skipped: list[str] = []
    end = len(source)
    while at < end:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else end]
        if text and not skip:
            node.kids.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        closing, name, rest = m[1], m[2], m[3]
        if not name:
            continue
        tag = name.lower()
        if closing:
            if skip:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                    skip = len(skipped)
                    continue
                if tag not in ("body", "html", "article", "main"):
                    continue
                skipped.clear()  # the part was never closed
                skip = 0
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag == "p":
                node.kids.append(Node("p", {}, node))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if skip:
            if tag not in VOID and not rest.endswith("/"):
                skipped.append(tag)
                skip = len(skipped)
            continue
        if tag in ("html", "body"):
            continue
        attrs = _attributes(rest)
        if tag in VOID:
            if tag == "br":
                node.kids.append("\n")
            elif tag == "hr":
                node.kids.append(Node("hr", {}, node))
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            up = node
            while up is not root and up.tag != "p" and up.tag not in ("table", "td", "th", "li", "blockquote", "div", "article", "section"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            up, last = node, None
            while up is not root and up.tag not in stop:
                if up.tag in closed:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        if _unwanted(tag, attrs, by_name):
            skipped.append(tag)
            skip = 1
            node.kids.append(Node("hr", {}, node))  # what stood here parts the text around it
            continue
        kid = Node(tag, attrs, node)
        node.kids.append(kid)
        node = kid
    return root


def _measure(node: Node, in_link: bool) -> None:
    """Characters and linked characters of every subtree, children before parents."""
    stack: list[tuple[Node, bool, bool]] = [(node, in_link, False)]
    while stack:
        n, linked, done = stack.pop()
        linked = linked or n.tag == "a"
        if done:
            for k in n.kids:
                if isinstance(k, str):
                    size = len(_SPACE.sub(" ", k).strip())
                    n.chars += size
                    n.linked += size if linked else 0
                else:
                    n.chars += k.chars
                    n.linked += k.linked
        else:
            stack.append((n, linked, True))
            stack += [(k, linked, False) for k in n.kids if isinstance(k, Node)]


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]


def _own_text(node: Node) -> str:
    """Text of a node outside its blocks."""
    parts: list[str] = []
    stack: list[Node | str] = [*reversed(node.kids)]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(k)
        elif k.tag not in BLOCK:
            stack += reversed(k.kids)
    return _SPACE.sub(" ", "".join(parts)).strip()


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _best(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    top, most = root, 0.0
    for n in _walk(root):
        if n.tag not in SCORED and n is not root:
            continue
        text = _own_text(n)
        if not text:
            continue
        points = (min(1.0, len(text) / FULL) + len(_COMMA.findall(text)) + min(MOST, len(text) / PER)) * (1 - _density(n))
        share, up = 1.0, n.parent if n.tag not in ("div", "section", "article", "main", "body") and n.parent is not None else n
        for step in range(STEPS):
            if up is None:
                break
            up.score += points * share
            up, share = up.parent, 1 / (2 if step == 0 else 3 * step)
    for n in _walk(root):
        if n.score:
            n.score *= 1 - _density(n)
            if n.score > most:
                top, most = n, n.score
    up = top
    while up is not None:  # the article around the best container is the better one
        if up.tag in ("article", "main") or up.attrs.get("itemprop", "").lower() == "articlebody" or up.attrs.get("role", "").lower() in ("main", "article"):
            top = up
            break
        up = up.parent
    if top.parent is None:
        return [top]
    kept = []
    for s in top.parent.kids:
        if isinstance(s, str):
            continue
        if s is top or s.score >= max(1.0, SIBLING * most) or s.tag in ("p", "blockquote", "pre") and _density(s) < 0.25 and s.chars > 80:
            kept.append(s)
    return kept


def _link_list(n: Node) -> bool:
    """A list or box that is mostly links."""
    return n.tag in ("ul", "ol", "div", "table", "section", "dl") and n.chars > 0 and _density(n) > 0.6 and sum(k.tag == "a" for k in _walk(n)) >= 3


def blocks(root: Node) -> list[str]:
    out: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(open_)).strip()
        open_.clear()
        if text:
            out.append(text)

    for container in _best(root):
        stack: list[Node | str | None] = [container]
        close()
        while stack:
            k = stack.pop()
            if k is None:
                close()
            elif isinstance(k, str):
                open_.append(k)
            elif k.tag in BLOCK:
                close()
                if not _link_list(k):
                    stack.append(None)
                    stack += reversed(k.kids)
            else:
                stack += reversed(k.kids)
        close()
    return out


def extract(source: str | None) -> str:
    """Main text: blocks joined by an empty line; empty if there is none."""
    if not source:
        return ""
    for by_name in (True, False):  # a page whose outermost box has an unlikely name is read without regard to names
        root = parse(source, by_name)
        _measure(root, False)
        if found := blocks(root):
            return "\n\n".join(found)
    return ""


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` without ``page`` but with ``text`` and ``n_chars`` (its code points).

    One task per input partition, page by page: no shuffle, memory bounded by the longest
    page. Null pages give an empty text; other columns pass through, and columns of the two names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", page)]
    source = pages.select(*kept, pages[page].alias("_page"))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("_page").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p.as_py()) for p in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*b.schema.names[: len(kept)], "text", "n_chars"],
            )

    return source.mapInArrow(run, f"{shape}text string, n_chars bigint")
