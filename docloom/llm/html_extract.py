"""Main text of web pages by scoring the tree of elements.

Paragraphs earn points for length and commas and pass them to their ancestors, less
with every level; a container's points are discounted by the share of its text that
stands in links.  The best container is kept, with the siblings that hold prose or
headings.  What is never part of an article (menus, forms, adverts, notices, comments
and the like, by element, role or class) is cut before.  Everything left in what is kept
stays: its text is whole, in page order, one block of text after the other.

Each page is parsed on its own; nothing is shuffled.  Work and memory grow with the
page: the end of a tag is looked for once, and open elements are found by their depths,
not by walks along the stack.

Defined cases.  Null or empty html, or one without text: the empty string.  Tags left
open or closed twice are mended as browsers do; a tag whose quotes never close ends at
the next >, and no quotes count from then on.  Very long pages: as above.  Ties: of
containers that score alike the first scored.  Repeated rows and null ids: each row on
its own.  Empty table: no rows.  Extra columns are kept by `extract`, where text and
n_chars replace columns of those names, and ignored by `report`.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
COMMENT_END = re.compile(r"--!?>")
MARK = re.compile(r"[>\"']")
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# The elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
CUT_TAGS = frozenset(
    "nav footer aside form button select input textarea menu dialog object applet canvas audio video fieldset"
    " noscript template iframe script style svg math head label".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion"
    " sidebar sidenav aside menu submenu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social comment comments commentlist disqus respond replies related recommended recommendations"
    " pagination pager widget widgets skip".split()
)
#: Words that say where or how a block stands, not what it is.
PLAIN_WORDS = frozenset(
    "area article bar block blog body bottom box btn button buttons col column container content fixed full global group"
    " holder inner item items layout left link links list main mobile module new outer page panel post primary region right"
    " row secondary section site slot space story sticky text title top unit wrap wrapper zone entry desktop js is has"
    " user reader count form thread sub left right".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
PARAGRAPH = frozenset("p pre blockquote td li dd div section article main body".split())
KEEP = frozenset("html body article main".split())
#: Start tag -> the open elements it ends, and those that shield them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "block", "score", "chars", "links", "heads", "in_article")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, in_article: bool = False):
        self.tag, self.parent, self.cut, self.in_article = tag, parent, cut, in_article
        #: The innermost block that this is in, or is.
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.kids: list[Node | str] = []
        self.score, self.chars, self.links, self.heads = 0.0, 0, 0, 0


def _names_clutter(value: str) -> bool:
    """Whether a class or id, as a whole, names what is no article: `ad-slot`, but not `share-price`."""
    for token in value.split():
        parts = [w.lower() for w in PARTS.findall(token)]
        if any(w in CUT_WORDS for w in parts) and all(w in CUT_WORDS or w in PLAIN_WORDS or w.isdigit() for w in parts):
            return True
    return False


def _is_cut(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CUT_TAGS or tag == "header" and not in_article:
        return True
    if not attrs or attrs.isspace() or tag in KEEP:
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            if _names_clutter(value) or "header" in value.lower().split() and not in_article:
                return True
        elif name == "role" and value.lower() in CUT_ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Scanner:
    """Ends of tags and of raw elements; what isn't found once isn't looked for again."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")
        self.open_ended: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag from `at` on; -1 if there is none."""
        page, pos = self.page, at
        if at > self.last:
            return -1
        while self.quotes:
            m = MARK.search(page, pos)
            if not m:
                self.quotes = False
                break
            k = m.start()
            if page[k] == ">":
                return k
            pos = k + 1
            before = k - 1
            while before >= at and page[before].isspace():
                before -= 1
            if page[before] == "=":  # elsewhere a quote is part of a name
                pos = page.find(page[k], pos) + 1
                if not pos:
                    self.quotes = False
        return page.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Place behind the end tag of a raw element; the end of the page if there is none."""
        if tag not in self.open_ended:
            if m := re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at):
                return m.end()
            self.open_ended.add(tag)
        return len(self.page)


def parse(page: str) -> Node:
    """The tree of a page; text of elements that hold no prose is left out."""
    root, scan = Node("#root", None), _Scanner(page)
    stack, depths = [root], {}
    at, end = 0, len(page)

    def add(text: str) -> None:
        if text:
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            depths[stack.pop().tag].pop()

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    while at < end:
        start = page.find("<", at)
        if start < 0 or start + 1 == end:
            add(page[at:])
            break
        c = page[start + 1]
        if c in "!?":
            add(page[at:start])
            if page.startswith("<!--", start):
                # An empty comment may close at once.
                if page.startswith((">", "->"), start + 4):
                    at = page.find(">", start) + 1
                else:
                    stop = COMMENT_END.search(page, start + 4)
                    at = stop.end() if stop else end
            else:
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            continue
        m = NAME.match(page, start + 1)
        stop = scan.tag_end(m.end()) if m else -1
        if stop < 0:
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        name, attrs, at = m[0], page[m.end() : stop], stop + 1
        slash, tag = name[0] == "/", name.lstrip("/").lower()
        if slash:
            if depths.get(tag):
                close(depths[tag][-1])
            elif tag in ("p", "br"):
                stack[-1].kids.append(Node("p", stack[-1]))
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                at = scan.raw_end(tag, at)
            continue
        if tag in VOID:
            stack[-1].kids.append(Node(tag, stack[-1]) if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in CLOSES_P and depths.get("p"):
            if depths["p"][-1] > deepest(("button", "table", "td", "th", "object")):
                close(depths["p"][-1])
        elif tag in ENDS:
            ended, shield = ENDS[tag]
            above = deepest(shield)
            first = [d[k] for t in ended if (d := depths.get(t)) and (k := bisect_right(d, above)) < len(d)]
            if first:
                close(min(first))
        in_article = bool(depths.get("article") or depths.get("main"))
        node = Node(tag, stack[-1], stack[-1].cut or _is_cut(tag, attrs, in_article), in_article)
        stack[-1].kids.append(node)
        depths.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def _walk(root: Node):
    """(node, None) on entry, (None, node) on exit, (text, owner) for text; what is cut is skipped."""
    stack: list = [(root, iter(root.kids))]
    yield root, None
    while stack:
        node, kids = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                yield kid, node
            elif not kid.cut:
                yield kid, None
                stack.append((kid, iter(kid.kids)))
                break
        else:
            stack.pop()
            yield None, node


def score(root: Node) -> list[Node]:
    """Count and score every element; those that got points."""
    scored: list[Node] = []
    own: dict[int, list] = {}
    in_link = 0
    for what, node in _walk(root):
        if isinstance(what, Node):
            in_link += what.tag == "a"
            continue
        if what is None:
            in_link -= node.tag == "a"
            if node.tag in PARAGRAPH and (mine := own.pop(id(node), None)) and (node.tag in ("p", "pre", "blockquote") or mine[0] >= 25):
                points, up, share = 1.0 + mine[1] + min(mine[0] / 100, 3.0), node.parent.block, 1.0
                if node.tag in ("div", "section", "article", "main", "body", "td"):
                    up = node
                while up is not None and share > 0.1:
                    if not up.score:
                        scored.append(up)
                    up.score += points * share
                    share /= 2
                    up = up.parent.block if up.parent is not None else None
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.links += node.links
                node.parent.heads += node.heads + (node.tag in HEADINGS and node.chars > 0)
            continue
        n = len(" ".join(what.split()))
        if not n:
            continue
        node.chars += n
        node.links += n if in_link else 0
        mine = own.setdefault(id(node.block), [0, 0])
        mine[0] += n
        mine[1] += what.count(",")
    return scored


def _value(node: Node) -> float:
    return node.score * (1 - node.links / node.chars) if node.chars else 0.0


def containers(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    scored = score(root)
    if not scored:
        return [root]
    best = max(scored, key=_value)
    # A part of an article stands for the article, unless that is one of several.
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None:
        return [best]
    kept = []
    for kid in best.parent.kids:
        if isinstance(kid, str) or kid.cut:
            continue
        prose = kid.chars > 0 and kid.links < 0.5 * kid.chars
        if best.tag in ("article", "main"):
            # Beside an article only its headings and more articles count.
            more = kid.tag in HEADINGS and prose or kid.tag == best.tag == "article" and kid.score and _value(kid) >= 0.2 * _value(best)
        elif best.tag in ("body", "html"):
            more = False
        else:
            more = prose and (kid.tag in HEADINGS or kid.tag in TEXTS or kid.score > 0 or kid.heads > 0) and not _is_imprint(kid)
        if kid is best or more:
            kept.append(kid)
    return kept


TEXTS = frozenset("p pre blockquote figure dl".split())
IMPRINT = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)", re.I)


def _is_imprint(node: Node) -> bool:
    """A short block that begins with a copyright mark."""
    return node.chars < 300 and bool(IMPRINT.match("".join(what for what, _ in _walk(node) if isinstance(what, str))))


def _is_menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "section") and node.chars > 0 and node.links > 0.8 * node.chars and sum(
        1 for k in node.kids if isinstance(k, Node)
    ) >= 3


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by blank lines."""
    if not page:
        return ""
    root = parse(page)
    blocks: list[tuple[str, bool, bool]] = []  # text, whether of a menu, whether a heading
    for top in containers(root):
        parts: list[str] = []
        menu, heading = None, False

        def flush() -> None:
            if text := " ".join("".join(parts).split()):
                blocks.append((text, menu is not None, heading))
            parts.clear()

        for what, node in _walk(top):
            if isinstance(what, str):
                parts.append(what)
                continue
            this = what or node
            if this.tag in BLOCK or this.tag == "#root":
                flush()
                heading = what is not None and this.tag in HEADINGS
            # Lists of links of an article are its sources; elsewhere they may be menus.
            if menu is None and what is not None and what is not top and not (what.in_article or what.tag in KEEP) and _is_menu(what):
                menu = what
            elif what is None and this is menu:
                menu = None
        flush()
    # A menu before or behind all prose is none of the article.
    prose = [k for k, (_, menu, heading) in enumerate(blocks) if not menu and not heading]
    first, last = (prose[0], prose[-1]) if prose else (0, len(blocks))
    return "\n\n".join(text for k, (text, menu, _) in enumerate(blocks) if not menu or first < k < last)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with text and n_chars (code points) in place of columns of those names."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array((main_text(x.as_py()) for x in column), pa.string())

    return pages.withColumn("text", text_of(F.col(html))).withColumn("n_chars", F.char_length("text").cast("long"))


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
