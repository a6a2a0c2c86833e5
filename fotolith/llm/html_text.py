"""Main text of web pages by tree scoring.

A page becomes a light element tree without boilerplate elements (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles), known by tag,
role, or a class or id that says nothing else; such names never touch headings and
paragraphs, and an article's own header and its sections' ids are the article's.
Every paragraph-like block passes points for its length and its commas to its
ancestors, whole to the parent, half to the next, a third to the one after;
a container's sum is discounted by its link density. The best container gives way to
its parent as long as the parent keeps ``PARENT_SHARE`` of the best score (an
article in sections, a story in several articles). What is kept is that container
and those of its siblings that score well enough or are headings or plain prose.

Text is decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one newline. Null, empty and text-less
pages give the empty string. Broken markup never raises: an unclosed comment,
tag or raw-text element runs to the end, a stray end tag is ignored. Very deep
trees are walked without recursion. Character references of any length are
decoded; numbers beyond Unicode give U+FFFD. Repeated rows give repeated results; extra
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fotolith.llm.common import prepare

#: Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the key closes, up to the nearest of the stoppers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}

#: Elements that are never main text.
DROPPED = frozenset(
    "head script style noscript template iframe svg canvas math object embed audio video map nav header footer aside form button select "
    "option datalist textarea input label menu dialog title noembed noframes".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of a class or id that mark boilerplate, and words that only say where such a thing stands or what shape it has.
#: A name marks boilerplate if it consists of both kinds alone: "share-buttons" does, "share-price" does not.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion sidebar rail menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social comment comments disqus respond reply replies related recommend recommended recommendations recirc recirculation widget widgets "
    "toolbar pagination paginator pager skip copyright disclaimer".split()
)
SHAPES = frozenset(
    "area author avatar bar block body bottom box btn button buttons card cards cell cloud column container count cta date desktop fixed float floating footer form frame global "
    "group head heading icon icons id inline inner item items label layer left line link links list local main meta mobile more outer page panel placeholder policy pop "
    "posts primary respond right roll root row secondary section site slot social sticky stories strip sub tags text thread title toggle tools top unit up wrap wrapper zone".split()
)
#: Names whose two words mark boilerplate together.
PAIRS = frozenset("side-bar pop-up sign-up log-in tag-cloud".split())
#: Words of reader comments: they count in the id of an article's section too, where other ids are names of its headings.
READERS = frozenset("comment comments disqus respond reply replies".split())
KEEP_ANYWAY = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())

PARAGRAPH = frozenset("p pre td blockquote li dd div section article main body figcaption".split())
BONUS = {"article": 5.0, "main": 3.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "td": 1.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0}
#: Points of a paragraph: one, one for each comma, one for each so many characters up to a limit.
CHARS_A_POINT, MOST_LENGTH_POINTS = 100, 3.0
#: A parent takes a container's place, a sibling stays beside it, at this share of the best score; least score of such a sibling.
PARENT_SHARE, SIBLING_SHARE, LEAST_SIBLING = 0.75, 0.2, 5.0
MAX_LINK_DENSITY = 0.25

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WATCHED = ("class", "id", "role", "hidden", "style", "aria-hidden")


LONG_NUMBER = re.compile(r"&#(?:0*([1-9][0-9]{7,})|[xX]0*([1-9a-fA-F][0-9a-fA-F]{6,})|0+([0-9]{1,7}(?![0-9]))|[xX]0+([0-9a-fA-F]{1,6}(?![0-9a-fA-F])));?")


def decoded(text: str) -> str:
    """The text without character references."""
    if "&" not in text:
        return text
    # Numbers of any length: those beyond Unicode are one sign, zeros before a number say nothing.
    short = lambda m: "\ufffd" if m[1] or m[2] else f"&#{m[3]};" if m[3] else f"&#x{m[4]};"
    return html.unescape(LONG_NUMBER.sub(short, text) if "&#" in text else text)


class Node:
    __slots__ = ("tag", "parent", "children", "text", "links", "heads", "commas", "score")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.text = self.links = self.heads = self.commas = 0
        self.score = 0.0


def marks(name: str) -> set[str]:
    """The words by which a class or id marks boilerplate; none if it says anything else."""
    words = {w for w in (part.strip("0123456789") for part in name.split("-")) if w}
    return words & (MARKS | PAIRS) if words <= MARKS | SHAPES else {name} & PAIRS


def is_boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    """``inside``: an article is open."""
    if tag in DROPPED and not (inside and tag == "header"):  # an article's own header holds its title
        return True
    low = attrs.lower()
    if not any(w in low for w in WATCHED):
        return False
    found = {m[1]: m[2] or m[3] or m[4] or "" for m in ATTR.finditer(low)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role") in DROPPED_ROLES:
        return True
    if tag in KEEP_ANYWAY:
        return False
    names = lambda k: [marks(x) for x in found.get(k, "").replace("_", "-").split()]
    own = names("id")
    if inside and tag == "section":
        own = [x & READERS for x in own]
    return any(x - {"header"} if inside else x for x in names("class") + own)


def parse(page: str) -> Node:
    """The element tree of a page without boilerplate; time is linear in the page, whatever is left open."""
    root = Node("html", None)
    stack: list[tuple[str, Node | None]] = [("", root)]  # None: inside boilerplate
    open_at: dict[str, list[int]] = {}  # of each tag, where its open elements stand in the stack
    blocks_at: list[int] = []
    at, n = 0, len(page)

    def pop() -> str:
        tag, _ = stack.pop()
        open_at[tag].pop()
        if tag in BLOCK:
            blocks_at.pop()
        return tag

    def nearest(tags: set[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < n:
        m = TOKEN.search(page, at)
        here = stack[-1][1]
        stop = m.start() if m else n
        if stop > at and here is not None:
            here.children.append(decoded(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if m["end"] if m["tag"] else m["end2"]:
            if open_at.get(tag):
                while pop() != tag:
                    pass
            elif tag in ("br", "p") and here is not None:
                here.children.append(Node(tag, here))
            continue
        if tag in BLOCK and blocks_at and blocks_at[-1] == nearest({"p"}):
            # An open paragraph ends where a block starts, unless a block inside it holds both.
            while pop() != "p":
                pass
        if tag in CLOSES:
            own, stoppers = CLOSES[tag]
            if (k := nearest(own)) > nearest(stoppers):
                while len(stack) > k:
                    pop()
        here = stack[-1][1]
        closed = tag in VOID
        drop = here is None or is_boilerplate(tag, attrs, bool(open_at.get("article")))
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            raw_end = found.start() if found else n
            at = n if not found or (shut := page.find(">", raw_end)) < 0 else shut + 1
            continue
        if closed:
            if not drop:
                here.children.append(Node(tag, here))
            continue
        node = None if drop else Node(tag, here)
        if node is not None:
            here.children.append(node)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks_at.append(len(stack))
        stack.append((tag, node))
    return root


def order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def score(nodes: list[Node]) -> None:
    """Fill length of text, links and headings, commas and score of all nodes."""
    for node in reversed(nodes):
        own = own_commas = 0
        for c in node.children:
            if isinstance(c, str):
                k = len(c.strip())
                own += k
                own_commas += c.count(",") + c.count("，") + c.count("、")
            elif c.tag not in BLOCK:
                own += c.text
                own_commas += c.commas
            if not isinstance(c, str):
                node.links += c.links
                node.heads += c.heads
        inner = sum(c.text for c in node.children if isinstance(c, Node) and c.tag in BLOCK)
        node.text, node.commas = own + inner, own_commas
        if node.tag == "a":
            node.links = node.text
        if node.tag in HEADINGS:
            node.heads = node.text
        if node.tag in PARAGRAPH and own:
            points = 1 + own_commas + min(own / CHARS_A_POINT, MOST_LENGTH_POINTS)
            up, share = node.parent, 1
            while up is not None and share <= 3:
                up.score += points / share
                up, share = up.parent, share + 1
    for node in nodes:
        node.score = (node.score + BONUS.get(node.tag, 0.0)) * (1 - node.links / node.text) if node.text else 0.0


def blocks(roots: list[Node]) -> list[str]:
    """The text blocks below the nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if line := " ".join("".join(run).split()):
                out.append(line)
            run.clear()

    todo: list[Node | str | None] = list(reversed(roots))
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return out


def keep(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    holders = [x for x in nodes if x.tag in BLOCK and x.tag != "p" and x.tag not in HEADINGS and x.text]
    if not holders:
        return nodes[:1]
    best = max(holders, key=lambda x: x.score)
    most = best.score
    while best.parent is not None and best.parent.score >= PARENT_SHARE * most > 0:
        best = best.parent
    if best.parent is None:
        return [best]

    def belongs(x: Node) -> bool:
        if x is best or 0 < x.heads == x.text:
            return True
        if x.score >= max(LEAST_SIBLING, SIBLING_SHARE * most):
            return True
        return x.tag in ("p", "pre", "blockquote") and x.text > 0 and x.links / x.text <= MAX_LINK_DENSITY

    return [x for x in best.parent.children if isinstance(x, Node) and belongs(x)]


def main_text(page: str) -> str:
    nodes = order(parse(page))
    score(nodes)
    return "\n".join(blocks(keep(nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of ``pages(page_id, url, html)``: one pass, no shuffle."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
