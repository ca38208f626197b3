"""Main text of web pages by composite text density.

A page is read into a tree as browsers read it, as far as text needs: raw text of scripts and the like, void
elements, end tags left out, comments, character references. Elements that don't hold an article's own words (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) go first, by tag, role, class
or id. But a name, role or form doesn't drop what the page is about (``_spare``): an element around the page's only
article, or, if its name could be a layout's, around most of the page's text. For each remaining node, C counts its characters, T its tags, LC and LT those of links; its density is

    C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCbody / Cbody * C + e)

with 1 for zero denominators: characters per tag, less the more of them are in links. The node with the greatest
sum of its children's densities holds the article. The least density on its path from the body is the threshold:
every other part of the page whose density reaches it gives its own greatest-sum subtree, too.

Ties of density sums go to the outer node, and of its children to the first.

Text is given in blocks: one line for each run of text between block elements, white space as one space.

Defined results: a null or empty html gives an empty text; so does a page without text in its body. Pages are read
whole, at any length and depth. Rows are read one by one; extra columns are ignored. An empty table gives an empty
table.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: elements that hold no text of a page at all
DROP = frozenset("head script style noscript template title button input select textarea option datalist label iframe object embed applet svg math canvas audio video map noembed noframes xmp".split())
#: elements whose content isn't an article's, unless they are around the article; forms also if around most of the page
ASIDE, FORM = frozenset("nav footer aside menu dialog".split()), frozenset(["form", "fieldset"])
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
# fixed values: words of class and id names, of reader comments, of what is seldom an article's, and of layouts
_TALK = re.compile(r"(?:comments?|commentlist|commentform|disqus\w*|replies|respond)(?:$|[_-])")
_SURE = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|breadcrumbs?|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|"
    r"related|recommended|pagination|pager|skip|sr-only|visually-hidden)(?:$|[_-])"
)
_LOOSE = re.compile(r"(?:banner|nav|navbar|navigation|menu\w*|footer|side-?bar|widgets?|notices?|popup|modal|overlay|social|toolbar|copyright|legal|disclaimer|hidden)(?:$|[_-])")
_HEADER = re.compile(r"(?:header|masthead)(?:$|[_-])")
#: a name with one of these says what a page has, not what an element is
_SAYS = re.compile(r"(?:has|no|with|without|is|js|enable|show|hide)[_-]")
#: share of a page's text above which a name, other than of reader comments, or a form is taken for a layout's
_LAYOUT = 0.6
#: why an element may go: never spared; hidden, or by tag, role or a name of comments; by a name or as a form; by a name
#: that layouts have, too
NEVER, APART, NAMED, LOOSE = 4, 3, 2, 1
#: an opening p, or one of these, ends what stands open, up to the element that holds it
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_SCOPE = frozenset("table td th caption button object applet html body article section main div li".split())
_START = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_TAG = re.compile(r"""<!--(?:-?>|.*?--!?>)|<!\[CDATA\[(.*?)\]\]>|<(?!!--)[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


#: characters of text that a task sends on at once, about
SLICE = 1 << 24


class Node:
    __slots__ = ("tag", "up", "parts", "drop", "c", "t", "lc", "lt", "density", "sum", "best")

    def __init__(self, tag: str, up: Node | None, drop: int):
        self.tag, self.up, self.drop = tag, up, drop
        self.parts: list[Node | str] = []
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0
        self.best: Node | None = None


def _named(pattern: re.Pattern, names: list[str]) -> bool:
    """Does a name, or a part of it after - or _, begin with the word."""
    return any(pattern.match(x) or any(pattern.match(x, m.end()) for m in re.finditer("[_-]", x)) for x in names)


def _boilerplate(tag: str, attributes: str, inside) -> int:
    """NEVER, APART, NAMED, LOOSE, or 0 for what may be part of an article."""
    if tag in DROP:
        return NEVER
    if tag in ASIDE or tag == "header" and not inside():
        return APART
    own = NAMED if tag in FORM else 0
    if not attributes or tag in ("html", "body"):
        return own
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in _ROLES or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return APART
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _ATTRIBUTE.sub(lambda m: m[0] if m[1].lower() == "hidden" else " ", attributes)):
        return APART
    names = [x for k in ("class", "id") for x in found.get(k, "").lower().split() if not _SAYS.match(x)]
    if _named(_TALK, names):
        return APART
    if own or _named(_SURE, names):
        return NAMED
    if tag in ("article", "main"):
        return 0
    return LOOSE if _named(_LOOSE, names) or _named(_HEADER, names) and not inside() else 0


def parse(source: str) -> Node:
    """The tree of a page, from its body."""
    root = Node("body", None, 0)
    stack = [root]
    stands: Counter[str] = Counter()  # how many elements of a tag stand open
    at, n = 0, len(source)

    def text(s: str) -> None:
        if s and stack[-1].drop < NEVER:
            stack[-1].parts.append(entities.unescape(s) if "&" in s else s)

    def close(to: int) -> None:
        stands.subtract(x.tag for x in stack[to:])
        del stack[to:]

    def push(node: Node) -> None:
        stands[node.tag] += 1
        stack.append(node)

    while at < n:
        start = _START.search(source, at)
        text(source[at : start.start() if start else n])
        if not start or not (m := _TAG.match(source, start.start())):
            break  # a tag or comment that never ends hides the rest, as in browsers
        at = m.end()
        if m[1] is not None:
            text(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in ("html", "body"):
            continue  # the root stands for both
        if m[2]:
            for k in range(len(stack) - 1, 0, -1) if stands[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in BLOCK:
                    break  # an end tag without a start in this cell
            else:
                if tag == "p":
                    stack[-1].parts.append(Node("p", stack[-1], stack[-1].drop))
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1) if stands["p"] else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag in _ENDS:
            ends, holds = _ENDS[tag]
            low = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in holds:
                    break
                if stack[k].tag in ends:
                    low = k
            if low is not None:
                close(low)
        if tag in "h1 h2 h3 h4 h5 h6".split() and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        up = stack[-1]
        drop = NEVER if up.drop == NEVER else _boilerplate(tag, m[4], lambda: any(x.tag in ("article", "main") for x in stack))
        node = Node(tag, up, drop)
        up.parts.append(node)
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if drop < NEVER:
                node.parts.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if tag == "head" and stack[-1] is root:
            push(node)
            continue
        if stack[-1].tag == "head" and tag not in ("meta", "link", "base", "template", "noscript"):
            close(len(stack) - 1)  # the head's end tag was left out
            up.parts.pop()
            node.up, node.drop = stack[-1], _boilerplate(tag, m[4], bool)
            stack[-1].parts.append(node)
        push(node)
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Keep what would go by its tag, role or name, where it holds the page's article or most of its text.

    An article is an article or main element that nothing below the element in question would drop. What goes by a
    name or as a form stays if it holds more text of articles than all that stays without it, or more than _LAYOUT
    of the page's text; what goes for another reason only if nothing else holds an article, and never
    for its text alone. A LOOSE name stays with any article. Outer elements are settled first."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [x for x in node.parts if isinstance(x, Node) and x.drop < NEVER]
    if not any(x.drop for x in nodes):
        return
    size: dict[int, int] = {}
    article: dict[int, int] = {}  # characters in articles that nothing at or below the node drops
    for node in reversed(nodes):
        inner = [x for x in node.parts if isinstance(x, Node) and x.drop < NEVER]
        size[id(node)] = sum(sum(map(len, x.split())) for x in node.parts if isinstance(x, str)) + sum(size[id(x)] for x in inner)
        article[id(node)] = size[id(node)] if node.tag in ("article", "main") else sum(article[id(x)] for x in inner if x.drop in (0, LOOSE))
    kept = article[id(root)]
    todo = [root]
    while todo:
        node = todo.pop()
        own = article[id(node)]
        if node.drop == LOOSE and (own or size[id(node)] > _LAYOUT * size[id(root)]):
            node.drop = 0
        elif node.drop == NAMED and (own > kept or not kept and size[id(node)] > _LAYOUT * size[id(root)]):
            node.drop = 0
        elif node.drop == APART and own and not kept and node.tag not in ("article", "main"):
            node.drop = 0
        if not node.drop:
            todo += [x for x in reversed(node.parts) if isinstance(x, Node) and x.drop < NEVER]


def _walk(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.drop]
    return out


#: tag of a pseudo-block: text and inline elements that stand between the blocks of a container
RUN = "#run"


def _group(root: Node) -> None:
    """Put what stands directly between blocks into pseudo-blocks, so that it has a density like other parts."""
    holds: set[int] = set()  # nodes with a block below
    for node in reversed(_walk(root)):
        inner = [x for x in node.parts if isinstance(x, Node) and not x.drop]
        if not any(x.tag in BLOCK or id(x) in holds for x in inner):
            continue
        holds.add(id(node))
        parts: list[Node | str] = []
        run: Node | None = None
        for x in node.parts:
            if isinstance(x, Node) and not x.drop and (x.tag in BLOCK or x.tag == RUN or id(x) in holds):
                run = None
            elif run or (x.strip() if isinstance(x, str) else not x.drop):
                if not run:
                    run = Node(RUN, node, 0)
                    parts.append(run)
                run.parts.append(x)
                if isinstance(x, Node):
                    x.up = run
                continue
            parts.append(x)
        node.parts = parts


def measure(root: Node) -> list[Node]:
    """Densities and density sums of all kept nodes; ``best`` is the greatest sum's node within each subtree."""
    _group(root)
    nodes = _walk(root)
    for node in reversed(nodes):
        node.c = node.t = node.lc = node.lt = 0
        for x in node.parts:
            if isinstance(x, str):
                node.c += sum(map(len, x.split()))
            elif not x.drop:
                node.c += x.c
                node.t += x.t + (x.tag != RUN)
                node.lc += x.lc
                node.lt += x.lt + (x.tag == "a")
        if node.tag == "a":
            node.lc, node.lt = node.c, node.t
    share = root.lc / (root.c or 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.c, node.t or 1, node.lc or 1, node.lt or 1
        if node.c:
            base = math.log(c / ((c - node.lc) or 1) * node.lc + share * c + math.e)
            node.density = max(0.0, c / t * math.log(max(c / lc * t / lt, 1e-9)) / math.log(base)) if base > 1 else c / t
        inner = _inner(node)
        node.sum = sum(x.density for x in inner) if inner else node.density
        node.best = node
        for x in inner:
            if x.best.sum > node.best.sum:
                node.best = x.best
    return nodes


def _inner(node: Node) -> list[Node]:
    """Kept block elements below a node, through inline ones: a paragraph's bold words are no part of a page."""
    out, todo = [], [x for x in reversed(node.parts) if isinstance(x, Node)]
    while todo:
        x = todo.pop()
        if x.drop:
            continue
        if x.tag in BLOCK or x.tag == RUN:
            out.append(x)
        else:
            todo += [y for y in reversed(x.parts) if isinstance(y, Node)]
    return out


def content(root: Node) -> list[Node]:
    """Subtrees that hold the main text, in page order. Inside an article element, all of it is."""
    measure(root)
    best = root.best
    path, node = [], best
    while node:
        path.append(node)
        node = node.up
    threshold = min(x.density for x in path)
    best = next((x for x in reversed(path) if x.tag == "article"), best)
    above = {id(x) for x in path[path.index(best) + 1 :]}
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is best:
            out.append(node)
        elif id(node) in above:
            todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.drop]
        elif node.tag not in BLOCK and node.tag != RUN:
            todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.drop]
        elif node.c and node.density >= threshold:
            out.append(node if node.best.sum <= node.sum or 2 * node.best.c < node.c else node.best)
    return out


def blocks(node: Node) -> list[str]:
    """Texts between block borders."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if s := " ".join("".join(run).split()):
            out.append(s)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.drop:
            if x.tag == "br":
                run.append(" ")
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.parts)
    end()
    return out


def main_text(source: str | None) -> str:
    root = parse(source or "")
    return "\n".join(line for node in content(root) for line in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, texts, held = 0, [], 0

            def rows(end: int) -> pa.RecordBatch:
                columns = [b.column(k).slice(first, end - first) for k in (0, 1)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])  # noqa: B023

            for k, x in enumerate(b.column(2)):
                texts.append(main_text(x.as_py()))
                held += len(texts[-1])
                if held >= SLICE:
                    yield rows(k + 1)
                    first, texts, held = k + 1, [], 0
            yield rows(b.num_rows)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
