"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, lowered the more of the
text stands in links (Sun, Song and Liao, 2011).  The node with the largest sum
of its children's densities is the heart of the article.  The smallest density on
the way from it up to the body is the threshold: going down from the body through
nodes at least as dense, the node of the largest sum in each such subtree is taken
too, so that an article in several parts stays whole.  No tag decides: an
``<article>`` or ``<main>`` is chosen by its density like any other element.

Two additions keep what an article holds between its dense parts.  What stands
between two taken children of one parent is taken, and so are the paragraphs, lists,
tables, quotations and headings next to a taken child, unless half of their text is
in links; of an element that only leads down to taken ones, just the headings right
before it.  A plain box without links beside a taken child is taken inside a box of
their own (a lead or a byline), not where the parts of the page stand, and so is a box
that holds just a heading before one.  Within what is taken, parts less dense than the
threshold that are mostly several links (a menu in a cell beside the text) go, and at
its ends short blocks that begin by speaking of the site's cookies.

Elements that never hold the article (menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments, scripts, styles) are left out before
densities are computed.  They are told by their tag, or by a class or role of a
container, or an id of a plain one, that consists of such words (MARK) and words for
boxes, as ``cookie-notice``.  A name that only holds such a word, as
``social-impact`` or ``has-sidebar``, is no reason by itself: half of the element's
text must stand in links, or it must hold form controls and no paragraph or heading.
Names that are wholly words for adverts and cookies leave out elements of any kind.
An article's own header stays.  ``<article>`` elements are left out as reader
comments only, and the body and ``<main>`` never.

The page is scanned once from left to right.  Open elements are kept with their
places on the stack by name, so that an end tag, or the implied end of a paragraph or
list item, costs the same at any depth; rescans after unfinished tags are limited to
a few times the page's length, after which quotes no longer hide a ``>``.  So a page
costs time in proportion to its length, whatever it holds.

Defined cases: a null or empty page, or one without text outside the left-out
elements, gives an empty text; very long and very deep pages are read whole; of
equally dense nodes the one with fewer tags is taken, then the first.  Rows with
equal or null ids are extracted each; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
LEFT_OUT = frozenset("head nav header footer aside form script style textarea title iframe noscript template button select menu dialog input noembed noframes".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label nobr br"
    " object canvas audio video source track svg g defs use path circle ellipse rect line polyline polygon tspan"
    " math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mfenced"
).split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
#: A start tag closes an open element of these, unless one of the second set stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words that mark what is not the article.
_MARK = (
    r"(?:ads?|ad(?:box|slot|unit|block|wrap(?:per)?|container)s?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?"
    r"|sidebar|footer|masthead|header|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|widget|pagination|complementary|contentinfo|search"
    r"|(?:more|other|latest|popular|trending)[_-](?:stories|articles|news|posts|reads)|read[_-](?:next|also))"
)
MARK = re.compile(rf"(?:^|[\s_-]){_MARK}(?:$|[\s_-])", re.I)
#: A whole name of such words, with words for the kind of box around them.
_BOX = r"(?:main|top|bottom|left|right|site|page|list|box|bar|area|wrap|wrapper|container|block|slot|unit|links?|posts?|articles?|buttons?|icons?|form|section|thread|item|body|reader|user|visitor|guest|google|story|inline|mobile|desktop|\d+)"
WHOLE = re.compile(rf"(?:{_BOX}[_-])*{_MARK}(?:[_-](?:{_MARK}|{_BOX}))*", re.I)
COMMENT = re.compile(rf"(?:{_BOX}[_-])*(?:comments?|repl(?:y|ies)|responses?)(?:[_-]{_BOX})*", re.I)
#: Names that leave out an element of any kind: adverts and notices about cookies.
ANYWHERE = re.compile(
    rf"(?:(?:{_BOX}|notice|banner|message|text|label)[_-])*(?:ads?|ad(?:box|slot|unit|block|wrap(?:per)?|container)s?|advert\w*|adsense|sponsor(?:ed|s)?|cookies?|gdpr)(?:[_-](?:{_BOX}|notice|banner|message|consent|text|label|content))*", re.I
)
PLAIN = frozenset("div ul ol dl table section".split())
CONTAINERS = PLAIN | {"aside", "nav"}
#: Elements whose share of links decides about them within the article too.
PARTS = PLAIN | {"tr", "td", "th", "tbody", "details", "center"}
#: A notice about cookies, which no name may mark.
COOKIES = re.compile(r"\s*(?:(?:we|our partners and we|this (?:web)?site|our (?:web)?site|by (?:using|continuing)\b[^.]{0,80})\b[^.]{0,40}\bcookies?\b)", re.I)
SITE = re.compile(r"site|experience|consent|accept|privacy|browser|agree|traffic", re.I)
NOTICE_CHARS = 600
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTROLS = frozenset("form input button select textarea".split())
ARTICLE = frozenset("article main".split())
#: Left-out elements that do not part the text around them.
UNSEEN = frozenset("script style template noscript title head input button select textarea".split())
#: What belongs to the text when it stands next to it; RUN is text without an element of its own.
RUN = "#run"
BOXES = frozenset("div header center".split())
FLOW = HEADINGS | frozenset(("p", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "section", "details", RUN))

_NAME = re.compile(r"[a-zA-Z][^\s>/]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAMED = re.compile(r"class|id|role", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s>/])", re.I) for tag in RAW}
_P_BARRIER = frozenset("button table td th caption html body article section div main".split())


class Node:
    __slots__ = ("tag", "parent", "children", "out", "doubtful", "block", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "taken")

    def __init__(self, tag: str, parent: Node | None, out: bool, doubtful: bool = False):
        self.tag, self.parent, self.out, self.doubtful = tag, parent, out, doubtful
        self.children: list[Node | str] = []
        self.block = tag not in INLINE
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best: Node = self
        self.taken = False


def marked(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's names leave it out, and whether they do so with support only."""
    if tag in ("html", "body", "main") or tag in HEADINGS or not _NAMED.search(attributes):
        return False, False
    doubtful = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name not in ("class", "id", "role"):
            continue
        if tag in ("article", "li"):
            if name == "class" and any(map(COMMENT.fullmatch, value.split())):
                return True, False
            continue
        if name == "class" and any(map(ANYWHERE.fullmatch, value.split())):
            return True, False
        if not MARK.search(value):
            continue
        if tag in (PLAIN if name == "id" else CONTAINERS) and any(map(WHOLE.fullmatch, value.split())):
            return True, False
        doubtful = True
    return False, doubtful


class Stack:
    """Open elements, with the places of each name's elements."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, at: int) -> None:
        """Close the element at a place and all in it; the root stays open."""
        while len(self.nodes) > max(at, 1):
            self.places[self.nodes.pop().tag].pop()

    def close(self, tags, barrier=()) -> None:
        """Close the innermost open element of ``tags`` unless one of ``barrier`` is further in."""
        at = self.last(tags)
        if at > 0 and at > self.last(barrier):
            self.cut(at)


class Scanner:
    """Finds the ends of tags, in time proportional to the page over all calls."""

    def __init__(self, html: str):
        self.html, self.budget = html, 4 * len(html)
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def end_of_tag(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1 at the page's end."""
        if at > self.last[">"]:
            return -1
        k = at
        while self.budget > 0 and (stop := _STOP.search(self.html, k)):
            c, k = stop.group(), stop.start()
            if c == ">":
                return k
            k = self.html.find(c, k + 1) + 1 if self.last[c] > k else k + 1
        # No end outside quotes: a quote is left open somewhere.
        self.budget -= len(self.html) - at
        return self.html.find(">", at)


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in document order; text that is left out is not kept."""
    root = Node("html", None, False)
    nodes, stack, scanner = [root], Stack(root), Scanner(html)
    at, end = 0, len(html)
    plain = 0

    def text(stop: int) -> None:
        top = stack.nodes[-1]
        if stop > plain and not top.out:
            top.children.append(unescape(html[plain:stop]))

    while at < end:
        at = html.find("<", at)
        if at < 0 or at + 1 >= end:
            break
        after = html[at + 1]
        if after in "!?":
            text(at)
            comment = html.startswith("<!--", at)
            stop = html.find("-->", at + 4) if comment else html.find(">", at)
            at = plain = end if stop < 0 else stop + (3 if comment else 1)
            continue
        closing = after == "/"
        name = _NAME.match(html, at + 1 + closing)
        if not name:
            at += 1
            continue
        text(at)
        stop = html.find(">", name.end()) if closing else scanner.end_of_tag(name.end())
        if stop < 0:
            plain = end
            break
        tag, attributes = name.group().lower(), "" if closing else html[name.end() : stop]
        at = plain = stop + 1
        if closing:
            if tag not in ("html", "body"):
                stack.close((tag,))
            continue
        if tag == "html":
            continue
        if tag == "body":
            if not stack.places.get("body"):
                stack.cut(1)
                body = Node("body", root, False)
                root.children.append(body)
                nodes.append(body)
                stack.push(body)
            continue
        if tag in ENDS_P:
            stack.close(("p",), _P_BARRIER)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        top = stack.nodes[-1]
        sure, doubtful = marked(tag, attributes)
        left_out = tag in LEFT_OUT and not (tag == "header" and stack.last(ARTICLE) > 0)
        node = Node(tag, top, top.out or left_out or sure, doubtful and not (tag == "header" and not left_out))
        top.children.append(node)
        nodes.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            stop = html.find(">", found.end()) if found else -1
            at = plain = stop + 1 if stop >= 0 else end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.push(node)
    text(end)
    settle(nodes)
    return root, nodes


def settle(nodes: list[Node]) -> None:
    """Leave out the doubtful elements that hold mostly links, or form controls without prose."""
    if not any(n.doubtful for n in nodes):
        return
    index = {id(n): k for k, n in enumerate(nodes)}
    chars, links, controls, prose = ([0] * len(nodes) for _ in range(4))
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if not n.out:
            chars[k] += sum(len("".join(x.split())) for x in n.children if isinstance(x, str))
        if n.tag == "a":
            links[k] = chars[k]
        controls[k] += n.tag in CONTROLS
        prose[k] += not n.out and (n.tag == "p" or n.tag in HEADINGS)
        if n.parent is not None:
            up = index[id(n.parent)]
            for held in (chars, links, controls, prose):
                held[up] += held[k]
    for k, n in enumerate(nodes):
        if n.parent is not None and n.parent.out:
            n.out = True
        elif n.doubtful:
            n.out = n.out or controls[k] > 0 and not prose[k] or 2 * links[k] >= chars[k] > 0


def wrap_runs(nodes: list[Node]) -> list[Node]:
    """The nodes with each run of bare text and inline elements beside blocks as a node of its own."""
    for n in reversed(nodes):
        if n.parent is not None and n.block and not n.out and n.tag not in UNSEEN:
            n.parent.block = True
    found = []
    for n in nodes:
        found.append(n)
        if n.out or not n.block or not any(isinstance(x, Node) and x.block and not x.out for x in n.children):
            continue
        children: list[Node | str] = []
        run: Node | None = None
        for x in n.children:
            if isinstance(x, Node) and (x.block and not x.out or x.out and x.tag not in UNSEEN):
                run = None
                children.append(x)
            elif run is None and isinstance(x, str) and not x.strip():
                continue
            else:
                if run is None:
                    run = Node(RUN, n, False)
                    children.append(run)
                    found.append(run)
                run.children.append(x)
                if isinstance(x, Node):
                    x.parent = run
        n.children = children
    # Parents before their children, in page order.
    order, todo = [], [found[0]]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [x for x in reversed(n.children) if isinstance(x, Node)]
    return order


def measure(nodes: list[Node]) -> None:
    """Characters, tags, densities and sums of densities of all nodes, children before parents."""
    for n in reversed(nodes):
        if n.out:
            continue
        for child in n.children:
            if isinstance(child, str):
                n.chars += len(child) - child.count(" ") - child.count("\n")
            elif not child.out:
                n.chars += child.chars
                n.tags += (child.tag != RUN) + child.tags
                n.link_chars += child.link_chars
                n.link_tags += child.link_tags + (child.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    body = max((n for n in nodes if n.tag in ("html", "body") and not n.out), key=lambda n: (n.chars, n.tag == "body"), default=None)
    if body is None or not body.chars:
        return
    share = body.link_chars / body.chars
    for n in reversed(nodes):
        if n.out or not n.chars:
            continue
        c, t = n.chars, max(1, n.tags)
        lc, lt = max(1, n.link_chars), max(1, n.link_tags)
        base = log(c * lc / max(1, c - n.link_chars) + share * c + e)
        n.density = c / t * log(c * t / (lc * lt)) / log(base) if c * t > lc * lt else 0.0
        own = [x for x in n.children if not isinstance(x, str) and not x.out and x.chars and x.block]
        n.total = sum(x.density for x in own) if own else n.density * n.block
        for x in own:
            there, here = ((m.total, -m.tags) for m in (x.best, n.best))
            if there > here or there == here and n.best is n:
                n.best = x.best


def select(root: Node, nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    if not root.chars:
        return []
    heart = root.best
    threshold, n = heart.density, heart
    while n is not None and n.tag != "html":
        threshold, n = min(threshold, n.density), n.parent
    heart.taken = True
    leads: set[int] = set()

    def lead(n: Node) -> None:
        while (n := n.parent) is not None and id(n) not in leads:
            leads.add(id(n))

    lead(heart)
    todo = [root]
    while todo:
        n = todo.pop()
        if n.taken:
            continue
        if id(n) not in leads:
            if not n.block or n.density < threshold or 2 * n.link_chars >= n.chars:
                continue
            n.best.taken = True
            lead(n.best)
            if n.taken:
                continue
        todo += [x for x in n.children if not isinstance(x, str) and not x.out and x.chars]
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.taken:
            found.append(n)
        elif id(n) in leads:
            todo += reversed(together(n, leads))
    for n in found:
        prune(n, threshold)
    without_notices(found[0], 0)
    without_notices(found[-1], -1)
    return found


def prune(top: Node, threshold: float) -> None:
    """Leave out the parts of a taken subtree that are less dense than the threshold and mostly several links: menus beside the text."""
    todo = [top]
    while todo:
        for x in todo.pop().children:
            if isinstance(x, str) or x.out or not x.chars or not x.block:
                continue
            if x.tag in PARTS and x.density < threshold and x.link_tags > 1 and 2 * x.link_chars >= x.chars:
                x.out = True
            else:
                todo.append(x)


def notice(n: Node) -> bool:
    """Whether a short block speaks of the site's cookies from its beginning."""
    if n.chars > NOTICE_CHARS:
        return False
    text = "".join(words(n))
    return bool(COOKIES.match(text) and SITE.search(text))


def without_notices(n: Node, end: int) -> None:
    """Leave out the blocks at one end of a subtree that are such notices."""
    while True:
        own = [x for x in n.children if not isinstance(x, str) and not x.out and x.chars and x.block]
        if not own or any(isinstance(x, str) and x.strip() for x in n.children):
            return
        if notice(own[end]):
            own[end].out = True
        else:
            n = own[end]


def words(top: Node) -> Iterator[str]:
    todo: list = [top]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            yield n
        elif not n.out:
            todo += reversed(n.children)


def only_heading(n: Node) -> bool:
    """Whether an element leads down to one heading and nothing else."""
    while n.tag not in HEADINGS:
        own = [x for x in n.children if not isinstance(x, str) and not x.out and x.chars]
        if len(own) != 1 or own[0].chars != n.chars:
            return False
        n = own[0]
    return True


def together(parent: Node, leads: set[int]) -> list[Node]:
    """The children of a node with taken ones below it that are taken, lead to taken ones, or stand with those."""
    own = [x for x in parent.children if not isinstance(x, str) and not x.out and x.chars]
    kept = [x.taken or id(x) in leads for x in own]
    sure = [k for k, x in enumerate(own) if kept[k]]
    loose = [2 * x.link_chars >= x.chars for x in own]
    for k in range(sure[0], sure[-1]):
        kept[k] = kept[k] or not loose[k]
    flows = any(own[k].taken for k in sure)
    # A plain box beside a taken part belongs to it inside a box of their own, not where the page's parts stand.
    inside = parent.tag not in ("html", "body") and any(x.taken for x in own)
    for step, k in ((-1, sure[0] - 1), (1, sure[-1] + 1)):
        while 0 <= k < len(own) and not loose[k] and not notice(own[k]):
            x = own[k]
            heading = step < 0 and (x.tag in HEADINGS or x.tag in BOXES and only_heading(x))
            if not (heading or flows and (x.tag in FLOW or inside and x.tag in BOXES and not x.link_tags)):
                break
            kept[k] = True
            k += step
    for x, keep in zip(own, kept):
        if keep and id(x) not in leads:
            x.taken = True
    return [x for x, keep in zip(own, kept) if keep]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of these subtrees in page order, white space collapsed, empty ones left out."""
    found: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            found.append(line)
        run.clear()

    for top in nodes:
        todo: list = [iter(top.children)]
        ends: list[bool] = [True]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
                if ends.pop():
                    flush()
            elif isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            else:
                block = child.tag not in INLINE and child.tag not in UNSEEN
                if block:
                    flush()
                if not child.out:
                    todo.append(iter(child.children))
                    ends.append(block)
    return found


def extract(html: str | None) -> str:
    if not html:
        return ""
    root, nodes = parse(html)
    nodes = wrap_runs(nodes)
    measure(nodes)
    return "\n\n".join(blocks(select(root, nodes)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
