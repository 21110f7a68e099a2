"""Main text of HTML pages by a tree-structured graphical model.

A page's elements form a tree. Each is content or not; an element's own look (tag, words of
its class and id, amount of text and links) gives the potential of its label, and each
parent-child edge, by the kind of the child, the potential of the two labels. Messages
pass up from the leaves and down from the root (sum-product), which gives every element's
exact marginal. Text is kept where the marginal of the element that holds it is one half
or more.

The potentials are learned from labelled pages by the exact gradient of their likelihood.
The labelled pages are made here from a grammar of articles, menus, headers, footers,
sidebars, notices, adverts, forms and comments (``labelled_pages``); others, of the same
form, can be given to ``fit``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template title iframe object svg math canvas audio video select textarea datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address summary legend".split())
#: What a start tag closes if it is open: the tags, and the elements beyond which one doesn't look.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("tr td th", "table"), "tbody": ("thead tr td th", "table"), "tfoot": ("tbody tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Words of class, id and role by what they hint at (fixed values).
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager tabs tablist skip toc sitemap",
    "head": "header masthead banner logo branding hero",
    "foot": "footer foot colophon contentinfo copyright legal imprint",
    "side": "sidebar aside widget widgets rail related recommended recommendations trending popular more complementary teaser teasers author bio",
    "advert": "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted dfp banner-ad",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall dialog disclaimer warning",
    "form": "form newsletter subscribe subscription signup login search share sharing social follow",
    "comments": "comment comments reply replies discussion disqus respond",
    "content": "content article post entry story body main text prose page hentry blog news articlebody",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "hints", "parent", "children", "chars", "linked", "ends", "flow", "truth")

    def __init__(self, tag: str, hints: frozenset, parent: Node | None) -> None:
        self.tag, self.hints, self.parent = tag, hints, parent
        self.children: list[Node] = []
        self.chars = self.linked = self.ends = 0
        self.flow: list = []  # strings and children, in order
        self.truth: int | None = None


#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta title script style noscript template".split())
#: Hidden elements that are open to the end of the page if they are never closed, as browsers have it.
RAW = frozenset(("script", "style"))


class Tree(HTMLParser):
    """Elements that can be seen, with text in place; missing end tags are implied.

    Nothing on a page is an error. What the parser would refuse (odd declarations, markup that
    is cut off) is skipped; an element that hides its content hides nothing if its end tag
    never comes or if it closes itself; the head ends where something else than head matter
    begins.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("html", frozenset(), None)
        self.nodes = [self.root]
        self.hidden: list[str] = []
        self.open: Counter = Counter()
        self.lines: list[int] = []
        self.last_end: dict[str, int] = {}

    def read(self, html: str) -> None:
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.whole = html
        self.feed(html)
        self.close()

    def _skipped(self, i: int, k: int) -> int:
        """Where to go on after markup at ``i``; -1 would mean that its end is missing."""
        if k < 0:
            k = self.rawdata.find(">", i) + 1
        return k or len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._skipped(i, self.rawdata.find(">", i) + 1 or -1)

    def parse_comment(self, i: int, report: bool = True) -> int:
        k = super().parse_comment(i, report)
        return k if k >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return self._skipped(i, super().parse_pi(i))

    def parse_starttag(self, i: int) -> int:
        return self._skipped(i, super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._skipped(i, super().parse_endtag(i))

    def _ends_later(self, tag: str) -> bool:
        """Whether an end tag of ``tag`` comes after this place."""
        if tag not in self.last_end:
            ends = [m.start() for m in re.finditer(f"</{tag}", self.whole, re.I)]
            self.last_end[tag] = ends[-1] if ends else -1
        line, column = self.getpos()
        return self.lines[line - 1] + column < self.last_end[tag]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden == ["head"] and tag not in IN_HEAD:
            self.hidden.clear()
        if self.hidden:
            if tag in HIDDEN and (tag in RAW or self._ends_later(tag)):
                self.hidden.append(tag)
            return
        if tag in HIDDEN:
            if tag in RAW or tag == "head" or self._ends_later(tag):
                self.hidden.append(tag)
            return
        if tag in ("html", "body"):
            self._describe(self.root, attrs)
            return
        if tag in CLOSES:
            self._imply(*CLOSES[tag])
        elif tag not in INLINE and tag not in VOID or tag == "hr":
            self._imply(frozenset(["p"]), frozenset("button td th caption object table".split()))
        node = Node(tag, frozenset(), self.here)
        self._describe(node, attrs)
        self.here.children.append(node)
        self.here.flow.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.here = node
            self.open[tag] += 1

    def _describe(self, node: Node, attrs: list) -> None:
        found = set(node.hints)
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                found.update(HINT_OF[w] for w in (x.lower() for x in WORD.findall(v)) if w in HINT_OF)
        node.hints = frozenset(found)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if self.open[tag]:
            n = self.here
            while n.parent is not None and n.tag != tag:
                n = n.parent
            self._close(n)

    def _close(self, n: Node) -> None:
        """Closes ``n`` and all that is open in it."""
        while self.here is not n:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent
        self.open[n.tag] -= 1
        self.here = n.parent

    def _imply(self, tags: frozenset, stop: frozenset) -> None:
        if not any(self.open[t] for t in tags):
            return
        n = self.here
        found = None
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                found = n
            n = n.parent
        if found is not None:
            self._close(found)

    def handle_data(self, data: str) -> None:
        if self.hidden == ["head"] and not data.isspace():
            self.hidden.clear()
        if self.hidden or not data:
            return
        here = self.here
        here.flow.append(data)
        if not data.isspace():
            here.chars += len(data)
            here.ends += data.count(".") + data.count("?") + data.count("!")


class LabelledTree(Tree):
    """Elements of a page whose tags say in ``truth`` whether they are content."""

    def _describe(self, node: Node, attrs: list) -> None:
        super()._describe(node, attrs)
        node.truth = next((int(v) for k, v in attrs if k == "truth"), node.truth)


STYLED, TAGS = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)"), re.compile(r"(?s)<[A-Za-z/!?].*?(?:>|\Z)")


def _stripped(html: str) -> Tree:
    """A page of one element: its text without tags."""
    t = Tree()
    t.handle_data(unescape(TAGS.sub(" ", STYLED.sub(" ", html))))
    return t


def parse(html: str | None, tree: type[Tree] = Tree) -> list[Node]:
    """Elements, parents before children; sums of text and links from below are filled in.

    Should the parser fail on a page after all, its tags are stripped.
    """
    t = tree()
    if html:
        try:
            t.read(html)
        except (AssertionError, ValueError, IndexError):
            t = _stripped(html)
    for n in reversed(t.nodes):
        if n.tag == "a":
            n.linked = n.chars
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.ends += n.ends
    return t.nodes


def kind(tag: str) -> int:
    """Of an edge, by the child: 0 inline, 1 text, 2 box."""
    return 0 if tag in INLINE or tag in VOID else 1 if tag in TEXTUAL else 2


def looks(n: Node) -> list[str]:
    """Names of an element's binary features."""
    k = kind(n.tag)
    size = min(n.chars.bit_length(), 12)
    share = n.linked / n.chars if n.chars else 0.0
    out = [f"kind {k}", f"tag {n.tag}", f"size {k} {size // 2}", f"links {k} {min(int(share * 5), 4)}", f"ends {k} {min(n.ends.bit_length(), 4)}"]
    out += [f"hint {h} {k}" for h in n.hints] or [f"plain {k}"]
    if n.tag in ("div", "section", "td") and n.children:
        out.append(f"paragraphs {min(sum(c.tag == 'p' for c in n.children), 3)}")
    return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


class Field:
    """Potentials: log odds of content by feature, and 2 x 2 scores of (parent, child) labels by kind of child."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.edge = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)]

    def odds(self, nodes: list[Node]) -> tuple[list[float], list[float], list[float]]:
        """Exact log odds of content of every element; the messages up; what each element says without its parent."""
        at = {id(n): i for i, n in enumerate(nodes)}
        get = self.weight.get
        below = [sum(get(f, 0.0) for f in looks(n)) for n in nodes]
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            e, a = self.edge[kind(nodes[i].tag)], below[i]
            up[i] = _add(e[1][0], e[1][1] + a) - _add(e[0][0], e[0][1] + a)
            below[at[id(nodes[i].parent)]] += up[i]
        full = below[:]
        for i in range(1, len(nodes)):
            e, b = self.edge[kind(nodes[i].tag)], full[at[id(nodes[i].parent)]] - up[i]
            full[i] = below[i] + _add(e[0][1], e[1][1] + b) - _add(e[0][0], e[1][0] + b)
        return full, up, below


def fit(pages: list[list[Node]], passes: int = 12, rate: float = 0.3) -> Field:
    """Learns from pages whose elements all have ``truth``: Adagrad on the exact likelihood, with a small ridge."""
    field = Field()
    seen: dict = {}

    def step(key, grad: float, old: float) -> float:
        seen[key] = seen.get(key, 1e-2) + grad * grad
        return old + rate * (grad - 1e-3 * old) / math.sqrt(seen[key])

    for _ in range(passes):
        for nodes in pages:
            at = {id(n): i for i, n in enumerate(nodes)}
            full, up, below = field.odds(nodes)
            change: dict[str, float] = {}
            edges = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)]
            for i, n in enumerate(nodes):
                gap = n.truth - 1 / (1 + math.exp(-max(min(full[i], 60.0), -60.0)))
                for f in looks(n):
                    change[f] = change.get(f, 0.0) + gap
                if i:
                    k, j = kind(n.tag), at[id(n.parent)]
                    b, e = full[j] - up[i], field.edge[kind(n.tag)]
                    s = [[e[p][c] + b * p + below[i] * c for c in (0, 1)] for p in (0, 1)]
                    z = _add(_add(s[0][0], s[0][1]), _add(s[1][0], s[1][1]))
                    for p in (0, 1):
                        for c in (0, 1):
                            edges[k][p][c] += (nodes[j].truth == p and n.truth == c) - math.exp(s[p][c] - z)
            for f, g in change.items():
                field.weight[f] = step(f, g, field.weight.get(f, 0.0))
            for k in range(3):
                for p in (0, 1):
                    for c in (0, 1):
                        field.edge[k][p][c] = step((k, p, c), edges[k][p][c], field.edge[k][p][c])
    return field


def blocks(nodes: list[Node], keep: list[bool]) -> list[str]:
    """Kept text in page order, a string for each block, white space made single spaces."""
    held = {id(n): k for n, k in zip(nodes, keep, strict=True)}
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        line = " ".join("".join(buffer).split())
        if line:
            out.append(line)
        buffer.clear()

    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        n, i = stack.pop()
        if i == len(n.flow):
            if n.tag not in INLINE:
                flush()
            continue
        stack.append((n, i + 1))
        item = n.flow[i]
        if isinstance(item, str):
            if held[id(n)]:
                buffer.append(item)
        elif item.tag in VOID:
            if item.tag == "br":
                buffer.append(" ")
            elif item.tag == "hr":
                flush()
        else:
            if item.tag not in INLINE:
                flush()
            stack.append((item, 0))
    flush()
    return out


def main_text(html: str | None, field: Field) -> str:
    """The page's main text; empty for null, empty and contentless pages."""
    nodes = parse(html)
    full, _, _ = field.odds(nodes)
    return "\n".join(blocks(nodes, [x >= 0 for x in full]))


SYLLABLES = "an er the in tion re ou on st ed ha wh le es ti ment en che sch ung ar que la de".split()


def labelled_pages(n: int = 240, seed: int = 5) -> list[list[Node]]:
    """Pages from a grammar, every element labelled content (1) or not (0)."""
    r = random.Random(seed)

    def words(k: int, end: str = "") -> str:
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(k)).capitalize() + end

    def prose(k: int) -> str:
        return " ".join(words(r.randrange(3, 18), r.choice(".....?!")) for _ in range(k))

    def el(tag: str, inner: str, y: int, cls: str = "") -> str:
        return f'<{tag} truth="{y}"' + (f' {r.choice(("class", "id", "class"))}="{cls}"' if cls else "") + f">{inner}</{tag}>"

    def inline(y: int) -> str:
        t = prose(r.choice([0, 1, 1, 2, 3, 6]))
        if r.random() < 0.5:
            t += " " + el(r.choice(["b", "em", "strong", "i", "code", "span"]), words(r.randrange(1, 40)), y) + " " + words(2, ".")
        if r.random() < 0.3:
            t += " " + el("a", words(r.randrange(1, 6)), y) + words(3, ".")
        return t or words(r.randrange(1, 4), r.choice(["", "."]))

    def links(k: int, y: int = 0) -> str:
        return el("ul", "".join(el("li", el("a", words(r.randrange(1, 5)), y), y) for _ in range(k)), y)

    def advert() -> str:
        return el(r.choice(["div", "div", "aside", "section", "p"]), r.choice([prose(1), words(6), prose(4), el("a", words(5), 0), el("span", prose(1), 0)]), 0, r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo box", "advertisement"]))

    def extras() -> str:
        return r.choice(["", "", advert(), el("div", links(3), 0, r.choice(["share", "social", "share-buttons"])), el("aside", el("h3", words(2), 0) + links(4), 0, r.choice(["related", "", "sidebar"])), el("form", words(3) + el("label", words(2), 0) + el("button", words(1), 0), 0, r.choice(["newsletter", ""])), el("nav", links(4), 0)])

    def body() -> str:
        out = [el(r.choice(["h1", "h1", "h2"]), words(r.randrange(2, 12)), 1)] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 4, 8, 15])):
            x = r.random()
            if x < 0.7:
                out.append(el("p", inline(1), 1))
            elif x < 0.76:
                out.append(el(r.choice(["ul", "ol"]), "".join(el("li", inline(1), 1) for _ in range(r.randrange(1, 6))), 1))
            elif x < 0.82:
                out.append(el("blockquote", r.choice([inline(1), el("p", inline(1), 1)]), 1))
            elif x < 0.87:
                out.append(el(r.choice(["h2", "h3"]), words(4), 1))
            elif x < 0.9:
                out.append(el("pre", words(9), 1))
            elif x < 0.93:
                out.append(el("figure", el("figcaption", words(8, "."), 1), 1))
            elif x < 0.96:
                out.append(el("table", "".join(el("tr", el("td", words(2), 1) + el("td", words(1), 1), 1) for _ in range(3)), 1))
            else:
                out.append(el(r.choice(["div", "section"]), el("p", inline(1), 1), 1))
            if r.random() < 0.12:
                out.append(extras())
        return "".join(out)

    def comments() -> str:
        return el(r.choice(["section", "div"]), el("h3", words(2), 0) + "".join(el(r.choice(["div", "article", "li"]), el("p", prose(r.randrange(1, 4)), 0), 0, r.choice(["comment", "comment reply"])) for _ in range(r.randrange(1, 5))), 0, r.choice(["comments", "discussion", "comment-list", "respond"]))

    pages = []
    for _ in range(n):
        parts = []
        if r.random() < 0.4:
            parts.append(el("div", el("p", prose(2), 0) + el("button", words(1), 0), 0, r.choice(["cookie-banner", "notice", "consent popup", "alert"])))
        if r.random() < 0.6:
            parts.append(el("header", el(r.choice(["h1", "div", "p", "a"]), words(2), 0) + r.choice(["", el("nav", links(5), 0), el("p", words(6), 0)]), 0, r.choice(["", "", "header", "masthead", "site-header"])))
        if r.random() < 0.75:
            parts.append(el("nav", links(r.randrange(2, 9)), 0, r.choice(["", "", "nav", "menu", "navbar", "main-navigation"])))
        for _ in range(r.randrange(3)):
            parts.append(advert())
        side = el(r.choice(["aside", "div", "section"]), el("h3", words(2), 0) + r.choice([links(5), el("p", prose(2), 0), el("p", el("a", words(4), 0), 0) * 3]), 0, r.choice(["sidebar", "widget", "related", "author bio"])) if r.random() < 0.5 else ""
        inner = body()
        if r.random() < 0.2:
            inner += comments()
        main = r.choice([("article", ""), ("article", ""), ("article", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("main", ""), ("div", "entry-content"), ("section", "story"), ("div", "")])
        text = el(main[0], inner, 1, main[1])
        if r.random() < 0.3:
            text = el(r.choice(["main", "div"]), text, 1, r.choice(["", "content", "page", "wrapper"]))
        if r.random() < 0.25:
            text = el("div", text + side, 1, r.choice(["", "container", "page"]))
            side = ""
        parts += r.choice([[side, text], [text, side]])
        if r.random() < 0.4:
            parts.append(comments())
        if r.random() < 0.3:
            parts.append(el("form", el("label", words(2), 0) + el("p", words(5), 0), 0, r.choice(["", "newsletter", "search"])))
        parts.append(el("footer", r.choice(["© " + words(9, "."), el("p", prose(1), 0), links(4), el("p", prose(4), 0) + links(3)]), 0, r.choice(["", "", "", "footer", "site-footer"])))
        page = "".join(parts)
        if r.random() < 0.3:  # the same without the tags that say it: then the class does
            for tag in ("header", "nav", "footer", "aside"):
                page = re.sub(rf'<{tag} truth="0"(?: (?:class|id)="([^"]*)")?>', lambda m, tag=tag: f'<div truth="0" class="{m[1] or tag}">', page).replace(f"</{tag}>", "</div>")
        nodes = parse("<body>" + page, LabelledTree)
        for x in nodes:
            x.truth = int(x.truth or 0) if x is not nodes[0] else 1
        pages.append(nodes)
    return pages


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """Main text of every row: ``id_col``, ``url_col``, text (empty if none), n_chars (code points).

    Null and empty html give an empty text; a cut-off or ill-formed page gives what could be
    read, and no page fails the job (see ``Tree``). ``br`` parts words and not blocks. A very
    long or deep page takes time and memory in proportion to its length. Repeated rows and null
    ids stay; an empty table gives no rows. Other columns are not read. Without ``field`` one
    is learned from ``labelled_pages``.
    """
    field = field or fit(labelled_pages())
    types = pages.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), field) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))
    out = out.mapInArrow(run, f"id {types[id_col].dataType.simpleString()}, url {types[url_col].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
