"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements and runs of text. Every node is content or not.
Node potentials come from a logistic fit on tag, class and id words, text length and
share of links; parent-child potentials are label counts per parent tag. Sum-product
messages go once up and once down the tree and give exact marginals; runs of text whose
marginal is at least one half make up the text. Both kinds of potentials are trained from
labelled pages, which are laid out by a grammar of common page parts with known labels.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements that have no content, that run inside a line, whose
# content is not markup, that may stand in a head or a select, that end an open svg or
# math, and what a starting tag closes. ``#inner`` stands for any element in svg or math.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr object svg math #inner".split()
)
GAPS = frozenset(("br", "img", "svg", "#inner"))
SILENT = "script|style|noscript|template|iframe|textarea"
HEAD = frozenset("base basefont bgsound head html link meta noframes title".split())
SELECT = INLINE | {"option", "optgroup", "hr"}
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html li main menu nav ol p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_REST = r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+"""
_TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<dumb>{SILENT})(?=[\s/>])(?:{_REST}>|[^>]*+>).*?(?:</(?P=dumb)(?=[\s/>])[^>]*+>|\Z)"""
    rf"""|<[!?][^>]*+>"""
    rf"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})>""",
    re.S | re.I,
)
_TITLE_END = re.compile(r"</title(?=[\s/>])[^>]*+>", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    text: str = ""
    chars: int = 0
    linked: int = 0
    label: int = -1


@dataclass
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _pieces(page: str) -> Iterator[tuple[int, int, str, re.Match | None]]:
    """(start, end, tag, match) of the tags of a page, and of its texts with an empty tag.

    Scripts, styles, templates, text areas and the fallbacks of iframe and script run to
    their end tag, or as in a browser to the page's end. A head ends where something starts
    that cannot stand in it, a select likewise, so their end tags may be missing; both are
    left out. Elements in svg and math are inline and an HTML block ends an open one.
    """
    at, quiet, title, foreign, titles_end = 0, "", False, "", True
    m = _TAG.search(page)
    while m is not None:
        start, at_ = m.start(), at
        at = m.end()
        if titles_end and m["name"] and m["name"].lower() == "title" and not m["end"]:
            # what a title holds is no markup; after one without an end tag no other has one
            end = _TITLE_END.search(page, at)
            titles_end = end is not None
            at = end.end() if end else at
        here, m = m, _TAG.search(page, at)
        if start > at_ and not title:
            if quiet == "head" and page[at_:start].strip():
                quiet = ""
            if not quiet:
                yield at_, start, "", None
        if here["name"] is None:
            if quiet == "select" and here["dumb"] and here["dumb"].lower() == "textarea":
                quiet = ""
            continue
        tag, ends = here["name"].lower(), bool(here["end"])
        title = tag == "title" and not ends and not titles_end
        if quiet == "head":
            if tag not in ("head", "body", "html") if ends else tag in HEAD:
                continue
            quiet = ""
        elif quiet == "select":
            if tag in SELECT:
                continue
            quiet = ""
            if tag == "select":
                continue
        if tag == "head" or tag == "select":
            quiet = "" if ends else tag
            if not ends and tag == "select" and foreign:
                foreign = ""
            continue
        if tag == "title":
            continue
        if foreign:
            if tag == foreign or tag in BLOCKS:
                if ends or tag != foreign:
                    foreign = ""
            elif tag not in INLINE:
                if ends:
                    continue
                tag = "#inner"
        elif (tag == "svg" or tag == "math") and not ends and not here["rest"].endswith("/"):
            foreign = tag
        yield start, at, tag, here
    if at < len(page) and not title and (not quiet or quiet == "head" and page[at:].strip()):
        yield at, len(page), "", None


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; runs of text are nodes with tag ``#text``."""
    nodes = [Node("#root", -1)]
    open_: list[int] = [0]
    run, links = _Run(), 0

    def flush() -> None:
        nonlocal run
        if run.parts:
            text = " ".join(html.unescape("".join(run.parts)).split())
            if text:
                nodes.append(Node("#text", open_[-1], text=text, chars=len(text), linked=min(run.linked, len(text))))
            run = _Run()

    def add(piece: str) -> None:
        run.parts.append(piece)
        if links:
            run.linked += len(piece.strip())

    def close(tags: set[str], limit: set[str]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[i]].tag
            if tag in tags:
                del open_[i:]
                return
            if tag in limit:
                return

    for start, end, tag, m in _pieces(page):
        if m is None:
            add(page[start:end])
            continue
        ends = bool(m["end"])
        if tag in INLINE:
            if tag == "a":
                links = 0 if ends else 1
            elif tag in GAPS:
                run.parts.append(" ")
            continue
        flush()
        if ends:
            if tag not in VOID:
                close({tag}, set())
                links = 0
            continue
        if tag in VOID:
            continue
        close({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "button"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPES[tag])
        words: list[str] = []
        if m["rest"]:
            for names in _NAMES.findall(m["rest"]):
                words += (w.lower() for w in _WORDS.findall("".join(names)))
        nodes.append(Node(tag, open_[-1], tuple(dict.fromkeys(words))))
        open_.append(len(nodes) - 1)
    flush()
    for node in reversed(nodes[1:]):
        nodes[node.parent].chars += node.chars
        nodes[node.parent].linked += node.linked
    return nodes


def traits(nodes: list[Node]) -> list[list[str]]:
    """Names of the traits that hold for each node."""
    out = []
    for node in nodes:
        size = min(8, node.chars.bit_length())
        links = 4 * node.linked // node.chars if node.chars else -1
        if node.tag == "#text":
            up = nodes[node.parent].tag
            stop = node.text[-1] in ".!?:;…"
            out.append(["#text", f"text size {size}", f"text links {links}", f"text in {up}", f"text stop {stop}"])
        else:
            out.append([f"tag {node.tag}", f"links {links}", f"size {size}", *(f"word {w}" for w in node.words)])
    return out


@dataclass
class TreeModel:
    """Log-odds per trait, and per parent tag the 2 x 2 table of parent and child labels."""

    bias: float
    weights: dict[str, float]
    edges: dict[str, tuple]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node, by one pass up and one down."""
        get, other = self.weights.get, self.edges["*"]
        odds = []
        for names in traits(nodes):
            z = self.bias + sum(get(t, 0.0) for t in names)
            odds.append(1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, z))))
        n = len(nodes)
        low, high = [1 - p for p in odds], odds[:]  # potential times messages from below
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            e = self.edges.get(nodes[p].tag, other)
            a, b = e[0] * low[i] + e[1] * high[i], e[2] * low[i] + e[3] * high[i]
            s = a + b
            up0[i], up1[i] = a / s, b / s
            low[p] *= up0[i]
            high[p] *= up1[i]
            s = low[p] + high[p]
            low[p], high[p] = low[p] / s, high[p] / s
        out = [0.0] * n
        s = low[0] + high[0]
        out[0] = high[0] / s
        top0, top1 = [1.0] * n, [1.0] * n
        for i in range(1, n):
            p = nodes[i].parent
            e = self.edges.get(nodes[p].tag, other)
            # the parent's belief without what this child has said
            a, b = top0[p] * low[p] / up0[i], top1[p] * high[p] / up1[i]
            x, y = a * e[0] + b * e[2], a * e[1] + b * e[3]
            s = x + y
            top0[i], top1[i] = x / s, y / s
            x, y = top0[i] * low[i], top1[i] * high[i]
            out[i] = y / (x + y)
        return out

    def text(self, page: str) -> str:
        nodes = parse(page)
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes)) if n.tag == "#text" and p >= 0.5)


def train(pages: list[list[Node]], rounds: int = 300, ridge: float = 2e-3) -> TreeModel:
    """Potentials from labelled pages (label 0 or 1 on every node)."""
    names: dict[str, int] = {}
    rows, cols, y = [], [], []
    tables: defaultdict = defaultdict(lambda: np.ones(4))
    seen = np.ones(2)
    for nodes in pages:
        for node, own in zip(nodes, traits(nodes)):
            for t in own:
                rows.append(len(y))
                cols.append(names.setdefault(t, len(names)))
            y.append(node.label)
            if node.parent >= 0:
                up = nodes[node.parent]
                for tag in (up.tag, "*"):
                    tables[tag][2 * up.label + node.label] += 1
                seen[node.label] += 1
    rows, cols, y = np.array(rows), np.array(cols), np.array(y, float)
    w, b, step = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8)
    for _ in range(rounds):  # gradient steps with a rate of its own per trait
        z = b + np.bincount(rows, w[cols], len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.bincount(cols, g[rows], len(names)) / len(y) + ridge * w / len(names)
        step += slope**2
        w -= 0.5 * slope / np.sqrt(step)
        b -= 0.5 * g.mean()
    share = seen / seen.sum()
    edges = {}
    for tag, table in tables.items():
        t = table.reshape(2, 2)
        t = t / t.sum(1, keepdims=True) / share  # child's label given the parent's, against its usual share
        edges[tag] = tuple(float(x) for x in t.ravel())
    return TreeModel(b, {t: float(w[i]) for t, i in names.items()}, edges)


# ---- labelled pages -------------------------------------------------------------------
# Names that page authors commonly give to the parts of a page.
PARTS = {
    "header": (("header", "div"), "header masthead top site branding logo topbar".split()),
    "nav": (("nav", "ul", "div"), "nav menu navbar navigation breadcrumb breadcrumbs links toc pager pagination".split()),
    "ad": (("div", "aside", "section"), "ad ads advert advertisement sponsor sponsored promo banner adsense".split()),
    "notice": (("div", "section"), "notice cookie cookies consent alert popup modal gdpr privacy newsletter subscribe warning message".split()),
    "side": (("aside", "div"), "sidebar side aside widget related recommended popular recent trending more teaser".split()),
    "form": (("form",), "form search login contact signup".split()),
    "comments": (("section", "div", "ol"), "comments comment commentlist reply replies respond discussion responses".split()),
    "share": (("div", "ul"), "share social tags sharing follow buttons".split()),
    "footer": (("footer", "div"), "footer copyright legal bottom colophon credits".split()),
}
CONTENT = (("article", "main", "div", "section"), "content article post entry story text main body page".split())


class Author:
    """Writes pages with known labels. ``label`` of a part holds for all below it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join("".join(self.r.choices("abcdefghilmnoprstuvéäñ", k=self.r.randint(2, 9))) for _ in range(n))

    def sentence(self, low: int = 1, high: int = 30) -> str:
        return self.words(low, high).capitalize() + self.r.choices(".!?,", [20, 1, 1, 1])[0]

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9])))

    def named(self, tags, names, share: float = 0.8) -> tuple[str, str]:
        tag = self.r.choice(tags)
        plain = tag in ("div", "ul", "ol", "section")
        if not plain and self.r.random() < 0.5 or self.r.random() > share:
            return tag, f"<{tag}>" if not plain else f'<{tag} class="{self.r.choice(names)}">'
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(["-", "_", " "]) + self.r.choice(["box", "wrap", "inner", "area", "block", "list", "left", "main", "item"])
        return tag, f'<{tag} {self.r.choice(["class", "id"])}="{name}">'

    def links(self, tag: str) -> Iterator[str]:
        if tag in ("ul", "ol"):
            for _ in range(self.r.randint(1, 8)):
                yield f'<li><a href="#">{self.words(1, 4)}</a></li>'
        elif self.r.random() < 0.6:
            yield "<ul>"
            for _ in range(self.r.randint(1, 8)):
                yield f'<li><a href="#">{self.words(1, 4)}</a></li>'
            yield "</ul>"
        else:
            for _ in range(self.r.randint(1, 6)):
                yield f'<a href="#">{self.words(1, 3)}</a> '

    def part(self, kind: str) -> str:
        tag, start = self.named(*PARTS[kind])
        out = [start]
        if kind in ("nav", "share"):
            out += self.links(tag)
        elif kind == "form":
            for _ in range(self.r.randint(1, 4)):
                out.append(f"<label>{self.words(1, 3)}</label><input type=text>")
            out.append(f"<button>{self.words(1, 2)}</button>")
        elif kind == "comments":
            for _ in range(self.r.randint(1, 4)):
                inner = "li" if tag == "ol" else self.r.choice(["div", "article", "p"])
                out.append(f'<{inner} class="{self.r.choice(["comment", "comment-body", "reply"])}">')
                out.append(self.paragraph() if inner == "p" else f"<p>{self.paragraph()}</p>")
                out.append(f"</{inner}>")
        elif kind == "footer":
            out.append(f"&copy; {self.words(1, 4)} &middot; {self.sentence()}")
        else:
            if self.r.random() < 0.5:
                out.append(self.r.choice([self.sentence(), f"<p>{self.paragraph()}</p>", f"<h3>{self.words(1, 5)}</h3>"]))
            else:
                out.append(self.sentence())
            if self.r.random() < 0.4:
                out += self.links("div")
        return "".join([*out, f"</{tag}>"])

    def block(self) -> str:
        kind = self.r.choices(["p", "open", "h", "list", "quote", "pre", "table"], [12, 5, 3, 2, 1, 0.5, 0.5])[0]
        if kind == "p":
            text = self.paragraph()
            if self.r.random() < 0.2:
                text += f' <a href="#">{self.words(1, 4)}</a> <b>{self.words(1, 3)}</b>'
            return f"<p>{text}</p>"
        if kind == "open":
            return f"<p><b>{self.paragraph()}<br>"
        if kind == "h":
            tag = self.r.choice(["h1", "h2", "h3"])
            return f"<{tag}>{self.words(1, 9)}</{tag}>"
        if kind == "list":
            return "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind == "quote":
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if kind == "pre":
            return f"<pre>{self.words(3, 20)}</pre>"
        return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.sentence()}</td></tr>" for _ in range(3)) + "</table>"

    def page(self) -> list[tuple[str, int]]:
        """Pieces of markup with the label of what they hold; wrappers have the label 1."""
        r, out = self.r, []
        before = [k for k in ("header", "nav", "ad", "notice", "form", "side") if r.random() < 0.45]
        after = [k for k in ("share", "side", "ad", "comments", "form", "nav") if r.random() < 0.4]
        wrap = r.random() < 0.3
        out.append(("<!DOCTYPE html><html><head><title>x</title></head><body>" + ('<div class="wrapper">' if wrap else ""), 1))
        r.shuffle(before)
        out += [(self.part(k), 0) for k in before]
        tag, start = self.named(*CONTENT)
        out.append((start, 1))
        if r.random() < 0.8:
            out.append((f"<h1>{self.words(1, 9)}</h1>", 1))
        for _ in range(r.choice([1, 1, 2, 4, 8, 15])):
            out.append((self.block(), 1))
            if r.random() < 0.08:
                out.append(("</b>" + self.part(r.choice(["ad", "share", "side", "form", "notice"])), 0))
        if r.random() < 0.15:
            out.append((self.part("comments"), 0))
        out.append((f"</{tag}>", 1))
        out += [(self.part(k), 0) for k in after]
        if r.random() < 0.85:
            out.append((self.part("footer"), 0))
        out.append(("</div>" if wrap else "" + "</body></html>", 1))
        return out


def labelled_pages(count: int = 400, seed: int = 7) -> list[list[Node]]:
    """Parsed pages with a label on every node."""
    pages = []
    for k in range(count):
        pieces = Author(seed * 100_003 + k).page()
        nodes, marks = [], []
        text = ""
        for markup, label in pieces:
            text += markup
            marks.append((len(text), label))
        # a node belongs to the piece in which its start lies
        nodes = parse(text)
        ends, at = [m[0] for m in marks], 0
        starts = _starts(text)
        for node, start in zip(nodes[1:], starts):
            while start >= ends[at]:
                at += 1
            node.label = marks[at][1]
        nodes[0].label = 1
        pages.append(nodes)
    return pages


def _starts(page: str) -> list[int]:
    """Where each node of ``parse`` but the root begins."""
    out, begun = [], None
    for start, end, tag, m in _pieces(page):
        if m is None:
            if begun is None and page[start:end].strip():
                begun = start
            continue
        if tag in INLINE:
            continue
        if begun is not None:
            out.append(begun)
            begun = None
        if not m["end"] and tag not in VOID:
            out.append(start)
    return out + ([begun] if begun is not None else [])


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null html counts as empty and gives an empty text. Blocks are joined by one line
    feed, white space inside a block becomes one space, character references are decoded.
    The answer depends on the row alone: repeated rows agree; other columns are ignored.
    """
    fitted = model or train(labelled_pages())

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                texts = [fitted.text(h.as_py() or "") for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
