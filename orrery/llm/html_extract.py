"""Main text of web pages by a tree-structured graphical model.

A tolerant parser builds the tree of block elements, with runs of text as leaves. Every node has a hidden
state, content or not. Its own evidence (tag, words of class and id, link share, length, punctuation) gives a
potential, and parent and child share a potential of their two states. Sum-product messages pass upward and
downward once and give exact marginals; leaves that are content with probability one half or more are the
text. Weights maximise the likelihood of labelled pages, whose gradient the same messages give.

labelled_pages() makes the training pages: page shapes of many kinds with their content known, from a seed.

Character references are decoded, white space inside a block becomes one space, blocks join by a line feed.
Nulls: a null page is empty and gives an empty text; null ids and addresses are ordinary. Repeated rows are
extracted each; empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the HTML standard: elements without content, with raw content, and inside lines of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
#: Raw elements whose content goes to the end of the page where they are not closed; others then count for nothing.
ENDLESS = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = frozenset("ul ol dl table article section div body html td th main aside nav header footer blockquote form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|[^<]+|<", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[.!?…:;。！？][\"'”’»)]*$")

#: Words of class, id and role that name the parts of a page.
SIDE = frozenset("ad ads advert advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside rail widget related recommended share social cookie consent notice alert popup modal overlay subscribe newsletter signup login form search comment comments reply replies disqus discussion copyright legal pagination pager tags toolbar byline meta skip".split())
MAIN = frozenset("article content main post entry story body text page story-body prose".split())
GROUPS = ("main article", "nav menu", "header", "footer", "aside", "form fieldset button select", "p", "h1 h2 h3 h4 h5 h6", "li ol ul dl dt dd", "blockquote pre figure figcaption table tr td th", "div section")
TAG_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
N_FEATURES = len(GROUPS) + 19


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset[str] = frozenset()
    text: list[str] = field(default_factory=list)
    linked: int = 0
    chars: int = 0


class Open:
    """The open elements, with the places of each tag and of scopes, so that what a tag closes is found at once."""

    def __init__(self) -> None:
        self.stack = [0]
        self.tags: list[str] = [""]
        self.places: dict[str, list[int]] = {}
        self.scopes, self.outer = [0], [0]

    def push(self, node: int, tag: str) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(at)
        if tag in SCOPE:
            self.scopes.append(at)
            if tag not in ("td", "th"):
                self.outer.append(at)

    def last(self, tag: str) -> int:
        """Where the innermost element of a tag is; 0 for none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.stack.pop()
            self.places[self.tags.pop()].pop()
        while self.scopes[-1] >= at:
            self.scopes.pop()
        while self.outer[-1] >= at:
            self.outer.pop()

    def close(self, tag: str) -> None:
        at = self.last(tag)
        if at and not (tag in ("p", "li") and self.scopes[-1] > at):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """What the start of a tag closes."""
        if tag in CLOSES_P and self.last("p") > self.scopes[-1]:
            self.cut(self.last("p"))
        if tag in ENDED_BY:
            at = max(map(self.last, ENDED_BY[tag]))
            if at > self.outer[-1]:
                self.cut(at)


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; leaves have the tag #text. Time is in proportion to the page."""
    nodes = [Node("#root", -1)]
    open_ = Open()
    links = 0
    leaf: int | None = None
    at, end = 0, len(page)
    without_close: set[str] = set()
    while at < end:
        m = _TOKEN.match(page, at)
        if m.group(0) == "<":
            # a tag whose quotes don't close ends at the next >
            m = _LOOSE.match(page, at) or m
        at = m.end()
        name = m.group(2) if m.re.groups else None
        if name is None:
            found = m.group(0)
            if found[:1] != "<" or found == "<":
                if leaf is None:
                    leaf = len(nodes)
                    nodes.append(Node("#text", open_.stack[-1]))
                nodes[leaf].text.append(found)
                size = len(found.strip())
                nodes[leaf].chars += size
                nodes[leaf].linked += size if links else 0
            continue
        tag = name.lower()
        if m.group(4) != ">":
            break
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            leaf = None
            open_.close(tag)
            links = 0
            continue
        if tag in RAW:
            close = None if tag in without_close else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ENDLESS:
                break
            else:
                without_close.add(tag)
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag in VOID:
            if tag == "br" and leaf is not None:
                nodes[leaf].text.append(" ")
            elif tag == "hr":
                leaf = None
            continue
        leaf, links = None, 0
        open_.make_room(tag)
        said = " ".join(a or b or c for a, b, c in _NAMES.findall(m.group(3))).lower() if m.group(3) else ""
        nodes.append(Node(tag, open_.stack[-1], frozenset(_PART.findall(said))))
        if not m.group(3).endswith("/"):
            open_.push(len(nodes) - 1, tag)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent]
        up.chars += nodes[i].chars
        up.linked += nodes[i].linked
    return nodes


def block_text(node: Node) -> str:
    return " ".join(html.unescape("".join(node.text)).split())


def features(nodes: list[Node]) -> list[list[int]]:
    """Indices of the features that hold for each node."""
    total = max(1, nodes[0].chars)
    out = []
    first = len(GROUPS)
    under: list[tuple[bool, bool]] = []
    for i, x in enumerate(nodes):
        f = [first]
        good, side = under[x.parent] if i else (False, False)
        if side:
            f.append(first + 17)
        elif good:
            f.append(first + 16)
        elif x.tag == "#text":
            f.append(first + 18)
        group = TAG_GROUP.get(x.tag)
        under.append((good or group == 0 or bool(x.names & MAIN), side or group in (1, 2, 3, 4, 5) or bool(x.names & SIDE)))
        if x.tag == "#text":
            last = x.text[-1].rstrip() if x.text else ""
            f.append(first + 1)
            f.append(first + (2 if x.chars < 25 else 3 if x.chars < 80 else 4 if x.chars < 250 else 5))
            if _ENDS.search(last):
                f.append(first + 6)
        else:
            if group is not None:
                f.append(group)
            if x.names & SIDE:
                f.append(first + 7)
            elif x.names & MAIN:
                f.append(first + 8)
            if x.chars > 0.5 * total:
                f.append(first + 9)
            elif x.chars < 0.05 * total:
                f.append(first + 10)
        share = x.linked / x.chars if x.chars else 0.0
        f.append(first + (11 if share == 0 else 12 if share < 0.3 else 13 if share < 0.7 else 14))
        if i and nodes[x.parent].tag == "#root":
            f.append(first + 15)
        out.append(f)
    return out


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((3, 4)))


def edge_kind(nodes: list[Node], i: int) -> int:
    """Which pair potential holds between a node and its parent: below the page's shell, above a leaf, or neither."""
    return 0 if nodes[nodes[i].parent].tag in ("#root", "html", "body") else 1 if nodes[i].tag == "#text" else 2


def messages(nodes: list[Node], own: list[float], pair: list[list[float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Marginals of content, and of (parent, child) state pairs, by one upward and one downward pass."""
    n = len(nodes)
    score = [(1.0, x) for x in own]
    belief = [list(x) for x in score]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    kinds = [edge_kind(nodes, i) if i else 0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        a, b = belief[i]
        p00, p01, p10, p11 = pair[kinds[i]]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
        z = m0 + m1
        up[i] = (m0 / z, m1 / z)
        q = belief[nodes[i].parent]
        q[0] *= up[i][0]
        q[1] *= up[i][1]
        z = q[0] + q[1]
        q[0] /= z
        q[1] /= z
    joint: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
    z = belief[0][0] + belief[0][1]
    belief[0] = [belief[0][0] / z, belief[0][1] / z]
    for i in range(1, n):
        f0, f1 = belief[nodes[i].parent]
        u0, u1 = up[i]
        c0, c1 = f0 / u0 if u0 else 0.0, f1 / u1 if u1 else 0.0
        a, b = belief[i]
        p00, p01, p10, p11 = pair[kinds[i]]
        j = (c0 * p00 * a, c0 * p01 * b, c1 * p10 * a, c1 * p11 * b)
        z = sum(j)
        joint[i] = (j[0] / z, j[1] / z, j[2] / z, j[3] / z)
        belief[i] = [joint[i][0] + joint[i][2], joint[i][1] + joint[i][3]]
    return [x[1] for x in belief], joint


def _potentials(model: Model, held: list[list[int]]) -> tuple[list[float], list[list[float]]]:
    w = model.weights
    own = [float(np.exp(min(30.0, max(-30.0, sum(w[k] for k in f))))) for f in held]
    return own, np.exp(model.pair).tolist()


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes = parse(page)
    own, pair = _potentials(model, features(nodes))
    sure, _ = messages(nodes, own, pair)
    return "\n".join(t for x, p in zip(nodes, sure, strict=True) if x.tag == "#text" and p >= 0.5 and (t := block_text(x)))


def labelled_pages(n: int = 120, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of many shapes and the texts of their content blocks."""
    rng = random.Random(seed)
    parts = "ba ke lo mi nu ra se ti vo za pe du fi go hu jo ly ma no qua".split()
    serial = iter(range(10**9))

    def words(k: int) -> str:
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(k))

    def sentence(lo: int = 6, hi: int = 40) -> str:
        return f"{words(rng.randint(lo, hi)).capitalize()} n{next(serial)}."

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div",)) -> str:
        tag = rng.choice(tags)
        attr = rng.choice(['class="{}"', 'id="{}"', 'class="x {} y"']).format(rng.choice(names)) if tag == "div" or rng.random() < 0.5 else ""
        return f"<{tag} {attr}>{inner}</{tag}>"

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(rng.randint(1, 2))} n{next(serial)}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"

    out = []
    for _ in range(n):
        good: set[str] = set()

        def keep(text: str, good: set[str] = good) -> str:
            good.add(text)
            return text

        body = [f"<h1>{keep(words(rng.randint(3, 10)) + f' n{next(serial)}')}</h1>"]
        style = rng.choice(["plain"] * 4 + ["bare", "short", "same"])
        for _ in range(rng.choice([0, 1, 2, 3, 8, 12, 12, 50])):
            kind = rng.random()
            text = " ".join(sentence() for _ in range(rng.randint(1, 5))) if kind < 0.85 else sentence(1, 4)
            if style == "bare":
                text = f"{words(rng.randint(5, 60))} n{next(serial)}"
            elif style == "short":
                text = sentence(1, 4)
            elif style == "same":
                text = " ".join([words(1)] * rng.randint(3, 80)) + f" n{next(serial)}"
            if kind < 0.6:
                body.append(f"<p>{keep(text)}</p>")
            elif kind < 0.7:
                body.append(f"<p><b>{keep(text)}<br>")
            elif kind < 0.78:
                body.append(f"<h2>{keep(words(rng.randint(2, 6)) + f' n{next(serial)}')}</h2>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{keep(sentence(3, 15))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote><p>{keep(sentence())}</p></blockquote>")
            else:
                body.append(f"<div>{keep(text)}</div>")
        if rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), box(["ad", "advert", "promo", "related", "share"], rng.choice([sentence(), menu()]), ("div", "aside")))
        inner = "".join(body)
        if rng.random() < 0.25:
            inner += box(["comments", "comment-list", "discussion"], "".join(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 5))), ("div", "section"))
        main = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="post entry">{}</div>', '<main><article>{}</article></main>', '<article class="story">{}</article>', "<div>{}</div>"]).format(inner)
        top = [box(["nav", "menu", "navbar"], menu(), ("nav", "div"))]
        if rng.random() < 0.6:
            top.insert(0, box(["header", "masthead"], f'<a href="/">{words(2)} n{next(serial)}</a><p>{sentence(2, 8)}</p>', ("header", "div")))
        for chance, names, what in ((0.7, ["ad", "banner", "sponsored"], sentence(3, 25)), (0.4, ["cookie-notice", "consent", "alert"], f"<p>{sentence(8, 30)}</p><button>ok</button>"), (0.3, ["newsletter", "login"], f"<form><label>{words(3)} n{next(serial)}</label><input><button>go</button></form>")):
            if rng.random() < chance:
                top.insert(rng.randint(0, len(top)), box(names, what))
        bottom = []
        if rng.random() < 0.5:
            bottom.append(box(["sidebar", "rail", "widget"], f"<h3>{words(2)} n{next(serial)}</h3>" + rng.choice([menu(), f"<p>{sentence()}</p>"]), ("aside", "div")))
        if rng.random() < 0.3:
            bottom.append(box(["comments", "replies"], "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 4))), ("section", "div")))
        bottom.append(box(["footer", "copyright"], f"&copy; {sentence(2, 12)}", ("footer", "div")))
        out.append((f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{''.join(top)}<!-- x -->{main}{''.join(bottom)}</body></html>", good))
    return out


def train(pages: list[tuple[str, set[str]]], rounds: int = 50, rate: float = 0.7, shrink: float = 1e-4) -> Model:
    """Weights by gradient ascent (AdaGrad) on the likelihood of the labelled trees."""
    trees = []
    for page, good in pages:
        nodes = parse(page)
        held, inside, text = features(nodes), [0] * len(nodes), [0] * len(nodes)
        state = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "#text":
                state[i] = int(block_text(nodes[i]) in good)
                inside[i], text[i] = nodes[i].chars * state[i], nodes[i].chars
            else:
                state[i] = int(2 * inside[i] > text[i])
            if i:
                inside[nodes[i].parent] += inside[i]
                text[nodes[i].parent] += text[i]
        trees.append((nodes, held, state))
    model = Model()
    past, past_pair = np.full(N_FEATURES, 1e-6), np.full((3, 4), 1e-6)
    size = sum(len(t[0]) for t in trees) or 1
    for _ in range(rounds):
        slope, slope_pair = (-shrink * model.weights * size).tolist(), (-shrink * model.pair * size).tolist()
        for nodes, held, state in trees:
            own, pair = _potentials(model, held)
            sure, joint = messages(nodes, own, pair)
            for i, f in enumerate(held):
                off = state[i] - sure[i]
                for k in f:
                    slope[k] += off
                if i:
                    row = slope_pair[edge_kind(nodes, i)]
                    row[2 * state[nodes[i].parent] + state[i]] += 1
                    for k in range(4):
                        row[k] -= joint[i][k]
        slope, slope_pair = np.array(slope) / size, np.array(slope_pair) / size
        past += slope**2
        past_pair += slope_pair**2
        model.weights += rate * slope / np.sqrt(past)
        model.pair += rate * slope_pair / np.sqrt(past_pair)
    return model


def extract_text(pages: DataFrame, model: Model | None = None, *, html_col: str = "html") -> DataFrame:
    """pages without html_col, plus text and n_chars."""
    model = model or train(labelled_pages())
    kept = [c for c in pages.columns if c != html_col and c not in ("text", "n_chars")]
    rows = pages.select(*(f"`{c}`" for c in kept), f"`{html_col}`")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return rows.mapInArrow(each, ", ".join(x for x in (fields, "text string, n_chars long") if x))
