"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
UNSEEN = RAW | frozenset("head svg math canvas object select option button audio video map datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dt dd legend summary".split())
#: What an opening tag ends if it is open, and the elements in which that search stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: The beginning of a comment, a tag (an end tag with /), or another declaration.
TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
QUOTE = re.compile(r"[\"'>]")
ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Words of class, id and role attributes, by what they tell of an element.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination toc tabs skip links",
    "frame": "header masthead banner topbar footer foot bottom colophon copyright logo brand",
    "side": "sidebar side aside rail widget related recommended recommend more trending popular tags complementary",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay disclaimer newsletter subscribe signup",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted dfp taboola outbrain",
    "form": "form search login share social sharing contact rating vote poll",
    "talk": "comment comments reply replies discussion disqus respond feedback thread",
    "text": "article content main post entry story body text page prose blog news copy",
}
#: Pages that a task holds parsed at a time, and their characters; a longer page is parsed by itself.
AT_A_TIME, CHARS_AT_A_TIME = 64, 2_000_000
HINT_OF = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
TAGS = "article main section div p h1 h2 li ul a nav header footer aside form table td blockquote pre figure span".split()
TAG_OF = {t: k for k, t in enumerate(TAGS)}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    hints: int = 0
    marked: bool = False  # of training pages: main text
    children: list[int] = field(default_factory=list)
    items: list = field(default_factory=list)  # texts (str) and child nodes (int), in page order
    own: int = 0
    text: int = 0
    link: int = 0
    size: int = 1


def _hints(attributes: str) -> int:
    found = 0
    for m in ATTR.finditer(attributes):
        for word in PART.findall(m[2] or m[3] or m[4] or ""):
            k = HINT_OF.get(word.lower())
            if k is not None:
                found |= 1 << k
    return found


class _TagEnds:
    """Where tags end: at the first > outside of quotes. A quote that nothing closes is a character like others.

    From the end backwards each quote or > knows the end that a tag would have whose unquoted part goes on there, so that a page is read
    once, however many tags have no end. Tags must be asked for in order.
    """

    def __init__(self, page: str) -> None:
        self.marks = [m.start() for m in QUOTE.finditer(page)]
        self.ends, self.at, following = [-1] * (len(self.marks) + 1), 0, {}
        for k in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[k]]
            self.ends[k] = self.marks[k] if c == ">" else self.ends[following.get(c, k) + 1]
            following[c] = k

    def of(self, begin: int) -> int:
        while self.at < len(self.marks) and self.marks[self.at] < begin:
            self.at += 1
        return self.ends[self.at]


def parse(page: str) -> list[Node]:
    """Block elements of a page in order of opening, links of inline elements included. Bad nesting is repaired: an end tag
    closes the nearest open element of its name, if there is one, and new blocks end open paragraphs, items and cells. The time is
    proportional to the page's length, whatever it holds: nothing is sought in the page or among open elements in vain."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: dict[str, list[int]] = {}  # the places in the stack of each name, and those of blocks
    blocks: list[int] = []
    at, seek, links, ends, last = 0, 0, 0, _TagEnds(page), page.rfind(">")

    def put(name: str, node: int) -> None:
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, node))

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            name = stack.pop()[0]
            opened[name].pop()
            if name in BLOCK:
                blocks.pop()
            links -= name == "a"

    def nearest(names: set[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def child(tag: str, hints: int, marked: bool = False) -> int:
        parent = stack[-1][1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, hints, marked))
        nodes[parent].children.append(len(nodes) - 1)
        nodes[parent].items.append(len(nodes) - 1)
        return len(nodes) - 1

    def add(text: str) -> None:
        if text and not text.isspace():
            text = html.unescape(text).replace("\x00", "\ufffd")
            node = nodes[stack[-1][1]]
            n = len(text.strip())
            node.items.append(text)
            node.own += n
            node.link += n if links else 0
        elif text:
            nodes[stack[-1][1]].items.append(" ")

    while m := TOKEN.search(page, seek):
        comment, slash, name = m.groups()
        name = name.lower() if name else ""
        end = ends.of(m.end()) if name else -1
        if comment:
            end = page.find("-->", m.end()) + 2
            end = end if end > 1 else len(page)
        elif end < 0 and (slash or not name) and m.end() <= last:  # a declaration, or an end tag that quotes don't let end
            end, name = page.index(">", m.end()), ""
        if end < 0:
            seek = m.start() + 1
            continue
        if at < m.start():
            add(page[at : m.start()])
        attributes = page[m.end() : end]
        at = seek = end + 1
        if not name:
            continue
        if slash:
            if opened.get(name):
                close(opened[name][-1])
            continue
        if name in ENDS:
            targets, stops = ENDS[name]
            if (place := nearest(targets)) > nearest(stops):
                close(place)
        elif name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if name in ("html", "body"):
            continue
        if name == "br":
            nodes[stack[-1][1]].items.append(" ")
        if name in RAW or name == "svg":
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at, last + 1)
            at = seek = found.end() if found else len(page)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            if name == "hr":
                nodes[stack[-1][1]].items.append("\x00")
            continue
        if name in BLOCK or name in UNSEEN:
            put(name, child(name, _hints(attributes), "data-keep" in attributes) if attributes else child(name, 0))
        else:
            hints = _hints(attributes) if name != "a" else 0
            # An inline element that says what it is counts as a block for the trees, not for the text.
            put(name, child("span", hints) if hints and hints != 1 << 7 else stack[-1][1])
            links += name == "a"
    add(page[at:])
    for node in reversed(nodes):
        node.text += node.own
        if node.parent >= 0:
            up = nodes[node.parent]
            up.text, up.link, up.size = up.text + node.text, up.link + node.link, up.size + node.size
    return nodes


def describe(nodes: list[Node]) -> np.ndarray:
    """Features of each node: tag, hints of its own, above and beneath, depth, subtree densities, sibling statistics."""
    above, beneath = [0] * len(nodes), [n.hints for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        beneath[nodes[i].parent] |= beneath[i]
    for i, n in enumerate(nodes[1:], 1):
        up = nodes[n.parent]
        above[i] = above[n.parent] | up.hints | (1 << 8 + TAG_OF[up.tag] if up.tag in TAG_OF else 0)
    column = lambda of: np.fromiter(of, np.int64, len(nodes))
    own, text, link, size, parent, depth = (column(map(attrgetter(name), nodes)) for name in ("own", "text", "link", "size", "parent", "depth"))
    tag, children = column(TAG_OF.get(n.tag, -1) for n in nodes), column(len(n.children) for n in nodes)
    up = np.maximum(parent, 0)
    siblings = np.maximum(1, children[up])
    bits = lambda of: [np.array(of, np.int64) >> k & 1 for k in range(8)]
    inside = lambda *tags: np.array(above, np.int64) & sum(1 << 8 + TAG_OF[t] for t in tags) > 0
    return np.stack([
        tag, tag[up], np.minimum(depth, 30), text, own, link / np.maximum(1, text), text / size, size,
        text / max(1, nodes[0].text), (np.cumsum(own) - own) / max(1, nodes[0].text), siblings, (text - own)[up] / siblings, text / np.maximum(1, text[up]), children,
        *bits([n.hints for n in nodes]), *bits(above), *bits(beneath), inside("article"), inside("main"), inside("nav", "header", "footer", "aside", "form"),
    ], axis=1).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of depth `depth` as arrays: features and cuts of inner nodes, values of leaves."""

    depth: int
    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32) -> Trees:
    """Gradient boosting of the logistic loss, with second-order gains over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(len(x), base), 2**depth - 1
    model = Trees(depth, base, np.zeros((trees, inner), int), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)))
    wide, many = bins + 1, x.shape[1]
    places = binned + np.arange(many) * wide
    last = np.array([len(e) for e in edges])[:, None] <= np.arange(wide)  # no cut behind the last edge
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = y - p, p * (1 - p) + 1e-6, np.zeros(len(x), int)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (many * wide) + places).ravel()
            total = lambda of: np.bincount(where, np.repeat(of, many), nodes * many * wide).reshape(nodes, many, wide).cumsum(axis=2)  # noqa: B023, E731
            gs, hs = total(g), total(h)
            gain = gs**2 / (hs + 1) + (gs[..., -1:] - gs) ** 2 / (hs[..., -1:] - hs + 1) - gs[..., -1:] ** 2 / (hs[..., -1:] + 1)
            gain[:, last] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            held = np.bincount(at - first, minlength=nodes)
            for k in range(nodes):
                j, cut = divmod(int(best[k]), wide)
                if held[k] >= 20 and gain[k, j, cut] > 1e-6:
                    model.features[t, first + k], model.cuts[t, first + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(len(x)), model.features[t, at]] > model.cuts[t, at])
        leaf = at - inner
        sums = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        model.leaves[t] = rate * sums
        margin += model.leaves[t][leaf]
    return model


def decode(nodes: list[Node], margins: np.ndarray) -> list[bool]:
    """The likeliest keeping of nodes in which none is kept beneath one that is dropped, and unseen elements are dropped.

    Of each node: the better of dropping its whole subtree, or keeping it and the best of each child.
    """
    drop, keep = -np.logaddexp(0, margins), -np.logaddexp(0, -margins)
    all_dropped, best = drop.tolist(), [0.0] * len(nodes)
    kept_value, keeps = keep.tolist(), [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        keeps[i] = nodes[i].tag not in UNSEEN and kept_value[i] > all_dropped[i]
        best[i] = kept_value[i] if keeps[i] else all_dropped[i]
        if i:
            all_dropped[nodes[i].parent] += all_dropped[i]
            kept_value[nodes[i].parent] += best[i]
    for i in range(1, len(nodes)):
        keeps[i] = keeps[i] and keeps[nodes[i].parent]
    return keeps


def render(nodes: list[Node], keeps: list[bool]) -> str:
    """Kept texts: a block each line, white space inside a block turned into one space, empty blocks left out."""
    out: list[str] = []
    work: list = [0]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
        elif keeps[item]:
            ends = [] if nodes[item].tag == "span" else ["\x00"]
            work += [*ends, *reversed(nodes[item].items), *ends]
        else:
            out.append(" " if nodes[item].tag == "span" else "\x00")
    blocks = (" ".join(b.split()) for b in "".join(out).split("\x00"))
    return "\n".join(b for b in blocks if b)


# --- training pages: drawn from rules below, as no page comes with labels ---


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choices("aeiounrstlmdkp", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def training_page(rng: random.Random) -> str:
    """A page whose article elements carry data-keep; everything else is boilerplate.

    A third of the pages say what their parts are only by words that no list holds, or not at all, so that place, depth, siblings and densities must tell.
    """
    w = lambda a, b: _words(rng, a, b)
    maybe = lambda p, s: s if rng.random() < p else ""
    links = lambda n: "".join(f"<li><a href=x>{w(1, 3)}</a></li>" for _ in range(n))
    mute = rng.random() < 0.33
    name = lambda kind: w(1, 1) if mute else rng.choice(HINTS[kind].split())

    def box(kind: str, inner: str, tags: str) -> str:
        tag, how = rng.choice(tags.split()), rng.random()
        attr = f' class="{name(kind)}"' if how < 0.5 else f' id="{name(kind)}-{rng.choice("abc")}"' if how < 0.8 else ""
        if mute:
            tag = rng.choice(("div", "div", "section", tag))
        elif tag in ("div", "section", "p") and not attr:
            attr = f" class={name(kind)}"
        return f"<{tag}{attr}>{inner}</{tag}>"

    nav = box("menu", f"<ul>{links(rng.randint(2, 9))}</ul>", "nav div nav")
    head = box("frame", f"<a href=/>{w(1, 3)}</a>{maybe(0.5, '<p>' + w(2, 8) + '</p>')}{maybe(0.4, nav)}", "header div header")
    mark = rng.choice(("&copy; ", "Copyright ", "&copy; 2", "(c) ", ""))
    foot = box("frame", f"{maybe(0.3, '<p>')}{mark}{rng.randint(1990, 2030)} {w(2, 14)}{maybe(0.4, '<ul>' + links(4) + '</ul>')}", "footer div footer")
    note = box("notice", f"{maybe(0.5, '<p>')}{w(5, 30)} <button>{w(1, 2)}</button>", "div section div")
    advert = lambda: box("advert", maybe(0.5, "<p>") + w(2, 25), "div aside div")
    side = box("side", "".join(f"<h3>{w(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul>{maybe(0.4, '<p>' + w(5, 30) + '</p>')}" for _ in range(rng.randint(1, 3))), "aside div aside")
    form = box("form", f"<label>{w(1, 3)}</label><input><p>{w(2, 12)}</p>", "form form div")
    talk = box("talk", f"<h3>{w(1, 3)}</h3>" + "".join(f"<div class={name('talk')}><p>{w(4, 40)}</p><a>{w(1, 1)}</a></div>" for _ in range(rng.randint(1, 6))), "div section div")

    def paragraph() -> str:
        kind = rng.random()
        body = w(1, rng.choice([6, 30, 90]))
        if kind < 0.12:
            return f"<ul data-keep>{''.join(f'<li data-keep>{w(1, 20)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if kind < 0.2:
            return f"<h{(h := rng.randint(2, 4))} data-keep>{w(1, 8)}</h{h}>"
        if kind < 0.25:
            return f"<blockquote data-keep><p data-keep>{body}</p></blockquote>"
        if kind < 0.29:
            return f"<table data-keep><tr data-keep><td data-keep>{w(1, 4)}</td><td data-keep>{w(1, 4)}</td></tr></table>"
        if kind < 0.32:
            return f"<figure data-keep><img><figcaption data-keep>{w(2, 12)}</figcaption></figure>"
        if kind < 0.36:
            return f"<pre data-keep>{w(3, 30)}</pre>"
        if kind < 0.42:
            return f"<div data-keep>{body}</div>"
        return f"<p data-keep>{maybe(0.1, '<b>')}{body}{maybe(0.2, f' <a href=y>{w(1, 3)}</a> ' + w(1, 9))}{maybe(0.1, '<br>')}</p>"

    parts = [f"<h1 data-keep>{w(2, 12)}</h1>"] * (rng.random() < 0.85) + [paragraph() for _ in range(rng.randint(1, 25))]
    for extra in (advert, lambda: form, lambda: box("side", f"<ul>{links(3)}</ul>", "div aside"), lambda: box("notice", w(3, 20), "div p")):
        if not mute and rng.random() < 0.2:
            parts.insert(rng.randint(1, len(parts)), extra())
    body = "".join(parts)
    kind = rng.random()
    core = f"<article data-keep>{body}</article>" if kind < 0.5 else f'<div data-keep class="{name("text")}">{body}</div>' if kind < 0.8 else f"<section data-keep>{body}</section>" if kind < 0.9 else f"<div data-keep>{body}</div>"
    if rng.random() < 0.4:
        core = f"<main data-keep>{core}{maybe(0.3, talk)}{maybe(0.2, side)}</main>"
    elif rng.random() < 0.4:
        core = f'<div data-keep id="{rng.choice("wrapper container page content main".split())}">{maybe(0.3, side)}{core}{maybe(0.3, talk)}</div>'
    top = [maybe(0.6, head), maybe(0.6, nav), maybe(0.3, note), maybe(0.4, advert())]
    rng.shuffle(top)
    end = [maybe(0.3, advert()), maybe(0.4, side), maybe(0.35, talk), maybe(0.2, form), maybe(0.2, note)]
    rng.shuffle(end)
    return f"<html><body>{''.join(top)}{core}{''.join(end)}{maybe(0.8, foot)}</body></html>"


@lru_cache(maxsize=1)
def model(pages: int = 700, seed: int = 11) -> Trees:
    """Trees fitted to `pages` drawn pages: a bound on the labelled rows, the same for every corpus."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(training_page(rng))
        xs.append(describe(nodes))
        ys.append(np.array([True, *[n.marked for n in nodes[1:]]]))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees see the nodes of all pages at once."""
    parsed = [parse(page or "") for page in pages]
    margins = trees.margin(np.concatenate([describe(nodes) for nodes in parsed])) if parsed else []
    ends = np.cumsum([len(nodes) for nodes in parsed])
    return [render(nodes, decode(nodes, margins[end - len(nodes) : end])) for nodes, end in zip(parsed, ends, strict=True)]


def _slices(pages: list[str | None]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, page in enumerate(pages):
        if k - start == AT_A_TIME or k > start and held + len(page or "") > CHARS_AT_A_TIME:
            yield start, k
            start, held = k, 0
        held += len(page or "")
    yield start, len(pages)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null or empty html, or no main text: an empty text. Very long and deeply nested pages are read whole, without
    recursion. Null ids and urls stay; repeated rows: a row each; no rows: no rows. Other columns are not read.
    """
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2).to_pylist()
            texts = [text for start, end in _slices(pages) for text in main_texts(pages[start:end], trees)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
