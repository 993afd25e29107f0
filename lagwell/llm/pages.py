"""Main text of web pages by a tree-structured graphical model of the DOM.

Every structural element is a node labelled content or boilerplate. Node
potentials are linear in features of the tag, its class and id, and its own
text; edge potentials join a node and its parent. Sum-product messages go
from the leaves to the root and back, one tree level of all pages of a batch
at a time, and give each node its exact content marginal. The weights are
learned by maximum likelihood on labelled pages, by default on generated
ones, so they depend on nothing but a seed.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lagwell.llm.batches import slices, texts

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
#: What may stand in a tag before its end, quoted strings as a whole.
_INSIDE = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^<>\"']++)*+")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements left out with all they hold; without an end tag only the first two run to the end of the page.
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style template noscript svg iframe annotation annotation-xml".split()}
#: What a head may hold; any other start tag, or text outside the title, ends one that is not closed.
HEAD = frozenset("html base basefont bgsound link meta title script style noscript template".split())

#: A formula runs on in its sentence; so does what stands inside an object or a canvas.
FORMULA = "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics object canvas"
INLINE = frozenset(FORMULA.split()) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img input hr meta link source track area col embed param base".split())
VOID_BREAK = frozenset(("br", "wbr", "img", "hr"))
#: A start tag of the first kind ends an open element of the second kinds.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("p", "td", "th", "tr"),
    "td": ("p", "td", "th"),
    "th": ("p", "td", "th"),
    "option": ("option",),
}
#: Where the search for an element to end stops.
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

TAG_GROUPS = ("nav menu", "header", "footer", "aside", "form fieldset label button select option textarea legend", "ul ol dl", "li dt dd", "p", "h1 h2 h3 h4 h5 h6", "article", "main", "section", "div", "table tbody thead tr td th", "figure figcaption", "blockquote pre", "body html")
CLASS_GROUPS = (
    r"nav|menu|breadcrumb|pagination|pager|toc",
    r"header|masthead|topbar|branding|logo",
    r"footer|copyright|legal|colophon",
    r"side|related|widget|recommend|popular|trending|teaser",
    r"\bads?\b|advert|sponsor|promo|banner|dfp|adsense",
    r"cookie|consent|notice|gdpr|alert|popup|modal|newsletter|subscribe|signup|paywall",
    r"comment|reply|replies|discussion|disqus|respond",
    r"share|social|follow|tweet",
    r"content|article|post\b|entry|story|body|text|prose|main",
    r"search|login|form",
)
_CLASSES = [re.compile(x, re.I) for x in CLASS_GROUPS]
_TAG_INDEX = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
N_TEXT = 8
N_FEATURES = 1 + len(TAG_GROUPS) + len(CLASS_GROUPS) + N_TEXT
N_EDGES = 3


@lru_cache(50_000)
def _element(tag: str, attributes: str) -> tuple[int, ...]:
    """The active features of a start tag."""
    on = [0]
    if tag in _TAG_INDEX:
        on.append(1 + _TAG_INDEX[tag])
    names = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else ""
    if names:
        on += [1 + len(TAG_GROUPS) + i for i, c in enumerate(_CLASSES) if c.search(names)]
    return tuple(on)


#: Elements nested deeper hang on their ancestor at this depth, as in browsers; none of their text is lost.
DEEPEST = 512


@dataclass
class Tree:
    """Structural elements of one page in document order; a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    on: list[tuple[int, ...]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


class Tags:
    """The markup of a page from left to right, in time proportional to the page.

    A tag ends at its first ``>`` outside quotes, or, where quotes do not
    pair up before the next ``<``, at its first ``>``; that is not tried again
    for the tags up to the place where the pairing failed.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.loose = page, page.rfind(">"), 0

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """``(start, end, name, inside, is an end tag)`` of the next one; comments and declarations have no name."""
        page = self.page
        while m := _MARK.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                return m.start(), len(page) if end < 0 else end + 3, "", "", False
            at = m.end()
            if at > self.last:
                continue
            if m[3] is None:
                return m.start(), page.find(">", at) + 1, "", "", False
            if m.start() >= self.loose:
                end = _INSIDE.match(page, at).end()
                if page.startswith(">", end):
                    return m.start(), end + 1, m[3].lower(), page[at:end], bool(m[2])
                self.loose = end
            end = page.find(">", at)
            return m.start(), end + 1, m[3].lower(), page[at:end], bool(m[2])
        return None


class Open:
    """The open elements, root first, with the places of each kind, so that none is searched for."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["html"]
        self.at: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def place(self, tag: str) -> int:
        """Of the innermost element of this kind; 0 if there is none."""
        held = self.at.get(tag)
        return held[-1] if held else 0

    def close(self, place: int) -> None:
        """It and all inside it."""
        if place:
            while len(self.nodes) > place:
                self.nodes.pop()
                self.at[self.tags.pop()].pop()


def parse(page: str) -> Tree:
    """The structural tree and its text blocks; inline elements belong to the element around them."""
    tree = Tree([-1], [0], ["html"], [_element("html", "")], [0], [0], [""])
    stack, pieces, links, linked = Open(), [], 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                at = stack.nodes[-1]
                tree.blocks.append((at, text))
                tree.chars[at] += len(text)
                tree.linked[at] += min(linked, len(text))
                tree.last[at] = text
        linked = 0

    at, head, title, endless = 0, False, False, set()
    tags = Tags(page)
    while found := tags.next(at):
        start, end, name, inside, closing = found
        if start > at:
            head = head and (title or page[at:start].isspace())
            if not head:
                pieces.append(page[at:start])
                if links:
                    linked += start - at
        at = end
        if not name:
            continue
        if name in _RAW_END and not closing:
            head = head and name in HEAD
            if name not in ("script", "style") and inside.endswith("/"):
                continue
            over = None if name in endless else _RAW_END[name].search(page, at)
            if over:
                at = over.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
            continue
        if name == "head":
            head, title = not closing, False
            continue
        if head:
            title = title and name != "title" if closing else name == "title"
            if closing or name in HEAD:
                continue
            head = False
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif name in VOID_BREAK:
                pieces.append(" ")
            continue
        flush()
        if closing:
            stack.close(stack.place(name))
            links = 0
            continue
        if name == "html" or name == "body" and stack.place("body"):
            continue
        for closed in CLOSES.get(name, ()):
            if closed == "p":
                if stack.tags[-1] == "p":
                    stack.close(stack.place("p"))
            elif stack.place(closed) > max(map(stack.place, FENCE.get(closed, ())), default=0):
                stack.close(stack.place(closed))
        depth = min(len(stack.nodes), DEEPEST)
        tree.parent.append(stack.nodes[depth - 1])
        tree.depth.append(depth)
        tree.tag.append(name)
        tree.on.append(_element(name, inside))
        tree.chars.append(0)
        tree.linked.append(0)
        tree.last.append("")
        if not inside.endswith("/"):
            stack.push(len(tree.parent) - 1, name)
    if at < len(page) and not (head and title):
        pieces.append(page[at:])
    flush()
    return tree


@dataclass
class Forest:
    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    first: np.ndarray


_SENTENCE = re.compile(r"[.!?…。:;\"'”»)]$")


def forest(trees: list[Tree]) -> Forest:
    first = np.cumsum([0, *(len(t.parent) for t in trees)])
    n = int(first[-1])
    x = np.zeros((n, N_FEATURES))
    at = [i for i, on in enumerate(o for t in trees for o in t.on) for _ in on]
    x[at, [f for t in trees for on in t.on for f in on]] = 1
    chars = np.array([c for t in trees for c in t.chars], float)
    linked = np.array([c for t in trees for c in t.linked], float)
    last = [s for t in trees for s in t.last]
    base = N_FEATURES - N_TEXT
    has = chars > 0
    ends = np.array([bool(s) and _SENTENCE.search(s) is not None for s in last])
    rights = np.array(["©" in s or "(c)" in s.lower()[:8] for s in last])
    for k, value in enumerate((has, chars > 40, chars > 120, chars > 400, has & (linked > 0.5 * chars), has & ends, has & (chars < 25), rights)):
        x[:, base + k] = value
    parent = np.concatenate([np.where(np.array(t.parent) >= 0, np.array(t.parent) + a, -1) for t, a in zip(trees, first, strict=False)]) if trees else np.zeros(0, int)
    depth = np.array([d for t in trees for d in t.depth], int)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    # edges differ for text-bearing children, for landmark elements and for the rest
    landmark = x[:, [1, 2, 3, 4, 5]].any(1)
    kind = np.where(landmark, 2, np.where(has, 0, 1))
    return Forest(x, parent, kind, levels, first)


def _soft(a: np.ndarray) -> np.ndarray:
    """log-sum-exp over the last axis of size two."""
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(f: Forest, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(content) per node, joint of (parent, node) labels per node, log partition) by sum-product up and down."""
    score = f.x @ w
    up = np.stack([np.zeros_like(score), score], 1)
    to_parent = np.zeros_like(up)
    psi = pair[f.kind]  # [n, parent label, own label]
    for level in reversed(f.levels[1:]):
        to_parent[level] = _soft(psi[level] + up[level][:, None, :])
        np.add.at(up, f.parent[level], to_parent[level])
    roots = f.levels[0] if f.levels else np.zeros(0, int)
    log_z = float(_soft(up[roots]).sum())
    down = np.zeros_like(up)
    joint = np.zeros((len(score), 2, 2))
    for level in f.levels[1:]:
        outer = up[f.parent[level]] + down[f.parent[level]] - to_parent[level]
        both = outer[:, :, None] + psi[level] + up[level][:, None, :]
        down[level] = np.logaddexp(*(outer[:, :, None] + psi[level]).transpose(1, 0, 2))
        both -= both.max((1, 2), keepdims=True)
        both = np.exp(both)
        joint[level] = both / both.sum((1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint, log_z


def train(trees: list[Tree], labels: list[list[int]], steps: int = 120, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, edge potentials [kind, parent, own]) by gradient ascent on the exact likelihood."""
    f = forest(trees)
    y = np.array([b for a in labels for b in a])
    w, pair = np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2))
    inner = np.flatnonzero(f.parent >= 0)
    gold = np.zeros((N_EDGES, 2, 2))
    np.add.at(gold, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    scale = np.maximum(np.bincount(f.kind[inner], minlength=N_EDGES), 1)[:, None, None]
    often = np.maximum(f.x.sum(0), 20)
    for _ in range(steps):
        p, joint, _ = marginals(f, w, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, f.kind[inner], joint[inner])
        w += rate * (f.x.T @ (y - p) / often * 2 - penalty * w)
        pair += rate * ((gold - expected) / scale - penalty * pair)
    return w, pair


# ---- labelled pages ----------------------------------------------------------------------


def _labelled(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A generated page and its text blocks with their labels, unique enough to find again."""
    word = lambda: "".join(rng.choice("aeioubcdlmnprstéü") for _ in range(rng.randint(2, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: phrase(2, 18).capitalize() + rng.choice(".....?!")
    truth: list[tuple[str, bool]] = []

    def say(text: str, content: bool) -> str:
        truth.append((text, content))
        return text

    def links(n: int) -> str:
        wrap = rng.choice((("<ul>", "<li>", "</li>", "</ul>"), ("<div>", "", " ", "</div>")))
        if wrap[1]:
            return wrap[0] + "".join(f'{wrap[1]}<a href="/x">{say(phrase(1, 3), False)}</a>{wrap[2]}' for _ in range(n)) + wrap[3]
        return wrap[0] + f'<a href="/x">{say(phrase(2, 6), False)}</a>' + wrap[3]

    def junk(kind: str) -> str:
        tag, names = {
            "nav": (rng.choice(("nav", "div", "ul")), ("nav", "menu", "main-menu", "breadcrumbs")),
            "header": (rng.choice(("header", "div")), ("header", "site-header", "masthead")),
            "footer": (rng.choice(("footer", "footer", "div")), ("footer", "site-footer", "copyright")),
            "side": (rng.choice(("aside", "div")), ("sidebar", "related", "widget")),
            "ad": (rng.choice(("div", "section", "aside")), ("ad", "ads", "advert", "sponsored", "promo-banner")),
            "notice": ("div", ("cookie-notice", "consent", "newsletter", "alert")),
            "form": ("form", ("search", "login", "")),
            "comments": (rng.choice(("section", "div")), ("comments", "comment-list", "discussion")),
            "share": ("div", ("share", "social-links")),
        }[kind]
        plain = tag in ("nav", "footer", "aside", "header", "form") and rng.random() < 0.6
        mark = "" if plain else f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'
        if kind in ("nav", "share") or kind == "header" and rng.random() < 0.5:
            body = links(rng.randint(2, 8))
            if tag == "ul":
                body = "".join(f'<li><a href="/x">{say(phrase(1, 3), False)}</a></li>' for _ in range(rng.randint(2, 7)))
        elif kind == "form":
            body = f"<label>{say(phrase(1, 3), False)}</label><input name=q><button>{say(phrase(1, 2), False)}</button>"
        elif kind == "footer":
            body = "&copy; " + say(phrase(1, 3) + " &middot; " + sentence(), False)
        elif kind == "comments":
            body = "".join(f'<div class="comment"><p>{say(" ".join(sentence() for _ in range(rng.randint(1, 4))), False)}</p></div>' for _ in range(rng.randint(1, 5)))
        else:
            bare = rng.random() < 0.5
            body = "".join((("", "") if bare else ("<p>", "</p>"))[0] + say(" ".join(sentence() for _ in range(rng.randint(1, 3))), False) + ("" if bare else "</p>") for _ in range(1 if bare else rng.randint(1, 2)))
        return f"<{tag}{mark}>{body}</{tag}>"

    def paragraph() -> str:
        text = " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 8, 14))))
        kind = rng.random()
        say(text, True)
        if kind < 0.08:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.16:
            return f"<p><b>{text}<br>"
        if kind < 0.22:
            return f"<ul><li>{text}</li></ul>"
        if kind < 0.27:
            return f"<table><tr><td>{text}</td></tr></table>"
        if kind < 0.3:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    parts = []
    for kind, share in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("form", 0.2), ("ad", 0.6)):
        if rng.random() < share:
            parts.append(junk(kind))
    body = [f"<h1>{say(phrase(1, 9), True)}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.choice((1, 2, 4, 8, 12))):
        if rng.random() < 0.12:
            body.append(f"<h2>{say(phrase(1, 5), True)}</h2>")
        body.append(paragraph())
        if rng.random() < 0.06:
            body.append(junk(rng.choice(("ad", "share", "side", "form"))))
    open_tag, close_tag = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<main><article class="entry">', "</article></main>"), ("<section>", "</section>"), ("<div>", "</div>")))
    parts.append(open_tag + "\n".join(body) + close_tag)
    for kind, share in (("comments", 0.35), ("share", 0.25), ("side", 0.5), ("form", 0.15), ("ad", 0.2), ("footer", 0.85)):
        if rng.random() < share:
            parts.append(junk(kind))
    wrap = rng.choice((("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="wrapper"><div class="row">', "</div></div>")))
    return f"<html><head><title>x</title></head><body>{wrap[0]}{''.join(parts)}{wrap[1]}</body></html>", truth


def labelled_tree(page: str, truth: list[tuple[str, bool]]) -> tuple[Tree, list[int]]:
    """The page's tree and a label per node: content, or leading to content, is 1."""
    tree = parse(page)
    good = {" ".join(html.unescape(t).split()) for t, c in truth if c}
    label = [0] * len(tree.parent)
    for at, text in tree.blocks:
        if text in good:
            while at >= 0 and not label[at]:
                label[at] = 1
                at = tree.parent[at]
    return tree, label


@lru_cache(2)
def trained(pages: int = 400, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    pairs = [labelled_tree(*_labelled(rng)) for _ in range(pages)]
    return train([t for t, _ in pairs], [y for _, y in pairs])


def main_text(trees: list[Tree], w: np.ndarray, pair: np.ndarray) -> list[str]:
    f = forest(trees)
    keep = marginals(f, w, pair)[0] > 0.5
    return ["\n\n".join(text for at, text in t.blocks if keep[a + at]) for t, a in zip(trees, f.first, strict=False)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(id, url, text, n_chars)`` of each page from its whole html.

    NULL and empty pages, and pages without content, have the empty text.
    Repeated rows are extracted each; other columns are dropped. No shuffle.
    """
    w, pair = weights or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                found = main_text([parse(p) for p in texts(part.column("html")).to_pylist()], w, pair)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    kind, url_kind = df.schema[id_col].dataType.simpleString(), df.schema[url_col].dataType.simpleString()
    out = df.selectExpr(f"`{id_col}` id", f"`{url_col}` url", f"`{html_col}` html").mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
