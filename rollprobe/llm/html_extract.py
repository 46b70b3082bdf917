"""HTML main-text extraction: gradient-boosted trees over DOM nodes, decoded from the root down.

Pages are parsed into a tree (void elements, raw-text elements, implied end tags). Every element becomes a row of
features: own tag, class/id tokens of the element and of its ancestors, depth, sibling counts, subtree text length, text
density, link density, punctuation. Trees boosted on the logistic loss give each node a log-odds of being main text.
They are trained here, on pages that ``layout`` builds with known truth (articles in semantic tags or in classed
``div``s, with menus, banners, notices, adverts, forms, sidebars and comments around them); no page of the input is used.

Decoding takes the node set with the largest sum of log-odds in which a kept node's ancestors are kept: a node's gain is
its own plus the positive gains of its children, and children of a dropped node cannot stay.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in page order
by one space. Null or empty html gives an empty text; pages without markup are one block; broken markup is closed at the
end of the page. Repeated rows are handled alike, extra columns ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?>\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("script style textarea iframe noembed noframes noscript template svg math canvas object audio video select button option datalist head title meta link".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
# an open element of the value's tags ends where one of the key's begins
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
NO_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "dd", "dt", "li"} | {"li", "dd", "dt"}

TAGS = "article main section div p h1 h2 h3 h4 li ul ol nav header footer aside form table td blockquote pre figure figcaption a span dl body label details dialog".split()
GOOD = "article content main body post entry story text paragraph page".split()
BAD = {
    "menu": "nav menu navbar breadcrumb breadcrumbs topbar tabs toc pagination pager links".split(),
    "edge": "header footer masthead copyright legal credits colophon site".split(),
    "side": "sidebar aside widget related recommended trending popular promo rail more".split(),
    "note": "cookie consent notice banner alert popup modal overlay newsletter subscribe signup gdpr paywall".split(),
    "ads": "ad ads advert advertisement sponsor sponsored adsense".split(),
    "talk": "comment comments reply replies discussion disqus respond share social author bio tags meta".split(),
}


class Node:
    __slots__ = ("tag", "up", "depth", "tokens", "kids", "nth", "parts", "order")

    def __init__(self, tag: str, up: Node | None, tokens: tuple[str, ...], order: int) -> None:
        self.tag, self.up, self.tokens, self.order = tag, up, tokens, order
        self.depth = up.depth + 1 if up else 0
        self.kids: list[Node] = []
        self.parts: list[tuple[int, str]] = []  # (place in page, own text)
        self.nth = len(up.kids) if up else 0


def parse(page: str) -> list[Node]:
    """Elements in page order; the first is a root that holds all."""
    root = Node("html", None, (), 0)
    nodes, now, at, place = [root], root, 0, 0
    while m := TOKEN.match(page, at):
        at, raw = m.end(), m.group()
        place += 1
        name = m.group(2)
        if name is None:
            if raw[0] != "<" or raw == "<":
                now.parts.append((place, raw))
            continue
        tag = name.lower()
        if m.group(1):
            up = now
            while up is not None and up.tag != tag:
                up = up.up
            if up is not None and up.up is not None:
                now = up.up
            continue
        if tag == "html":
            continue
        if tag in NO_P:
            up = now
            while up.up is not None and up.tag not in ("p", "table", "td", "th", "button", "object"):
                up = up.up
            if up.tag == "p" and up.up is not None:
                now = up.up
        if tag in ENDS:
            up = now
            while up.up is not None and up.tag not in ENDS[tag] and up.tag not in FENCE[tag]:
                up = up.up
            if up.tag in ENDS[tag] and up.up is not None:
                now = up.up
        if tag == "body":
            while now.up is not None:
                now = now.up
        found = tuple(t for a in ATTRIBUTE.finditer(m.group(3)) for t in PIECE.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())) if m.group(3) else ()
        node = Node(tag, now, found, place)
        now.kids.append(node)
        nodes.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag in ("path", "rect", "circle"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag == "title" or tag == "textarea":
                node.parts.append((place, page[at:stop]))
            close = page.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        now = node
    return nodes


WIDTH = len(TAGS) + 2 + 2 * (1 + len(BAD)) + 12
_TAG = {t: i for i, t in enumerate(TAGS)}
_TOKEN = {t: 0 for t in GOOD} | {t: k for k, (_, ts) in enumerate(BAD.items(), 1) for t in ts}


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    x = np.zeros((n, WIDTH), np.float32)
    index = {id(v): i for i, v in enumerate(nodes)}
    up = np.array([index[id(v.up)] if v.up else 0 for v in nodes])
    own = np.zeros((n, 5))  # letters, link letters, marks, elements, paragraphs
    base = len(TAGS) + 2
    wide = 1 + len(BAD)
    for i, v in enumerate(nodes):
        if v.tag in _TAG:
            x[i, _TAG[v.tag]] = 1
        x[i, len(TAGS)] = v.tag in BLOCK
        x[i, len(TAGS) + 1] = v.tag in GONE
        for t in v.tokens:
            if t in _TOKEN:
                x[i, base + _TOKEN[t]] = 1
        if v.tag in ("nav", "header", "footer", "aside", "form"):
            x[i, base + {"nav": 1, "header": 2, "footer": 2, "aside": 3, "form": 4}[v.tag]] = 1
        if v.tag in ("article", "main"):
            x[i, base] = 1
        if v.up is not None:
            p = up[i]
            x[i, base + wide : base + 2 * wide] = np.maximum(x[p, base : base + wide], x[p, base + wide : base + 2 * wide])
        text = "".join(t for _, t in v.parts) if v.tag not in GONE else ""
        size = len(text.strip())
        own[i] = size, size if v.tag == "a" else 0, sum(map(text.count, ".,;:!?")), 1, v.tag in ("p", "br")
    whole = own.copy()
    for i in range(n - 1, 0, -1):
        whole[up[i]] += whole[i]
    total = max(whole[0, 0], 1)
    kids = np.array([len(v.kids) for v in nodes])
    place = np.array([v.order for v in nodes]) / max(nodes[-1].order, 1)
    size, links, marks, count, paras = whole.T
    tail = np.stack([np.log1p(size), size / total, links / np.maximum(size, 1), size / count / 100, marks / np.maximum(size, 1) * 20, np.log1p(count), np.log1p(paras), np.array([v.depth for v in nodes]), np.array([v.nth for v in nodes]), kids[up], place, size[up] / total], axis=1)
    x[:, -12:] = tail
    return x


# ---------------------------------------------------------------- gradient-boosted trees
class Boosted:
    """Logistic boosting of depth-limited regression trees on binned features."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 24) -> None:
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.base)
        width, inner = x.shape[1], 2**self.depth - 1
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, feat, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                k = self.bins + 1
                code = ((node - first)[:, None] * width + np.arange(width)) * k + binned
                gs, hs = (np.bincount(code.ravel(), np.repeat(v, width), minlength=many * width * k).reshape(many, width, k).cumsum(axis=2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                best = gain.reshape(many, -1).argmax(axis=1)
                for j in range(many):
                    c, b = divmod(int(best[j]), k)
                    if b < len(cuts[c]) and gain[j, c, b] > 1e-3:
                        feat[first + j], cut[first + j] = c, cuts[c][b]
                node = 2 * node + 1 + (x[np.arange(len(x)), feat[node]] > cut[node])
            leaf = np.bincount(node - inner, g, minlength=inner + 1) / (np.bincount(node - inner, h, minlength=inner + 1) + 1)
            self.feature.append(feat)
            self.cut.append(cut)
            self.leaf.append(self.rate * leaf)
            f += self.rate * leaf[node - inner]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feat, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feat[node]] > cut[node])
            out += leaf[node - len(feat)]
        return out


# ---------------------------------------------------------------- training pages
def layout(r: np.random.Generator) -> str:
    """A page whose main text stands between \\x01 and \\x02."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(r.choice(letters, r.integers(2, 10)))
    words = lambda a, b: " ".join(word() for _ in range(r.integers(a, b)))
    sentence = lambda: words(4, 16).capitalize() + r.choice([".", ".", "!", "?", ","])
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    pick = lambda *xs: xs[r.integers(len(xs))]
    cls = lambda group: f' class="{pick(*BAD[group])}{pick("", "-" + word(), " " + word())}"'
    wrap = lambda tag, attr, body: f"<{tag}{attr}>{body}</{tag}>"
    menu = lambda: wrap(pick("nav", "div", "ul"), pick(cls("menu"), "") if r.random() < 0.5 else cls("menu"), "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.integers(3, 9))) + "</ul>")
    ad = lambda: wrap(pick("div", "aside"), cls("ads"), sentence() + pick("", link()))
    note = lambda: wrap(pick("div", "section"), cls("note"), sentence() + pick("", "<button>ok</button>"))
    side = lambda: wrap(pick("aside", "div"), cls("side"), "<h3>" + words(1, 4) + "</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.integers(2, 6))) + "</ul>" + pick("", f"<p>{sentence()}</p>"))
    talk = lambda: wrap(pick("div", "section", "ol"), cls("talk"), "".join(wrap(pick("div", "li", "p"), pick("", cls("talk")), sentence() + " " + sentence()) for _ in range(r.integers(1, 5))))
    form = lambda: f"<form><label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>"
    edge = lambda tag: wrap(pick(tag, tag, "div"), cls("edge"), pick("&copy; ", "") + words(2, 14) + pick("", link()))
    body = [f"<h1>{words(3, 12)}</h1>"] if r.random() < 0.85 else []
    for _ in range(pick(1, 2, 4, 8, 14)):
        kind = r.random()
        p = " ".join(sentence() for _ in range(pick(1, 1, 2, 4, 8)))
        if kind < 0.12:
            body.append(f"<p><b>{p}<br>")
        elif kind < 0.2:
            body.append(f"<h2>{words(1, 6)}</h2>")
        elif kind < 0.28:
            body.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.integers(2, 5))) + "</ul>")
        elif kind < 0.33:
            body.append(f"<blockquote>{p}</blockquote>")
        elif kind < 0.38:
            body.append(f"<p>{p} {link()} {sentence()}</p>")
        elif kind < 0.42:
            body.append("<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence()}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.47:
            body.append("\x02" + pick(ad, note, side)() + "\x01")
        else:
            body.append(f"<p>{p}</p>")
    tag = pick("article", "article", "main", "div", "section", "div")
    attr = "" if tag in ("article", "main") and r.random() < 0.7 else f' {pick("class", "id")}="{pick(*GOOD)}{pick("", "-" + word())}"'
    main = wrap(tag, attr, "\x01" + "".join(body) + "\x02")
    if r.random() < 0.3:
        main = wrap("div", pick("", ' class="container"', ' id="wrapper"'), main + pick("", side()))
    before = [f() for f in (lambda: edge("header"), menu, ad, note, form) if r.random() < 0.55]
    after = [f() for f in (side, talk, ad, form, menu) if r.random() < 0.35] + [edge("footer")]
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>" + "".join(before) + main + "".join(after) + "</body></html>"


def truth(nodes: list[Node]) -> np.ndarray:
    """1 where a node holds main text or has a descendant that does, by the marks of ``layout``."""
    own, inside = {}, False
    for place, text, node in sorted(((p, t, v) for v in nodes for p, t in v.parts), key=lambda x: x[0]):
        kept = False
        for piece in re.split("([\x01\x02])", text):
            if piece in ("\x01", "\x02"):
                inside = piece == "\x01"
            elif piece.strip():
                kept |= inside
        own[id(node)] = own.get(id(node), False) or kept
    y = np.zeros(len(nodes))
    index = {id(v): i for i, v in enumerate(nodes)}
    for i in range(len(nodes) - 1, -1, -1):
        if own.get(id(nodes[i])):
            y[i] = 1
        if y[i] and nodes[i].up:
            y[index[id(nodes[i].up)]] = 1
    return y


def train(pages: int = 500, seed: int = 11) -> Boosted:
    r, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(pages):
        nodes = parse(layout(r))
        xs.append(features(nodes))
        ys.append(truth(nodes))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


# ---------------------------------------------------------------- decoding
def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Nodes kept: ancestors first, none below a dropped one; the root always stays."""
    index = {id(v): i for i, v in enumerate(nodes)}
    up = [index[id(v.up)] if v.up else -1 for v in nodes]
    gain = np.array([-50.0 if v.tag in GONE else float(o) for v, o in zip(nodes, odds, strict=True)])
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[up[i]] += gain[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[up[i]] and gain[i] > 0
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """Kept text in page order: one space between blocks and for white space inside them."""
    events = []
    for v, k in zip(nodes, keep, strict=True):
        if k:
            events += [(p, 1, html.unescape(t)) for p, t in v.parts]
        if v.tag in BLOCK:
            events.append((v.order, 0, " "))
            last = v
            while last.kids:
                last = last.kids[-1]
            end = max([last.order, *(p for p, _ in v.parts[-1:]), *(p for p, _ in last.parts[-1:])])
            events.append((end, 2, " "))
    events.sort(key=lambda e: (e[0], e[1]))
    return " ".join("".join(t for _, _, t in events).split())


def extract_pages(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_nodes of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        trees = [parse(h or "") for h in batch.column("html").to_pylist()]
        x = [features(t) for t in trees]
        odds = shared.value.predict(np.concatenate(x)) if x else np.zeros(0)
        cut = np.cumsum([0, *(len(t) for t in trees)])
        texts = [text_of(t, decode(t, odds[a:b])) for t, a, b in zip(trees, cut, cut[1:])]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts], "n_nodes": [len(t) for t in trees]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, fn, "page_id long, url string, text string, n_chars long, n_nodes int", 1 << 20)
