"""Main-text extraction by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of elements (unclosed and misnested tags as in
HTML: implied ends, void elements, raw-text elements). Each element gets features:
kind of tag, families of tokens in its class, id and role, depth, text, link and
tag density of its subtree, share of the page's and the parent's text, and
statistics of its siblings. A boosted ensemble of small trees gives the
probability that an element belongs to the article, given that its parent does.

Decoding goes from the root down: an element is in only if its parent is in, so a
paragraph in a rejected box can't be chosen and a chosen one has no rejected
ancestor. Inline elements without class, id, role or style follow their parent. Scripts, styles, templates, the head, form controls and comments of
the markup have no text in any case.

The trees are fitted on pages that this module generates (``training_pages``,
a documented, fixed number); no page of the corpus is needed and every session gets
the same model.

Defined cases: null html counts as empty and gives an empty text; plain text
without tags is one block; repeated rows are extracted alike; an empty table gives an
empty result; other columns are ignored. White space is Unicode's, non-breaking
spaces included. Elements such as ``svg`` may nest; one without its end tag is
passed over as a tag only.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwright.llm.common import slices

# fixed values: element names by their part in HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())  # without an end tag they reach to the end
ASIDE = set("template iframe svg noscript select noembed noframes".split())  # passed over up to their end tag, empty without one
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mrow msup msub mfrac msqrt mtext semantics object".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KINDS = ["article main", "nav menu", "header", "footer", "aside", "form button input label fieldset", "ul ol dl", "li dt dd", "a", "p pre blockquote xmp", "h1 h2 h3 h4 h5 h6", "div section body html", "table tr td th tbody thead", "figure figcaption", "head"]
KIND = {t: k for k, names in enumerate(KINDS) for t in names.split()}
# fixed values: families of class, id and role tokens
FAMILIES = [
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "ad ads advert advertisement adsense adslot sponsor sponsored promo promotion banner dfp",
    "sidebar side aside widget rail complementary",
    "footer foot bottom copyright legal colophon contentinfo",
    "header head masthead top logo topbar",
    "cookie cookies consent gdpr notice alert popup modal overlay dialog toast message privacy",
    "share sharing social related recommended recommend more popular trending tags meta byline author follow",
    "comment comments reply replies respond disqus discussion thread feedback",
    "newsletter subscribe subscription signup login search form register paywall",
    "article content post entry main body story text prose page copy",
    "hidden hide invisible sr screen",
]
FAMILY = {t: k for k, names in enumerate(FAMILIES) for t in names.split()}

MARKS = set("class id role itemprop hidden aria-hidden style".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ASIDE_TAG = re.compile(rf"<(/?)({'|'.join(sorted(ASIDE))})(?=[\s/>])((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?]")


@dataclass
class Tree:
    """Elements in document order; element 0 is the page."""

    tag: list[str] = field(default_factory=lambda: [""])
    attrs: list[dict[str, str]] = field(default_factory=lambda: [{}])
    up: list[int] = field(default_factory=lambda: [-1])
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, decoded text


def parse(html: str) -> Tree:
    t = Tree()
    stack, at, block, n = [0], 0, 0, len(html)
    asides: dict[int, int] | None = None

    def pop_to(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if t.tag[stack[k]] in names:
                del stack[k:]
                return
            if t.tag[stack[k]] in stop:
                return

    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at:
            t.runs.append((stack[-1], block, entities.unescape(html[at:end])))
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                t.runs.append((stack[-1], block, m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if name == "br":
            t.runs.append((stack[-1], block, " "))
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if t.tag[stack[k]] == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P:
            pop_to({"p"}, {"table", "td", "button", "div", "section", "article", "main", "aside", "blockquote", "li"})
        if name in IMPLIED:
            pop_to(*IMPLIED[name])
        t.tag.append(name)
        t.attrs.append({a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m[3])} if m[3].strip() else {})
        t.up.append(stack[-1])
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
        elif name in ASIDE and not m[3].rstrip().endswith("/"):
            asides = _aside_ends(html) if asides is None else asides
            at = asides.get(at, at)
        elif name not in VOID | ASIDE and not m[3].rstrip().endswith("/") or (name not in VOID and name not in RAW and KIND.get(name) is not None):
            stack.append(len(t.tag) - 1)
    return t


def _aside_ends(html: str) -> dict[int, int]:
    """For the end of each start tag of an ``ASIDE`` element that has an end tag,
    where that ends; nested ones of one name are counted."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for m in _ASIDE_TAG.finditer(html):
        stack = opened.setdefault(m[2].lower(), [])
        if m[1]:
            if stack:
                ends[stack.pop()] = m.end()
        elif not m[3].rstrip().endswith("/"):
            stack.append(m.end())
    return ends


NEVER = RAW | ASIDE | {"head", "button", "input"}
N_FEATURES = len(KINDS) + len(FAMILIES) + 17


def features(t: Tree) -> np.ndarray:
    n = len(t.tag)
    up = t.up
    chars, words, links, punct, tags, paras, items, heads, kids, order = ([0] * n for _ in range(10))
    same: dict[tuple[int, str], int] = {}
    for e, _, s in t.runs:
        w = s.split()
        c = sum(map(len, w))
        chars[e] += c
        words[e] += len(w)
        punct[e] += len(_PUNCT.findall(s)) if c else 0
    depth = [0] * n
    for i in range(1, n):
        p = up[i]
        depth[i] = depth[p] + 1
        order[i] = kids[p]
        kids[p] += 1
        same[p, t.tag[i]] = same.get((p, t.tag[i]), 0) + 1
    own = chars[:]
    for i in range(n - 1, 0, -1):
        p, tag = up[i], t.tag[i]
        if tag == "a":
            links[i] = chars[i]
        chars[p] += chars[i]
        words[p] += words[i]
        links[p] += links[i]
        punct[p] += punct[i]
        tags[p] += tags[i] + 1
        paras[p] += paras[i] + (tag == "p")
        items[p] += items[i] + (tag == "li")
        heads[p] += heads[i] + (tag[:1] == "h" and tag[1:].isdigit())
    x = np.zeros((n, N_FEATURES), np.float32)
    k0 = len(KINDS)
    for i in range(n):
        k = KIND.get(t.tag[i])
        if k is not None:
            x[i, k] = 1
        a = t.attrs[i]
        if a:
            for name in ("class", "id", "role", "itemprop"):
                if a.get(name):
                    for tok in _TOKEN.findall(_CAMEL.sub(" ", a[name]).lower()):
                        f = FAMILY.get(tok)
                        if f is not None:
                            x[i, k0 + f] += 1
            if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", ""):
                x[i, k0 + len(FAMILIES) - 1] += 2
    k1 = k0 + len(FAMILIES)
    c = np.array(chars, np.float32)
    u = np.array([max(p, 0) for p in up])
    kid = np.array(kids, np.float32)
    cols = [
        np.array(depth), np.log1p(c), np.log1p(np.array(own)), c / max(1, chars[0]), c / np.maximum(1, c[u]), np.array(links) / np.maximum(1, c), np.array(tags) / np.maximum(1, c), np.array(punct) / np.maximum(1, np.array(words)),
        np.log1p(np.array(paras)), np.log1p(np.array(items)), np.array(heads), kid, np.array(order), np.array(order) / np.maximum(1, kid[u] - 1), kid[u], np.array([same.get((up[i], t.tag[i]), 1) for i in range(n)]), c / np.maximum(1, np.array(words)),
    ]
    for j, col in enumerate(cols):
        x[:, k1 + j] = col
    return x


@dataclass
class Forest:
    """Trees of one depth as arrays: per tree and inner node a feature and a
    limit (go right if above), per leaf a value."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = (self.value.shape[1] - 1).bit_length()
        rows = np.arange(len(x))
        for f, lim, val in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > lim[at])
            out += val[at - (len(val) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> Forest:
    """Logistic loss, Newton leaf values, histogram splits, all trees full."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z, inner = np.full(len(y), base), (1 << depth) - 1
    feat, lim, val = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf, np.float32), np.zeros((rounds, inner + 1))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = at - first
            best = np.full(width, 1e-6)
            G, H = np.bincount(cell, g, width), np.bincount(cell, h, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                nb = len(e) + 1
                key = cell * nb + code[:, j]
                gl = np.cumsum(np.bincount(key, g, width * nb).reshape(width, nb), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(key, h, width * nb).reshape(width, nb), axis=1)[:, :-1]
                gain = gl**2 / (hl + l2) + (G[:, None] - gl) ** 2 / (H[:, None] - hl + l2) - (G**2 / (H + l2))[:, None]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                win = top > best
                best[win] = top[win]
                feat[r, first : first + width][win] = j
                lim[r, first : first + width][win] = e[k[win]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feat[r, at]] > lim[r, at])
        leaf = at - inner
        val[r] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        z += val[r, leaf]
    return Forest(feat, lim, val, base)


# -- training pages --------------------------------------------------------


class PageMaker:
    """Invented pages whose article is known. ``data-in`` and ``data-out`` mark
    it for ``labels``; the features don't see them."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = [a + b for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "é", "ö", "ñi")]

    def words(self, n: int) -> str:
        out = ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 3))) for _ in range(n)]
        return " ".join(w + self.r.choice([".", ",", "", "", "", "", ""]) for w in out).capitalize()

    def some(self, lo: int = 3, hi: int = 90) -> str:
        return self.words(int(lo * (hi / lo) ** self.r.random()))

    def link(self, text: str) -> str:
        return f'<a href="/{text[:4]}">{text}</a>'

    def name(self, family: int) -> str:
        tok = self.r.choice(FAMILIES[family].split())
        return self.r.choice([f'class="{tok}"', f'id="{tok}"', f'class="site-{tok}"', f'class="{tok}-box x{self.r.randint(1, 99)}"', f'class="c{self.r.randint(1, 9)} {tok}"'])

    def chrome(self) -> str:
        """A box that isn't the article."""
        r = self.r
        links = "".join(f"<li>{self.link(self.words(r.randint(1, 3)))}</li>" for _ in range(r.randint(2, 9)))
        paras = "".join(f"<p>{self.some()}</p>" for _ in range(r.randint(1, 4)))
        entry = f'<div class="comment"><b>{self.words(1)}</b><p>{self.some()}</p></div>'
        return r.choice([
            lambda: f"<nav><ul>{links}</ul></nav>",
            lambda: f"<div {self.name(0)}><ul>{links}</ul></div>",
            lambda: f"<ul {self.name(0)}>{links}</ul>",
            lambda: f"<div {self.name(1)}>{self.some()}</div>",
            lambda: f"<div {self.name(1)}>{paras}{self.link(self.words(2))}</div>",
            lambda: f"<aside>{paras}<ul>{links}</ul></aside>",
            lambda: f"<aside {self.name(2)}><h3>{self.words(2)}</h3>{paras}</aside>",
            lambda: f"<div {self.name(2)}><h3>{self.words(2)}</h3><ul>{links}</ul>{paras}</div>",
            lambda: f"<footer>&copy; {self.words(2)} &middot; {self.some()}</footer>",
            lambda: f"<footer><p>{self.some()}</p><ul>{links}</ul></footer>",
            lambda: f"<div {self.name(3)}>{self.some()}</div>",
            lambda: f"<header><h2>{self.words(3)}</h2><p>{self.words(6)}</p></header>",
            lambda: f"<header {self.name(4)}><div>{self.words(3)}</div><ul>{links}</ul></header>",
            lambda: f"<div {self.name(4)}><span>{self.words(3)}</span></div>",
            lambda: f"<div {self.name(5)}><p>{self.some()}</p><button>{self.words(1)}</button></div>",
            lambda: f"<section {self.name(5)}>{self.some()}</section>",
            lambda: f"<div {self.name(6)}><h3>{self.words(2)}</h3><ul>{links}</ul></div>",
            lambda: f"<p {self.name(6)}>{self.words(6)}</p>",
            lambda: f"<section {self.name(7)}><h2>{self.words(1)}</h2>{entry * r.randint(1, 6)}</section>",
            lambda: f"<div {self.name(7)}>{paras}</div>",
            lambda: f"<ol {self.name(7)}><li>{self.some()}</li><li><p>{self.some()}</p></li></ol>",
            lambda: f"<article {self.name(7)}><p>{self.some()}</p></article>",
            lambda: f"<form><label>{self.words(2)}</label><input type=text><p>{self.some(3, 20)}</p><button>{self.words(1)}</button></form>",
            lambda: f"<div {self.name(8)}><p>{self.some()}</p><form><input name=q><button>{self.words(1)}</button></form></div>",
            lambda: f"<div {self.name(10)}>{paras}</div>",
            lambda: f'<div style="display: none"><p>{self.some()}</p></div>',
            lambda: "<script>var a='<p>x</p>';</script><style>p{color:red}</style><!-- note -->",
            lambda: f"<noscript><p>{self.some()}</p></noscript>",
        ])()

    def inline(self, text: str) -> str:
        w = text.split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            i = self.r.randrange(len(w))
            tag = self.r.choice(["b", "em", "i", "strong", "code", "span", 'a href="/x"', "mark", "small"])
            w[i] = f"<{tag}>{w[i]}</{tag.split(' ')[0]}>"
        return self.r.choice(["", "", "", "<b>"]) * (self.r.random() < 0.4) + " ".join(w)

    def block(self) -> str:
        r = self.r
        items = "".join(f"<li>{self.inline(self.some(2, 30))}</li>" for _ in range(r.randint(1, 6)))
        p = lambda: f"<p>{self.inline(self.some(2, 160))}" + r.choice(["</p>", "</p>", "</p>", "<br>"])
        kind = r.random()
        if kind < 0.66:
            return p()
        return r.choice([
            lambda: f"<h{r.randint(2, 4)}>{self.words(r.randint(1, 7))}</h2>".replace("</h2>", ""),
            lambda: f"<h2>{self.words(r.randint(1, 7))}</h2>",
            lambda: f"<ul>{items}</ul>",
            lambda: f"<ol>{items}</ol>",
            lambda: f"<blockquote>{p()}</blockquote>",
            lambda: f"<pre>{self.some(3, 40)}</pre>",
            lambda: f"<table><tr><th>{self.words(1)}</th><th>{self.words(1)}</th></tr><tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr></table>",
            lambda: f"<figure><img src=x.png><figcaption>{self.words(5)}</figcaption></figure>",
            lambda: f"<div>{self.inline(self.some())}</div>",
            lambda: f"<section><h3>{self.words(3)}</h3>{p()}</section>",
            lambda: f"<div>{p()}{p()}</div>",
        ])()

    def page(self) -> str:
        r = self.r
        title = self.words(r.randint(2, 10))
        inner = []
        for _ in range(int(1 * 30 ** r.random())):
            inner.append(self.block())
            if r.random() < 0.06:
                inner.append(f"<div data-out>{self.chrome()}</div>" if r.random() < 0.2 else re.sub(r"^<(\w+)", r"<\1 data-out", self.chrome()))
        if r.random() < 0.2:
            inner.append(re.sub(r"^<(\w+)", r"<\1 data-out", f"<section {self.name(7)}><h3>{self.words(1)}</h3><p>{self.some()}</p><p>{self.some()}</p></section>"))
        head = f"<h1>{title}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        open_tag = r.choice(["article", "article", "article", "main", f"div {self.name(9)}", f"section {self.name(9)}", f"article {self.name(9)}", f"div role=main {self.name(9)}"])
        art = f"<{open_tag} data-in>{head}{''.join(inner)}</{open_tag.split(' ')[0]}>"
        if r.random() < 0.25:
            art = r.choice(["<main>%s</main>", '<div class="wrapper">%s</div>', "<div><div>%s</div></div>", '<div id="page">%s</div>']) % (self.chrome() * r.randint(0, 1) + art + self.chrome() * r.randint(0, 1))
        before = "".join(self.chrome() for _ in range(r.randint(0, 4)))
        after = "".join(self.chrome() for _ in range(r.randint(0, 4)))
        return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style></head><body>{before}{art}{after}</body></html>"


def labels(t: Tree) -> np.ndarray:
    mark = [0] * len(t.tag)
    y = np.zeros(len(t.tag))
    for i in range(len(t.tag)):
        a = t.attrs[i]
        mark[i] = 1 if "data-in" in a else -1 if "data-out" in a else max(mark[t.up[i]], -1) if i else 0
        y[i] = mark[i] == 1
    for i in range(len(t.tag) - 1, 0, -1):
        y[t.up[i]] = max(y[t.up[i]], y[i]) if mark[t.up[i]] != -1 else 0
    return y


@lru_cache(maxsize=1)
def model(training_pages: int = 500, seed: int = 11) -> Forest:
    maker = PageMaker(seed)
    xs, ys = [], []
    for _ in range(training_pages):
        t = parse(maker.page())
        x, y = features(t), labels(t)
        use = [i for i in range(1, len(y)) if y[t.up[i]] and t.tag[i] not in NEVER]
        xs.append(x[use])
        ys.append(y[use])
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(t: Tree, margin: np.ndarray) -> str:
    """Text of the elements chosen from the root down."""
    chosen = [True] * len(t.tag)
    for i in range(1, len(t.tag)):
        follows = t.tag[i] in ("html", "body") or (t.tag[i] in INLINE and not t.attrs[i].keys() & MARKS)
        chosen[i] = chosen[t.up[i]] and t.tag[i] not in NEVER and (follows or margin[i] > 0)
    parts: list[str] = []
    last = None
    for e, block, s in t.runs:
        if chosen[e]:
            if block == last:
                parts[-1] += s
            else:
                parts.append(s)
                last = block
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def extract(pages: list[str], forest: Forest) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    x = [features(t) for t in trees]
    margin = forest.margin(np.concatenate(x))
    ends = np.cumsum([len(a) for a in x])
    return [decode(t, m) for t, m in zip(trees, np.split(margin, ends[:-1]))]


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""
    forest = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 1 << 20):
            texts = extract([h or "" for h in b.column(2).to_pylist()], forest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
