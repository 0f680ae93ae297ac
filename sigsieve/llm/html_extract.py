"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes, with hierarchical decoding.

Each element has features: its place (depth, siblings, position), its subtree (text, tags, links, density), its tag and
attribute tokens, and those of its ancestors.  Spark's GBTClassifier learns which elements belong to the main text from
a bounded, generated sample of labelled layouts (menus, sidebars, notices, adverts, forms, comments and articles in many
markups); the trees go to the tasks as arrays.  Decoding keeps the set of elements with the largest sum of log-odds in
which no element is kept without its parent, so a kept paragraph in a dropped sidebar, or the reverse, can't happen.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, out, pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NO_TEXT = frozenset("head script style title noscript template svg math iframe object canvas audio video textarea select datalist noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "button", "html", "head", "body", "option", "optgroup", "select", "td", "th", "tr", "caption", "legend", "title"}
SCOPE = frozenset("article section main div table td th caption button aside nav header footer body blockquote li ul ol dl form figure details".split())
#: Open elements that an opening tag ends, and the elements that this doesn't look past.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"body"})}
TAG_GROUPS = [frozenset(x.split()) for x in (
    "article main", "section div span", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl li dt dd menu", "table tbody thead tr td th caption", "blockquote pre figure figcaption code",
    "nav", "header", "footer", "aside", "form button input select label fieldset textarea option legend", "a", "b i em strong u s small sub sup mark br wbr img", "html body", "dialog")]
#: Attribute tokens (class, id, role) by what they usually name.
TOKEN_GROUPS = [frozenset(x.split()) for x in (
    "article content main post entry story body text prose page maincontent articlebody postcontent entrycontent",
    "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar tabs pager pagination toc skip",
    "header masthead banner hero branding logo sitename",
    "footer colophon copyright legal bottom",
    "sidebar side aside rail widget widgets complementary secondary related recommended trending popular more",
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense outbrain taboola",
    "cookie cookies consent notice alert gdpr popup modal overlay toast disclaimer announcement message warning dialog",
    "form newsletter subscribe subscription signup login search contact register paywall",
    "comment comments reply replies discussion disqus respond reviews reader feedback thread responses",
    "share sharing social meta byline tags tag author date follow")]
#: The last three: a sign of boilerplate on the path from the root, inside a form or aside and the like, inside an article.
N_FEATURES = 14 + len(TAG_GROUPS) + 2 * len(TOKEN_GROUPS) + 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-region)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Elements in document order; `end` is one past the last element inside."""
    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    tokens: list[frozenset] = field(default_factory=lambda: [frozenset()])
    label: list[str] = field(default_factory=lambda: [""])
    parts: list[tuple[int, str]] = field(default_factory=list)  # (element, text), (-1, " ") between blocks


def parse(text: str) -> Page:
    page, stack, at = Page(), [0], 0
    tag, parent, depth, end, tokens, label, parts = page.tag, page.parent, page.depth, page.end, page.tokens, page.label, page.parts

    def pop(to: int) -> None:
        while len(stack) > to:
            end[stack.pop()] = len(tag)

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None or m.start() > at:
            parts.append((stack[-1], text[at : m.start() if m else len(text)]))
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            parts.append((-1, " "))
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == name:
                    pop(k)
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == "p":
                    pop(k)
                    break
                if tag[stack[k]] in SCOPE:
                    break
        if name in ENDS:
            ended, past = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] in past:
                    break
                if tag[stack[k]] in ended:
                    pop(k)
                    if name != "tr":
                        break
        attributes = m[3] or m[6] or ""
        own, mark = frozenset(), ""
        if "=" in attributes:
            found = _ATTRIBUTE.findall(attributes)
            if found:
                mark = next((a or b or c for n, a, b, c in found if n == "data-region"), "")
                own = frozenset(w for n, a, b, c in found if n != "data-region" for x in (a or b or c).split()
                                for w in [*_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()), re.sub(r"[^a-z]", "", x.lower())] if w)
        tag.append(name)
        parent.append(stack[-1])
        depth.append(len(stack))
        end.append(len(tag))
        tokens.append(own)
        label.append(mark)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        stack.append(len(tag) - 1)
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(text, at)
            stop = close.start() if close else len(text)
            parts.append((stack[-1], text[at:stop]))
            at = stop
    pop(0)
    return page


_ALL_TOKENS = {t: j for j, g in enumerate(TOKEN_GROUPS) for t in g}
_ALL_TAGS = {t: j for j, g in enumerate(TAG_GROUPS) for t in g}


def features(pages: list[Page]) -> np.ndarray:
    """One row per element (the root included) of all pages, one after the other."""
    rows = []
    for p in pages:
        n = len(p.tag)
        parent, end, depth = np.array(p.parent), np.array(p.end), np.array(p.depth)
        chars, marks = np.zeros(n), np.zeros(n)
        for i, t in p.parts:
            if i >= 0 and p.tag[i] not in NO_TEXT:
                chars[i] += len(t) - t.count(" ") - t.count("\n")
                marks[i] += t.count(".") + t.count(",")
        link = np.array([t == "a" for t in p.tag], float)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])[end] - np.concatenate([[0], np.cumsum(x)])[:-1]
        inside_link = np.zeros(n, bool)
        for i in np.flatnonzero(link):
            inside_link[i : end[i]] = True
        text, links, tags = total(chars), total(chars * inside_link), total(np.ones(n))
        paragraphs = total(np.array([t == "p" for t in p.tag], float))
        kids = np.bincount(parent[1:], minlength=n)
        rank = np.zeros(n)
        seen: dict[int, int] = {}
        for i, q in enumerate(p.parent):
            rank[i] = seen.get(q, 0)
            seen[q] = rank[i] + 1
        siblings = np.where(parent >= 0, kids[parent], 1)
        x = np.zeros((n, N_FEATURES), np.float32)
        x[:, 0] = depth
        x[:, 1], x[:, 2], x[:, 3] = np.log1p(chars), np.log1p(text), links / np.maximum(text, 1)
        x[:, 4], x[:, 5], x[:, 6] = np.log1p(tags), np.log1p(text / tags), np.log1p(kids)
        x[:, 7], x[:, 8] = rank / np.maximum(siblings, 1), np.log1p(siblings)
        x[:, 9], x[:, 10] = np.log1p(paragraphs), total(marks) / np.maximum(text, 1)
        x[:, 11], x[:, 12] = np.arange(n) / n, text / max(text[0], 1)
        x[:, 13] = x[np.maximum(parent, 0), 3]
        a, b, c = 14, 14 + len(TAG_GROUPS), 14 + len(TAG_GROUPS) + len(TOKEN_GROUPS)
        for i in range(n):
            j = _ALL_TAGS.get(p.tag[i])
            if j is not None:
                x[i, a + j] = 1
            for t in p.tokens[i]:
                j = _ALL_TOKENS.get(t)
                if j is not None:
                    x[i, b + j] = 1
            if i:
                q = p.parent[i]
                x[i, c:] = x[q, c:]
                x[i, c : c + len(TOKEN_GROUPS)] = np.maximum(x[i, c : c + len(TOKEN_GROUPS)], x[q, b:c])
                x[i, -2] = max(x[q, -2], x[i, a + 7 : a + 12].max(), x[i, a + 15])
                x[i, -1] = max(x[q, -1], x[q, a])
                x[i, -3] = max(x[i, -2], x[i, b + 1 : c].max(), x[q, -3])
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)


# ---- the generated, labelled layouts


def _words(r: random.Random, low: int, high: int) -> str:
    n = r.randint(low, high)
    ws = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(1, 9))) for _ in range(n)]
    return " ".join(w + (r.choice(".,") if r.random() < 0.12 else "") for w in ws).capitalize() + "."


def _el(r: random.Random, choices: list[tuple[str, str]], inner: str, keep: int | None = None) -> str:
    tag, name = r.choice(choices)
    attribute = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
    mark = f' data-region="{keep}"' if keep is not None else ""
    return f"<{tag}{attribute}{mark}>{inner}</{tag}>"


def _names(tag: str, names: str) -> list[tuple[str, str]]:
    return [(tag, n) for n in names.split()]


def _boilerplate(r: random.Random) -> str:
    link = lambda low=1, high=4: f'<a href="/x">{_words(r, low, high)}</a>'
    items = lambda low, high: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(low, high))) + "</ul>"
    ps = lambda low, high, size=25: "".join(f"<p>{_words(r, 3, size)}</p>" for _ in range(r.randint(low, high)))
    loose = lambda low, high: _words(r, low, high)
    kind = r.randrange(9)
    if kind == 0 and r.random() < 0.25:  # no name at all: only its links tell
        return _el(r, [("div", ""), ("ul", ""), ("section", "")], items(3, 9) if r.random() < 0.5 else " | ".join(link() for _ in range(r.randint(3, 8))), 0)
    if kind == 0:
        return _el(r, [("nav", ""), *_names("nav", "menu main-nav"), *_names("div", "menu nav navbar breadcrumb site-navigation pagination"), *_names("ul", "menu nav")], items(2, 9) if r.random() < 0.8 else " | ".join(link() for _ in range(r.randint(2, 8))), 0)
    if kind == 1:
        return _el(r, [("header", ""), *_names("header", "site-header masthead"), *_names("div", "header banner masthead topbar")], r.choice([f"<h1>{loose(1, 6)}</h1>", f"<p>{loose(2, 12)}</p>", link(), items(2, 6), loose(2, 9)]), 0)
    if kind == 2:
        return _el(r, [("footer", ""), ("footer", ""), *_names("footer", "site-footer"), *_names("div", "footer page-footer copyright")], r.choice([f"&copy; {loose(2, 30)}", ps(1, 3), items(2, 8) + loose(2, 10)]), 0)
    if kind == 3:
        return _el(r, [("aside", ""), *_names("aside", "sidebar widget"), *_names("div", "sidebar side-bar widget related right-rail recommended"), *_names("section", "related-posts sidebar")], r.choice([items(2, 8), f"<h3>{loose(1, 4)}</h3>" + ps(1, 6, 80), ps(1, 3, 120), loose(5, 60)]), 0)
    if kind == 4:
        return _el(r, [*_names("div", "ad ads advert ad-slot advertisement sponsored promo banner-ad"), *_names("section", "sponsored ad"), *_names("p", "ad sponsored"), *_names("aside", "ad")], r.choice([loose(3, 40), loose(3, 90), link(3, 20)]), 0)
    if kind == 5:
        return _el(r, [*_names("div", "cookie-notice notice alert consent gdpr-popup modal disclaimer"), *_names("section", "notice announcement"), *_names("p", "notice warning"), ("dialog", "")], r.choice([ps(1, 2, 40), loose(4, 60), loose(4, 30) + "<button>Ok</button>"]), 0)
    if kind == 6:
        return _el(r, [("form", ""), *_names("form", "search newsletter"), *_names("div", "newsletter subscribe login-form search-box")], f"<label>{loose(1, 8)}</label><input name=q><button>{loose(1, 3)}</button>" + r.choice(["", ps(1, 2, 30), f"<textarea>{loose(1, 9)}</textarea>", "<select><option>a<option>b</select>"]), 0)
    if kind == 7:
        body = "".join(_el(r, [*_names("div", "comment comment-body reply"), *_names("li", "comment"), ("div", ""), *_names("article", "comment"), ("p", "")], r.choice([loose(3, 80), ps(1, 3, 60)])) for _ in range(r.randint(1, 6)))
        return _el(r, [*_names("section", "comments discussion"), *_names("div", "comments comment-list disqus_thread responses reader-comments"), *_names("ol", "comments comment-list")], f"<h3>{loose(1, 3)}</h3>" * r.randint(0, 1) + body, 0)
    return _el(r, [*_names("div", "share social-share tags post-meta follow"), *_names("ul", "social share-links")], " ".join(link(1, 2) for _ in range(r.randint(2, 6))), 0)


def _article(r: random.Random) -> str:
    blocks = []
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 20])):
        kind, body = r.random(), _words(r, 1, r.choice([6, 6, 30, 30, 120, 120, 500]))
        if r.random() < 0.2:
            body = f"{body} <{(t := r.choice(['b', 'i', 'em', 'span', 'strong', 'code']))}>{_words(r, 1, 8)}</{t}> {_words(r, 1, 20)}"
        if r.random() < 0.12:
            body += f' <a href="/y">{_words(r, 1, 5)}</a>'
        if kind < 0.62:
            blocks.append(r.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<div>{body}</div>"]))
        elif kind < 0.72:
            blocks.append(f"<{(t := r.choice(['h2', 'h3', 'h4']))}>{_words(r, 1, 7)}</{t}>")
        elif kind < 0.82:
            blocks.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{_words(r, 1, 15)}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 7))) + f"</{t}>")
        elif kind < 0.87:
            blocks.append("<table>" + "".join("<tr>" + "".join(f"<td>{_words(r, 1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.94:
            blocks.append(f"<{(t := r.choice(['blockquote', 'pre', 'figure', 'section']))}>{r.choice(['', '<p>'])}{body}</{t}>")
        else:
            blocks.append(body + r.choice(["<br>", " "]))
    if r.random() < 0.3:
        blocks.insert(r.randrange(len(blocks) + 1), _boilerplate(r))
    head = r.choice(["", f"<h1>{_words(r, 1, 12)}</h1>", f"<h1>{_words(r, 1, 12)}</h1>"])
    names = [("article", ""), ("article", ""), ("main", ""), *_names("article", "post story"), *_names("div", "content post-content entry-content article-body story main-content post"), *_names("section", "article content"), ("div", ""), ("section", "")]
    whole = _el(r, names, head + "".join(blocks), 1)
    for _ in range(r.choice([0, 0, 1, 2])):
        whole = _el(r, [("div", ""), ("main", ""), *_names("div", "container wrapper row page content-wrap layout"), ("section", "")], whole + (_boilerplate(r) if r.random() < 0.4 else ""), 1)
    return whole


def labelled_pages(n: int, seed: int = 42) -> list[str]:
    """Generated pages whose data-region marks (never a feature) hold the labels: 1 main text or what holds it, 0 not."""
    r, pages = random.Random(seed), []
    for _ in range(n):
        before = "".join(_boilerplate(r) for _ in range(r.randint(0, 4)))
        after = "".join(_boilerplate(r) for _ in range(r.randint(0, 4)))
        middle = _article(r) if r.random() < 0.92 else ""
        head = f"<head data-region='0'><meta charset=utf-8><title>{_words(r, 1, 9)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        pages.append(f"<!DOCTYPE html><html data-region='1'>{head}<body data-region='1'>{before}{middle}{after}</body></html>")
    return pages


def _labels(page: Page) -> np.ndarray:
    y = np.zeros(len(page.tag))
    y[0] = 1
    for i in range(1, len(y)):
        y[i] = float(page.label[i]) if page.label[i] else y[page.parent[i]]
    return y


@dataclass(frozen=True)
class Trees:
    """Flat trees: children of node i at left[i] and right[i], a leaf points to itself."""
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 2 * total  # GBTClassifier's margin is half the log-odds


def learn(spark: SparkSession, n_pages: int = 1000, rounds: int = 16, depth: int = 5, seed: int = 42) -> Trees:
    """Trees from n_pages generated pages, the bound of the training sample."""
    pages = [parse(p) for p in labelled_pages(n_pages, seed)]
    x, y = features(pages), np.concatenate([_labels(p) for p in pages])
    rows = spark.createDataFrame(pa.table({"label": y, "x": pa.array(list(x.astype(np.float64)))})).coalesce(2)
    rows = rows.select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=32, seed=seed).fit(rows)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(node, scale: float) -> int:
        at = len(feature)
        for column_, v in ((feature, 0), (threshold, 0.0), (left, at), (right, at), (value, 0.0)):
            column_.append(v)
        if node.subtreeDepth() == 0:
            value[at] = scale * node.prediction()
        else:
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = add(node.leftChild(), scale), add(node.rightChild(), scale)
        return at

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        roots.append(add(tree._java_obj.rootNode(), weight))
    return Trees(np.array(roots), np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), depth)


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Kept elements: the set of the largest sum of log-odds that holds the parent of each of its elements."""
    gain = np.clip(logit, -6, 6)
    gain[0] = 6.0
    for i in range(len(gain) - 1, 0, -1):
        if page.tag[i] in NO_TEXT:
            gain[i] = -np.inf
        elif gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = gain > 0
    for i in range(1, len(gain)):
        keep[i] &= keep[page.parent[i]]
    return keep


def main_text(page: Page, keep: np.ndarray) -> str:
    text = "".join(" " if i < 0 else html.unescape(t) if "&" in t else t for i, t in page.parts if i < 0 or keep[i])
    return " ".join(text.split())


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.  Null or empty html: empty text.  Repeated rows give repeated rows.
    Only page_id, url and html are read."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            parsed = [parse(t or "") for t in column(b, "html").to_pylist()]
            logit = sent.value.logit(features(parsed))
            stops = np.cumsum([len(p.tag) for p in parsed])
            texts = [main_text(p, decode(p, part)) for p, part in zip(parsed, np.split(logit, stops[:-1]), strict=True)]
            yield out(schema, [column(b, "page_id"), column(b, "url"), texts, [len(t) for t in texts]])

    thin = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return thin.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
