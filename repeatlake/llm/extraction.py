"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

Every element gets features of itself (tag, attribute tokens, depth), of its
subtree (text, tag and link densities, punctuation, controls) and of its place
(siblings, ancestors, position). Trees boosted on a generated, labelled set of
pages give the log odds that the element's own text is main text. Decoding is
hierarchical: an element is before the main text, in it, or taken out of it,
states only move in that order from ancestor to descendant, and each move costs
a constant; the best assignment over the whole tree is found by dynamic
programming. So no part of a menu inside the article survives, and no paragraph
is main text without its ancestors agreeing.

The text is what is left in page order: character references decoded, white
space inside a block made one space, blocks trimmed and joined by two newlines.
References are decoded in each run of text before inline elements are joined.

Training pages come from a seeded generator of this module, not from the table.

Cases: null or empty pages and pages without text give the empty text. Broken
markup is read as far as it goes. Nothing is cut, whatever the length. Other
columns are ignored; repeated rows are repeated; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.llm.arrow import map_rows
from repeatlake.llm.dom import BLOCK, RAW, Node, fold, parse, tidy

#: Tokens of class, id and role that hint at main text, and at what is around it.
GOOD = frozenset("article articles body content contents entry main page post story text prose news blog hentry maincontent".split())
BAD = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs button byline captcha comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus donate feedback flash foot footer form gdpr head header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popular popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split()
)
SKIP = RAW | {"head", "svg", "select", "option", "datalist", "object", "canvas", "audio", "video", "math"}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button label input textarea", "table tbody tr", "td th", "blockquote pre figure figcaption", "#root html body", "a", "span b i em strong u small font"]
TAG_NUMBER = {t: k for k, group in enumerate(TAGS) for t in group.split()}
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TOGETHER = 20_000  # elements whose features are held at a time
MOVE = 1.0  # cost of entering or leaving the main text, in log odds


class Page:
    """A page's elements in page order with their features."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        self.own: list[int] = []  # characters of own text, inline descendants included
        rows = []
        stack = [(parse(page), -1, 0, 0, 0, 0, 0, False)]
        counts: list[list[float]] = []  # text, linked text, tags, stops, commas, digits, controls, words
        while stack:
            node, up, depth, index, good, bad, same, linked = stack.pop()
            if isinstance(node, str):
                text = tidy(node) if "&" in node or "\n" in node else node.strip()
                if text:
                    c = counts[up]
                    n = len(text)
                    c[0] += n
                    c[1] += n * linked
                    c[3] += text.count(".") + text.count("!") + text.count("?")
                    c[4] += text.count(",")
                    c[7] += text.count(" ") + 1
                    self.own[up] += n
                continue
            me = len(self.nodes)
            hints = {t.lower() for k, v in node.attributes().items() if k in ("class", "id", "role", "itemprop", "aria-label") for t in TOKENS.findall(v)} if node.attrs else ()
            g, b = sum(t in GOOD for t in hints), sum(t in BAD for t in hints)
            self.nodes.append(node)
            self.parent.append(up)
            self.own.append(0)
            counts.append([0.0, 0.0, 1.0, 0.0, 0.0, 0.0, float(node.tag in ("input", "button", "select", "textarea", "label")), 0.0])
            kids = [x for x in node.parts if not isinstance(x, str)]
            tagged = TAG_NUMBER.get(node.tag, len(TAGS))
            rows.append([tagged, depth, index, len(kids), same, g, b, good, bad])
            inner = good + g + (node.tag in ("article", "main"))
            outer = bad + b + (node.tag in ("nav", "aside", "footer", "form"))
            alike: dict[str, int] = {}
            for x in kids:
                alike[x.tag] = alike.get(x.tag, 0) + 1
            later, place = [], 0
            for x in node.parts:
                if isinstance(x, str):
                    later.append((x, me, 0, 0, 0, 0, 0, linked or node.tag == "a"))
                elif x.tag not in SKIP:
                    later.append((x, me, depth + 1, place, inner, outer, alike[x.tag], linked or node.tag == "a"))
                    place += 1
            stack.extend(reversed(later))
        total = np.array(counts)
        own = total.copy()
        for k in range(len(rows) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        before = np.concatenate([[0], np.cumsum(own[:, 0])[:-1]])
        text = np.maximum(total[:, 0], 1)
        whole = max(1.0, total[0, 0])
        up = np.maximum(np.array(self.parent), 0)
        base = np.array(rows, float)
        heading = np.array([n.tag == "h1" for n in self.nodes], float)
        paragraphs = np.array([n.tag == "p" for n in self.nodes], float)
        for k in range(len(rows) - 1, 0, -1):
            heading[self.parent[k]] += heading[k]
            paragraphs[self.parent[k]] += paragraphs[k]
        self.features = np.column_stack([
            base, np.log1p(total[:, 0]), total[:, 1] / text, np.log(text / total[:, 2]), total[:, 3] / text * 100, total[:, 4] / text * 100,
            total[:, 6] > 0, np.log1p(total[:, 7]), np.log1p(own[:, 0]), before / whole, total[:, 0] / whole, base[up, 0], base[up, 5], base[up, 6],
            (total[:, 1] / text)[up], np.log(text / total[:, 2])[up], heading, np.log1p(paragraphs), base[up, 3],
        ])

    def weights(self) -> np.ndarray:
        return np.log1p(np.array(self.own, float)) / 4

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """For each element whether its own text is main text: the best way through before, in, out of the main text."""
        n, gain = len(self.nodes), odds * self.weights()
        best = np.zeros((n, 3))
        best[:, 1] = gain
        choice = np.zeros((n, 3), np.int8)
        for k in range(n - 1, 0, -1):  # children have higher numbers than their parents
            p, (a, b, c) = self.parent[k], best[k]
            enter = b - MOVE > a
            leave = c - MOVE > b
            choice[k] = (1 if enter else 0, 2 if leave else 1, 2)
            best[p, 0] += b - MOVE if enter else a
            best[p, 1] += c - MOVE if leave else b
            best[p, 2] += c
        state = np.zeros(n, np.int8)
        for k in range(1, n):
            state[k] = choice[k][state[self.parent[k]]]
        return state == 1

    def text(self, main: np.ndarray) -> str:
        """The main text's blocks with an empty line between them."""
        number = {id(node): k for k, node in enumerate(self.nodes)}
        blocks: list[str] = []
        run: list[str] = []

        def end() -> None:
            if run:
                if block := fold("".join(run)):
                    blocks.append(block)
                run.clear()

        stack: list = [self.nodes[0]]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, tuple):
                if main[x[1]]:
                    run.append(html.unescape(x[0]))
            elif id(x) in number:
                me, block = number[id(x)], x.tag in BLOCK
                if x.tag == "br":
                    run.append(" ")
                    continue
                if block:
                    end()
                    stack.append(None)
                stack.extend((p, me) if isinstance(p, str) else p for p in reversed(x.parts))
        end()
        return "\n\n".join(blocks)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over features cut into at most 32 bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, least: int = 8):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned, f = self._bin(x), np.zeros(len(y))
        self.rate, self.trees = rate, []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), depth, least)
            self.trees.append(tree)
            f += rate * self._walk(tree, binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)]).astype(np.int16)

    def _grow(self, x, g, h, rows, depth, least):
        leaf = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * least:
            return leaf
        whole, best = g[rows].sum() ** 2 / (h[rows].sum() + 1.0), (1e-3, None)
        for k in range(x.shape[1]):
            bins = len(self.cuts[k]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(x[rows, k], w, bins))[:-1] for w in (g[rows], h[rows], None))
            ok = (ns >= least) & (len(rows) - ns >= least)
            if ok.any():
                won = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - whole
                at = int(np.where(ok, won, -np.inf).argmax())
                if won[at] > best[0]:
                    best = (won[at], (k, at))
        if best[1] is None:
            return leaf
        k, at = best[1]
        left = x[rows, k] <= at
        return k, at, self._grow(x, g, h, rows[left], depth - 1, least), self._grow(x, g, h, rows[~left], depth - 1, least)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        k, at, a, b = tree
        left, out = x[:, k] <= at, np.empty(len(x))
        out[left], out[~left] = self._walk(a, x[left]), self._walk(b, x[~left])
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.rate * sum(self._walk(t, binned) for t in self.trees)


# The generated training pages. Elements carry data-main="1" or "0", which is taken off before features are made.


def _words(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append("".join(r.choice("bcdfghlmnprstvz") + r.choice("aeiouéäö") for _ in range(r.randint(1, 4))))
        if r.random() < 0.08:
            out[-1] += r.choice(",.;.!?")
    return " ".join(out)


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, r.randint(4, 18)).capitalize() + "." for _ in range(r.randint(low, high)))


def _around(r: random.Random, kind: str) -> str:
    """One thing that is not main text."""
    tag = r.choice({"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form", "div"]}.get(kind, ["div", "section", "aside", "p"]))
    names = {"nav": ["nav", "menu", "navbar", "breadcrumbs", ""], "header": ["header", "masthead", "top-bar", ""], "footer": ["footer", "site-footer", "copyright", ""], "aside": ["sidebar", "widget", "related", ""], "form": ["login", "search-form", "newsletter", "subscribe"], "ad": ["ad", "ads", "banner", "sponsored", "promo"], "notice": ["cookie-notice", "consent", "gdpr-banner", "notice"], "comments": ["comments", "comment-list", "discussion", "replies"], "share": ["share", "social", "tags"]}[kind]
    name = r.choice(names)
    head = f'<{tag} data-main="0"' + (f' {r.choice(["class", "id"])}="{name}"' if name or tag == "div" else "") + ">"
    link = lambda: f'<a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))}</a>'
    if kind in ("nav", "share") or kind == "footer" and r.random() < 0.3 or kind == "header" and r.random() < 0.6:
        inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
        inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if r.random() < 0.7 else " | ".join(link() for _ in range(r.randint(2, 8)))
        inner = (f"<h1>{_words(r, 2)}</h1>" if kind == "header" and r.random() < 0.4 else "") + inner
    elif kind == "form":
        inner = f"<label>{_words(r, 2)}</label><input name=q><button>{_words(r, 1)}</button>" + (f"<p>{_sentences(r, 1, 2)}</p>" if r.random() < 0.5 else "")
    elif kind == "comments":
        inner = f"<h3>{_words(r, 1)}</h3>" + "".join(f'<div class="comment"><b>{_words(r, 1)}</b><p>{_sentences(r, 1, 4)}</p></div>' for _ in range(r.randint(1, 4)))
    elif kind == "aside":
        inner = f"<h3>{_words(r, 2)}</h3>" + ("".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) if r.random() < 0.5 else f"<p>{_sentences(r, 1, 3)}</p>")
    elif kind == "footer":
        inner = f"&copy; {_words(r, 2)} &middot; {_sentences(r, 1, 3)}"
    else:
        inner = _sentences(r, 1, 4) if r.random() < 0.6 else f"<p>{_sentences(r, 1, 2)}</p>" + (f"<button>{_words(r, 1)}</button>" if kind == "notice" else "")
    return f"{head}{inner}</{tag}>"


def training_page(r: random.Random) -> str:
    """A page with marked main text among what usually stands around it."""
    body = []
    for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12])):
        kind = r.random()
        if kind < 0.74:
            text = _sentences(r, 1, 6)
            if r.random() < 0.3:
                text = text.replace(" ", f" <{r.choice('b i em a'.split())} href=/x>{_words(r, 2)}</b></i></em></a> ", 1)
            body.append(f"<p>{text}" + ("</p>" if r.random() < 0.8 else "<br>"))
        elif kind < 0.84:
            body.append(f"<h2>{_words(r, r.randint(2, 6))}</h2>")
        elif kind < 0.92:
            body.append("<ul>" + "".join(f"<li>{_sentences(r, 1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.96:
            body.append(f"<blockquote>{_sentences(r, 1, 2)}</blockquote>")
        else:
            body.append(f"<table><tr><td>{_words(r, 3)}</td><td>{_words(r, 2)}</td></tr></table>")
    for kind in ("ad", "share", "aside", "form", "notice"):
        if r.random() < 0.12:
            body.insert(r.randint(0, len(body)), _around(r, kind))
    title = f"<h1>{_words(r, r.randint(3, 10))}</h1>" if r.random() < 0.85 else ""
    tag, name = r.choice([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry"), ("section", "story"), ("div", "post-text"), ("td", ""), ("div", "")])
    main = f'<{tag} data-main="1"' + (f' class="{name}"' if name else "") + f">{title}{''.join(body)}</{tag}>"
    if r.random() < 0.25:
        main = f'<{r.choice(["div", "main", "section"])} id="{r.choice(["page", "wrapper", "container", "main"])}">{main}' + (_around(r, "comments") if r.random() < 0.5 else "")
    before = [_around(r, k) for k, share in (("nav", 0.8), ("header", 0.4), ("notice", 0.25), ("ad", 0.5), ("form", 0.2), ("aside", 0.2)) if r.random() < share]
    after = [_around(r, k) for k, share in (("comments", 0.3), ("aside", 0.3), ("ad", 0.3), ("form", 0.15), ("footer", 0.85), ("share", 0.2), ("notice", 0.1)) if r.random() < share]
    r.shuffle(before)
    ends = "" if r.random() < 0.15 else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><script>var t='</p>';</script></head><body>{''.join(before)}{main}{''.join(after)}{ends}"


def train(pages: int = 500, seed: int = 11) -> Boosted:
    """Trees fitted to the text-bearing elements of generated pages."""
    r, rows, marks = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(training_page(r))
        state: list[int] = []
        for node, up in zip(page.nodes, page.parent):
            mark = re.search(r'data-main="([01])"', node.attrs)
            state.append(int(mark[1]) if mark else state[up] if up >= 0 else 0)
        useful = [k for k, n in enumerate(page.own) if n]
        rows.append(page.features[useful])
        marks += [state[k] for k in useful]
    return Boosted(np.concatenate(rows), np.array(marks, float))


def extract(page: str | None, model: Boosted) -> str:
    """The main text of one page."""
    if not page:
        return ""
    read = Page(page)
    if not any(read.own):
        return ""
    return read.text(read.decode(model.odds(read.features)))


def main_texts(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    trained = model or train()

    def texts_of(read: list[Page]) -> list[str]:
        sizes = np.cumsum([0, *(len(p.nodes) for p in read)])
        odds = trained.odds(np.concatenate([p.features for p in read]))
        return [p.text(p.decode(odds[a:b])) if any(p.own) else "" for p, a, b in zip(read, sizes, sizes[1:])]

    def make():
        def each(batch: pa.RecordBatch):
            read, size, start = [], 0, 0
            for k, value in enumerate(batch.column(2)):
                read.append(Page(value.as_py()))
                size += len(read[-1].nodes)
                if size >= TOGETHER or k == len(batch) - 1:
                    found = texts_of(read)
                    yield {"page_id": batch.column(0)[start : k + 1], "url": batch.column(1)[start : k + 1], "text": found, "n_chars": [len(t) for t in found]}
                    read, size, start = [], 0, k + 1

        return each

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_rows(rows, "page_id long, url string, text string, n_chars long", make)


def query(spark, sf_dir: str) -> DataFrame:
    """``op1``: the main text of all pages."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
