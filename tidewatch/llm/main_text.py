"""Main text of web pages: boosted trees over DOM nodes, decoded from the top so that no node contradicts another.

Every node of a page (block elements, elements with a class, id or role, and loose text) is described by its own
markup, its place among its siblings and the density of text, links, tags and punctuation in its subtree; words of
class, id and role, and element names, count by their learned log odds, for the node and for the nodes around and
below it. Two models of gradient-boosted trees give, per node, the odds that it holds both article and surroundings,
and those that it is article. Decoding chooses a state per node, mixed, article or surroundings, with the highest sum
of log probabilities among those in which surroundings have no article below and an article's part is never mixed:
an advert inside an article can go, a paragraph inside an advert can't stay.

Pages carry no labels, so training is by distant supervision. ``train`` takes at most ``SAMPLE`` pages (those with the
smallest hash, of at most ``LARGEST`` bytes). Pages with one ``article`` or ``main`` element teach by it; and the words
of all sampled pages are set anew in ``LAYOUTS`` layouts, where what is article, menu, header, footer, sidebar, notice,
advert, form or comment is known. Extraction reads every page whole and needs no shuffle.

Null or empty html, and pages without article, give an empty text and 0 characters. Repeated rows and ids are separate
rows. Unclosed, misplaced and cut off tags are read as a browser would in the common cases; nothing is recursive, so
depth does not matter. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_arrow
from tidewatch.llm.dom import CONTAINER, MARK, Page, joined, read
from tidewatch.llm.layouts import layout, material
from tidewatch.llm.treeboost import BinnedTrees

SAMPLE = 300
LARGEST = 100_000
LAYOUTS = 1000
#: A token counts from so many training nodes on.
LEAST = 3
ROUNDS = 40
MIXED, ARTICLE, OTHER = 0, 1, 2

_BLOCKS_OF_TEXT = ("#text", "p", "li", "td", "dd", "blockquote", "pre", "figcaption", "span", "a", "h1", "h2", "h3", "h4", "h5", "h6")


@dataclass
class Model:
    odds: dict[str, float]  # per word of markup
    mixed: BinnedTrees
    article: BinnedTrees


class Nodes:
    """Numbers per node of a batch of pages, side by side."""

    def __init__(self, pages: list[Page]):
        count = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        n = int(self.first[-1])
        self.page = np.repeat(np.arange(len(pages)), count)
        parent = np.fromiter((k for p in pages for k in p.parent), np.int64, n)
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(n), parent + self.first[self.page])
        self.depth = np.fromiter((k for p in pages for k in p.depth), np.int64, n)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        self.end = np.ones(n, np.int64)
        for rows in self.levels[:0:-1]:
            np.add.at(self.end, self.parent[rows], self.end[rows])
        self.end += np.arange(n)
        runs = np.array([len(p.run_node) for p in pages], np.int64)
        node = np.fromiter((k for p in pages for k in p.run_node), np.int64, int(runs.sum())) + np.repeat(self.first[:-1], runs)
        texts = [t for p in pages for t in p.run_text]
        link = np.fromiter((k for p in pages for k in p.run_link), bool, len(texts))
        self.own = {}
        size = np.fromiter(map(len, texts), np.float64, len(texts))
        for name, values in (
            ("chars", size),
            ("linked", size * link),
            ("spaces", np.fromiter((t.count(" ") + 1 for t in texts), np.float64, len(texts))),
            ("commas", np.fromiter((t.count(",") + t.count(".") for t in texts), np.float64, len(texts))),
            ("runs", np.ones(len(texts))),
            ("sign", np.fromiter(("©" in t for t in texts), np.float64, len(texts))),
        ):
            self.own[name] = np.bincount(node, values, minlength=n)
        self.own["controls"] = np.fromiter((k for p in pages for k in p.controls), np.float64, n)
        self.own["nodes"] = np.ones(n)
        self.sums = {k: self.below(v) for k, v in self.own.items()}

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = np.concatenate([[0.0], np.cumsum(own)])
        return total[self.end] - total[:-1]

    def features(self, pages: list[Page], odds: dict[str, float], forget: np.random.Generator | None = None) -> np.ndarray:
        n = len(self.parent)
        tag = np.fromiter((odds.get(f"<{t}>", 0.0) for p in pages for t in p.tag), np.float64, n)
        most, least = np.zeros(n), np.zeros(n)
        at = 0
        for p in pages:
            for tokens in p.tokens:
                if tokens:
                    known = [odds[t] for t in tokens if t in odds] or [v for v in (_inside(t, odds) for t in tokens) if v]
                    if known:
                        most[at], least[at] = max(0.0, *known), min(0.0, *known)
                at += 1
        if forget is not None:  # a share of markup is unknown, so that the trees learn to do without
            gone = forget.random(n) < 0.25
            most[gone] = least[gone] = 0
        above_most, above_least = np.maximum(most, tag), np.minimum(least, tag)
        under_most, under_least = above_most.copy(), above_least.copy()
        for rows in self.levels[1:]:
            above_most[rows] = np.maximum(above_most[rows], above_most[self.parent[rows]])
            above_least[rows] = np.minimum(above_least[rows], above_least[self.parent[rows]])
        for rows in self.levels[:0:-1]:
            np.maximum.at(under_most, self.parent[rows], under_most[rows])
            np.minimum.at(under_least, self.parent[rows], under_least[rows])
        chars, nodes = self.sums["chars"], self.sums["nodes"]
        whole = chars[self.first[:-1]][self.page]
        siblings, place, before, after = self._siblings(chars)
        here = np.concatenate([[0.0], np.cumsum(self.own["chars"])])
        ahead = here[:-1] - here[self.first[:-1]][self.page]
        kind = {t: k for k, t in enumerate(_BLOCKS_OF_TEXT)}
        tags = np.fromiter((kind.get(t, -1) for p in pages for t in p.tag), np.float64, n)
        box = np.fromiter((t in CONTAINER for p in pages for t in p.tag), np.float64, n)
        up = self.parent
        link = self.sums["linked"] / np.maximum(chars, 1)
        columns = [
            tag, most, least, above_most[up], above_least[up], under_most, under_least, self.depth, np.log1p(chars),
            chars / np.maximum(whole, 1), chars / np.maximum(chars[up], 1), link, link[up], chars / np.maximum(self.sums["runs"], 1),
            self.sums["commas"] / np.maximum(self.sums["spaces"], 1), nodes / np.maximum(chars, 1), np.log1p(nodes), place / np.maximum(siblings, 1), siblings,
            np.log1p(before), np.log1p(after), self.sums["controls"], ahead / np.maximum(whole, 1), self.sums["sign"] > 0, tags, tags[up], box,
            self.own["chars"] / np.maximum(chars, 1), chars / np.maximum(self.sums["spaces"], 1), np.log1p(self.sums["commas"][up]),
        ]
        return np.column_stack([np.asarray(c, np.float64) for c in columns])

    def _siblings(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of siblings, own place, and the text of the one before and after."""
        n = len(self.parent)
        key = np.where(self.root, n + np.arange(n), self.parent)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        start = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
        group = np.cumsum(start) - 1
        begin = np.flatnonzero(start)
        size = np.diff(np.concatenate([begin, [n]]))
        siblings, place, before, after = (np.zeros(n) for _ in range(4))
        siblings[order] = size[group]
        place[order] = np.arange(n) - begin[group]
        text = chars[order]
        before[order] = np.where(start, 0, np.concatenate([[0.0], text[:-1]])) if n else 0
        last = np.concatenate([start[1:], [True]]) if n else start
        after[order] = np.where(last, 0, np.concatenate([text[1:], [0.0]])) if n else 0
        return siblings, place, before, after

    def decode(self, mixed: np.ndarray, article: np.ndarray) -> np.ndarray:
        """The state of every node, from log odds."""
        log = lambda z: -np.logaddexp(0, -z)
        value = np.column_stack([log(mixed), log(-mixed) + log(article), log(-mixed) + log(-article)])
        for rows in self.levels[:0:-1]:
            up = self.parent[rows]
            any_state = value[rows].max(1)
            np.add.at(value[:, MIXED], up, any_state)
            np.add.at(value[:, ARTICLE], up, value[rows, ARTICLE:].max(1))
            np.add.at(value[:, OTHER], up, value[rows, OTHER])
        state = np.empty(len(value), np.int64)
        for level, rows in enumerate(self.levels):
            free = value[rows].argmax(1)
            if not level:
                state[rows] = free
                continue
            up = state[self.parent[rows]]
            part = ARTICLE + value[rows, ARTICLE:].argmax(1)
            state[rows] = np.where(up == MIXED, free, np.where(up == ARTICLE, part, OTHER))
        # A mixed node's own text goes by its own odds.
        loose = (state == MIXED) & (article > 0)
        return np.where(loose, ARTICLE, state)


def _inside(token: str, odds: dict[str, float]) -> float:
    """Log odds of a known word that an unknown one begins or ends with."""
    for cut in range(len(token) - 1, 3, -1):
        for piece in (token[:cut], token[-cut:]):
            if piece in odds:
                return odds[piece]
    return 0.0


def _states(page: Page) -> np.ndarray:
    """States from marks: a mark holds for all below; what has none lies around marked nodes."""
    out = np.full(len(page.tag), MIXED)
    for k, (mark, parent) in enumerate(zip(page.mark, page.parent, strict=True)):
        out[k] = (ARTICLE if mark == "1" else OTHER) if mark is not None else out[parent] if parent >= 0 else MIXED
    return out


def _distant(page: Page) -> np.ndarray | None:
    """States of a page that says itself where its article is; None where it does not."""
    roots = [k for k, t in enumerate(page.tag) if t == "article"] or [k for k, t in enumerate(page.tag) if t == "main"]
    if len(roots) != 1:
        return None
    around = set()
    k = roots[0]
    while k >= 0:
        around.add(k)
        k = page.parent[k]
    out = np.full(len(page.tag), OTHER)
    for k, parent in enumerate(page.parent):
        if k == roots[0]:
            out[k] = ARTICLE
        elif k in around:
            out[k] = MIXED
        elif parent >= 0 and out[parent] == ARTICLE and page.tag[k] not in ("nav", "aside", "form", "footer", "button", "dialog"):
            out[k] = ARTICLE
    return out


def fit(htmls: list[str], layouts: int = LAYOUTS, seed: int = 13) -> Model:
    """A model from whole pages (those the sample holds)."""
    rng = random.Random(seed)
    pages, states = [], []
    real = [read(h) for h in htmls]
    for p in real:
        s = _distant(p)
        if s is not None:
            pages.append(p)
            states.append(s)
    words = material(real)
    for _ in range(layouts):
        p = read(layout(words, rng, MARK))
        pages.append(p)
        states.append(_states(p))
    state = np.concatenate(states)
    seen: dict[str, list[int]] = {}
    for p, s in zip(pages, states, strict=True):
        for tag, tokens, y in zip(p.tag, p.tokens, s, strict=True):
            if y != MIXED:
                for t in {f"<{tag}>", *tokens}:
                    seen.setdefault(t, [0, 0])[int(y == ARTICLE)] += 1
    share = (state == ARTICLE).sum() / max((state == OTHER).sum(), 1)
    odds = {t: float(np.log((yes + 1) / (no + 1) / share)) for t, (no, yes) in sorted(seen.items()) if yes + no >= LEAST}
    x = Nodes(pages).features(pages, odds, np.random.default_rng(seed))
    pure = state != MIXED
    return Model(odds, BinnedTrees(ROUNDS).fit(x, (~pure).astype(float)), BinnedTrees(ROUNDS).fit(x[pure], (state[pure] == ARTICLE).astype(float)))


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE, layouts: int = LAYOUTS) -> Model:
    """A model from the sample: the pages with the smallest hashes of id and html.

    Only pages below a bound that a few times the sample passes leave their tasks, however many tasks there are.
    """
    html = F.col(html_col).cast("string")
    some = pages.select(html.alias("html"), F.xxhash64(F.col(id_col), html).alias("hash")).where((F.octet_length("html") <= LARGEST) & (F.length(F.trim("html")) > 0))
    share = min(1.0, 4 * sample / max(pages.count(), 1))
    bound = int(-(1 << 63) + share * ((1 << 64) - 1))
    for chosen in (some.where(F.col("hash") <= min(bound, (1 << 63) - 1)), some):
        found = [r["html"] for r in chosen.orderBy("hash", "html").limit(sample).collect()]
        if found:  # else nearly all pages are blank or too large
            break
    return fit(found, layouts)


def extract_pages(htmls: list[str], model: Model) -> list[str]:
    pages = [read(h) for h in htmls]
    nodes = Nodes(pages)
    x = nodes.features(pages, model.odds)
    kept = nodes.decode(model.mixed.score(x), model.article.score(x)) == ARTICLE
    return [joined(p, kept[a:b].tolist()) for p, a, b in zip(pages, nodes.first[:-1], nodes.first[1:], strict=True)]


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # its size is set by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = extract_pages([h or "" for h in b.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
