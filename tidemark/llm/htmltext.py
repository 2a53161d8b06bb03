"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the elements around them, above zero where they look like an
article's, and tags score below zero; one linear scan finds the contiguous region of the greatest sum. The weights are
those of a logistic model of labelled pages, which are generated here with known articles. Inside the region, words that
score below zero (an advert or a form in the middle of an article) are left out.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of their own, elements that hold others, items that end the item before, and other blocks.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HOLDERS = frozenset("html head body div section article main aside nav header footer form fieldset table tbody thead tfoot ul ol dl menu figure blockquote details dialog template noscript select button svg object video audio".split())
ITEMS = frozenset("li tr td th dt dd option optgroup p".split())
BLOCKS = HOLDERS | ITEMS | frozenset("h1 h2 h3 h4 h5 h6 pre address hr br figcaption caption summary legend center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Labelled pages that are generated, and the weights' steps a unit.
PAGES, STEPS = 1000, 256
#: A word of more letters counts as several.
WORD_LETTERS = 12

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)")
_ODD = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden|aria-label)(?![\w-])(?:\s*=\s*(\"[^\"]*|'[^']*|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Run(NamedTuple):
    """Text between two tags: where it lies, its block, its number of words, and the features of the elements around it."""

    start: int
    end: int
    block: int
    words: int
    linked: bool
    score: int


def _keys(tag: str, attributes: str) -> tuple[str, ...]:
    """The features of an element: its name, and the words of its class, id and role."""
    if not attributes or attributes.isspace():
        return (tag,)
    out = {tag}
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").lstrip("\"'")
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                out.add(".hidden")
        elif name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.add(".hidden")
        else:
            out.update("." + w for w in _WORDS.findall(_CAMEL.sub(" ", value[:400]).lower()))
    return tuple(out)


class _Open:
    """The open elements, with how often each feature is among them and the sum of its weights."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.weights, self.score, self.seen = weights, 0, defaultdict(int)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.holders: list[int] = []

    def push(self, tag: str, keys: tuple[str, ...]) -> None:
        if tag in ITEMS:
            self.close(tag)
        elif tag in BLOCKS:
            self.close("p")
        self.places[tag].append(len(self.stack))
        if tag in HOLDERS:
            self.holders.append(len(self.stack))
        self.stack.append((tag, keys))
        for k in keys:
            self.seen[k] += 1
            if self.seen[k] == 1:
                self.score += self.weights.get(k, 0)

    def close(self, tag: str) -> None:
        """Ends the last open ``tag``, if no element that holds others was opened since, or if it is one."""
        at = self.places[tag][-1] if self.places[tag] else -1
        if at < 0 or (tag not in HOLDERS and self.holders and at < self.holders[-1]):
            return
        while len(self.stack) > at:
            name, keys = self.stack.pop()
            self.places[name].pop()
            if name in HOLDERS:
                self.holders.pop()
            for k in keys:
                self.seen[k] -= 1
                if not self.seen[k]:
                    self.score -= self.weights.get(k, 0)


def _measure(text: str) -> int:
    return sum(1 + len(w) // WORD_LETTERS for w in text.split())


def parsed(page: str, weights: dict[str, int], trace: list[tuple[str, ...]] | None = None) -> list[Run | str]:
    """The page as text runs and names of tags, in order. ``trace`` gets the features of each run.

    Comments, declarations and the content of scripts, styles and titles are no text. What is not closed ends with the page.
    """
    out: list[Run | str] = []
    open_, block, at, n = _Open(weights), 0, 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = None
        while lt >= 0 and not (m := _TAG.match(page, lt) or _ODD.match(page, lt)):
            lt = page.find("<", lt + 1)  # a bare sign is text
        end = lt if lt >= 0 else n
        if end > at:
            words = _measure(page[at:end])
            out.append(Run(at, end, block, words, bool(open_.seen["a"]), open_.score))
            if trace is not None:
                trace.append(tuple(k for k, v in open_.seen.items() if v))
        if m is None:
            break
        at = m.end()
        if m.re is _ODD:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            block += 1
        out.append(tag)
        if m[1]:
            open_.close(tag)
        elif tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else n
        elif tag not in VOID:
            open_.push(tag, _keys(tag, m[3]))
    return out


def _block_features(items: list[Run | str]) -> dict[int, tuple[str, str]]:
    """By block: how many words it has, and how much of it is linked."""
    words, linked = defaultdict(int), defaultdict(int)
    for r in items:
        if isinstance(r, Run):
            words[r.block] += r.words
            linked[r.block] += r.words * r.linked
    return {b: (f"#{min(n, 40).bit_length()}", f"%{(3 * linked[b] + n - 1) // n if n else 0}") for b, n in words.items()}


class Model(NamedTuple):
    """Weights of the features of words, in steps, with their bias, and what a tag costs."""

    words: dict[str, int]
    tags: dict[str, int]
    bias: int


def scores(items: list[Run | str], model: Model) -> list[int]:
    """Of each item, in steps: a run's words together, between -STEPS and STEPS each; a tag less than zero."""
    of_block = _block_features(items)
    out = []
    for r in items:
        if isinstance(r, Run):
            a, b = of_block[r.block]
            z = (r.score + model.bias + model.words.get(a, 0) + model.words.get(b, 0)) / STEPS
            each = round(STEPS * np.tanh(z / 2)) if r.words else 0  # twice the probability, less one
            out.append(r.words * each)
        else:
            out.append(-model.tags.get(r, model.tags[""]))
    return out


def best_region(values: list[int]) -> tuple[int, int]:
    """Start and end of the contiguous part with the greatest sum, the first of several; empty if no sum is above zero."""
    best, found, total, start = 0, (0, 0), 0, 0
    for k, v in enumerate(values):
        if total <= 0:
            total, start = 0, k
        total += v
        if total > best:
            best, found = total, (start, k + 1)
    return found


def extract(page: str, model: Model) -> str:
    """The main text: blocks in page order, joined by a space."""
    items = parsed(page, model.words)
    values = scores(items, model)
    a, b = best_region(values)
    blocks: dict[int, list[str]] = defaultdict(list)
    for r, v in zip(items[a:b], values[a:b], strict=True):
        if isinstance(r, Run) and v >= 0:
            blocks[r.block].append(unescape(page[r.start : r.end]))
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(t for t in texts if t)


# Labelled pages.

#: Words of classes and ids, by the part of a page that they mark.
MARKS = {
    "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs skip pagination pager toc links",
    "head": "header masthead banner logo branding top topbar site search",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner privacy warning message subscribe paywall",
    "side": "sidebar side aside widget widgets related recommended trending popular more rail teaser archive tags",
    "form": "form search newsletter subscribe signup login contact register",
    "share": "share sharing social buttons follow tools meta toolbar print",
    "comment": "comment comments commentlist discussion reply replies respond disqus responses thread reader feedback",
    "foot": "footer foot bottom copyright legal credits colophon site imprint",
    "body": "content article post entry story text body main page column hentry prose",
}


def _piece(r: random.Random, part: str, named: bool) -> str:
    """A part of a page that is no article."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 10)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{some(1, 5)}</a></li>' for _ in range(r.randint(a, b)))
    prose = lambda a, b: "".join(f"<p>{some(1, 40)}</p>" for _ in range(r.randint(a, b)))
    marks = MARKS[part].split()
    mark = f' {r.choice(("class", "class", "id"))}="{r.choice((" ", "-", "_")).join(r.sample(marks, r.choice((1, 1, 2))))}"' if named else ""
    tag = {"menu": ("nav", "nav", "div", "ul"), "head": ("header", "header", "div"), "side": ("aside", "aside", "div"), "form": ("form",), "foot": ("footer", "footer", "div"), "advert": ("div", "div", "aside", "section"), "comment": ("section", "div", "ol")}.get(part, ("div", "section"))
    tag = r.choice(tag)
    if not mark and tag in ("div", "section", "ol") and part in ("advert", "notice", "comment"):
        mark = f' class="{r.choice(marks)}"'  # nothing else would show what it is
    inner = {
        "menu": lambda: f"<ul>{links(2, 9)}</ul>" if tag != "ul" else links(2, 9),
        "head": lambda: r.choice((f"<a href='/'>{some(1, 3)}</a>", f"<h1>{some(1, 3)}</h1><p>{some(2, 8)}</p>", f"<nav><ul>{links(2, 6)}</ul></nav>")),
        "advert": lambda: r.choice((some(2, 25), f"<p>{some(2, 25)}</p>", f"<a href='/x'>{some(2, 9)}</a>", f"<img src=a.png><span>{some(1, 5)}</span>")),
        "notice": lambda: r.choice((some(4, 40), f"<p>{some(4, 40)}</p><button>{word()}</button>")),
        "side": lambda: f"<h3>{some(1, 3)}</h3>" + r.choice((f"<ul>{links(2, 8)}</ul>", prose(1, 3), f"<p>{some(3, 20)}</p><a href='/y'>{word()}</a>")),
        "form": lambda: f"<label>{some(1, 3)}</label><input name=q><select><option>{word()}<option>{word()}</select><button>{word()}</button>" + r.choice(("", f"<p>{some(2, 15)}</p>")),
        "share": lambda: "".join(f"<a href='#'>{word()}</a> " for _ in range(r.randint(2, 5))) + r.choice(("", f"<span>{some(1, 4)}</span>")),
        "comment": lambda: f"<h{(h := r.randint(2, 3))}>{some(1, 3)}</h{h}>" + "".join(f"<{(c := r.choice(('div', 'article', 'li')))}{f' class="comment"' if named else ''}><b>{word()}</b>{prose(1, 3)}</{c}>" for _ in range(r.randint(1, 5))),
        "foot": lambda: r.choice((f"&copy; {some(2, 12)} &middot; {some(1, 6)}.", f"<p>{some(2, 15)}</p><ul>{links(1, 5)}</ul>", f"<p>{some(3, 30)}</p>")),
    }[part]()
    return f"<{tag}{mark}>{inner}</{tag}>"


def labelled(seed: int) -> list[tuple[str, bool]]:
    """A generated page, in pieces with whether they belong to the article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstué") for _ in range(r.randint(1, 10)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    named = r.random() < 0.6
    piece = lambda *parts: (_piece(r, r.choice(parts), named), False)

    def inline() -> str:
        a, b = some(1, 20), some(1, 4)
        return a + r.choice(("", "", "", f" <b>{b}</b> {word()}", f" <a href='/z'>{b}</a>, {some(1, 9)}", f" <em>{b}</em>", f"<br>{b}", f" <span>{b}</span>")) + r.choice((".", ".", "", "&amp;"))

    def block() -> str:
        kind = r.random()
        if kind < 0.72:
            return f"<p>{' '.join(inline() for _ in range(r.choice((1, 1, 2, 4, 6))))}</p>"
        if kind < 0.78:
            return f"<p><b>{inline()}<br>"  # never closed
        if kind < 0.84:
            return f"<h{(h := r.randint(2, 4))}>{some(1, 7)}</h{h}>"
        if kind < 0.9:
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{inline()}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if kind < 0.94:
            return f"<blockquote><p>{inline()}</p></blockquote>"
        if kind < 0.97:
            return f"<figure><img src=b.png><figcaption>{some(2, 9)}</figcaption></figure>"
        return f"<table><tr><th>{word()}</th><th>{word()}</th></tr><tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr></table>"

    out = [(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{some(2, 8)}</title><style>p{{margin:0}}</style><script>var t='<p>{some(1, 5)}</p>';</script></head><body>", False)]
    wraps = r.choice((0, 0, 1, 1, 2))
    out.append(("".join(r.choice(("<div>", "<div>", "<div id=wrap>", '<div class="container">')) for _ in range(wraps)), False))
    for part in ("notice", "head", "menu", "menu", "advert", "form"):
        if r.random() < 0.45:
            out.append(piece(part))
    marks = r.sample(MARKS["body"].split(), 2)
    tag = r.choice(("article", "article", "article", "main", "div", "section", "td", ""))
    mark = f' class="{marks[0]}-{marks[1]}"' if tag and (named or (tag in ("div", "section") and r.random() < 0.5)) else ""
    out.append((("<table><tr>" if tag == "td" else "") + (f"<{tag}{mark}>" if tag else ""), True))
    if r.random() < 0.85:
        out.append((f"<h1>{some(1, 9)}</h1>", True))
    for _ in range(r.choice((1, 2, 4, 7, 12))):
        out.append((block(), True))
        if r.random() < 0.1:
            out.append(piece("advert", "side", "share", "form", "notice"))
        if r.random() < 0.05:
            out.append(("<script>track('<p>no</p>')</script>", False))
    if r.random() < 0.15:
        out.append(piece("comment"))
    out.append(((f"</{tag}>" if tag else "") + ("</tr></table>" if tag == "td" else ""), True))
    for part in ("share", "comment", "side", "side", "menu", "form", "advert", "notice"):
        if r.random() < 0.3:
            out.append(piece(part))
    if r.random() < 0.75:
        out.append(piece("foot"))
    return [*out, ("</div>" * wraps + "</body></html>" if r.random() < 0.8 else "", False)]


@cache
def trained(pages: int = PAGES, seed: int = 13) -> Model:
    """The weights of ``pages`` generated pages: of words by logistic regression, of tags by how often they lie outside articles."""
    names: dict[str, int] = {}
    rows, cols, inside, weight = [], [], [], []
    around: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for k in range(pages):
        pieces = labelled(seed * 1_000_003 + k)
        page = "".join(p for p, _ in pieces)
        ends = np.cumsum([len(p) for p, _ in pieces])
        label = lambda at: pieces[int(np.searchsorted(ends, at, "right"))][1]  # noqa: B023, E731
        trace: list[tuple[str, ...]] = []
        items = parsed(page, {}, trace)
        of_block, features, at = _block_features(items), iter(trace), 0
        for r in items:
            if isinstance(r, Run):
                found, at = next(features), r.end
                if r.words:
                    for f in (*found, *of_block[r.block]):
                        rows.append(len(inside))
                        cols.append(names.setdefault(f, len(names)))
                    inside.append(label(r.start))
                    weight.append(min(r.words, 20))
            else:
                around[r][label(min(at, len(page) - 1))] += 1
    x = np.zeros((len(inside), len(names) + 1))
    x[rows, cols] = 1
    x[:, -1] = 1
    y, c = np.array(inside, float), np.array(weight, float)
    w = np.zeros(x.shape[1])
    for _ in range(12):  # Newton's steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (y - p)) - w
        h = (x.T * (c * p * (1 - p) + 1e-9)) @ x + np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    steps = np.round(w * STEPS).astype(int)
    # at most a quarter of a word, so that a paragraph of one word pays for its own tags
    tags = {t: 1 + STEPS * out // (4 * (out + in_ + 1)) for t, (out, in_) in around.items()}
    return Model({f: int(steps[k]) for f, k in names.items()}, {**tags, "": STEPS // 8}, int(steps[-1]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null and empty pages have an empty text, as have pages where no region scores above zero. A page without tags is one
    block. Character references are decoded once, white space of any kind becomes one space. Pages are read whole, in
    linear time; repeated rows get the same result, null ids and addresses are kept, other columns are ignored, an empty
    table gives no rows.
    """
    model = trained()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", model) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
