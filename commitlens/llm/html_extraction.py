"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its leaf blocks, the runs of text between block-level tags, each with its ancestors.
A block's features are its ancestors' tags and the words of their class, id and role, and the look of its text (length,
links, stops, place in the page). The field has two states, article or not; it is trained by maximum likelihood
(forward-backward) on labelled pages, and pages are decoded by Viterbi. labelled_pages() makes the training pages: many
layouts of invented text in which every block's label is known; others can be given.

Defined results: null or empty html gives the empty text; broken markup is read as far as it goes (unclosed elements
end with their parents, a cut tag at the end is markup); repeated rows and pages of one block are alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, SEED, EPOCHS = 400, 7, 150
#: Fixed values of HTML: elements that stay inside a line, that have no end, that hold no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Comments, elements without text of the page, tags (quoted values may hold > and <; where a quote never ends, it is a
#: letter like others), declarations. Runs are possessive, so that a cut tag costs no second reading.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|title|svg|iframe|object)\b[^>]*+>.*?(?:</\1\s*>|$)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+(?=>|$)|[^<>]*+)(?:>|$)|<[!?][^>]*+(?:>|$)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\s+")
#: An opening tag of the key ends an open element of its values.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@lru_cache(50_000)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple(sorted({w.lower() for m in _ATTRIBUTE.finditer(attributes) for v in m.groups()[1:] if v for w in _NAME.findall(v)}))


def blocks(page: str | None) -> list[tuple[tuple, str, int, str]]:
    """(ancestors from the root, text, characters of it inside links, marker) of each leaf block in page order; an
    ancestor is (tag, names); the marker is the attribute data-label of the nearest ancestor that has one."""
    out, stack, parts, links = [], [], [], 0
    pos, page = 0, page or ""

    def flush():
        nonlocal links
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                label = next((m for *_, m in reversed(stack) if m), "")
                out.append((tuple((t, n) for t, n, _ in stack if t not in INLINE), text, links, label))
        parts.clear()
        links = 0

    def add(text):
        nonlocal links
        if text:
            parts.append(text)
            if any(t == "a" for t, _, _ in stack):
                links += len(text.strip())

    for m in _TOKEN.finditer(page):
        add(page[pos : m.start()])
        pos = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append(" ")
            elif not m[2]:
                stack.append((tag, (), ""))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p" or stack[k][0] in _CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k][0] not in INLINE:
                break
        if tag not in VOID and not m[4].endswith("/"):
            mark = re.search(r'data-label="(\d)"', m[4])
            stack.append((tag, _names(m[4]), mark[1] if mark else ""))
    add(page[pos:])
    flush()
    return out


@lru_cache(100_000)
def _ancestor_features(path: tuple) -> tuple[str, ...]:
    out = {"bias"}
    for t, names in path:
        out.add("in:" + t)
        out.update("name:" + n for n in names)
    if path:
        out.add("leaf:" + path[-1][0])
        out.update("own:" + n for n in path[-1][1])
    return tuple(out)


def features(page_blocks: list) -> list[list[str]]:
    n, out = len(page_blocks), []
    for i, (path, text, links, _) in enumerate(page_blocks):
        size = text.count(" ") + 1
        share = links / len(text)
        look = [
            f"words:{min(7, int(math.log2(size)))}", f"links:{min(3, math.ceil(3 * share))}", "stop" if text[-1] in ".!?…:;\"»" else "open",
            f"place:{min(4, 5 * i // n)}", "first" if i == 0 else "later", "sign" if "©" in text or "|" in text or "·" in text else "plain",
        ]
        leaf = path[-1][0] if path else "none"
        out.append([*_ancestor_features(path), *look, f"{leaf}/{look[0]}", f"{leaf}/{look[1]}"])
    return out


class Field:
    """weights: feature -> (weight of state 0, of state 1); between: [2, 2] from state to state."""

    def __init__(self, weights: dict[str, tuple[float, float]], between: np.ndarray):
        self.weights, self.between = weights, between

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        get, none = self.weights.get, (0.0, 0.0)
        (t00, t01), (t10, t11) = self.between.tolist()
        a = b = 0.0
        back = []
        for k, fs in enumerate(feats):
            e0 = e1 = 0.0
            for f in fs:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if k:
                from0, from1 = a + t00 >= b + t10, a + t01 > b + t11
                back.append((0 if from0 else 1, 0 if from1 else 1))
                a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
            else:
                a, b = e0, e1
        if not feats:
            return []
        state = [0 if a >= b else 1]
        for p in reversed(back):
            state.append(p[state[-1]])
        return state[::-1]


def train(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, l2: float = 1e-2) -> Field:
    """Maximum likelihood of the labels of pages (features of each block, label of each block), by Adam; all pages go
    through forward-backward side by side."""
    index: dict[str, int] = {}
    most = max(len(y) for _, y in pages)
    fb, ff = [], []
    for p, (fs, _) in enumerate(pages):
        for t, names in enumerate(fs):
            for f in names:
                fb.append(p * most + t)
                ff.append(index.setdefault(f, len(index)))
    fb, ff, n = np.array(fb), np.array(ff), len(pages)
    y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
    for p, (_, ys) in enumerate(pages):
        y[p, : len(ys)], mask[p, : len(ys)] = ys, True
    w, b = np.zeros((len(index), 2)), np.zeros((2, 2))
    gold = np.eye(2)[y] * mask[:, :, None]
    pair = mask[:, 1:] & mask[:, :-1]
    gold_b = np.array([[(pair & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    m, v = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for step in range(1, epochs + 1):
        e = np.stack([np.bincount(fb, w[ff, s], n * most) for s in (0, 1)], 1).reshape(n, most, 2)
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, most):
            x = np.logaddexp(alpha[:, t - 1, :1] + b[0], alpha[:, t - 1, 1:] + b[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], x, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(most - 2, -1, -1):
            nxt = e[:, t + 1] + beta[:, t + 1]
            x = np.logaddexp(b[:, 0] + nxt[:, :1], b[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None], x, 0)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + b + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        diff = (gold - node).reshape(-1, 2)
        gw = np.stack([np.bincount(ff, diff[fb, s], len(index)) for s in (0, 1)], 1) - l2 * n * w
        g = np.concatenate([gw.ravel(), (gold_b - edge.sum((0, 1)) - l2 * n * b).ravel()]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        up = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w + up[:-4].reshape(w.shape), b + up[-4:].reshape(2, 2)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, b)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts; the attribute data-label says of each stretch whether it is article (1) or not (0)."""
    r = random.Random(seed)
    pick = r.choice

    def words(lo, hi):
        return [("".join(pick("bdfgklmnprst") + pick("aeiou") for _ in range(r.randint(1, 4)))) for _ in range(r.randint(lo, hi))]

    def sentence(lo=4, hi=25):
        return " ".join(words(lo, hi)).capitalize() + pick(".....!?")

    def text(lo=1, hi=6):
        return " ".join(sentence() for _ in range(r.randint(lo, hi)))

    def links(k, item="li"):
        each = "".join(f"<{item}><a href='/x'>{' '.join(words(1, 3))}</a></{item}>" for _ in range(k))
        return f"<ul>{each}</ul>" if item == "li" else each

    def attr(*names):
        return f" {pick(('class', 'class', 'class', 'id'))}=\"{pick(names)}\"" if names else ""

    def no(tag, inner, *names):
        return f'<{tag}{attr(*names)} data-label="0">{inner}</{tag}>'

    def body_part():
        k = r.random()
        if k < 0.66:
            return f"<p>{text()}{pick(('</p>', '</p>', ''))}"
        if k < 0.74:
            return f"<p><b>{sentence(2, 8)}<br><p>{text()}</p>"
        if k < 0.82:
            return f"<{(h := pick(('h2', 'h3')))}>{' '.join(words(2, 7))}</{h}>"
        if k < 0.88:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.93:
            return f"<blockquote><p>{text(1, 3)}</p></blockquote>"
        if k < 0.97:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{' '.join(words(1, 3))}</td><td>{' '.join(words(1, 3))}</td></tr>" for _ in range(3)) + "</table>"

    def noise_inside():
        return pick((
            lambda: no("div", text(1, 2), "ad", "advert", "ads", "advertisement", "banner", "sponsored", "promo"),
            lambda: no("aside", text(1, 2) + links(2), "sidebar", "related", "more", "box"),
            lambda: no("form", f"<label>{' '.join(words(1, 4))}</label><input><button>{' '.join(words(1, 2))}</button>", "newsletter", "subscribe", "signup", "search"),
            lambda: no("div", links(4), "share", "social", "related", "tags"),
        ))()

    def comments():
        each = "".join(f"<{(t := pick(('div', 'li')))}{attr('comment', 'reply', 'comment-body')}><h4>{' '.join(words(1, 2))}</h4><p>{text(1, 3)}</p></{t}>" for _ in range(r.randint(1, 5)))
        return no(pick(("section", "div", "ol")), f"<h3>{' '.join(words(1, 3))}</h3>{each}", "comments", "discussion", "respond", "reader-comments", "comment-list")

    def chrome_before():
        return [
            no("nav", links(r.randint(3, 8), pick(("li", "li", "span"))), *pick(((), ("menu", "navbar", "nav", "main-nav")))),
            no("header", f"<h1>{' '.join(words(1, 3))}</h1><p>{sentence(2, 8)}</p>", *pick(((), ("site-header", "masthead", "header", "top")))),
            no("div", links(r.randint(3, 8)), "menu", "navigation", "topbar", "breadcrumb", "breadcrumbs"),
            no("div", f"<p>{text(1, 2)}</p><button>{' '.join(words(1, 2))}</button>", "cookie-notice", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal"),
            no("div", text(1, 2), "ad", "ads", "advert", "banner", "sponsor", "promo"),
            no("form", f"<label>{' '.join(words(1, 3))}</label><select><option>{' '.join(words(1, 2))}</option></select>", "search", "login"),
        ]

    def chrome_after():
        return [
            no("footer", f"&copy; {' '.join(words(1, 3))} &middot; {sentence(2, 10)}", *pick(((), ("footer", "site-footer", "bottom")))),
            no("footer", f"<p>{text(1, 2)}</p>{links(4)}", *pick(((), ("footer", "legal")))),
            no("aside", f"<h3>{' '.join(words(1, 3))}</h3>{links(5)}<p>{text(1, 2)}</p>", *pick(((), ("sidebar", "widget", "secondary")))),
            no("div", f"<p>{text(1, 3)}</p>{links(3)}", "sidebar", "side", "widget", "related", "recommended", "rail"),
            comments(), no("div", text(1, 2), "ad", "advert", "sponsored", "banner-ad"), no("div", f"<p>{text(1, 2)}</p>", "footer", "copyright", "disclaimer", "legal"),
        ]

    out = []
    for _ in range(n):
        inner = f"<h1>{' '.join(words(2, 9))}</h1>" if r.random() < 0.8 else ""
        if r.random() < 0.2:
            inner += f"<div{attr('byline', 'meta', 'author')}>{' '.join(words(2, 4))}</div>"
        for _ in range(r.randint(1, 12)):
            inner += body_part()
            if r.random() < 0.06:
                inner += noise_inside()
        if r.random() < 0.25:
            inner += comments()
        box = pick(("article", "article", "article", "main", "div", "div", "section"))
        names = () if box in ("article", "main") and r.random() < 0.6 else ("content", "article", "post", "entry-content", "story", "main-content", "post-body", "text", "article-body")
        article = f'<{box}{attr(*names)} data-label="1">{inner}</{box}>'
        if r.random() < 0.3:
            article = f"<main>{article}</main>" if box != "main" else f"<div class='wrapper'>{article}</div>"
        before, after = [x for x in chrome_before() if r.random() < 0.5], [x for x in chrome_after() if r.random() < 0.5]
        r.shuffle(before)
        r.shuffle(after)
        page = "".join(before) + article + "".join(after)
        out.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page if r.random() < 0.7 else f'<div class=page>{page}</div>'}</body></html>")
    return out


def training_set(pages: list[str]) -> list[tuple[list, list[int]]]:
    out = []
    for p in pages:
        b = blocks(p)
        if b:
            out.append((features(b), [int(x[3] == "1") for x in b]))
    return out


@lru_cache(1)
def default_field() -> Field:
    return train(training_set(labelled_pages()))


def main_text(page: str | None, field: Field) -> str:
    b = blocks(page)
    return " ".join(text for (_, text, _, _), s in zip(b, field.decode(features(b)), strict=True) if s)


def _extract(field: Field):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p, field) for p in b], dtype=object)

    return F.pandas_udf(run, "string")


def extract_articles(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    text = _extract(field or default_field())(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
