"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has a tag-path
vector (tags, classes and ids of its ancestors, hashed) and a hashed-word vector. A bidirectional
LSTM in numpy reads the blocks of the whole page in both directions and labels every one as article or
not. It is trained here, on pages made up by ``made_page`` from common ways to mark up articles,
menus, headers, footers, sidebars, notices, adverts, forms and comments; the same pages and seed
give the same weights.
"""

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<svg(?=[\s/])[^>]*/>"
    r"|<(?:script(?=[\s/>])[^>]*>.*?(?:</script\s*>|\Z)|style(?=[\s/>])[^>]*>.*?(?:</style\s*>|\Z)"
    r"|textarea(?=[\s/>])[^>]*>.*?(?:</textarea\s*>|\Z))"
    r"|<(noscript|template|iframe|svg|select|object)(?=[\s/>])[^>]*>.*?</\1\s*>"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S | re.I)
MARKED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Tags that begin and end a block of text; of these, the ones that have no end tag; and
# those that an element of the same group, or any block for p, ends.
BLOCK_TAGS = frozenset(
    "html head title body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol "
    "li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend label button option "
    "blockquote pre figure figcaption address details summary hr center ins".split())
EMPTY_TAGS = frozenset("hr".split())
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table form".split())

PATH_SLOTS, WORD_SLOTS = 1024, 1024
PATH_DIM, WORD_DIM, HIDDEN = 16, 6, 16
PAGES, EPOCHS, BATCH, RATE, SEED = 900, 6, 30, 0.01, 11
# Blocks that go through the network at a time, padding included.
CELLS = 20_000


def blocks(page: str) -> list[tuple[list[str], str]]:
    """(tag-path tokens, text with white space as single spaces) of every leaf block with text."""
    out: list[tuple[list[str], str]] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = [t for _, tokens in stack for t in tokens]
                path.append(f"leaf:{stack[-1][0]}" if stack else "leaf:")
                if linked * 2 > len(text):
                    path.append("links")
                out.append((path, text))
            parts.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m.group(2)
        if tag not in BLOCK_TAGS:
            continue
        flush()
        in_link = 0
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        ended = ENDED_BY.get(tag)
        if ended:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in LISTS:
                    break
                if stack[k][0] in ended:
                    del stack[k:]
                    break
        if tag in EMPTY_TAGS:
            continue
        tokens = [f"tag:{tag}"]
        for kind, value in MARKED.findall(m.group(4)) if m.group(4) else ():
            tokens += [f"name:{part.lower()}" for part in NAME_PART.findall(value)]
        stack.append((tag, tokens))
    parts.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=200_000)
def _slot(token: str, slots: int) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % slots


def vectors(found: list[tuple[list[str], str]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Path slots, word slots and log length of each block."""
    return [(np.array([_slot(p, PATH_SLOTS) for p in path]),
             np.array([_slot(w, WORD_SLOTS) for w in text.lower().split()]),
             np.log1p(len(text)) / 5) for path, text in found]


class Labeller:
    """Embeddings, a bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + 1
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "path": draw(PATH_SLOTS, PATH_DIM) * 4, "word": draw(WORD_SLOTS, WORD_DIM) * 4,
            "fx": draw(d, 4 * HIDDEN), "fh": draw(HIDDEN, 4 * HIDDEN), "fb": np.zeros(4 * HIDDEN, np.float32),
            "bx": draw(d, 4 * HIDDEN), "bh": draw(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
            "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for b in ("fb", "bb"):
            self.w[b][HIDDEN:2 * HIDDEN] = 1

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), lengths.max(), PATH_DIM + WORD_DIM + 1), np.float32)
        for i, page in enumerate(pages):
            for t, (path, words, size) in enumerate(page):
                x[i, t, :PATH_DIM] = self.w["path"][path].sum(0)
                if len(words):
                    x[i, t, PATH_DIM:-1] = self.w["word"][words].mean(0)
                x[i, t, -1] = size
        return x, lengths

    def _run(self, x, mask, side: str, keep: bool = False):
        """Hidden states of one direction, and what training needs of each step."""
        h = np.zeros((x.shape[0], HIDDEN), np.float32)
        c, states, trail = h, [], []
        z = x @ self.w[f"{side}x"] + self.w[f"{side}b"]
        for t in range(x.shape[1]):
            g = z[:, t] + h @ self.w[f"{side}h"]
            i, f, o = (1 / (1 + np.exp(-g[:, k * HIDDEN:(k + 1) * HIDDEN])) for k in range(3))
            n = np.tanh(g[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            c_new = f * c + i * n
            tc = np.tanh(c_new)
            if keep:
                trail.append((i, f, o, n, tc, c, h, m))
            c, h = m * c_new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            states.append(h)
        return np.stack(states, 1), trail

    @staticmethod
    def _flip(x, lengths):
        """Each page's blocks in reverse order, padding left at the end."""
        at = np.arange(x.shape[1])[None, :]
        back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
        return x[np.arange(len(x))[:, None], back]

    def forward(self, x, lengths, keep: bool = False):
        mask = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)
        hf, tf = self._run(x, mask, "f", keep)
        hb, tb = self._run(self._flip(x, lengths), mask, "b", keep)
        both = np.concatenate([hf, self._flip(hb, lengths)], 2)
        p = 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"])))
        return p, mask, both, tf, tb

    def _back(self, dh_all, trail, x, side, grad):
        """Gradients of one direction; returns those of its inputs."""
        dh = np.zeros_like(dh_all[:, 0])
        dc, dz = dh, []
        for t in range(len(trail) - 1, -1, -1):
            i, f, o, n, tc, c, h, m = trail[t]
            dh = dh + dh_all[:, t]
            dcn = m * (dc + dh * o * (1 - tc * tc))
            g = np.concatenate([dcn * n * i * (1 - i), dcn * c * f * (1 - f),
                                m * dh * tc * o * (1 - o), dcn * i * (1 - n * n)], 1)
            grad[f"{side}h"] += h.T @ g
            dz.append(g)
            dh, dc = (1 - m) * dh + g @ self.w[f"{side}h"].T, (1 - m) * dc + dcn * f
        dz = np.stack(dz[::-1], 1)
        grad[f"{side}x"] += np.tensordot(x, dz, ([0, 1], [0, 1]))
        grad[f"{side}b"] += dz.sum((0, 1))
        return dz @ self.w[f"{side}x"].T

    def gradients(self, pages: list, labels: list) -> dict[str, np.ndarray]:
        x, lengths = self.inputs(pages)
        p, mask, both, tf, tb = self.forward(x, lengths, keep=True)
        y = np.zeros_like(p)
        for i, page in enumerate(labels):
            y[i, :len(page)] = page
        d = (p - y) * mask / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["out"], grad["bias"] = np.tensordot(both, d, ([0, 1], [0, 1])), d.sum(keepdims=True)[0]
        dboth = d[:, :, None] * self.w["out"]
        dx = self._back(dboth[:, :, :HIDDEN], tf, x, "f", grad)
        flipped = self._back(self._flip(dboth[:, :, HIDDEN:], lengths), tb, self._flip(x, lengths), "b", grad)
        dx = dx + self._flip(flipped, lengths)
        for i, page in enumerate(pages):
            for t, (path, words, _) in enumerate(page):
                np.add.at(grad["path"], path, dx[i, t, :PATH_DIM])
                if len(words):
                    np.add.at(grad["word"], words, dx[i, t, PATH_DIM:-1] / len(words))
        return grad

    def train(self, pages: list, labels: list) -> "Labeller":
        """Adam over shuffled batches."""
        one = {k: np.zeros_like(v) for k, v in self.w.items()}
        two = {k: np.zeros_like(v) for k, v in self.w.items()}
        order, step = list(range(len(pages))), 0
        for epoch in range(EPOCHS):
            Random(epoch).shuffle(order)
            for at in range(0, len(order), BATCH):
                step += 1
                chosen = order[at:at + BATCH]
                for k, g in self.gradients([pages[i] for i in chosen], [labels[i] for i in chosen]).items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.w[k] -= RATE * (one[k] / (1 - 0.9**step)) / (
                        np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages: list) -> list[np.ndarray]:
        """For each page, whether each of its blocks belongs to the article."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            chosen = order[-max(1, CELLS // longest):]
            del order[-len(chosen):]
            x, lengths = self.inputs([pages[i] for i in chosen])
            p = self.forward(x, lengths)[0]
            for i, row, n in zip(chosen, p, lengths):
                out[i] = row[:n] > 0.5
        return out


# Names and words that mark up the parts of the pages to train on.
ARTICLE_MARKS = ["<article>", "<main>", '<div class="content">', '<div id="post">', '<section class="story">',
                 '<div class="entry-content">', '<div class="article-body">', '<article class="post">',
                 '<div id="main-content">', '<div class="text">', '<main role="main"><article>']
PART_MARKS = {
    "nav": ["<nav>", '<nav class="main">', '<div class="menu">', '<div id="navbar">', '<div class="breadcrumb">',
            '<div class="navigation">', '<div id="menu">', '<div role="navigation">', '<div class="toolbar">'],
    "header": ["<header>", '<div class="header">', '<div class="site-header">', '<div id="masthead">',
               '<header class="top">', '<div class="topbar">', '<div class="logo">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">',
               '<footer class="site">', '<div class="bottom legal">'],
    "aside": ["<aside>", '<div class="sidebar">', '<div class="related">', '<div class="widget">',
              '<section class="recommended">', '<div id="sidebar">', '<div class="popular">',
              '<aside class="right">', '<div class="share social">', '<div class="tags">'],
    "notice": ['<div class="cookie">', '<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="notice">',
               '<div class="alert">', '<div class="newsletter">', '<div id="gdpr">', '<div class="consent">',
               '<div role="alert">', '<div class="subscribe">', '<section class="banner">', '<div class="popup modal">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">',
           '<div class="sponsored">', '<section class="promo">', '<div id="ad-top">', '<aside class="ad">',
           '<div class="ad-slot banner">', '<ins class="adsbygoogle">'],
    "form": ["<form>", '<form class="search">', '<form id="login">', '<form action="/go">', '<form class="contact">'],
    "comment": ['<div class="comments">', '<section id="comments">', '<div class="comment-list">', '<div id="disqus">',
                '<div class="discussion">', '<section class="comments">', '<ol class="commentlist">',
                '<div class="responses replies">', '<div class="reader-comments">'],
}
PART_WORDS = {
    "nav": "home menu search news about contact login archive", "header": "welcome logo menu search edition",
    "footer": "copyright privacy terms imprint rights reserved contact", "aside": "related popular share latest tags",
    "notice": "cookies accept privacy subscribe newsletter consent notice", "ad": "advertisement sponsored buy offer sale",
    "form": "name email password search send submit", "comment": "reply comment says ago like report posted"}


def made_page(r: Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it belongs to the article."""
    sound = ["".join(r.choice("aeiouäéñst nrlmcdh".replace(" ", "")) for _ in range(r.randint(1, 4)))
             for _ in range(12)]
    word = lambda: "".join(r.choice(sound) for _ in range(r.randint(1, 3)))
    text = lambda low, high: " ".join(word() for _ in range(r.randint(low, high))) or "x"
    out, labels = ["<!DOCTYPE html><html><head>"], []

    def close(mark: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", mark)))

    def block(tag: str, body: str, label: bool) -> str:
        labels.append(label)
        ended = "" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{body}{ended}"

    def spoken(part: str, low: int, high: int) -> str:
        return text(low, high) + (" " + r.choice(PART_WORDS[part].split()) if r.random() < 0.4 else "")

    def other(part: str) -> None:
        mark = r.choice(PART_MARKS[part])
        out.append(mark)
        if part == "nav":
            out.append("<ul>")
            for _ in range(r.randint(2, 8)):
                out.append(block("li", f'<a href="/{word()}">{spoken(part, 1, 2)}</a>', False))
            out.append("</ul>")
        elif part == "form":
            for _ in range(r.randint(1, 4)):
                out.append(block(r.choice(["label", "p", "button", "div"]), spoken(part, 1, 5), False))
        elif part == "comment":
            if r.random() < 0.5:
                out.append(block(r.choice(["h2", "h3"]), spoken(part, 1, 2), False))
            for _ in range(r.randint(1, 6)):
                out.append('<div class="comment">' if r.random() < 0.4 else "<div>")
                out.append(block(r.choice(["p", "p", "li", "div"]), spoken(part, 2, 60), False) + "</div>")
        elif r.random() < 0.4:
            out.append(f"{spoken(part, 2, 25)}")
            labels.append(False)
        else:
            for _ in range(r.randint(1, 4)):
                out.append(block(r.choice(["p", "div", "h3", "li"]), spoken(part, 1, 25), False))
        out.append(close(mark))

    out.append(block("title", text(3, 12), False) + "</head><body>")
    for part in ("notice", "header", "nav", "ad", "form", "aside"):
        if r.random() < {"nav": 0.8, "header": 0.5, "ad": 0.5}.get(part, 0.2):
            other(part)
    shell = r.choice(["", "", '<div id="page">', '<div class="wrapper">', '<div class="container"><div class="row">'])
    mark = r.choice(ARTICLE_MARKS) if r.random() < 0.9 else f'<div class="{word()}">'
    out.append(shell + mark)
    if r.random() < 0.8:
        title = block("h1", text(2, 14), True)
        out.append(f"<header>{title}</header>" if r.random() < 0.2 else title)
    for _ in range(r.randint(0, 14)):
        kind = r.random()
        if kind < 0.75:
            out.append(block("p", text(1, 150), True))
        elif kind < 0.87:
            out.append(block(r.choice(["h2", "h3", "blockquote", "pre", "div"]), text(1, 25), True))
        elif kind < 0.93:
            out.append("<ul>" + "".join(block("li", text(1, 20), True) for _ in range(r.randint(1, 4))) + "</ul>")
        else:
            other(r.choice(["ad", "aside", "notice", "form"]))
    inside = r.random() < 0.4
    if inside and r.random() < 0.5:
        other("comment")
    out.append(close(mark) + close(shell))
    for part in ("comment", "aside", "ad", "form", "nav", "notice", "footer"):
        if r.random() < {"footer": 0.85, "comment": 0.3}.get(part, 0.2):
            other(part)
    if r.random() < 0.9:
        out.append("</body></html>")
    return "".join(out), labels


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> Labeller:
    """A labeller trained on so many made-up pages."""
    r = Random(seed)
    seen, labels = [], []
    while len(seen) < pages:
        page, marks = made_page(r)
        found = blocks(page)
        if len(found) == len(marks):
            seen.append(vectors(found))
            labels.append(marks)
    return Labeller(seed).train(seen, labels)


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    kept = model.label([vectors(f) for f in found])
    return ["\n\n".join(text for (_, text), k in zip(f, ks) if k) for f, ks in zip(found, kept)]


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (main text of ``html``, blocks joined by two line feeds; empty for NULL,
    empty or article-less pages) and ``n_chars``; columns of these names are replaced. Row by row:
    repeated rows each get their text, no rows give none."""
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows, out, size, part = [p or "" for p in batch], [], 0, []
            for p in rows:
                part.append(p)
                size += len(p)
                if size > 4_000_000:
                    out += main_texts(part, held.value)
                    size, part = 0, []
            yield pd.Series(out + main_texts(part, held.value), dtype=object)

    return pages.withColumn("text", F.pandas_udf(texts, "string")("html")).withColumn(
        "n_chars", F.length("text").cast("long"))
