"""Main-text extraction: a recurrent labeller over the leaf blocks of a page.

A page is cut into blocks (text between block-level tags). Each block is read as hashed features: the
elements on its path with their classes and ids, its words, and a few measures (length, share of
links, stops). A bidirectional LSTM in numpy reads a page's blocks in order and labels each with the
whole page as context; blocks labelled as article are joined. The labeller is trained here: on invented
layouts, and on a bounded sample of the pages themselves that have ``article`` or ``main`` elements,
whose blocks are labelled by those elements and by the named furniture (menus, footers, adverts ...) around them.
Training pages are read whole; pages of like length are trained on together.

Null and empty pages give empty text. Scripts, styles, templates, comments, titles and the fields of forms are never
text. Unclosed and misplaced tags are allowed, as are pages without head or body; a tag cut off by the end of the page is
dropped. Character references are decoded in each run of text by itself. Very long pages are read whole; their memory grows
with their number of blocks. Repeated rows and further columns change nothing.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, sampled, small_batches

#: Fixed values of HTML: elements that end a block, that hold no text of the page, that have no end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template textarea title iframe select head".split())
HEAD_TAGS = frozenset("base link meta title style script noscript template head html".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same group.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STEP = re.compile(r"""=\s*(["'])|>""")
#: Elements around a block whose names are kept, the innermost ones.
DEEPEST = 64
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

PATH, WORDS, MEASURES = 512, 32, 8
INPUT = PATH + WORDS + MEASURES
HIDDEN = 16


@dataclass(frozen=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: float  # share of its characters inside links


class Tags:
    """Tags of a page in order, each character read a bounded number of times.

    A quote opens a value only after an equals sign, and only if it is closed somewhere; once a tag has no end under this rule,
    tags end at the next ``>`` up to the end of the page. A tag or comment without any end reaches to the end of the page.
    """

    def __init__(self, page: str):
        self.page, self.quoted = page, True

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends, before ``>``; -1 if nowhere."""
        start = at
        while self.quoted:
            m = _STEP.search(self.page, at)
            if m is None:
                self.quoted = False
            elif not m[1]:
                return m.start()
            else:
                close = self.page.find(m[1], m.end())
                at = close + 1 if close >= 0 else m.end()
        return self.page.find(">", start)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closes, name, attributes) of the first tag from ``at`` on; comments and declarations have no name."""
        m = _OPEN.search(self.page, at)
        if m is None:
            return None
        if m[1] or m[2]:
            mark = "-->" if m[1] else ">"
            end = self.page.find(mark, m.end())
            return m.start(), end + len(mark) if end >= 0 else len(self.page), False, "", ""
        end = self._end(m.end())
        if end < 0:
            return m.start(), len(self.page), False, "", ""
        return m.start(), end + 1, bool(m[3]), m[4].lower(), self.page[m.end() : end]


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order, with white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = hidden = linked = at = 0
    page = page or ""
    tags, opened = Tags(page), Counter()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append(Block(tuple(n for _, names in stack[-DEEPEST:] for n in names), whole, min(1.0, linked / len(whole))))
        text.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[i:]:
            opened[tag] -= 1
            hidden -= tag in HIDDEN_TAGS
            links -= tag == "a"
        del stack[i:]

    def end_head() -> None:
        if opened["head"]:
            close(next(i for i, x in enumerate(stack) if x[0] == "head"))

    def put(piece: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and not piece.isspace():
            end_head()
        if piece and not hidden:
            piece = html.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)

    while at < len(page):
        found = tags.next(at)
        if found is None:
            put(page[at:])
            break
        start, end, closes, tag, attributes = found
        if start > at:
            put(page[at:start])
        at = end
        if not tag:
            continue
        if not closes and tag not in HEAD_TAGS:
            end_head()
        if tag in BLOCK_TAGS:
            flush()
        if closes:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag == "br":
            put(" ")
        if tag in VOID_TAGS:
            continue
        if tag in _ENDS or tag in BLOCK_TAGS:
            group = _ENDS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in group or stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        names = [tag]
        if attributes:
            for q in _NAMES.finditer(attributes):
                names += [f".{w}" for w in re.split(r"[\s_-]+", (q[1] or q[2] or q[3] or "").lower()) if w]
        stack.append((tag, tuple(names)))
        opened[tag] += 1
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def _bucket(kind: str, x: str, size: int) -> int:
    return zlib.crc32(f"{kind}{x}".encode("utf-8", "replace")) % size


class Features:
    """What the labeller reads of blocks: hashed path columns, and a dense part of hashed words and measures."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words = Remembered(lambda w: _bucket("word", w, WORDS))

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        """Columns that are 1 for a path: its elements and names, and the last one again."""
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[path] = np.array([_bucket("path", n, PATH) for n in sorted(set(path))] + [_bucket("last", path[-1] if path else "", PATH)])
        return self.paths[path]

    def dense(self, own: list[Block]) -> np.ndarray:
        """[block, WORDS + MEASURES]"""
        self.words.trim()
        out = np.empty((len(own), WORDS + MEASURES), np.float32)
        words = [_WORD.findall(b.text.lower()) for b in own]
        sizes = np.fromiter(map(len, words), np.int64, len(own))
        ids = np.fromiter((self.words[w] for some in words for w in some), np.int64, int(sizes.sum()))
        counts = np.bincount(np.repeat(np.arange(len(own)) * WORDS, sizes) + ids, minlength=len(own) * WORDS).reshape(len(own), WORDS)
        out[:, :WORDS] = 2 * counts / np.maximum(8, sizes)[:, None]
        length = np.fromiter((len(b.text) for b in own), np.float32, len(own))
        out[:, WORDS] = 1
        out[:, WORDS + 1] = np.minimum(2, length / 200)
        out[:, WORDS + 2] = [b.linked for b in own]
        out[:, WORDS + 3] = [b.text[-1] in ".!?" for b in own]
        out[:, WORDS + 4] = np.log1p(length) / 8
        out[:, WORDS + 5] = np.arange(len(own)) / max(1, len(own))
        out[:, WORDS + 6] = [b.text.count(".") for b in own] / length
        out[:, WORDS + 7] = np.arange(len(own)) == 0
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output for each block; weights as a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = weights or {
            **{f"x{d}": rng.normal(0, 0.15, (INPUT, 4 * h)).astype(np.float32) for d in "fb"},
            **{f"h{d}": rng.normal(0, 0.15, (h, 4 * h)).astype(np.float32) for d in "fb"},
            **{f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for d in "fb"},
            "o": rng.normal(0, 0.3, (2 * h,)).astype(np.float32),
            "p": np.zeros(1, np.float32),
        }

    def _direction(self, z: np.ndarray, d: str, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states [page, step, HIDDEN]; z are the inputs' parts of the gates, steps in reading order."""
        n, steps, h = len(z), z.shape[1], HIDDEN
        state, cell = np.zeros((n, h), z.dtype), np.zeros((n, h), z.dtype)
        out = np.zeros((n, steps, h), z.dtype)
        for t in range(steps):
            g = z[:, t] + state @ self.w[f"h{d}"]
            i, f, o = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h])
            u, on = np.tanh(g[:, 3 * h :]), mask[:, t, None]
            before, cell = cell, np.where(on, f * cell + i * u, cell)
            last, tanh = state, np.tanh(cell)
            state = np.where(on, o * tanh, state)
            out[:, t] = state
            if keep is not None:
                keep.append((i, f, o, u, before, tanh, last))
        return out

    def scores(self, pages: list[list[Block]], make: Features) -> list[np.ndarray]:
        """For each page the chance of each of its blocks to be article; pages of like size go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        both = np.concatenate([self.w["xf"], self.w["xb"]], 1)
        seen: dict[tuple[str, ...], int] = {}
        known: list[np.ndarray] = []  # a path's part of the gates, for both directions

        def place(path: tuple[str, ...]) -> int:
            if path not in seen:
                seen[path] = len(known)
                known.append(both[make.path(path)].sum(0))
            return seen[path]

        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(len(order), 128, 20_000 // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            sizes = np.array([len(pages[i]) for i in some])
            steps = int(sizes.max())
            mask = np.arange(steps)[None, :] < sizes[:, None]
            z = np.zeros((n, steps, 8 * HIDDEN), np.float32)
            paths = [place(b.path) for i in some for b in pages[i]]
            dense = np.concatenate([make.dense(pages[i]) for i in some])
            z[mask] = np.stack(known)[paths] + dense @ both[PATH:]
            logit = np.full((n, steps), self.w["p"][0], np.float32)
            for d, part, gates in (("f", self.w["o"][:HIDDEN], z[..., : 4 * HIDDEN]), ("b", self.w["o"][HIDDEN:], z[..., 4 * HIDDEN :])):
                turn = (lambda v: v) if d == "f" else (lambda v: v[:, ::-1])
                logit += turn(self._direction(turn(gates + self.w[f"c{d}"]), d, turn(mask))) @ part
            p = _sigmoid(logit)
            for k, i in enumerate(some):
                out[i] = p[k, : sizes[k]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the blocks, and its gradient by backpropagation through time; x [page, step, INPUT], y and mask [page, step]."""
        h, (n, most) = HIDDEN, mask.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {}
        for d in "fb":
            turn = (lambda v: v) if d == "f" else (lambda v: v[:, ::-1])
            hidden[d] = self._direction(turn(x @ self.w[f"x{d}"] + self.w[f"c{d}"]), d, turn(mask), kept[d])
        both = np.concatenate([hidden["f"], hidden["b"][:, ::-1]], 2)
        p = _sigmoid(both @ self.w["o"] + self.w["p"])
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-12) * mask).sum() / mask.sum()
        wrong = (p - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,nth->h", wrong, both), "p": wrong.sum(keepdims=True).reshape(1)}
        for d, part in (("f", slice(0, h)), ("b", slice(h, None))):
            turn = (lambda v: v) if d == "f" else (lambda v: v[:, ::-1])
            down, mark, inp = turn(wrong[..., None] * self.w["o"][part]), turn(mask), turn(x)
            gh, gc = np.zeros_like(self.w[f"h{d}"]), np.zeros((n, most, 4 * h), x.dtype)
            state, cell = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
            for t in range(most - 1, -1, -1):
                i, f, o, u, before, tanh, last = kept[d][t]
                act = mark[:, t, None]
                up = np.where(act, down[:, t] + state, 0)
                dc = np.where(act, up * o * (1 - tanh * tanh) + cell, 0)
                g = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), up * tanh * o * (1 - o), dc * i * (1 - u * u)], 1)
                gh += last.T @ g
                gc[:, t] = g
                state = np.where(act, g @ self.w[f"h{d}"].T, state)
                cell = np.where(act, dc * f, cell)
            grad |= {f"h{d}": gh, f"c{d}": gc.sum((0, 1)), f"x{d}": inp.reshape(-1, INPUT).T @ gc.reshape(-1, 4 * h)}
        return float(loss), grad

    def train(self, pages: list[tuple[list[Block], list[int]]], steps: int, lot: int = 32, rate: float = 0.02, seed: int = 4) -> None:
        """Adam on lots of whole pages of like length; pages are (blocks, labels)."""
        rng, make = np.random.default_rng(seed), Features()
        pages = sorted(pages, key=lambda p: len(p[0]))
        read = [([make.path(b.path) for b in own], make.dense(own), labels) for own, labels in pages]
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for it in range(1, steps + 1):
            first = int(rng.integers(0, max(1, len(read) - lot + 1)))
            some = read[first : first + lot]
            most = len(some[-1][2])
            x, y, mask = np.zeros((len(some), most, INPUT), np.float32), np.zeros((len(some), most), np.float32), np.zeros((len(some), most), bool)
            for k, (paths, dense, labels) in enumerate(some):
                n = len(labels)
                np.add.at(x[k], (np.repeat(np.arange(n), [len(c) for c in paths]), np.concatenate(paths)), 1)
                x[k, :n, PATH:], y[k, :n], mask[k, :n] = dense, labels, True
            for k, g in self.gradients(x, y, mask)[1].items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                self.w[k] = (self.w[k] - rate * min(1, 3 * (1 - it / (steps + 1))) * (m1[k] / (1 - 0.9**it)) / (np.sqrt(m2[k] / (1 - 0.999**it)) + 1e-8)).astype(np.float32)


#: Names by which pages mark what is not the article, used to label training pages.
FURNITURE = {
    "menu": ("nav", "div.nav", "div.menu", "ul.menu", "div.navbar", "div.breadcrumb", "ol.breadcrumbs", "div#navigation"),
    "top": ("header", "div.header", "div#header", "div.masthead", "div.topbar", "div.site-header"),
    "bottom": ("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright"),
    "side": ("aside", "div.sidebar", "div#sidebar", "section.related", "div.widget", "div.related-posts"),
    "notice": ("div.cookie", "div.cookie-notice", "div.notice", "div.consent", "div.alert", "div.banner", "div.popup", "div.paywall"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "section.sponsored", "div.promo", "aside.promo"),
    "form": ("form", "form.search", "form.newsletter", "div.newsletter", "div.subscribe", "form#login"),
    "talk": ("div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "section#disqus", "div.replies"),
    "share": ("div.share", "ul.social", "div.social-share", "div.tags", "div.byline-links"),
}
#: Bodies without a telling name, and where link lists stand without one.
PLAIN_BODIES = ("div", "section", "td", "center", "div.wrapper", "div.col", "div.row", "div.x1", "span", "body")
PLAIN_MENUS = ("div", "ul", "p", "td", "div.row", "div.x2")
BODIES = ("article", "main", "div.article", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div.main", "div.post-content", "article.post", "main#main", "div.story-body")
_MARKS = frozenset(m for names in FURNITURE.values() for n in names for m in re.findall(r"^[a-z0-9]+(?=$)|[.#][a-z]+", n)) - {".site", ".entry", ".post", ".list", ".related", ".byline"}
_OUT = frozenset(x.replace("#", ".") for x in _MARKS) | {"nav", "header", "footer", "aside", "form", ".related"}


def weak_labels(own: list[Block]) -> list[int] | None:
    """Labels from an article or main element and the furniture inside it; None where a page has neither."""
    if not any({"article", "main"} & set(b.path) for b in own):
        return None
    out = []
    for b in own:
        inner = max(i for i, n in enumerate(("", *b.path)) if n in ("", "article", "main"))
        out.append(int(inner > 0 and not _OUT & set(b.path[inner:]) and not {"nav", "aside", "footer", "form"} & set(b.path)))
    return out


def _open(name: str) -> tuple[str, str]:
    tag, kind, own = re.match(r"([a-z0-9]+)([.#]?)(.*)", name).groups()
    return tag, f"<{tag}" + (f' {"class" if kind == "." else "id"}="{own}"' if kind else "") + ">"


def invented_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page of made-up words in a random layout, and the label of each of its blocks."""
    letters = np.array(list("abcdefghijklmnoprstuvw"))
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 9)))
    said = lambda a, b: (" ".join(word() for _ in range(rng.integers(a, b))) + rng.choice([".", ".", "", "!"])).capitalize()
    out, labels = [], []

    def furniture(kind: str) -> None:
        plain = kind == "menu" and rng.random() < 0.25
        tag, head = _open(rng.choice(PLAIN_MENUS if plain else FURNITURE[kind]))
        if plain or kind in ("menu", "side", "share") and rng.random() < 0.8:
            n = int(rng.integers(2, 7))
            links = [f"<a href='/{word()}'>{said(1, 4)}</a>" for _ in range(n)]
            if plain and rng.random() < 0.5 or tag == "p":
                inner, count = " | ".join(links), 1
            else:
                inner, count = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", n
        elif kind == "talk" or rng.random() < 0.4:
            n = int(rng.integers(1, 4))
            inner, count = "".join(f"<p>{said(3, 30)}</p>" for _ in range(n)), n
        else:
            inner, count = f"{said(2, 25)}", 1
        out.append(("<table><tr>" if tag == "td" else "") + f"{head}{inner}</{tag}>" + ("</tr></table>" if tag == "td" else ""))
        labels.extend([0] * count)

    def part(x: float) -> tuple[str, int]:
        """A piece of a story and its number of blocks."""
        n = int(rng.integers(2, 5))
        some = lambda tag, a, b: "".join(f"<{tag}>{said(a, b)}</{tag}>" for _ in range(n))
        if x < 0.12:
            return f"<{rng.choice(['h2', 'h3'])}>{said(2, 8)}" + rng.choice(["</h2>", "</h3>"]), 1
        if x < 0.22:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>{some('li', 2, 15)}</{tag}>", n
        if x < 0.26:
            return f"<pre>{said(2, 30)}\n  {said(2, 20)}</pre>", 1
        if x < 0.30:
            return f"<details><summary>{said(2, 8)}</summary>{some('p', 3, 30)}</details>", n + 1
        if x < 0.34:
            return f"<table><tr>{some('th', 1, 3)}</tr><tr>{some('td', 1, 8)}</tr></table>", 2 * n
        if x < 0.38:
            return f"<figure><figcaption>{said(3, 15)}</figcaption></figure>", 1
        if x < 0.42:
            return "<dl>" + "".join(f"<dt>{said(1, 4)}<dd>{said(3, 20)}" for _ in range(n)) + "</dl>", 2 * n
        if x < 0.47:
            return f"<blockquote>{said(2, 40)}</blockquote>", 1
        return rng.choice(["<p>", "<p><b>", "<p>", "<div>"]) + said(2, 70) + rng.choice(["</p>", "</p>", "<br>"]) + ("<p>" if rng.random() < 0.1 else ""), 1

    def story() -> None:
        tag, head = _open(rng.choice(PLAIN_BODIES if rng.random() < 0.35 else BODIES))
        depth = int(rng.integers(0, 3))
        out.append(("<table><tr>" if tag == "td" else "") + head + "<div>" * depth)
        if rng.random() < 0.7:
            out.append(f"<h1>{said(3, 12)}</h1>")
            labels.append(1)
        even = rng.random() < 0.2  # some pages hold nothing but like paragraphs
        for _ in range(rng.integers(20, 130) if rng.random() < 0.1 else rng.integers(1, 9)):
            if not even and rng.random() < 0.07:
                furniture(rng.choice(["advert", "share", "side", "form", "notice"]))
                continue
            text, n = (f"<p>{said(4, 14)}</p>", 1) if even else part(rng.random())
            out.append(text)
            labels.extend([1] * n)
        if rng.random() < 0.2:
            furniture("talk")
        out.append("</div>" * depth + f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))

    bare = rng.random() < 0.1  # nothing around the story
    for kind, p in (("notice", 0.2), ("top", 0.5), ("menu", 0.8), ("advert", 0.5), ("form", 0.2)):
        if rng.random() < p and not bare:
            furniture(kind)
    shell = rng.random() < 0.3
    if shell:
        out.append("<div class='container'>")
    story()
    for kind, p in (("talk", 0.4), ("side", 0.5), ("share", 0.2), ("advert", 0.2), ("form", 0.2), ("bottom", 0.8)):
        if rng.random() < p and not bare:
            furniture(kind)
    opening = rng.choice(["<html><body>", "<html><body>", "<html><head><title>x</title></head><body>", "<html><head><title>x</title>", ""])
    return opening + "".join(out) + ("</div>" if shell else "") + "</body></html>", labels


def fit(pages: DataFrame, *, html_col: str = "html", key_col: str = "page_id", bound: int = 200, invented: int = 1200, steps: int = 600, longest: int = 100_000) -> dict[str, np.ndarray]:
    """Weights from ``invented`` layouts and about ``bound`` whole pages of up to ``longest`` characters, trained in one task; the weights reach the driver."""
    rows = pages.where(F.char_length(html_col) <= longest).select(F.col(key_col).cast("string").alias("key"), F.col(html_col).alias("html"))
    rows = sampled(rows, "key", bound)
    # one row that is always there starts the task even if there are no pages
    rows = rows.unionAll(rows.sparkSession.range(1).select(F.lit("").alias("key"), F.lit("").alias("html")))

    def learn(got: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(17)
        own: list[tuple[list[Block], list[int]]] = []
        for _ in range(invented):
            page, labels = invented_page(rng)
            cut = blocks(page)
            if len(cut) == len(labels):
                own.append((cut, labels))
        for page in got.sort_values("key")["html"]:
            cut = blocks(page)
            labels = weak_labels(cut)
            if labels:
                own.append((cut, labels))
        model = Labeller()
        model.train([(b, y) for b, y in own if b], steps)
        return pd.DataFrame({"name": list(model.w), "shape": [list(v.shape) for v in model.w.values()], "data": [v.astype(np.float32).tobytes() for v in model.w.values()]})

    got = rows.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(learn, "name string, shape array<int>, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]).copy() for r in got}


def extract(pages: DataFrame, weights: dict[str, np.ndarray], *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(kept columns, text) of every row."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, make = Labeller(shared.value), Features()
        for batch in batches:
            cut = [blocks(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            scores = model.scores(cut, make)
            text = ["\n".join(b.text for b, p in zip(own, s, strict=True) if p >= 0.5) for own, s in zip(cut, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string")
