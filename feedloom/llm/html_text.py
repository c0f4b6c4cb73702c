"""Main-text extraction: a bidirectional LSTM labels every block of a page from the whole page's context.

A page is read as a sequence of blocks: runs of text between block-level tags, each with its place,
the open elements above it. A block's vector holds hashed names, classes and ids of its place, hashed
words, and a few lengths. A small bidirectional LSTM in numpy gives each block a probability of
being main text. It is trained here, on a bounded sample of the pages whose structure names the
parts, and on the same text dressed in other layouts, also such that name nothing.

Reading takes time in proportion to the page, whatever its markup: tags are met once from left to
right, and a place adds only its own names to those of the place above it.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: At most so many pages (first by a hash of page_id, of at most MAX_CHARS characters) are learned from, whole ones of at most MAX_BLOCKS blocks.
MAX_PAGES, MAX_CHARS, MAX_BLOCKS = 200, 200_000, 80
PATH, WORDS, EXTRA, HIDDEN = 160, 32, 6, 24
SIZE = PATH + WORDS + EXTRA
#: The words of a long block are hashed in pieces of about so many characters; a long page is labelled in pieces of so many blocks.
CHUNK, STEPS = 1 << 16, 4096

# Fixed values of HTML: elements inside a line, without content, whose content is code, and whose content is never shown.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CODE = {"script", "style"}
UNSEEN = {"title", "template"}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_SHORT_COMMENT = re.compile(r"<!--+>")
_CODE_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in CODE}
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPLIT = re.compile(r"[\s_-]+")
#: What a start tag closes, unless one of the second is open in between.
_CLOSES = {"li": (("li",), ("ul", "ol")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}

# Names that layouts give to the parts of a page.
MAIN_NAMES = set("article main content post entry story text".split())
OTHER_NAMES = set(
    (
        "nav menu navbar navigation breadcrumb breadcrumbs header masthead banner footer copyright sidebar aside widget related recommended share social "
        "ad ads advert advertisement sponsor sponsored promo cookie consent notice alert popup modal newsletter subscribe signup form login search button select textarea "
        "comment comments reply respond discussion tags pagination head"
    ).split()
)


class Place(NamedTuple):
    """An open element: hashed names of it and all above as bits, the slot of its own last name, and what it lies in."""

    bits: int
    leaf: int
    name: str
    main: bool
    other: bool
    link: bool
    unseen: bool


class Block(NamedTuple):
    """A block: the place of its first text, its text, and the share of characters inside links."""

    place: Place
    text: str
    linked: float


class Slots(dict):
    """The slot of each name by its crc32; remembers short names, and is emptied when it has grown to ``MEMORY``."""

    MEMORY = 200_000

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        slot = zlib.crc32(name.encode("utf-8", "replace")) % self.size
        if len(name) <= 40:
            if len(self) >= self.MEMORY:
                self.clear()
            self[name] = slot
        return slot


_NAME_SLOTS, _WORD_SLOTS = Slots(PATH), Slots(WORDS)


def _own_names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    for kind, *values in _NAMED.findall(attributes):
        for word in _SPLIT.split(_CAMEL.sub(r"\1 \2", "".join(values))):
            if word:
                found.append(("#" if kind.lower() == "id" else ".") + word.lower())
    return tuple(found)


def _summary(names: tuple[str, ...]) -> tuple[int, int, str, bool, bool]:
    bits = 0
    for n in names:
        bits |= 1 << _NAME_SLOTS[n]
    bare = [n.lstrip(".#") for n in names]
    return bits, _NAME_SLOTS[">" + names[-1]], names[-1], any(n in MAIN_NAMES for n in bare), any(n in OTHER_NAMES for n in bare)


@lru_cache(50_000)
def _short_element(tag: str, attributes: str) -> tuple[int, int, str, bool, bool]:
    return _summary(_own_names(tag, attributes))


def _element(tag: str, attributes: str) -> tuple[int, int, str, bool, bool]:
    return _short_element(tag, attributes) if len(attributes) <= 120 else _summary(_own_names(tag, attributes))


ROOT = Place(0, -1, "", False, False, False, False)


def inside(above: Place, tag: str, attributes: str = "") -> Place:
    """The place of an element below another; elements inside a line only tell whether there is a link."""
    if tag in INLINE:
        return above._replace(link=True) if tag == "a" else above
    bits, leaf, name, main, other = _element(tag, attributes)
    return Place(above.bits | bits, leaf, name, above.main or main, above.other or other, above.link, above.unseen or tag in UNSEEN)


def blocks(page: str | None) -> list[Block]:
    """Every non-empty block in page order.

    Left out are comments, scripts, styles, titles and templates, and nothing else. Unclosed elements end
    with the element around them, an unclosed comment at the next ``>``, an unclosed script or style
    with the page. A ``<`` that opens no tag is text.
    """
    out: list[Block] = []
    page = page or ""
    names: list[str] = []
    places: list[Place] = [ROOT]
    open_at: dict[str, list[int]] = {}
    levels: list[int] = []  # the open elements that are not inside a line
    text: list[str] = []
    first: Place | None = None
    linked = total = 0

    def flush() -> None:
        nonlocal first, linked, total
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append(Block(first or ROOT, words, linked / max(1, total)))
            text.clear()
        first, linked, total = None, 0, 0

    def add(raw: str) -> None:
        nonlocal first, linked, total
        place = places[-1]
        if not raw or place.unseen:
            return
        t = entities.unescape(raw) if "&" in raw else raw
        text.append(t)
        n = len(t.strip())
        if n:
            total += n
            if place.link:
                linked += n
            if first is None:
                first = place

    def close(i: int) -> None:
        while len(names) > i:
            open_at[names.pop()].pop()
            places.pop()
        while levels and levels[-1] >= i:
            levels.pop()

    at, comments, ends, tag = 0, True, True, _TAG
    while ends:
        i = page.find("<", at)
        if i < 0:
            break
        m = tag.match(page, i)
        opens = page[i + 1 : i + 2]
        letter = opens.isascii() and opens.isalpha()
        if m is None and letter and tag is _TAG:
            tag = _PLAIN_TAG  # some quote swallows the rest of the page: from here on tags end at the next >
            m = tag.match(page, i)
        if m is None:
            if opens in ("!", "?", "/"):
                end = -1
                if comments and page.startswith("<!--", i):
                    quick = _SHORT_COMMENT.match(page, i)
                    end = quick.end() - 1 if quick else page.find("-->", i + 4)
                    comments = end >= 0
                    end = end if quick or end < 0 else end + 2
                if end < 0:
                    end = page.find(">", i)
                ends = end >= 0
                if ends:
                    add(page[at:i])
                    at = end + 1
                continue
            if letter:
                break  # no tag ends after here
            add(page[at : i + 1])
            at = i + 1
            continue
        add(page[at:i])
        at = m.end()
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if name not in INLINE:
                flush()
            if open_at.get(name):
                close(open_at[name][-1])
            continue
        empty = attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\r\n\"'" or "=" not in attributes)
        if name in CODE:
            text.append(" ")
            if not empty:
                end = _CODE_ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            text.append("\n")
        if name not in INLINE:
            flush()
        if name in VOID or empty:
            continue
        if name not in INLINE:
            if levels and names[levels[-1]] == "p":
                close(levels[-1])
            if name in _CLOSES:
                last = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)
                these, barrier = _CLOSES[name]
                if last(these) > last(barrier):
                    close(min(open_at[t][-1] for t in these if open_at.get(t) and open_at[t][-1] > last(barrier)))
            levels.append(len(names))
        open_at.setdefault(name, []).append(len(names))
        names.append(name)
        places.append(inside(places[-1], name, attributes))
    add(page[at:])
    flush()
    return out


def block_vectors(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row per block from ``start`` to ``stop``: hashed names of its place, shares of all hashed words, and lengths."""
    some = page[start:stop]
    x = np.zeros((len(some), SIZE), np.float32)
    if some:
        bits = np.frombuffer(b"".join([b.place.bits.to_bytes(PATH // 8, "little") for b in some]), np.uint8)
        x[:, :PATH] = np.unpackbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
    counts, n_words = np.zeros(len(some) * WORDS, np.int64), np.zeros(len(some), np.int64)
    slots: list[int] = []
    owner: list[int] = []
    many: list[int] = []

    def tally() -> None:
        np.add.at(n_words, owner, many)
        counts[:] += np.bincount(np.repeat(np.array(owner, np.int64), many) * WORDS + np.array(slots, np.int64), minlength=len(counts))
        slots.clear(), owner.clear(), many.clear()

    for i, block in enumerate(some):
        at = 0
        while at <= len(block.text):
            end = block.text.find(" ", at + CHUNK) if len(block.text) > at + CHUNK else -1
            end = len(block.text) if end < 0 else end
            words = block.text[at:end].split(" ")
            slots.extend(map(_WORD_SLOTS.__getitem__, words))
            owner.append(i)
            many.append(len(words))
            at = end + 1
            if len(slots) > CHUNK:
                tally()
    tally()
    x[:, PATH : PATH + WORDS] = counts.reshape(len(some), WORDS) / np.maximum(n_words, 1)[:, None]
    leaf = np.array([b.place.leaf for b in some], np.int64)
    x[np.flatnonzero(leaf >= 0), leaf[leaf >= 0]] += 1
    n = np.array([len(b.text) for b in some], np.float64)
    ends = [b.text[-1] in ".!?\"" for b in some]
    x[:, PATH + WORDS :] = np.stack([np.log1p(n) / 8, [b.linked for b in some], np.arange(start, start + len(some)) / max(1, len(page)), ends, n < 40, n > 200], axis=1)
    return x


class BlockLabeller:
    """Bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": scale(SIZE, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
        self.p |= {"o": scale(2 * HIDDEN, 1), "ob": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, pages, SIZE) already in this direction's order; live: 1 where a page has a block."""
        steps, pages = x.shape[:2]
        z_all = x @ self.p["x" + d] + self.p["c" + d]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_all[t] + h @ self.p["h" + d]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[t][:, None]
            c2 = (f * c + i * g) * m
            th = np.tanh(c2)
            h2 = o * th * m
            if keep:
                tape.append((h, c, i, f, o, g, th, m))
            h, c = h2, c2
            out[t] = h
        return out, tape

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), SIZE), np.float32)
        live = np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], live[: len(p), k] = p, 1
        return x, live

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for every block of every page; both directions run side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [k for k in np.argsort([len(p) for p in pages], kind="stable") if len(pages[k])]
        while order:
            take = max(1, min(64, STEPS * 4 // len(pages[order[-1]])))
            some, order = order[-take:], order[:-take]
            for k, y in zip(some, self._probabilities([pages[k] for k in some]), strict=True):
                out[k] = y
        return out

    def _probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Step t meets block t of every page forwards and block t from its end backwards, so padding is met last.

        Inputs are made for ``STEPS`` steps at a time. A sigmoid is half a tanh of half its argument,
        plus a half, so one tanh serves all gates.
        """
        sizes = [len(p) for p in pages]
        half = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, np.float32(0.5), np.float32(1))
        w = np.stack([self.p["hf"] * half, self.p["hb"] * half])
        h, c = np.zeros((2, len(pages), HIDDEN), np.float32), np.zeros((2, len(pages), HIDDEN), np.float32)
        z = np.empty((2, len(pages), 4 * HIDDEN), np.float32)
        logit = [np.full(n, self.p["ob"][0], np.float32) for n in sizes]
        outs = [self.p["o"][:HIDDEN, 0], self.p["o"][HIDDEN:, 0]]
        for start in range(0, max(sizes), STEPS):
            steps = min(STEPS, max(sizes) - start)
            inputs = np.zeros((steps, 2, len(pages), 4 * HIDDEN), np.float32)
            for k, (page, n) in enumerate(zip(pages, sizes, strict=True)):
                a, b = start, min(n, start + steps)
                if a < b:
                    inputs[: b - a, 0, k] = (block_vectors(page, a, b) @ self.p["xf"] + self.p["cf"]) * half
                    inputs[: b - a, 1, k] = ((block_vectors(page, n - b, n - a) @ self.p["xb"] + self.p["cb"]) * half)[::-1]
            seen = np.empty((steps, 2, len(pages), HIDDEN), np.float32)
            for t in range(steps):
                np.matmul(h, w, out=z)
                np.add(z, inputs[t], out=z)
                np.tanh(z, out=z)
                gate = z[:, :, : 3 * HIDDEN] * np.float32(0.5) + np.float32(0.5)
                c = gate[:, :, HIDDEN : 2 * HIDDEN] * c
                c += gate[:, :, :HIDDEN] * z[:, :, 3 * HIDDEN :]
                h = np.multiply(gate[:, :, 2 * HIDDEN :], np.tanh(c), out=seen[t])
            for k, n in enumerate(sizes):
                a, b = start, min(n, start + steps)
                if a < b:
                    logit[k][a:b] += seen[: b - a, 0, k] @ outs[0]
                    logit[k][n - b : n - a] += (seen[: b - a, 1, k] @ outs[1])[::-1]
        return [1 / (1 + np.exp(-v)) for v in logit]

    def _back(self, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grads: dict) -> None:
        dh = dc = np.zeros_like(dout[0])
        dz_all = np.zeros((len(tape), dout.shape[1], 4 * HIDDEN), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, th, m = tape[t]
            dh = (dh + dout[t]) * m
            dc = (dc + dh * o * (1 - th * th)) * m
            dz_all[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads["h" + d] += h.T @ dz_all[t]
            dh, dc = dz_all[t] @ self.p["h" + d].T, dc * f
        grads["x" + d] += np.ascontiguousarray(x).reshape(-1, SIZE).T @ dz_all.reshape(-1, 4 * HIDDEN)
        grads["c" + d] += dz_all.sum(axis=(0, 1))

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], passes: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the mean log loss of all blocks."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(passes):
            order = rng.permutation(len(pages))
            order = np.concatenate([o[np.argsort([len(pages[k]) for k in o], kind="stable")] for o in np.array_split(order, max(1, len(order) // 240))])
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x, live = self._pad([pages[k] for k in some])
                y = np.zeros_like(live)
                for i, k in enumerate(some):
                    y[: len(labels[k]), i] = labels[k]
                f, tf = self._run(x, live, "f", True)
                b, tb = self._run(x[::-1], live[::-1], "b", True)
                both = np.concatenate([f, b[::-1]], axis=2)
                p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["ob"])[:, :, 0]))
                d = ((p - y) * live / live.sum())[:, :, None].astype(np.float32)
                grads = {k: np.zeros_like(w) for k, w in self.p.items()}
                grads["o"] = np.einsum("tph,tpo->ho", both, d)
                grads["ob"] = d.sum(axis=(0, 1))
                dboth = d @ self.p["o"].T
                self._back("f", x, tf, dboth[:, :, :HIDDEN], grads)
                self._back("b", x[::-1], tb, dboth[::-1, :, HIDDEN:], grads)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def structural_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks inside a part named as main text and no part named as another; None if no part is named main."""
    return np.array([b.place.main and not b.place.other for b in page], np.float32) if any(b.place.main for b in page) else None


@lru_cache(20_000)
def placed(path: tuple[str, ...]) -> Place:
    """The place of a path of tags, each followed by its classes (.name) and ids (#name)."""
    place, at = ROOT, 0
    while at < len(path):
        end = at + 1
        while end < len(path) and path[end][0] in ".#":
            end += 1
        bits, leaf, name, main, other = _summary(path[at:end])
        place = Place(place.bits | bits, leaf, name, place.main or main, place.other or other, False, False)
        at = end
    return place


def dressed(texts: list[str], rng: np.random.Generator, named_parts: bool = True) -> tuple[list[Block], np.ndarray]:
    """One page of the given main-text blocks in a made-up layout, with its labels.

    Without ``named_parts`` no element is named, by tag or class, after the part it holds: what is left are
    places, lengths, links and words.
    """
    pick = lambda options: options[int(rng.integers(len(options)))]
    short = lambda: " ".join(pick(texts).split(" ")[: int(rng.integers(1, 14))])
    named = lambda tag, name: (tag, pick([".", "#"]) + name) if named_parts else (tag,)
    page: list[Block] = []
    labels: list[float] = []
    root: tuple[str, ...] = ("html", "body") + pick([(), ("div",), ("div", ".wrapper"), ("div", "#page"), ("div", ".container")])
    table = not named_parts and rng.random() < 0.5
    if table:
        root += ("table", "tr")
    blank = [("td",)] if table else [("div",), ("div", "div"), ("section",)]

    def add(path: tuple[str, ...], text: str, linked: float, label: float) -> None:
        page.append(Block(placed(root + path), text, linked))
        labels.append(label)

    def other(names: list[str], tags: list[str], leaves: list[tuple[str, ...]], most: int, linked: float) -> None:
        top = pick([named("div", pick(names)), named("section", pick(names)), (pick(tags),), (pick(tags), "." + pick(names))]) if named_parts else pick(blank)
        leaf = pick(leaves)
        for _ in range(int(rng.integers(1, most))):
            add(top + leaf, pick(texts) if named_parts and rng.random() < 0.2 else short(), linked if rng.random() < 0.9 else 0.0, 0)

    menu = lambda: other(["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination"], ["nav"], [("ul", "li"), ("ol", "li"), (), ("div",)], 9, 1.0)
    advert = lambda: other(["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner"], ["aside", "div"], [(), ("p",), ("div",)], 3, 0.3) if rng.random() < 0.7 else None
    if rng.random() < 0.7:
        other(["header", "masthead", "banner"], ["header"], [(), ("h1",), ("p",), ("div",)], 4, 0.2)
    if rng.random() < 0.8:
        menu()
    if rng.random() < 0.4:
        other(["cookie", "consent", "notice", "alert", "popup", "modal"], ["div"], [(), ("p",), ("div",)], 3, 0.1)
    advert()
    if rng.random() < 0.3:
        other(["sidebar", "widget", "related"], ["aside"], [("p",), ("ul", "li"), ("h3",), ("div",)], 6, 0.6)
    container = pick([("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", "#content"), ("div", ".post"), ("section", ".entry"), ("div", ".story"), ("div", ".post", ".body"), ("div", ".article", ".text"), ("article", ".entry", ".content"), ("div", "#main")]) if named_parts else pick(blank)
    for k, t in enumerate(texts):
        leaf = pick([("h1",), ("h2",), ("p",)]) if k == 0 else pick([("p",)] * 8 + [("ul", "li")] * 2 + [("h2",), ("h3",), ("ul", "li"), ("blockquote", "p"), ("blockquote",), ("pre",), ("div",), (), ("table", "tr", "td"), pick([("math",), ("noscript", "p"), ("object", "p"), ("svg", "text"), ("figure", "figcaption")])])
        add(container + leaf, t, 0.1 if rng.random() < 0.1 else 0.0, 1)
        if named_parts and rng.random() < 0.04:
            add(container + pick([named("div", pick(["ad", "advert", "sponsored", "promo", "related", "share", "newsletter"])), ("aside",), ("aside", ".related"), ("form",)]) + pick([(), ("p",)]), short(), 0.3, 0)
        if named_parts and rng.random() < 0.02:
            add(container + pick([("button",), ("p", "button"), ("select", "option"), ("textarea",)]), short(), 0.0, 0)
    if rng.random() < 0.4:
        other(["related", "recommended", "share", "social", "tags", "newsletter", "subscribe", "signup", "login", "search"], ["aside", "form"], [("p",), ("ul", "li"), ("h3",), ("label",), ()], 5, 0.7)
    if named_parts and rng.random() < 0.5:
        other(["comments", "comment", "respond", "discussion", "reply"], ["section", "aside"], [("div", ".comment", "p"), ("ul", "li", ".comment"), ("p",), ("ol", "li"), ("article", ".comment", "p")], 7, 0.0)
    if rng.random() < 0.4:
        other(["sidebar", "widget"], ["aside"], [("p",), ("ul", "li"), ("h3",), ("div",)], 6, 0.6)
    advert()
    if rng.random() < 0.85:
        other(["footer", "copyright"], ["footer"], [(), ("p",), ("ul", "li"), ("div",)], 4, 0.2)
    return page, np.array(labels, np.float32)


def made_up_texts(rng: np.random.Generator) -> list[str]:
    """Sentences of made-up words, to learn from where no page has any text."""
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuv"), int(rng.integers(2, 9))))
    return [" ".join(word() for _ in range(int(rng.integers(6, 60)))).capitalize() + "." for _ in range(30)]


def train(pages: DataFrame, max_pages: int = MAX_PAGES, layouts: int = 4, seed: int = 4) -> BlockLabeller:
    """A labeller learned from at most ``max_pages`` pages (page_id, html), first in the order of a hash of page_id.

    Their ids are chosen first, so only the sample's pages reach the driver. A sampled page whose
    parts are named gives its own labels, if it has at most ``MAX_BLOCKS`` blocks; its main text is
    also dressed in ``layouts`` made-up layouts with named parts and one without. Of a page that names no part, the
    blocks of 80 characters or more are taken for such texts. Null and longer pages are not learned
    from; where no page has a usable text, made-up sentences are dressed.
    """
    rows = pages.select("page_id", "html").where(F.col("html").isNotNull() & (F.length("html") <= MAX_CHARS))
    order = [F.xxhash64(F.lit(seed), "page_id"), "page_id"]
    ids = rows.where("page_id is not null").select("page_id").distinct().orderBy(*order).limit(max_pages)
    rows = rows.join(F.broadcast(ids), "page_id").orderBy(*order, F.xxhash64("html")).limit(max_pages).collect()
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def dress(texts: list[str], named: int) -> None:
        for k in range(named + 1):
            made, y = dressed(texts[: int(rng.integers(1, 40))], rng, k < named)
            xs.append(block_vectors(made))
            ys.append(y)

    for r in rows:
        page = blocks(r["html"])
        labels = structural_labels(page)
        if labels is not None and len(page) <= MAX_BLOCKS:
            xs.append(block_vectors(page))
            ys.append(labels)
        main = [b.text for b in page if len(b.text) >= 80] if labels is None else [b.text for b, y in zip(page, labels, strict=True) if y]
        if main:
            dress(main, layouts)
    for _ in range(0 if xs else 40):
        dress(made_up_texts(rng), layouts)
    model = BlockLabeller()
    model.fit(xs, ys)
    return model


def extract_text(pages: DataFrame, model: BlockLabeller) -> DataFrame:
    """Main text of every page (page_id, url, html): page_id, url, text, n_chars (code points of text).

    References are decoded, white space in a block becomes one space, blocks are joined by one space
    in page order. Null, empty or textless html: empty text. Pages of any length are read whole, in time
    in proportion to it, broken markup included (see ``blocks``).
    Null ids or urls and repeated rows stay as they are; other columns are left out. Empty table: no rows.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                found = [blocks(h) for h in some.html]
                texts = [" ".join(b.text for b, y in zip(page, p, strict=True) if y >= 0.5) for page, p in zip(found, model.probabilities(found), strict=True)]
                yield pd.DataFrame({"page_id": some.page_id, "url": some.url, "text": texts, "n_chars": [len(t) for t in texts]})

    return bounded_batches(pages.select("page_id", "url", "html")).mapInPandas(run, schema + ", text string, n_chars long")
