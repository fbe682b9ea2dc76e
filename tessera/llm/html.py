"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is split into runs of text between block-level tags. A block's features are the tags and
class words of its ancestors, and its own length, links and punctuation. Two labels, main or other;
the field is trained on labelled pages that this module generates (page layouts of its own, with
invented text, the label of every block known) and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunked

# Tags that do not end a block, tags without content, tags whose content is not text, tags whose content has no tags.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg noembed noframes".split())
PLAIN = frozenset("title textarea xmp".split())
#: Without an end tag their content is all that follows; the others of RAW and PLAIN are then taken as empty.
TO_THE_END = frozenset("script style".split())
#: An open paragraph ends where one of these starts; these end an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_ITS_KIND = frozenset("li dt dd tr td th option".split())

NAME = re.compile(r"[^\s/>]*")
#: What follows a tag's name up to the > that ends it: quoted values hide it. Nothing here is tried twice.
REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
ATTRIBUTES = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
MAIN, OTHER = 1, 0


@dataclass(eq=False)
class Node:
    """An open element: its tag, the tag with the words of its class, id and role, and the element around it."""

    above: Node | None
    tag: str
    name: str
    place: Place | None = None  # what a Decoder knows of it


@dataclass
class Block:
    path: Node | None
    text: str
    linked: int  # characters in links


def ancestors(node: Node | None) -> tuple[str, ...]:
    """The names of an element and those around it, the outermost first."""
    out = []
    while node is not None:
        out.append(node.name)
        node = node.above
    return tuple(reversed(out))


def named(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role."""
    if len(attributes) < 5:
        return tag
    return _named(tag, attributes) if len(attributes) < 1000 else _named.__wrapped__(tag, attributes)


@lru_cache(maxsize=20_000)
def _named(tag: str, attributes: str) -> str:
    found = " ".join(next(filter(None, m.groups()[1:]), "") for m in ATTRIBUTES.finditer(attributes))
    split = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found).lower()
    return " ".join([tag, *dict.fromkeys(WORD.findall(split))])


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE)


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes) in page order; kinds are text, start, empty (a self-closed start) and end.

    One pass from left to right. A quote that nothing closes does not hide the > after it, nor do the quotes
    before it in tags that were open there. A tag or comment that nothing ends is dropped with what follows.
    """
    at, n, odd = 0, len(page), -1
    text_from = 0
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        first = page[lt + 2 : lt + 3] if closing else after
        if not (first.isascii() and first.isalpha()) and after not in ("!", "?"):
            at = lt + 1  # a < in text
            continue
        if lt > text_from:
            yield "text", page[text_from:lt], ""
        if after in ("!", "?"):
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            if end < 0:
                return
            at = text_from = end + (3 if page.startswith("<!--", lt) else 1)
            continue
        start = lt + 1 + closing
        name_end = NAME.match(page, start).end()
        end = REST.match(page, name_end).end() if lt > odd else page.find(">", name_end)
        if 0 <= end < n and page[end] != ">":  # an odd quote
            odd = end
            end = page.find(">", name_end)
        if not 0 <= end < n:
            return
        empty = page[end - 1] == "/" and end > name_end
        yield "end" if closing else "empty" if empty else "start", page[start:name_end].lower(), page[name_end:end]
        at = text_from = end + 1
        if not closing and not empty and (tag := page[start:name_end].lower()) in RAW | PLAIN:
            found = _end_tag(tag).search(page, at)
            close = page.find(">", found.end()) if found else -1
            if close < 0 and tag not in TO_THE_END:
                yield "end", tag, ""
                continue
            if tag in PLAIN:
                yield "text", page[at : found.start()], ""
            yield "end", tag, ""
            if close < 0:
                return
            at = text_from = close + 1
    if text_from < n:
        yield "text", page[text_from:], ""


def blocks(page: str) -> list[Block]:
    """The text blocks in page order, white space collapsed; empty ones are left out. Time grows with the page's length."""
    out: list[Block] = []
    stack: list[Node] = []
    count: Counter = Counter()  # open elements by tag
    text: list[str] = []
    linked, links, path = 0, 0, None

    def end() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(path, joined, linked))
            text.clear()
        linked = 0

    def close(tag: str) -> bool:
        """End the innermost open element of this tag and all inside it."""
        if not count[tag]:
            return False
        while True:
            last = stack.pop()
            count[last.tag] -= 1
            if last.tag == tag:
                return True

    for kind, what, attributes in markup(page):
        if kind == "text":
            if not text:
                if not what.strip():
                    continue
                path = stack[-1] if stack else None
            text.append(what)
            linked += len(what) if links else 0
            continue
        if what == "a" and kind != "empty":
            links = int(kind == "start")
        if what in INLINE:
            continue
        end()
        if kind == "end":
            if close(what):
                links = 0
            continue
        if what in ENDS_P:
            close("p")
        elif what in ENDS_ITS_KIND and stack and stack[-1].tag == what:
            close(what)
        if what not in VOID and kind == "start":
            stack.append(Node(stack[-1] if stack else None, what, named(what, attributes)))
            count[what] += 1
    end()
    return out


# --- features ---

SECTIONS = frozenset("article main nav aside footer header section form head dialog figure".split())


def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    """Ancestor tags and class words, the innermost section and the parent."""
    out, inner = [], "none"
    for depth, node in enumerate(path):
        tag, *names = node.split(" ")
        out.append(f"in {tag}")
        out += [f"class {n}" for n in names]
        if tag in SECTIONS or names:
            inner = node if tag not in SECTIONS else tag
            last = [f"inner {tag}", *(f"inner class {n}" for n in names)] if tag in SECTIONS or names else []
            out = [x for x in out if not x.startswith("inner ")] + last
    parent = path[-1].split(" ")[0] if path else "none"
    return tuple(dict.fromkeys([*out, f"parent {parent}", f"inner none {inner == 'none'}"]))


def text_features(text: str, linked: int) -> list[str]:
    """Length, links, punctuation."""
    n = text.count(" ") + 1
    size = next(i for i, most in enumerate((1, 3, 6, 12, 30, 1 << 60)) if n <= most)
    share = min(3, 4 * linked // max(1, len(text)))
    low = text.lower()
    out = [f"size {size}", f"links {share}"]
    out += ["stops"] if text[-1] in ".!?:;…\"”" else []
    out += ["rights"] if "©" in low or "copyright" in low or "all rights" in low else []
    out += ["dots"] if " · " in low or " | " in low else []
    return out


# --- labelled pages ---

# What layouts call their parts.
MENU = ("nav", "ul class=menu", "div class=navbar", "div id=main-nav", "div class=breadcrumbs", "div role=navigation", "div class=topbar")
ASIDE = ("aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related-posts", "section class=recommended", "div class=share-buttons social", "div class=tags", "ul class=pagination")
NOTICE = ("div class=ad", "div class=advert", "div id=ad-top", "div class=banner promo", "div class=cookie-notice", "div class=cookie-consent", "div class=popup modal", "div class=alert notice", "section class=sponsored", "div class=newsletter subscribe", "ins class=adsbygoogle", "div role=banner", "noscript", "dialog")
FORM = ("form", "form class=search", "div class=search-form", "div class=login", "fieldset", "button", "select")
FOOT = ("footer", "div class=footer", "div id=footer", "div class=copyright legal", "footer class=site-footer")
HEAD = ("header", "div class=header", "div id=header", "header class=site-header", "div class=masthead logo")
COMMENTS = ("section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div id=disqus thread", "div class=reviews responses", "div class=replies discussion")
BODY = ("article", "main", "div class=content", "div class=post", "div class=entry-content", "div class=article-body", "div id=content", "section class=story text", "article class=post", "div role=main", "div itemprop=articleBody", "div class=page body", "div class=main column", "section")
WRAP = ("div", "div class=container", "div class=wrapper", "div id=page", "div class=row", "section", "div class=inner", "div class=layout")


class Layout:
    """Makes one labelled page after the other."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def text(self, least: int, most: int) -> str:
        r = self.rng
        word = lambda: "".join(r.choice("aeiourstnlmdkpv") for _ in range(r.randint(1, 9)))
        return " ".join(word() for _ in range(r.randint(least, most))).capitalize()

    def block(self, tag: str, label: int, least: int, most: int, link: float = 0.0) -> str:
        r = self.rng
        text = self.text(least, most) + (r.choice([".", ".", "!", "?"]) if label or r.random() < 0.5 else "")
        self.labels.append(label)
        return f"<{tag}>" + (f'<a href="/x">{text}</a>' if r.random() < link else text) + (f"</{tag}>" if r.random() < 0.95 or tag != "p" else "")

    def part(self, names: tuple[str, ...], label: int, kind: str) -> str:
        """A part of the page, named in one of the given ways."""
        r = self.rng
        name = r.choice(names)
        tag = name.split(" ")[0]
        attr = re.sub(r"(\w+)=(.*)", r'\1="\2"', name[len(tag) :])
        if kind == "links":
            inside = "<ul>" + "".join(self.block("li", label, 1, 3, 0.95) for _ in range(r.randint(1, 8))) + "</ul>"
        elif kind == "line":
            sep = r.choice(["", "© 2024 ", "&copy; ", ""]) if names is FOOT else ""
            inside = self.block(r.choice(["p", "span", "div"]), label, 1, 14).replace(">", ">" + sep, 1)
        else:
            inside = "".join(self.block(r.choice(["p", "p", "div", "li"]), label, 1, 40, 0.1) for _ in range(r.randint(1, 4)))
        return f"<{tag}{attr}>{inside}</{tag}>"

    def chrome(self, chance: float) -> str:
        r, out = self.rng, []
        for names, kind in ((HEAD, "line"), (MENU, "links"), (NOTICE, "line"), (NOTICE, "text"), (FORM, "line"), (ASIDE, r.choice(["links", "text"]))):
            if r.random() < chance:
                out.append(self.part(names, OTHER, kind))
        r.shuffle(out)
        return "".join(out)

    def body(self) -> str:
        r, out = self.rng, []
        name = r.choice(BODY)
        tag = name.split(" ")[0]
        attr = re.sub(r"(\w+)=(.*)", r'\1="\2"', name[len(tag) :])
        if r.random() < 0.8:
            title = self.block(r.choice(["h1", "h1", "h2"]), MAIN, 1, 14)
            out.append(f"<header>{title}</header>" if r.random() < 0.2 else title)
        for _ in range(r.randint(1, 10)):
            tags = ["p"] * 8 + ["h2", "h3", "blockquote", "li", "pre", "figcaption", "td", "div"]
            out.append(self.block(r.choice(tags), MAIN, 1, r.choice([5, 30, 90]), 0.04))
            if r.random() < 0.1:
                out.append(self.part(r.choice([NOTICE, ASIDE, FORM]), OTHER, r.choice(["line", "text", "links"])))
        if r.random() < 0.15:
            out.append(self.part(COMMENTS, OTHER, "text"))
        if r.random() < 0.15:
            out.append(self.part(FOOT, OTHER, "line"))
        return f"<{tag}{attr}>{''.join(out)}</{tag}>"

    def page(self) -> tuple[str, list[int]]:
        """A page and its blocks' labels."""
        r = self.rng
        self.labels: list[int] = []
        head = f"<head>{self.block('title', OTHER, 2, 12)}<style>p{{a:b}}</style><script>x('</p>')</script></head>"
        top = self.chrome(0.5)
        mid = "".join(f"<{w.split(' ')[0]}{re.sub(r'(\w+)=(.*)', r'\1="\2"', w[len(w.split(' ')[0]):])}>" for w in r.sample(WRAP, r.randint(0, 3)))
        main = self.body()
        tail = (self.part(COMMENTS, OTHER, "text") if r.random() < 0.35 else "") + self.chrome(0.25) + (self.part(FOOT, OTHER, r.choice(["line", "links", "text"])) if r.random() < 0.8 else "")
        return f"<!DOCTYPE html><html>{head}<body>{top}{mid}{main}{tail}</body></html>", self.labels


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    layout = Layout(seed)
    return [layout.page() for _ in range(n)]


# --- the field ---


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x label
    start: np.ndarray


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[str, list[int]]], steps: int = 120, decay: float = 1e-4) -> Field:
    """Maximise the labels' conditional likelihood by Adam, all pages in lockstep (padded to the longest)."""
    rows = [([(*path_features(ancestors(b.path)), *text_features(b.text, b.linked)) for b in blocks(p)], labels) for p, labels in pages]
    rows = [(f, y) for f, y in rows if f and len(f) == len(y)]
    names = {x: i for i, x in enumerate(sorted({x for f, _ in rows for b in f for x in b}))}
    n, longest = len(rows), max(len(y) for _, y in rows)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, on = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (f, labels) in enumerate(rows):
        on[i, : len(labels)], y[i, : len(labels)] = True, labels
        for t, b in enumerate(f):
            x[i, t, [names[k] for k in b]] = 1
    gold, flat = np.eye(2, dtype=np.float32)[y] * on[..., None], x.reshape(-1, len(names))
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    theta = [np.zeros((len(names), 2), np.float32), np.zeros((2, 2), np.float32), np.zeros(2, np.float32)]
    mean, var = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, steps + 1):
        w, moves, start = theta
        e = (flat @ w).reshape(n, longest, 2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, longest):
            nxt = _logsum(alpha[:, t - 1, :, None] + moves, 1) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None], nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            prev = _logsum(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(on[:, t + 1, None], prev, 0)
        z = _logsum(alpha[:, -1], 1)[:, None]
        marginal = np.exp(alpha + beta - z[..., None]) * on[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None, None]) * on[:, 1:, None, None]
        grads = [flat.T @ (gold - marginal).reshape(-1, 2), gold_moves - pair.sum((0, 1)), (gold[:, 0] - marginal[:, 0]).sum(0)]
        for i, g in enumerate(grads):
            g = g / n - decay * theta[i]
            mean[i], var[i] = 0.9 * mean[i] + 0.1 * g, 0.99 * var[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.1 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
    return Field(names, *theta)


@lru_cache(maxsize=4)
def default_field(pages: int = 300, seed: int = 7) -> Field:
    return train(labelled_pages(pages, seed))


@dataclass(eq=False)
class Place:
    """What of an element's surroundings the field knows: the same features as path_features(), found from those of the element around it."""

    seen: frozenset[str]  # tags and class words of all elements, as far as the field knows them
    inner: tuple[str, ...]
    none: bool  # there is no section or class around
    parent: str
    below: dict[str, Place] = field(default_factory=dict)
    weights: tuple[float, float] | None = None


class Decoder:
    def __init__(self, model: Field) -> None:
        self.field = model
        self.forget()

    def forget(self) -> None:
        self.outside, self.equal, self.steps = Place(frozenset(), (), True, "parent none"), {}, 0

    def inside(self, place: Place, name: str) -> Place:
        """The place inside an element of this name; places with the same features are one."""
        know = self.field.names
        tag, *words = name.split(" ")
        new = {f for f in (f"in {tag}", *(f"class {w}" for w in words)) if f in know} - place.seen
        inner, none = place.inner, place.none
        if tag in SECTIONS or words:
            inner, none = tuple(dict.fromkeys(f for f in (f"inner {tag}", *(f"inner class {w}" for w in words)) if f in know)), False
        parent = f"parent {tag}" if f"parent {tag}" in know else ""
        key = (place.seen | new if new else place.seen, inner, none, parent)
        found = self.equal.get(key)
        if found is None:
            found = self.equal[key] = Place(*key)
        place.below[name] = found
        self.steps += 1
        return found

    def place(self, node: Node | None) -> Place:
        """The place inside an element, kept on the element."""
        up = []
        while node is not None and node.place is None:
            up.append(node)
            node = node.above
        place = self.outside if node is None else node.place
        for x in reversed(up):
            place = x.place = place.below.get(x.name) or self.inside(place, x.name)
        return place

    def emission(self, b: Block) -> tuple[float, float]:
        place = self.place(b.path)
        w = place.weights
        if w is None:
            w = place.weights = self._sum([*place.seen, *place.inner, place.parent, f"inner none {place.none}"])
        o, m = self.text_weights(tuple(text_features(b.text, b.linked)))
        return w[0] + o, w[1] + m

    def text_weights(self, features: tuple[str, ...]) -> tuple[float, float]:
        found = self.equal.get(features)
        if found is None:
            found = self.equal[features] = self._sum(features)
        return found

    def _sum(self, features) -> tuple[float, float]:
        rows = sorted(self.field.names[f] for f in features if f in self.field.names)
        other, main = self.field.weights[rows].sum(0).tolist() if rows else (0.0, 0.0)
        return other, main

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi over two labels; ties go to the label `other`."""
        if not found:
            return []
        (oo, om), (mo, mm) = self.field.moves.tolist()
        if self.steps > 50_000:
            self.forget()
        e = self.emission(found[0])
        o, m = e[0] + float(self.field.start[0]), e[1] + float(self.field.start[1])
        back = []
        for b in found[1:]:
            e = self.emission(b)
            back.append((m + mo > o + oo, m + mm > o + om))
            o, m = max(o + oo, m + mo) + e[0], max(o + om, m + mm) + e[1]
        label = int(m > o)
        out = [label]
        for from_o, from_m in reversed(back):
            label = int(from_m if label else from_o)
            out.append(label)
        return out[::-1]


def extract(pages: DataFrame, spark: SparkSession, model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for each row of pages (page_id, url, html).

    A null or empty html has an empty text; so has a page without main blocks. A tag, comment, script or
    style that nothing ends takes what follows with it; a quote that nothing closes hides no >; a
    self-closed element, or another one whose content is not text and that has no end tag, is empty.
    Repeated rows give repeated rows, null ids and urls stay null, an empty table gives an
    empty table, other columns are not read. A page is parsed whole.
    """
    shared = spark.sparkContext.broadcast(model or default_field())  # a few hundred features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in chunked(batches, "html"):
            rows = []
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                main = [b.text for b, y in zip(found, decoder.decode(found)) if y]
                text = " ".join(main)
                rows.append((text, len(text), len(found), len(main)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *cols], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    kept = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return kept.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main bigint")
