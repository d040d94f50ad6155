"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into blocks: runs of text between block-level tags, with the tags, classes, ids and roles above them.
Each block is main text or not; the field scores labels by features of its ancestors, its own text and its place, and
neighbours by a transition weight.  It is trained by conditional likelihood on labelled pages (:mod:`html_layouts`
writes them: common layouts with known labels), once per job on the driver: their number is a parameter.  Every page
is decoded by Viterbi in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .html_layouts import labelled_pages

TRAINING_PAGES = 480
BUCKETS, STEPS, RATE, DECAY = 1 << 12, 150, 0.2, 1e-3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.  Raw text goes on to its closing tag or the end of the page ...
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
#: ... the others are elements: what closes an element around them ends them too.
OPAQUE = frozenset("template svg math object select canvas audio video".split())
#: Without a closing tag these have no content of their own that could be told from the page's.
EMBEDDED = frozenset("object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
#: An opening tag on the left ends an open element on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that an implied end does not reach beyond.
HOLDS = frozenset("ul ol dl table article section nav aside main header footer form div body".split())

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in RAW}
_EMBEDDED_END = re.compile(rf"</({'|'.join(sorted(EMBEDDED))})(?=[\s/>])", re.I)


class Above:
    """An open element: the feature names it adds to those of the elements around it, and the nearest block-level tag.

    Elements around are shared, never copied, so that a page's elements take room in proportion to the page at any depth.
    """

    __slots__ = ("outer", "new", "leaf", "score")

    def __init__(self, outer: Above | None, new: list[str], leaf: str) -> None:
        self.outer, self.new, self.leaf, self.score = outer, new, leaf, None

    def names(self) -> list[str]:
        node, found = self, []
        while node:
            found += node.new
            node = node.outer
        return found


@dataclass
class Block:
    text: str
    above: Above | None  # the innermost open element
    linked: int  # characters inside links


#: Elements whose tag says nothing about a block.
_PLAIN = frozenset("html body b i em strong span".split())


def _names(attributes: str) -> tuple[str, ...]:
    words = [w.lower() for m in _NAME.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")]
    hidden = ("hidden",) if re.search(r"\bhidden\b|display\s*:\s*none", attributes) else ()
    return tuple(f".{w}" for w in words) + hidden


class _Stack:
    """The open elements, with the places of each tag: what a closing tag ends is found without a walk through them."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, list[str], Above]] = []
        self.places: dict[str, list[int]] = {}
        self.open_names: dict[str, int] = {}
        self.opaque = 0

    def top(self) -> Above | None:
        return self.elements[-1][2] if self.elements else None

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def push(self, tag: str, names: tuple[str, ...] = ()) -> None:
        outer = self.top()
        features = [f"up={x}" for x in dict.fromkeys((tag, *names)) if x not in _PLAIN]
        new = [x for x in features if not self.open_names.get(x)]
        for x in features:
            self.open_names[x] = self.open_names.get(x, 0) + 1
        leaf = "hidden" if "hidden" in names else tag if tag not in INLINE else outer.leaf if outer else "none"
        self.places.setdefault(tag, []).append(len(self.elements))
        self.opaque += tag in OPAQUE
        self.elements.append((tag, features, Above(outer, new, leaf)))

    def close(self, tags: tuple[str, ...], holds: frozenset[str]) -> None:
        """Ends the innermost element of ``tags`` and all inside it, unless one of ``holds`` stands in between."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if at < 0 or any(self.places[h][-1] > at for h in holds if h not in tags and self.places.get(h)):
            return
        while len(self.elements) > at:
            tag, features, _ = self.elements.pop()
            self.places[tag].pop()
            self.opaque -= tag in OPAQUE
            for x in features:
                self.open_names[x] -= 1


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; tags may be unclosed, crossed or cut off.  Time and room grow with the page's length, not
    with its depth."""
    stack = _Stack()
    out: list[Block] = []
    parts: list[str] = []
    state = {"above": None, "linked": 0, "worded": False}
    close = stack.close

    def add(raw: str) -> None:
        if stack.opaque:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not state["worded"]:
            state["above"], state["worded"] = stack.top(), not text.isspace() and text != ""
        parts.append(text)
        if stack.has("a"):
            state["linked"] += len(text)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, state["above"], state["linked"]))
            parts.clear()
        state["linked"], state["worded"] = 0, False

    at = 0
    last = {tag: -1 for tag in EMBEDDED}  # where the page closes such an element for the last time
    for m in _EMBEDDED_END.finditer(page):
        last[m[1].lower()] = m.start()
    while True:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if ends:
            if tag in INLINE:
                close((tag,), frozenset(["p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6"]) | HOLDS)
            elif tag == "p":
                close(("p",), HOLDS)
            else:
                close((tag,), frozenset())
        elif tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea") and not (stack.has("svg") or stack.has("math")):
                at = _END[tag].search(page, at).start()
        elif tag in OPAQUE:
            if not attributes.endswith("/") and (tag not in EMBEDDED or last[tag] >= at):
                stack.push(tag)
        elif tag not in VOID and not (attributes.endswith("/") and tag in INLINE):
            if tag not in INLINE:
                close(("p",), HOLDS | OPAQUE)
                if tag in ENDS:
                    close(ENDS[tag], HOLDS - {"div"} | OPAQUE if tag not in ("tr", "td", "th") else frozenset(["table"]) | OPAQUE)
            stack.push(tag, _names(attributes) if attributes else ())
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _bucket(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


@dataclass
class Features:
    """Feature buckets of blocks, and the score of what stands above them."""

    named: dict[str, int] = field(default_factory=dict)

    def one(self, name: str) -> int:
        if name not in self.named:
            if len(self.named) > 100_000:
                self.named.clear()
            self.named[name] = _bucket(name)
        return self.named[name]

    def own(self, b: Block, place: int, count: int) -> list[int]:
        n = len(b.text)
        names = [f"leaf={b.above.leaf if b.above else 'none'}", f"len={min(n.bit_length(), 10)}", f"link={min(4, 4 * b.linked // n)}", f"place={4 * place // count}",
                 f"end={b.text[-1] if b.text[-1] in '.!?:;,' else 'x'}", f"stops={min(3, b.text.count('. ') + b.text.count(', '))}"]
        if "©" in b.text:
            names.append("copyright")
        return [self.one(x) for x in names]

    def block(self, b: Block, place: int, count: int) -> list[int]:
        return [*[self.one(x) for x in (b.above.names() if b.above else [])], *self.own(b, place, count)]

    def above(self, weight: list[float], node: Above | None) -> float:
        """The weights of all elements above a block; each element is scored once per page."""
        unknown = []
        while node and node.score is None:
            unknown.append(node)
            node = node.outer
        score = node.score if node else 0.0
        for node in reversed(unknown):
            score += sum(weight[self.one(x)] for x in node.new)
            node.score = score
        return score

    def scores(self, weight: list[float], blocks: list[Block]) -> list[float]:
        return [self.above(weight, b.above) + sum(weight[x] for x in self.own(b, i, len(blocks))) for i, b in enumerate(blocks)]


@dataclass
class Field:
    """Scores of label 1 against 0: weight per feature bucket, and log potentials of neighbours [from][to] and of the first."""

    weight: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def __post_init__(self) -> None:
        self.weights = self.weight.tolist()

    def viterbi(self, scores: list[float]) -> list[int]:
        (a00, a01), (a10, a11) = self.step.tolist()
        best0, best1 = float(self.first[0]), float(self.first[1]) + scores[0]
        back: list[tuple[int, int]] = []
        for s in scores[1:]:
            from0, from1 = (0, best0 + a00), (0, best0 + a01)
            if best1 + a10 > from0[1]:
                from0 = (1, best1 + a10)
            if best1 + a11 > from1[1]:
                from1 = (1, best1 + a11)
            back.append((from0[0], from1[0]))
            best0, best1 = from0[1], from1[1] + s
        label = int(best1 > best0)
        labels = [label]
        for b in reversed(back):
            label = b[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS) -> Field:
    """Maximum conditional likelihood with a quadratic penalty, by Adam over all pages: forward and backward sums of all
    chains run side by side, padded to the longest."""
    features = Features()
    n, longest = len(pages), max(len(b) for b, _ in pages)
    rows, cols = [], []
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        mask[p, : len(blocks)] = True
        gold[p, : len(labels)] = labels
        for i, b in enumerate(blocks):
            found = features.block(b, i, len(blocks))
            rows += [p * longest + i] * len(found)
            cols += found
    rows_, cols_ = np.array(rows), np.array(cols)
    size = BUCKETS + 6
    theta, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    observed = np.bincount(cols_, weights=gold.reshape(-1)[rows_], minlength=BUCKETS)
    pair = np.zeros((2, 2))
    for i in range(longest - 1):
        np.add.at(pair, (gold[:, i][mask[:, i + 1]], gold[:, i + 1][mask[:, i + 1]]), 1)
    observed = np.concatenate([observed, pair.reshape(-1), np.bincount(gold[:, 0], minlength=2)])
    for turn in range(1, steps + 1):
        step, first = theta[BUCKETS : BUCKETS + 4].reshape(2, 2), theta[BUCKETS + 4 :]
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(rows_, weights=theta[cols_], minlength=n * longest).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = first + emit[:, 0]
        for i in range(1, longest):
            moved = np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, axis=1) + emit[:, i]
            ahead[:, i] = np.where(mask[:, i, None], moved, ahead[:, i - 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        expected_pair = np.zeros((2, 2))
        for i in range(longest - 2, -1, -1):
            later = emit[:, i + 1] + behind[:, i + 1]
            back = np.logaddexp.reduce(step + later[:, None, :], axis=2)
            behind[:, i] = np.where(mask[:, i + 1, None], back, 0.0)
            joint = np.exp(ahead[:, i, :, None] + step + later[:, None, :] - whole[:, None, None])
            expected_pair += joint[mask[:, i + 1]].sum(0)
        marginal = np.exp(ahead + behind - whole[:, None, None])
        one = np.where(mask, marginal[:, :, 1], 0.0)
        expected = np.concatenate([np.bincount(cols_, weights=one.reshape(-1)[rows_], minlength=BUCKETS), expected_pair.reshape(-1), marginal[:, 0].sum(0)])
        gradient = (observed - expected) / n - DECAY * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        theta = theta + RATE * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8) * min(1.0, 2.0 * (1 - turn / (steps + 1)))
    return Field(theta[:BUCKETS], theta[BUCKETS : BUCKETS + 4].reshape(2, 2), theta[BUCKETS + 4 :])


def train_on_layouts(count: int = TRAINING_PAGES, seed: int = 0) -> Field:
    pages = []
    for page, main in labelled_pages(count, seed):
        blocks = blocks_of(page)
        pages.append((blocks, [int(b.text in main) for b in blocks]))
    return train(pages)


def main_text(model: Field, features: Features, page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    labels = model.viterbi(features.scores(model.weights, blocks))
    return " ".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without main text, give an empty text.  Very long and very deep pages (any number of
    unclosed elements) are read whole, in time and room that grow with their length.  Repeated rows and null ids are rows like any
    other; further columns are ignored.
    """
    field_ = model or train_on_layouts()
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            texts = [main_text(field_, features, h) for h in batch["html"]]
            out = batch[["page_id", "url"]].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
