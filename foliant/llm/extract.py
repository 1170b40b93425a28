"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks; each is a vector of its hashed tag path, its hashed words and a few sizes.
A bidirectional LSTM in numpy reads the whole sequence and says of every block whether it belongs to the article, so each
decision sees the whole document. The network is trained here, on pages written from layouts whose blocks are known.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only

#: Sizes of the hashed path and word vectors, of the sizes' vector, of the state of one direction.
PATH_DIM, WORD_DIM, SIZE_DIM, HIDDEN = 192, 32, 8, 24
#: Pages written for training, passes over them, pages in a step, rate of learning.
TRAIN_PAGES, EPOCHS, STEP_PAGES, RATE = 700, 6, 35, 0.01
#: Pages that are labelled at once; blocks at once, so that one long page does not pad many.
LABEL_PAGES, LABEL_BLOCKS = 128, 60_000

# Fixed values of HTML: elements without content, with raw content, and those that are part of a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CELLS = frozenset("td th tr".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "td": CELLS, "th": CELLS, "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"])}
# Fixed values of HTML: what an element that closes others does not look beyond.
WITHIN = {"li": frozenset("ul ol table td th".split()), "dt": frozenset("dl table td th".split()), "dd": frozenset("dl table td th".split()), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}
WITHIN_BLOCK = frozenset("table td th caption button object".split())
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    """path: the buckets that the names of all elements around have, a bit each; leaf: the tag of the innermost; depth: how
    many elements are around; linked: characters of the text in links."""

    path: int
    leaf: str
    depth: int
    text: str
    linked: int


class Path:
    """The elements that are open, and the buckets of their names; each is counted, so what a block costs does not grow with
    how deep it is."""

    def __init__(self, elements: tuple[str, ...] = ()):
        self.names: list[str] = []
        self.counts, self.bits = [0] * PATH_DIM, 0
        for name in elements:
            self.push(name)

    def push(self, name: str) -> None:
        self.names.append(name)
        for token in set(name.split(" ")):
            bucket = _hash(token) % PATH_DIM
            self.counts[bucket] += 1
            self.bits |= 1 << bucket

    def pop(self) -> None:
        for token in set(self.names.pop().split(" ")):
            bucket = _hash(token) % PATH_DIM
            self.counts[bucket] -= 1
            if not self.counts[bucket]:
                self.bits ^= 1 << bucket

    def block(self, text: str, linked: int, inside: tuple[str, ...] = ()) -> Block:
        """A block here, within the inline elements named."""
        bits = self.bits
        for name in inside:
            for token in name.split(" "):
                bits |= 1 << _hash(token) % PATH_DIM
        return Block(bits, self.names[-1].split(" ")[0] if self.names else "", len(self.names), text, linked)


class Blocks(HTMLParser):
    """The leaf blocks of a page in order, whatever its markup; character references are decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.path, self.inline, self.open = Path(), [], Counter()
        self.parts: list[str] = []
        self.inside: tuple[str, ...] | None = None
        self.linked, self.raw, self.blocks = 0, 0, []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(self.path.block(text, self.linked, self.inside or ()))
        self.parts, self.linked, self.inside = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and tag not in RAW:
            self.flush()
            self.close_implied(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        said = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role")}
        name = " ".join([tag, *_NAME.findall(" ".join(said.values()))])
        self.stack.append((tag, name))
        self.open[tag] += 1
        if tag in INLINE:
            self.inline.append(name)
        else:
            self.path.push(name)
        self.raw += tag in RAW

    def close_implied(self, tag: str) -> None:
        """Close the elements that this one ends, innermost first, as far as it looks."""
        limits = WITHIN.get(tag, WITHIN_BLOCK)
        closed = [t for t, by in CLOSED_BY.items() if tag in by]
        i = len(self.stack) - 1
        while i >= 0 and any(self.open[t] for t in closed):
            t = self.stack[i][0]
            if t in closed:
                self.pop_to(i)
            elif t in limits:
                return
            i -= 1

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag, _ = self.stack.pop()
            self.open[tag] -= 1
            self.raw -= tag in RAW
            if tag in INLINE:
                self.inline.pop()
            else:
                self.path.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE and tag not in RAW:
            self.flush()
        if self.open[tag]:
            self.pop_to(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)
            if not data.isspace():
                around = tuple(name for name in self.inline if " " in name)
                self.inside = around if self.inside is None else tuple(name for name in self.inside if name in around)
            if self.open["a"]:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


@functools.lru_cache(maxsize=100_000)
def _hash(token: str) -> int:
    return zlib.crc32(token.encode())


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: the buckets of its whole path and of its innermost tag, of all its words, and sizes."""
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + SIZE_DIM), np.float32)
    if not blocks:
        return out
    packed = b"".join((b.path | 1 << _hash(f"<{b.leaf}") % PATH_DIM).to_bytes(PATH_DIM // 8, "little") for b in blocks)
    out[:, :PATH_DIM] = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(len(blocks), -1), axis=1, bitorder="little")
    for row, (at, block) in zip(out, enumerate(blocks)):
        words = block.text.lower().split()
        counts = np.bincount([_hash("w" + w) % WORD_DIM for w in words], minlength=WORD_DIM)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
        n = len(block.text)
        row[PATH_DIM + WORD_DIM :] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, block.linked / n if n else 0.0, sum(c in ".,;:!?" for c in block.text[-3:]) / 3, at / max(1, len(blocks) - 1), "©" in block.text, np.log1p(block.depth) / 3, block.leaf == "h1")
    return out


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, rng: np.random.Generator):
        d, h = PATH_DIM + WORD_DIM + SIZE_DIM, HIDDEN
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {}
        for side in "fb":
            self.p |= {f"x{side}": draw(d, 4 * h), f"h{side}": draw(h, 4 * h), f"c{side}": np.zeros(4 * h, np.float32)}
            self.p[f"c{side}"][h : 2 * h] = 1.0  # remember at first
        self.p |= {"o": draw(2 * h, 1), "oc": np.zeros(1, np.float32)}

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        given = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.p[f"h{side}"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            tanh = np.tanh(new_c)
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[:, t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["oc"], -30, 30)))[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all blocks, by going back through the steps."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(s, x, mask, kept[s]) for s in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["oc"], -30, 30)))
        dz = (p - y[..., None]) * mask[..., None] / mask.sum()
        grads = {"o": np.einsum("nth,nto->ho", both, dz), "oc": dz.sum(axis=(0, 1))}
        d_both = dz @ self.p["o"].T
        for at, s in enumerate("fb"):
            d_out = d_both[..., at * HIDDEN : (at + 1) * HIDDEN]
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            d_given = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            d_h = np.zeros_like(self.p[f"h{s}"])
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[s]):
                dh = dh + d_out[:, t]
                here, dcell = dh * m, dc * m
                dcell = dcell + here * o * (1 - tanh**2)
                d = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), here * tanh * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                d_given[:, t] = d
                d_h += h.T @ d
                dh = d @ self.p[f"h{s}"].T + dh * (1 - m)
                dc = dcell * f + dc * (1 - m)
            flat = d_given.reshape(-1, 4 * HIDDEN)
            grads |= {f"x{s}": x.reshape(-1, x.shape[2]).T @ flat, f"h{s}": d_h, f"c{s}": flat.sum(axis=0)}
        return grads

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks belong to its article; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(LABEL_PAGES, LABEL_BLOCKS // len(pages[order[min(LABEL_PAGES, len(order)) - 1]])))
            some, order = order[:n], order[n:]
            x, mask = padded([features(pages[i]) for i in some])
            for i, p in zip(some, self.probabilities(x, mask)):
                out[i] = p[: len(pages[i])] >= 0.5
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), max(map(len, rows)), rows[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1.0
    return x, mask


# How sites name the parts of their pages.
ARTICLE = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "div class=story", "section class=article", "main class=page", "div role=main", "div class=text", "td class=body"]
AROUND = ["nav", "nav class=menu", "ul class=menu", "div class=navbar", "div id=navigation", "header", "div class=header", "div id=masthead", "footer", "div class=footer", "div id=footer", "aside", "div class=sidebar", "div id=sidebar", "div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "div class=banner", "div class=cookie-notice", "div class=cookie-banner", "div class=notice", "div class=alert", "form", "div class=newsletter", "div class=login", "form class=search", "div class=comments", "section id=comments", "div class=comment", "ol class=commentlist", "div class=related", "div class=share", "div class=social", "div class=breadcrumb", "div class=widget", "div class=popup", "div class=copyright", "div class=tags", "div class=pagination"]
INSIDE = ["div class=ad", "div class=advert", "aside", "div class=related", "div class=notice", "form class=newsletter", "div class=share", "div class=comments", "section class=comments"]


def made_page(rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A page's blocks as the parser would give them, and whether each belongs to the article."""
    pick = lambda some: some[int(rng.integers(len(some)))]
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(26, size=int(rng.integers(2, 9))))
    words = lambda n: [word()] * n if rng.random() < 0.08 else [word() for _ in range(n)]
    sentence = lambda n: (" ".join(words(n)) + pick([".", ".", ".", "", "!", "?"])).capitalize()
    named = lambda spec: " ".join(_NAME.findall(re.sub(r"(class|id|role)=", "", spec)))
    wrapping = lambda n: tuple(named(pick(["div", "div class=wrapper", "div class=container", "div id=page", "section", "div class=row", "div class=col", "div class=inner"])) for _ in range(n))
    wraps = wrapping(int(rng.integers(0, 3)) if rng.random() < 0.75 else int(rng.integers(3, 30)))
    below = wrapping(int(rng.integers(1, 12))) if rng.random() < 0.2 else ()  # between the article, or what is around it, and its blocks
    top, out = ("html", "body"), [(Path(("html", "head", "title")).block(sentence(6), 0), False)]

    def around(path: tuple[str, ...], spec: str) -> None:
        inner = pick([("ul", "li"), ("p",), ("div",), (), ("li",), ("span",), ("h3",), ("ul", "li")])
        for _ in range(int(rng.integers(1, 7)) if inner else 1):
            text = sentence(int(rng.integers(1, 30)) if rng.random() < 0.4 else int(rng.integers(1, 6)))
            if "footer" in spec and rng.random() < 0.6:
                text = "© " + text
            linked = len(text) if rng.random() < (0.85 if "li" in inner else 0.25) else 0
            tag, *said = named(spec).split(" ")
            if said and not inner and rng.random() < 0.3:  # the name on an inline element around the whole text
                out.append((Path((*path, *below, tag)).block(text, linked, (" ".join(["span", *said]),)), False))
            else:
                out.append((Path((*path, named(spec), *below, *inner)).block(text, linked), False))

    for _ in range(int(rng.integers(0, 4))):
        around((*top, *wraps[: int(rng.integers(0, len(wraps) + 1))]), pick(AROUND))
    body = (*top, *wraps, named(pick(ARTICLE)))
    if rng.random() < 0.85:
        out.append((Path((*body, *below, "h1")).block(sentence(int(rng.integers(1, 12))), 0), True))
    for _ in range(int(rng.integers(1, 24))):
        if rng.random() < 0.06:
            around(body, pick(INSIDE))
        inner = pick([("p",)] * 12 + [("h2",), ("h3",), ("ul", "li"), ("blockquote", "p"), ("pre",), (), ("table", "tr", "td"), ("div",), ("section", "p")])
        text = sentence(int(rng.integers(1, 4)) if rng.random() < 0.15 else int(rng.integers(4, 120)))
        linked = int(len(text) * rng.random() * 0.3) if rng.random() < 0.2 else len(text) if rng.random() < 0.02 else 0
        out.append((Path((*body, *below, *inner)).block(text, linked), True))
    for _ in range(int(rng.integers(0, 5))):
        around((*top, *wraps[: int(rng.integers(0, len(wraps) + 1))]), pick(AROUND))
    return out


@functools.cache
def trained(seed: int = 11) -> Labeller:
    """The network after EPOCHS passes over TRAIN_PAGES pages, by Adam."""
    rng = np.random.default_rng(seed)
    net = Labeller(rng)
    pages = [made_page(rng) for _ in range(TRAIN_PAGES)]
    rows = [features([b for b, _ in page]) for page in pages]
    truth = [np.array([y for _, y in page], np.float32) for page in pages]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = sorted(rng.permutation(len(pages)), key=lambda i: len(rows[i]) // 8)
        for at in rng.permutation(range(0, len(order), STEP_PAGES)):
            some = order[at : at + STEP_PAGES]
            x, mask = padded([rows[i] for i in some])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(some):
                y[j, : len(truth[i])] = truth[i]
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_text(pages: list[str | None], net: Labeller) -> list[str]:
    blocks = [blocks_of(h) for h in pages]
    return ["\n\n".join(b.text for b, y in zip(some, keep) if y) for some, keep in zip(blocks, net.label(blocks))]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every row: the blocks of the article, white space as single spaces, joined by two
    line feeds. Null or empty html, or a page without an article, has an empty text of 0 characters. Repeated rows give
    repeated results; null ids and urls stay null; other columns are not read. Nothing is shuffled."""
    bound_batches(pages.sparkSession)
    net = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_text(batch.column(2).to_pylist(), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = only(pages, id_col, url_col, html_col).withColumn(url_col, F.col(f"`{url_col}`").cast("string"))
    out = rows.mapInArrow(read, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
