"""Tables in HTML as grids, and the measures that compare them.

A grid is laid out as browsers do: a cell takes the next free column of its row and holds the rows and columns of its
spans. Functions here are plain Python over one table; udf_of() makes Arrow functions of them for whole columns."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache, wraps
from html import escape
from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliant.operators.text import common_subsequence


@dataclass
class Cell:
    row: int
    col: int
    rowspan: int
    colspan: int
    header: bool
    text: str


@dataclass
class Grid:
    cells: list[Cell] = field(default_factory=list)
    rows: int = 0
    cols: int = 0
    problems: list[str] = field(default_factory=list)


class _Tags(HTMLParser):
    """Calls open(tag, attributes), close(tag) and said(text) of a listener, in document order."""

    def __init__(self, listener):
        super().__init__()
        self.to = listener

    def handle_starttag(self, tag, attrs):
        self.to.open(tag, dict(attrs))

    def handle_endtag(self, tag):
        self.to.close(tag)

    def handle_data(self, data):
        self.to.said(data)


# Tags as most tables have them. HTML of these and of texts without "<" and "&" is plain: it needs no parser, and what a
# listener makes of it depends on its tags alone, but for the texts that go into it.
_PLAIN_TAG = re.compile(r"""(</?(?:table|thead|tbody|tfoot|tr|td|th|p|b|i|div|span)>|<(?:table|thead|tbody|tfoot|tr|td|th|p|b|i|div|span)(?: [a-z]+=(?:[0-9A-Za-z]+|"[^"<>&]*"|'[^'<>&]*'))+>)""")
_ATTRIBUTE = re.compile(r""" ([a-z]+)=(?:([0-9A-Za-z]+)|"([^"]*)"|'([^']*)')""")
# The longest tags of a table whose outcome is kept, and how many are kept at once in a worker.
KEPT_LENGTH, KEPT = 2_000, 4_096


@lru_cache(8)
def _parts(html: str) -> tuple[str, list[str]] | None:
    """The tags of plain HTML in a row, and the texts before, between and after them; None of other HTML."""
    parts = _PLAIN_TAG.split(html)
    texts = parts[::2]
    said = "".join(texts)
    return None if "<" in said or "&" in said else ("".join(parts[1::2]), texts)


@lru_cache(1_024)
def _tag(tag: str) -> tuple[str, dict | None]:
    """The name and attributes of a plain tag; of a closing one None."""
    if tag[1] == "/":
        return tag[2:-1], None
    name, _, rest = tag[1:-1].partition(" ")
    return name, {m[1]: m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(f" {rest}")}


class _Listener:
    """What is made of a table's tags. It gets the numbers of texts, not the texts, so that it does for all tables of the
    same tags."""

    def open(self, tag, attrs): ...

    def close(self, tag): ...

    def said(self, number): ...

    def end(self): ...


def _play(kind: type, tags: str):
    to = kind()
    every = _PLAIN_TAG.findall(tags)
    for i, tag in enumerate(every):
        to.said(i)
        name, attrs = _tag(tag)
        if attrs is None:
            to.close(name)
        else:
            to.open(name, attrs)
    to.said(len(every))
    to.end()
    return to


_kept = lru_cache(KEPT)(_play)


class _Numbered:
    """A listener that gets the number of each text in place of it."""

    def __init__(self, to: _Listener):
        self.open, self.close, self.to, self.texts = to.open, to.close, to, []

    def said(self, text):
        self.to.said(len(self.texts))
        self.texts.append(text)


def heard(kind: type, html: str | None, whole: bool = False) -> tuple:
    """A listener of the kind that has heard some HTML, not to be changed, and the texts by their numbers. If whole, what
    is cut off at the end counts as far as it goes."""
    found = _parts(html or "")
    if found:
        return (_kept if len(found[0]) <= KEPT_LENGTH else _play)(kind, found[0]), found[1]
    to = kind()
    numbered = _Numbered(to)
    reader = _Tags(numbered)
    reader.feed(html or "")
    if whole:
        reader.close()
    to.end()
    return to, numbered.texts


def by_tags(function):
    """A function of HTML whose outcome its tags alone decide, kept for plain HTML of the same tags."""
    kept = lru_cache(KEPT)(function)

    @wraps(function)
    def over(*htmls: str | None):
        tags = []
        for html in htmls:
            found = _parts(html or "")
            if not found or len(found[0]) > KEPT_LENGTH:
                return function(*htmls)
            tags.append(found[0])
        return kept(*tags)

    return over


def one_line(texts: list[str], numbers: list[int]) -> str:
    """Some of the texts joined, white space collapsed."""
    return " ".join((texts[numbers[0]] if len(numbers) == 1 else "".join([texts[i] for i in numbers])).split())


class _Reader(_Listener):
    """The rows of the outermost table; the text of nested ones belongs to the cell around them."""

    def __init__(self):
        self.depth, self.rows, self.cell, self.grid = 0, [], None, None

    def open(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.end()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.end()
            if not self.rows:
                self.rows.append([])
            self.cell = [attrs.get("rowspan"), attrs.get("colspan"), tag == "th", []]

    def close(self, tag):
        if tag == "table":
            if self.depth == 1:
                self.end()
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.end()

    def said(self, number):
        if self.cell is not None:
            self.cell[3].append(number)

    def end(self):
        if self.cell is not None:
            self.rows[-1].append(tuple(self.cell))
            self.cell = None


def span(said: str | None) -> int | None:
    """A span as written; 1 if none is, None if it is no positive number."""
    if said is None:
        return 1
    return int(said) if said.strip().isdigit() and int(said) > 0 else None


def grid_of(html: str | None) -> Grid:
    """The grid of the first table. Spans that are no numbers are problems and count as 1; so are cells over others, rows
    of other widths and row spans past the end."""
    reader, texts = heard(_Reader, html, whole=True)
    if reader.grid is None:
        reader.grid = _laid_out(reader.rows)
    grid = reader.grid
    cells = [Cell(c.row, c.col, c.rowspan, c.colspan, c.header, one_line(texts, c.text)) for c in grid.cells]
    return replace(grid, cells=cells, problems=[*grid.problems])


def _laid_out(rows: list[list[tuple]]) -> Grid:
    """The grid of some rows, with the numbers of its cells' texts."""
    out, taken = Grid(rows=len(rows)), {}
    for r, row in enumerate(rows):
        c = 0
        for said_rows, said_cols, header, text in row:
            while (r, c) in taken:
                c += 1
            rowspan, colspan = span(said_rows), span(said_cols)
            if rowspan is None or colspan is None:
                out.problems.append("parse error")
            rowspan, colspan = rowspan or 1, colspan or 1
            if r + rowspan > out.rows:
                out.problems.append("rowspan past the end")
            for i in range(r, min(out.rows, r + rowspan)):
                for j in range(c, c + colspan):
                    if (i, j) in taken:
                        out.problems.append("cells overlap")
                    taken[i, j] = len(out.cells)
            out.cells.append(Cell(r, c, rowspan, colspan, header, text))
            c += colspan
    widths = Counter(r for r, _ in taken)
    out.cols = max((c for _, c in taken), default=-1) + 1
    if any(widths[r] != out.cols for r in range(out.rows)):
        out.problems.append("rows of different widths")
    if not out.cells:
        out.problems.append("no cells")
    return out


def f1(a: Counter, b: Counter) -> float:
    """Of two multisets: 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(not a and not b)
    return 2 * (a & b).total() / (a.total() + b.total())


def like(a: int, b: int) -> float:
    return 1.0 if a == b else min(a, b) / max(a, b)


# Fixed values of the measures: parts of the match score, the likeness of texts from which it counts, and the most that it
# gives; the elements whose tags are tokens.
MATCH_PARTS = {"size": 0.15, "cells": 0.45, "places": 0.30, "heads": 0.10}
TEXT_COUNTS, TEXT_GIVES = 0.85, 0.92
TOKEN_TAGS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th")
_FENCE = re.compile(r"```(?:html)?", re.IGNORECASE)


class _Places(_Listener):
    """The cells of the outer table's rows that are closed, by where they stand, and the places that they hold; a bad span
    counts as 1, and a span may reach past the last row."""

    def __init__(self):
        self.depth, self.row, self.closed = 0, None, []

    def end(self):
        self.cells, self.heads, taken = set(), set(), set()
        for r, row in enumerate(self.closed):
            c = 0
            for head, down, right in row:
                while (r, c) in taken:
                    c += 1
                held = {(i, j) for i in range(r, r + down) for j in range(c, c + right)}
                self.cells.add((r, c, down, right, head))
                taken |= held
                if head:
                    self.heads |= held
                c += right
        self.taken = taken
        self.size = tuple(max((x[k] for x in taken), default=-1) + 1 for k in (0, 1))

    def open(self, tag, attrs):
        self.depth += tag == "table"
        if self.depth == 1 and tag == "tr":
            self.row = []
        elif self.depth == 1 and tag in ("td", "th") and self.row is not None:
            self.row.append((tag == "th", *(span(attrs.get(k)) or 1 for k in ("rowspan", "colspan"))))

    def close(self, tag):
        if tag == "table":
            self.depth -= 1
        elif self.depth == 1 and tag == "tr" and self.row is not None:
            self.closed.append(self.row)
            self.row = None


def plain_key(html: str | None) -> str:
    """The digits, Latin letters and Hangul syllables outside tags."""
    found = _parts(html or "")
    return letters("".join(found[1]) if found else re.sub(r"<[^>]+>", " ", html or ""))


def letters(text: str) -> str:
    return text if text.isascii() and text.isalnum() else re.sub(r"[^0-9A-Za-z가-힣]+", "", text)


def text_likeness(predicted: str, truth: str) -> float:
    """Twice the longest common subsequence of the plain texts over their lengths; 1 for two empty ones."""
    a, b = plain_key(predicted), plain_key(truth)
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def lifted(score: float, predicted: str, truth: str) -> float:
    """A score of structure, lifted to the texts' likeness where that is high."""
    if score >= TEXT_GIVES:
        return score
    alike = text_likeness(predicted, truth)
    return max(score, min(TEXT_GIVES, alike)) if alike >= TEXT_COUNTS else score


def match_score(predicted: str, truth: str) -> float:
    """Likeness of two tables by size, cells, places held and header places, lifted by their texts. Two without rows are
    alike, one without rows is like nothing."""
    score, met = match_of_tags(predicted, truth)
    return lifted(score, predicted, truth) if met else score


def match_of_tags(predicted: str, truth: str) -> tuple[float, bool]:
    """The score without the texts, and whether both tables have rows."""
    return _match(_FENCE.sub("", predicted or ""), _FENCE.sub("", truth or ""))


@by_tags
def _match(predicted: str, truth: str) -> tuple[float, bool]:
    p, t = heard(_Places, predicted)[0], heard(_Places, truth)[0]
    if not p.closed or not t.closed:
        return float(not p.closed and not t.closed), False
    sets = {"cells": (p.cells, t.cells), "places": (p.taken, t.taken), "heads": (p.heads, t.heads)}
    score = MATCH_PARTS["size"] * (like(p.size[0], t.size[0]) + like(p.size[1], t.size[1])) / 2
    score += sum(MATCH_PARTS[k] * f1(Counter(x), Counter(y)) for k, (x, y) in sets.items())
    return score, True


class _Cells(_Listener):
    """The texts' numbers of all cells, whatever table they are in; a cell inside a cell ends the outer one's text."""

    def __init__(self):
        self.now, self.cells = None, []

    def open(self, tag, attrs):
        if tag in ("td", "th"):
            self.now = []

    def close(self, tag):
        if tag in ("td", "th") and self.now is not None:
            self.cells.append(self.now)
            self.now = None

    def said(self, number):
        if self.now is not None:
            self.now.append(number)


def cell_texts(html: str | None) -> list[str]:
    found, texts = heard(_Cells, html)
    return [one_line(texts, numbers) for numbers in found.cells]


def cell_accuracy(predicted: list[str], truth: list[str]) -> tuple[float, float, float]:
    """Precision, recall and F1 of the cells' texts of all tables as multisets, to four places; zeros without cells."""
    p, t = (Counter(text for html in some for text in cell_texts(html)) for some in (predicted, truth))
    return shares((p & t).total(), p.total(), t.total())


def shares(both: int, p: int, t: int) -> tuple[float, float, float]:
    """Precision, recall and F1 to four places; zeros if either has none."""
    return tuple(round(x, 4) for x in (both / p, both / t, 2 * both / (p + t))) if p and t else (0.0, 0.0, 0.0)


class _Tokens(_Listener):
    """Tags of tables as tokens, with the spans of cells as written, and the numbers of the texts inside cells."""

    def __init__(self):
        self.depth, self.out = 0, []

    def open(self, tag, attrs):
        if tag in ("td", "th"):
            self.depth += 1
            self.out.append((tag, attrs.get("rowspan", "1"), attrs.get("colspan", "1")))
        elif tag in TOKEN_TAGS:
            self.out.append(f"<{tag}")

    def close(self, tag):
        if tag in TOKEN_TAGS:
            self.depth -= tag in ("td", "th") and self.depth > 0
            self.out.append(f"</{tag}")

    def said(self, number):
        if self.depth:
            self.out.append(number)


def table_tokens(html: str | None, texts: bool) -> list:
    """Tokens of tags and, if asked for, of texts, which begin with "=" as no tag's token does."""
    found, said = heard(_Tokens, html)
    if not texts:
        return [x for x in found.out if type(x) is not int]
    out = [f"={' '.join(said[x].split())}" if type(x) is int else x for x in found.out]
    return [x for x in out if x != "="]


def unlike(a, b) -> tuple:
    """Two sequences without what they begin and end with alike, which no distance between them rests on."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start : len(a) - end], b[start : len(b) - end]


def edits(a: list, b: list) -> int:
    """The edit distance of two sequences, a bit for each item of a (Hyyrö 2003)."""
    a, b = unlike(a, b)
    if not a or not b:
        return len(a) or len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for y in b:
        same = masks.get(y, 0)
        zero = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(zero | up) & full, up & zero
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(zero | more) & full, more & zero
    return distance


def teds(predicted: str, truth: str, texts: bool = True) -> float:
    """1 less the edit distance of the tables' tokens over the longer; with texts at least their likeness, without lifted by
    it. Two without tokens are alike, one without is like nothing."""
    if not texts:
        score, met = teds_of_tags(predicted, truth)
        return lifted(score, predicted, truth) if met else score
    p, t = table_tokens(predicted, True), table_tokens(truth, True)
    if not p or not t:
        return float(not p and not t)
    score = 1 - edits(p, t) / max(len(p), len(t))
    return max(score, text_likeness(predicted, truth)) if score < 1 else score


@by_tags
def teds_of_tags(predicted: str, truth: str) -> tuple[float, bool]:
    """The score without the texts, and whether both tables have tokens."""
    p, t = table_tokens(predicted, False), table_tokens(truth, False)
    if not p or not t:
        return float(not p and not t), False
    return 1 - edits(p, t) / max(len(p), len(t)), True


def over_tables(score, predicted: list[str], truth: list[str]) -> float | None:
    """The mean score of the tables of a document, paired in order; missing ones are empty. If there is one true table, all
    predicted ones are its parts. None without true tables, 0 without predicted ones."""
    if not truth:
        return None
    if not predicted:
        return 0.0
    if len(truth) == 1:
        predicted = ["\n".join(predicted)]
    return sum(score(p, t) for p, t in zip_longest(predicted, truth, fillvalue="")) / max(len(predicted), len(truth))


class _Rows(_Listener):
    """The spans of the cells of all rows that are closed, as written."""

    def __init__(self):
        self.row, self.closed = None, []

    def open(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append((int(attrs.get("rowspan", 1)), int(attrs.get("colspan", 1))))

    def close(self, tag):
        if tag == "tr" and self.row is not None:
            self.closed.append(self.row)
            self.row = None


@by_tags
def grid_fault(html: str | None) -> str:
    """Why a table is no sound grid, empty if it is: spans are numbers, there are rows, no place is held twice, and all rows
    hold equally many places."""
    try:
        rows = heard(_Rows, html)[0].closed
    except (TypeError, ValueError):
        return "spans are no numbers"
    if not rows:
        return "no rows"
    taken: set[tuple[int, int]] = set()
    for r, row in enumerate(rows):
        c = 0
        for down, right in row:
            while (r, c) in taken:
                c += 1
            held = {(i, j) for i in range(r, r + down) for j in range(c, c + right)}
            if taken & held:
                return "cells overlap"
            taken |= held
            c += right
    widths = Counter(r for r, _ in taken)
    return "rows of different widths" if len({widths[r] for r in range(len(rows))}) > 1 else ""


def places(html: str | None) -> _Places:
    return heard(_Places, _FENCE.sub("", html or ""))[0]


def held_and_cells(html: str | None) -> list[int]:
    """How many places a table's cells hold, and how many cells there are."""
    found = places(html)
    return [len(found.taken), len(found.cells)]


def validation(faults: DataFrame, fault: str) -> DataFrame:
    """Tables, sound ones, others, the share of sound ones to four places, and how many tables have each fault."""
    every = F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "n"))))
    counts = faults.groupBy(F.col(fault).alias("f")).agg(F.count("*").alias("n"))
    of = F.col("f") == ""
    total = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias("valid"), F.map_filter(every, lambda k, v: k != "").alias("faults"))
    return total.select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), F.round(F.try_divide("valid", "total"), 4).alias("score"), "faults")


@by_tags
def diagnostics(html: str | None) -> list[int]:
    """Rows, columns, rows that do not hold a place in every column, and cells that span past the last row. Bad spans are 1;
    every row and cell counts, closed or not."""
    grid = grid_of(html)
    held: dict[int, set[int]] = {}
    for c in grid.cells:
        for r in range(c.row, c.row + c.rowspan):
            held.setdefault(r, set()).update(range(c.col, c.col + c.colspan))
    cols = max((j for some in held.values() for j in some), default=-1) + 1
    return [grid.rows, cols, sum(len(held.get(r, ())) != cols for r in range(grid.rows)) if cols else 0, sum(c.row + c.rowspan > grid.rows for c in grid.cells)]


_BAR, _RULE = re.compile(r"(?<!\\)\|"), re.compile(r"\s*:?-+:?\s*")


def markdown_grid(text: str) -> tuple[int, int]:
    """Rows, the ruler aside, and columns of a Markdown table; escaped bars are text."""
    rows = [_BAR.split(line.strip().strip("|")) if "\\" in line else line.strip().strip("|").split("|") for line in text.splitlines() if "|" in line]
    rows = [r for r in rows if "-" not in r[0] or not all(_RULE.fullmatch(c) for c in r)]
    return len(rows), max(map(len, rows), default=0)


class _Analysis(_Listener):
    """The rows of the first table and all tables in it, each with the cells that are its own."""

    def __init__(self):
        self.depth, self.over, self.open_rows, self.open_cells, self.rows = 0, False, [], [], []

    def open(self, tag, attrs):
        if self.over:
            return
        self.depth += tag == "table"
        if self.depth and tag == "tr":
            self.rows.append([])
            self.open_rows.append(self.rows[-1])
        elif self.open_rows and tag in ("td", "th"):
            cell = [tag == "th", max(1, int(attrs.get("rowspan") or 1)), max(1, int(attrs.get("colspan") or 1)), []]
            self.open_rows[-1].append(cell)
            self.open_cells.append(cell)

    def close(self, tag):
        if tag == "table":
            self.depth -= 1
            self.over = self.over or self.depth == 0
        elif tag == "tr" and self.open_rows:
            self.open_rows.pop()
        elif tag in ("td", "th") and self.open_cells:
            self.open_cells.pop()

    def said(self, number):
        for cell in self.open_cells:
            cell[3].append(number)


def analyze(html: str | None) -> dict:
    """rows, cols, header_rows, cells, header_text, errors and valid of the first table. Texts are laid over the places
    their cells span; a place that has a text and gets another is an error, and so is a row span that ends more than one
    row past the last."""
    out = {"rows": 0, "cols": 0, "header_rows": 0, "cells": 0, "header_text": "", "errors": [], "valid": False}
    try:
        found, texts = heard(_Analysis, html)
    except ValueError:
        return out | {"errors": ["spans are no numbers"]}
    if not found.depth and not found.over:
        return out | {"errors": ["no table"]}
    grid: dict[tuple[int, int], str] = {}
    from_above: dict[int, list[int]] = {}
    for r, row in enumerate(found.rows):
        out["header_rows"] += bool(row) and all(head for head, *_ in row)
        c = max(from_above.get(r, [-1])) + 1
        for _, down, right, parts in row:
            while grid.get((r, c)):
                c += 1
            text = " ".join(" ".join(texts[x] for x in parts).split())
            out["cells"] += 1
            for j in range(c, c + right):
                if grid.get((r, j)):
                    out["errors"].append(f"row {r + 1}, column {j + 1} twice")
                for i in range(r, r + down):
                    grid[i, j] = text
                    if i > r:
                        from_above.setdefault(i, []).append(j)
            c += right
    past = max((i for i, _ in grid), default=-1) - len(found.rows)
    if past > 0:
        out["errors"].append("a row span ends past the last row")
    out["rows"] = len(found.rows) + max(0, past)
    out["cols"] = max((j for i, j in grid if i != len(found.rows) or past > 0), default=-1) + 1
    top = range(out["header_rows"] or 1)
    out["header_text"] = " | ".join(t for i in top for j in range(out["cols"]) if (t := grid.get((i, j), "")))
    out["valid"] = bool(out["rows"] and out["cols"] and not out["errors"])
    return out


@lru_cache(KEPT)
def _sizes(html: str) -> dict:
    found = analyze(html)
    return {k: found[k] for k in ("rows", "cols", "header_rows", "cells", "valid")}


def sizes(html: str | None) -> dict:
    """rows, cols, header_rows, cells and valid as analyze gives them. They rest on the tags, and on which texts are blank."""
    found = _parts(html or "")
    if not found or len(found[0]) > KEPT_LENGTH:
        return analyze(html)
    bodies = ["x" if text and not text.isspace() else "" for text in found[1]]
    return _sizes("".join([x for pair in zip(bodies, [*_PLAIN_TAG.findall(found[0]), ""]) for x in pair]))


def size_facts(html: str | None) -> list[int]:
    found = sizes(html)
    return [found["rows"], found["cols"], found["cells"], int(found["valid"])]


def in_bars(text: str) -> str:
    return text.replace("|", "\\|")


def to_markdown(html: str) -> str:
    """The grid as a Markdown table; spanned places are empty, bars in texts are escaped."""
    parts, texts = markdown_parts(html)
    return "".join([x if type(x) is str else in_bars(one_line(texts, x)) for x in parts])


def markdown_parts(html: str) -> tuple[list[str | list[int]], list[str]]:
    """The Markdown of a table, with the numbers of cells' texts in place of them, and the texts by their numbers."""
    reader, texts = heard(_Reader, html, whole=True)
    g = reader.grid = reader.grid or _laid_out(reader.rows)
    rows = [[""] * g.cols for _ in range(g.rows)]
    for c in g.cells:
        rows[c.row][c.col] = c.text
    lines = [[x for i, text in enumerate(r) for x in (" | " if i else "| ", text)] + [" |" if r else "|  |"] for r in rows]
    lines.insert(1, ["|" + " --- |" * g.cols])
    return [x for i, line in enumerate(lines) for x in ("\n" if i else "", *line)] if rows else [], texts


def markdown_size(html: str) -> list[int]:
    """Rows and columns of the Markdown that is made of a table."""
    return [*markdown_grid(to_markdown(html))]


def to_html(rows: list[list[str]], header: bool = True) -> str:
    """A grid of texts as HTML; trailing empty rows and columns are left out."""
    while rows and not any(rows[-1]):
        rows = rows[:-1]
    wide = max((i + 1 for r in rows for i, t in enumerate(r) if t), default=0)
    line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{escape(t, quote=False)}</{tag}>" for t in [*r, *[""] * wide][:wide]) + "</tr>"
    return "<table>" + "".join(line(r, "th" if header and i == 0 else "td") for i, r in enumerate(rows)) + "</table>"


class _Bare(_Listener):
    """The first table's HTML without attributes but spans, and the texts of its rows' own cells."""

    def __init__(self):
        self.depth, self.over, self.out, self.rows, self.open_rows, self.cells = 0, False, [], [], [], []

    def open(self, tag, attrs):
        self.depth += tag == "table" and not self.over
        if not self.depth or self.over:
            return
        spans = "".join(f' {k}="{attrs[k]}"' for k in ("rowspan", "colspan") if k in attrs)
        self.out.append(f"<{tag}{spans}>")
        if tag == "tr":
            self.rows.append([])
            self.open_rows.append(self.rows[-1])
        elif tag in ("td", "th") and self.open_rows:
            self.cells.append([])
            self.open_rows[-1].append(self.cells[-1])

    def close(self, tag):
        if not self.depth or self.over:
            return
        self.out.append(f"</{tag}>")
        if tag == "tr" and self.open_rows:
            self.open_rows.pop()
        elif tag in ("td", "th") and self.cells:
            self.cells.pop()
        elif tag == "table":
            self.depth -= 1
            self.over = self.depth == 0

    def said(self, number):
        if self.depth and not self.over:
            self.out.append(number)
            for cell in self.cells:
                cell.append(number)


def bare(html: str | None) -> tuple[str, str, str]:
    """The first table without attributes but spans; its rows that have a text as Markdown, and as lines. Empty without one."""
    found, texts = heard(_Bare, html)
    rows = [[" ".join(" ".join([texts[x] for x in cell]).split()) for cell in row] for row in found.rows]
    rows = [row for row in rows if any(row)]
    wide = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(t.replace("|", "\\|") for t in [*row, *[""] * wide][:wide]) + " |" for row in rows]
    ruler = ["| " + " | ".join(["---"] * wide) + " |"] if rows else []
    return "".join([escape(texts[x], quote=False) if type(x) is int else x for x in found.out]), "\n".join([*lines[:1], *ruler, *lines[1:]]), "\n".join(" ".join(row).strip() for row in rows)


def first_balanced(html: str) -> str:
    """The first table with all that is nested in it; empty if it does not end."""
    depth = start = 0
    for m in re.finditer(r"(?i)<(/?)table\b[^>]*>", html):
        if not m[1]:
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                return html[start : m.end()]
    return ""


def merge_continued(first: str, rest: str) -> str:
    """The rows of a table that goes on put under those of the first; a repeated header is dropped, columns are padded."""
    a, b = grid_of(first), grid_of(rest)

    def texts(g: Grid) -> list[list[str]]:
        rows = [[""] * g.cols for _ in range(g.rows)]
        for c in reversed(g.cells):
            rows[c.row][c.col] = c.text
        return rows

    top, more = texts(a), texts(b)
    if top and more and more[0] == top[0]:
        more = more[1:]
    wide = max(a.cols, b.cols)
    return to_html([r + [""] * (wide - len(r)) for r in [*top, *more]], any(c.header for c in a.cells))


def udf_of(function, kind: str):
    """An Arrow function over columns of texts."""

    def over(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*(x if x is not None else "" for x in row)) for row in zip(*columns)])

    over.__annotations__ = {}
    if function.__code__.co_argcount == 1 or kind.startswith("1:"):
        def one(a: pd.Series) -> pd.Series:
            return over(a)

        return pandas_udf(one, kind.removeprefix("1:"))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return over(a, b)

    return pandas_udf(two, kind)
