"""Tables in HTML by whole columns: plain HTML is cut into tags and texts by numpy and Arrow, and what rests on its form is
worked out once for each form.

The form of a table is its tags with its texts replaced by what a function keeps of them, for one that rests on tags alone by
nothing. Rows come out as through the functions of tables.py, which other HTML goes through row by row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

from foliant.operators import tables as tb
from foliant.operators.text import common_subsequence

# Fixed value: how many forms' outcomes are kept at once in a worker, of each function.
KEPT_FORMS = 16_384
LESS, MORE, AND = 60, 62, 38  # < > &


@dataclass
class Cut:
    """Rows as numbers of words: those of row r are codes[begin[r] : begin[r + 1]], a text, a tag, a text and so on, a text
    last. plain tells of which rows that is true."""

    words: list[str]
    codes: np.ndarray
    begin: np.ndarray
    plain: np.ndarray


@lru_cache(1_024)
def _is_plain(tag: str) -> bool:
    return bool(tb._PLAIN_TAG.fullmatch(tag))


def cut(column: pa.Array) -> Cut:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    marks = np.flatnonzero((data == LESS) | (data == MORE))
    opens = data[marks] == LESS
    first = np.searchsorted(marks, at)
    many = np.diff(first)
    row = np.repeat(np.arange(n), many)
    plain = many % 2 == 0
    plain[row[opens != ((np.arange(len(marks)) - first[row]) % 2 == 0)]] = False
    plain[np.searchsorted(at, np.flatnonzero(data == AND), "right") - 1] = False
    starts = np.append(np.insert(marks + ~opens, first[:-1], at[:-1]), at[-1])
    parts = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    words, codes, begin = parts.dictionary.to_pylist(), parts.indices.to_numpy(), first + np.arange(n + 1)
    strange = np.array([w[:1] == "<" and not _is_plain(w) for w in words], bool)
    if strange.any():
        plain[np.searchsorted(begin, np.flatnonzero(strange[codes]), "right") - 1] = False
    return Cut(words, codes, begin, plain)


def plain_rows(*columns: pa.Array) -> tuple[list[Cut], np.ndarray, np.ndarray]:
    """The columns' rows that are plain in all of them, cut, and the numbers of these and of the other rows."""
    cuts = [cut(c) for c in columns]
    plain = np.logical_and.reduce([c.plain for c in cuts])
    rows = np.flatnonzero(plain)
    if len(rows) < len(plain):
        cuts = [cut(c.take(pa.array(rows))) for c in columns]
    return cuts, rows, np.flatnonzero(~plain)


def nothing(text: str) -> str:
    return ""


def forms(c: Cut, keep: Callable[[str], str] = nothing) -> tuple[list[str], np.ndarray]:
    """The different forms of the rows, and the number of the form of each."""
    number: dict[str, int] = {}
    new = np.array([number.setdefault(w if w[:1] == "<" else keep(w), len(number)) for w in c.words], np.int32)
    codes = new[c.codes] if len(new) else c.codes.astype(np.int32)
    keys = pa.Array.from_buffers(pa.large_binary(), len(c.begin) - 1, [None, pa.py_buffer((c.begin * 4).astype(np.int64)), pa.py_buffer(codes)]).dictionary_encode()
    kept = [*number]
    return ["".join([kept[i] for i in np.frombuffer(k, np.int32).tolist()]) for k in keys.dictionary.to_pylist()], keys.indices.to_numpy()


@lru_cache(KEPT_FORMS)
def _outcome(function: Callable, *forms: str):
    return function(*forms)


def by_form(function: Callable, keep: Callable[[str], str] = nothing) -> Callable[..., list]:
    """The function over columns of HTML, whose outcome the rows' forms decide: called once for each form, or once for each
    combination of forms, and not again while that is kept. It should be one of a module, which workers know again."""
    one = lambda htmls: _outcome(function, *htmls) if max(map(len, htmls)) <= tb.KEPT_LENGTH else function(*htmls)

    def over(*columns: pa.Array) -> list:
        cuts, rows, rest = plain_rows(*columns)
        return spread(rows, rest, columns, over_cuts(cuts), function)

    def over_cuts(cuts: list[Cut]) -> list:
        every, which = forms(cuts[0], keep)
        every = [(x,) for x in every]
        for c in cuts[1:]:
            more, again = forms(c, keep)
            pairs, which = np.unique(which.astype(np.int64) * max(len(more), 1) + again, return_inverse=True)
            every = [(*every[p // len(more)], more[p % len(more)]) for p in pairs.tolist()]
        found = [one(x) for x in every]
        return [found[i] for i in which.tolist()]

    over.over_cuts = over_cuts
    return over


def spread(rows: np.ndarray, rest: np.ndarray, columns: tuple[pa.Array, ...], found: list, function: Callable) -> list:
    """What was found for some rows, and what the function says of the rest, in order."""
    if not len(rest):
        return found
    out = [None] * (len(rows) + len(rest))
    for i, x in zip(rows.tolist(), found):
        out[i] = x
    for i in rest.tolist():
        out[i] = function(*(c[i].as_py() or "" for c in columns))
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, in a row."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def udf_of(over: Callable[..., list], kind: str, columns: int = 1):
    """An Arrow function of one that takes columns and gives a list or an array."""
    made = lambda found: found if isinstance(found, (pa.Array, pa.ChunkedArray)) else pa.array(found, _TYPES[kind])
    if columns == 1:
        def single(a: pa.Array) -> pa.Array:
            return made(over(a))

        return arrow_udf(single, kind)

    def double(a: pa.Array, b: pa.Array) -> pa.Array:
        return made(over(a, b))

    return arrow_udf(double, kind)


_TYPES = {"array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "string": pa.string(), "double": pa.float64()}


# What the functions keep of texts.
def blank_or_not(text: str) -> str:
    return "x" if text and not text.isspace() else ""


def rulers_and_bars(text: str) -> str:
    """Texts that could be taken for rulers or hold bars as they are, of others whether they are blank."""
    return text if "|" in text or "-" in text or "\\" in text else blank_or_not(text)


@lru_cache(KEPT_FORMS)
def _single_cells(form: str) -> list[int] | None:
    """The words that are the cells' texts; None if a cell has more than one."""
    cells = tb.heard(tb._Cells, form)[0].cells
    return None if any(len(c) != 1 for c in cells) else [2 * c[0] for c in cells]


def _numbered(c: Cut, found: list[list[int]], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many words its form asks for, and where in the codes these are, in a row."""
    lengths = np.array([len(x) for x in found], np.int64)
    flat = np.array([i for x in found for i in x], np.int64)
    at = ranges((np.cumsum(lengths) - lengths)[which], lengths[which])
    return lengths[which], np.repeat(c.begin[:-1], lengths[which]) + flat[at]


@lru_cache(KEPT_FORMS)
def _shares(both: int, p: int, t: int) -> list[float]:
    return [*tb.shares(both, p, t)]


def cell_accuracy(predicted: pa.Array, truth: pa.Array) -> list[list[float]]:
    """tables.cell_accuracy of each predicted table and true one."""
    single = lambda p, t: [*tb.cell_accuracy([p], [t])]
    cuts, rows, rest = plain_rows(predicted, truth)
    found = [forms(c) for c in cuts]
    cells = [[_single_cells(f) for f in every] for every, _ in found]
    odd = np.logical_or.reduce([np.array([x is None for x in some], bool)[which] for some, (_, which) in zip(cells, found)]) if len(rows) else np.zeros(0, bool)
    number: dict[str, int] = {}
    n, keys, totals = len(rows), [], []
    for c, some, (_, which) in zip(cuts, cells, found):
        text = np.array([number.setdefault(" ".join(w.split()), len(number)) for w in c.words], np.int64)
        many, at = _numbered(c, [x or [] for x in some], which)
        keys.append((np.repeat(np.arange(n), many) << 32) + text[c.codes[at]])
        totals.append(many)
    both = np.zeros(n, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    begins = np.flatnonzero(np.diff(every[order], prepend=-1))
    if len(begins):
        ours = np.add.reduceat((order < len(keys[0])).astype(np.int64), begins)
        all_ = np.diff(begins, append=len(every))
        both = np.bincount(every[order[begins]] >> 32, np.minimum(ours, all_ - ours), minlength=n).astype(np.int64)
    out = [_shares(*x) for x in zip(both.tolist(), totals[0].tolist(), totals[1].tolist())]
    for i in np.flatnonzero(odd).tolist():
        out[i] = single(predicted[int(rows[i])].as_py() or "", truth[int(rows[i])].as_py() or "")
    return spread(rows, rest, (predicted, truth), out, single)


@lru_cache(KEPT_FORMS)
def _template(form: str) -> list[str | int] | None:
    """The Markdown of a form, with the numbers of words where their texts go; None if a cell has more than one text."""
    out, _ = tb.markdown_parts(form)
    return None if any(len(x) != 1 for x in out if type(x) is not str) else [x if type(x) is str else 2 * x[0] for x in out]


def to_markdown(html: pa.Array) -> pa.Array | list[str]:
    """tables.to_markdown of each table."""
    (c,), rows, rest = plain_rows(html)
    every, which = forms(c)
    found = [_template(f) for f in every]
    odd = np.array([x is None for x in found], bool)[which] if len(rows) else np.zeros(0, bool)
    words = [tb.in_bars(" ".join(w.split())) for w in c.words]
    number = {}
    flat = [[x if type(x) is int else -1 - number.setdefault(x, len(number)) for x in y or []] for y in found]
    lengths = np.array([len(x) for x in flat], np.int64)
    asked = np.array([i for x in flat for i in x], np.int64)
    many = lengths[which] if len(rows) else np.zeros(0, np.int64)
    asked = asked[ranges((np.cumsum(lengths) - lengths)[which], many)] if many.sum() else asked[:0]
    here = np.repeat(c.begin[:-1], many)
    texts = asked >= 0
    codes = np.where(texts, 0, len(words) - 1 - asked)
    codes[texts] = c.codes[here[texts] + asked[texts]]
    pieces = pa.array([*words, *number], pa.string()).take(pa.array(codes))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pieces), "")
    if not len(rest) and not odd.any():
        return lines
    out = lines.to_pylist()
    for i in np.flatnonzero(odd).tolist():
        out[i] = tb.to_markdown(html[int(rows[i])].as_py())
    return spread(rows, rest, (html,), out, tb.to_markdown)


def lifting(by_forms: Callable[..., list], whole: Callable[[str, str], float]) -> Callable[..., list]:
    """Scores of structure lifted by the texts' likeness as tables.lifted does, from a function by form that gives the score
    and whether there is something to lift, and the one that does it all for a row. Texts are compared only if their lengths
    let them be alike enough."""
    def over(predicted: pa.Array, truth: pa.Array) -> list[float]:
        cuts, rows, rest = plain_rows(predicted, truth)
        found = by_forms.over_cuts(cuts)
        score = np.array([s for s, _ in found], float)
        keys = [[tb.letters(w) if w[:1] != "<" else "" for w in c.words] for c in cuts]
        a, b = (np.add.reduceat(np.array([len(k) for k in some], np.int64)[c.codes], c.begin[:-1]) if len(rows) else np.zeros(0, np.int64) for some, c in zip(keys, cuts))
        most = np.where(a + b > 0, 2 * np.minimum(a, b) / np.maximum(a + b, 1), 1.0)
        for i in np.flatnonzero(np.array([met for _, met in found], bool) & (score < tb.TEXT_GIVES) & (most >= tb.TEXT_COUNTS) & (most > score)).tolist():
            p, t = ("".join([some[x] for x in c.codes[c.begin[i] : c.begin[i + 1]].tolist()]) for some, c in zip(keys, cuts))
            alike = 2 * common_subsequence(p, t) / (len(p) + len(t)) if p or t else 1.0
            if alike >= tb.TEXT_COUNTS:
                score[i] = max(score[i], min(tb.TEXT_GIVES, alike))
        return spread(rows, rest, (predicted, truth), score.tolist(), whole)

    return over
