"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits, cut into k + 1 pieces, has one piece that occurs unchanged. All
pieces of all items are found in one pass over a text (Aho-Corasick); around each hit the whole item is verified by
Myers' bit-parallel edit distance. Texts are compared in lower case with single spaces for white space.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only, stored

#: Characters of an item for each edit that is allowed.
CHARS_PER_EDIT = 12
#: Characters of items whose pieces are searched for at once; bounds the memory of driver and workers.
BLOCK_CHARS = 2_000_000
#: Windows whose distances a matcher keeps, as a passage that many texts share is met again and again.
KEPT_WINDOWS = 20_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 parts of about equal length: (place, part)."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def least_edits(masks: dict[str, int], m: int, text: str, budget: int) -> int | None:
    """The least edit distance of the pattern of m characters to any part of text, None if over budget (Myers 1999).
    Stops when the characters that are left cannot bring the distance down to the budget."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, left = full, 0, m, m, len(text)
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        if score < best:
            best = score
        left -= 1
        if score - left > budget and best > budget:
            return None
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
    return best if best <= budget else None


class Matcher:
    """The items of a block, and all their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items, places = [], {}
        for item_id, text in items:
            text = plain(text)
            if item_id is None or not text:
                continue
            budget = len(text) // chars_per_edit
            for at, part in pieces(text, budget):
                places.setdefault(part, []).append((len(self.items), at))
            self.items.append((item_id, len(text), budget, bit_masks(text)))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places
        self.known: dict[tuple[int, str], int | None] = {}

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, least edits) of the items that occur in the text within their budgets."""
        text, starts = plain(text), set()
        if self.empty:
            return []
        for end, (size, where) in self.automaton.iter(text):
            for item, at in where:
                starts.add((item, end + 1 - size - at))
        found: dict[int, int] = {}
        for item, start in starts:
            item_id, m, budget, masks = self.items[item]
            if start + m + budget <= 0 or start + budget + m > len(text) + 2 * budget:
                continue
            window = (item, text[max(0, start - budget) : start + m + budget])
            if window not in self.known:
                if len(self.known) >= KEPT_WINDOWS:
                    self.known.clear()
                self.known[window] = least_edits(masks, m, window[1], budget)
            edits = self.known[window]
            if edits is not None:
                found[item] = min(edits, found.get(item, edits))
        return sorted((self.items[i][0], edits) for i, edits in found.items())


@functools.lru_cache(maxsize=1)
def matcher(items: tuple[tuple[int, str], ...], chars_per_edit: int) -> Matcher:
    """One matcher for all tasks of a worker that search for the same items."""
    return Matcher(list(items), chars_per_edit)


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items that have an id and a text, in blocks of BLOCK_CHARS characters or one longer item; at least one block. The
    driver reads them partition by partition and holds one block."""
    block: list[tuple[int, str]] = []
    size = made = 0
    rows = benchmark.select(F.col("`item_id`").cast("long").alias("id"), F.col("`text`").cast("string").alias("text"))
    for item_id, text in rows.filter("id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield tuple(block)
            block, size, made = [], 0, made + 1
        block.append((item_id, text))
        size += len(text)
    if block or not made:
        yield tuple(block)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """id, item_id and distance for each text and each benchmark item that occurs in it within an edit for every
    chars_per_edit characters.

    Null or blank texts hold nothing; items without an id or text are in nothing; a row that repeats gives its pairs
    again. Texts are read once for each block of items, which goes to the tasks with their code; nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def found(items: tuple[tuple[int, str], ...]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = matcher(items, chars_per_edit)
            for batch in batches:
                rows = [(i, *hit) for i, text in enumerate(batch.column(1).to_pylist()) for hit in one.find(text)]
                at, ids, edits = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(edits, pa.int32())], ["id", "item_id", "distance"])

        return only(docs, id_col, text_col).mapInArrow(search, f"id {kind}, item_id long, distance int").withColumnRenamed("id", id_col)

    out = None
    for items in item_blocks(benchmark):
        out = found(items) if out is None else stored(out.unionByName(found(items)), "leaks")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item; nothing is shuffled. Of more than one block of items
    each is searched for in what the one before left, stored between."""
    bound_batches(docs.sparkSession)

    def clean(items: tuple[tuple[int, str], ...]):
        @F.arrow_udf("boolean")
        def holds_none(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = matcher(items, chars_per_edit)
            for batch in batches:
                yield pa.array([not one.find(text) for text in batch.to_pylist()], pa.bool_())

        return holds_none(F.col(f"`{text_col}`").cast("string"))

    out = None
    for items in item_blocks(benchmark):
        out = (docs if out is None else stored(out, "cleaned")).filter(clean(items))
    return out
