"""Text rules as column expressions, and the few that need a fold in Python, as Arrow functions over whole batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Words that ask for all of a document, and answers that mean nothing was found.
EXHAUSTIVE = ["전체", "모든", "모두", "빠짐없이", "전부", "목록", "리스트", "나열", "정리해", "총정리", "각각", "all ", "every", "list ", "entire", "exhaustive", "complete list"]
NOTHING = ["없음", "none", "n/a", "not found"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(child: Column, parent: Column) -> Column:
    """Share of the child's distinct tokens of two letters and more that the parent has; 0 without any."""
    some = F.array_distinct(F.filter(child, lambda t: F.length(t) >= 2))
    return F.when(F.size(some) == 0, 0.0).otherwise(F.size(F.array_intersect(some, parent)) / F.size(some))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    a, b = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2.0 * both / (a + b))


def one_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


# Distances tried before the whole table of a pair is worked out.
BANDS = (16, 64, 256)


def distance(a: Column, b: Column) -> Column:
    """The edit distance, worked out in a band around the diagonal that is widened until it holds the distance, so that
    texts that are nearly alike cost their length, not its square."""
    out = F.levenshtein(a, b)
    for most in reversed(BANDS):
        near = F.levenshtein(a, b, most)  # -1 beyond
        out = F.when(near >= 0, near).otherwise(out)
    return out


def cer(predicted: Column, truth: Column) -> Column:
    """Edits over the truth's length, white space collapsed; null for an empty truth; may be over 1."""
    p, t = one_space(predicted), one_space(truth)
    return F.when(F.length(t) == 0, F.lit(None)).otherwise(distance(p, t) / F.greatest(F.length(t), F.lit(1)))


def cer_plain(predicted: Column, truth: Column) -> Column:
    """As cer without collapsing; of an empty truth 0 for nothing predicted, else 1; six places."""
    return F.when(F.length(truth) == 0, F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)).otherwise(F.round(F.levenshtein(predicted, truth) / F.length(truth), 6))


def escape(text: Column, quotes: bool = False) -> Column:
    text = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else text


def plain(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return one_space(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("int")
    return F.when(minutes > 0, F.format_string("%d min %d s", minutes, (seconds % 60).cast("int"))).otherwise(F.format_string("%d s", seconds.cast("int")))


def asks_for_all(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.exists(F.array(*map(F.lit, EXHAUSTIVE)), lambda m: F.contains(low, m))


def has_content(text: Column) -> Column:
    return ~F.lower(F.btrim(text)).isin(*NOTHING)


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of a text as an array: its units joined while they fit into size, each chunk after the first led by the last
    overlap characters of the one before.

    Units are the trimmed paragraphs; one that is longer than size gives its words instead, joined by spaces, and what
    follows its last word is joined as paragraphs are. Two folds in the JVM: one lays out where chunks begin, one is the
    lead-in. A null text is an empty one and gives no chunks."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), one_trim), lambda p: p != "")
    unit = lambda value, inner, fresh: F.struct(value.alias("text"), inner.alias("inner"), fresh.alias("fresh"))
    words = lambda p: F.transform(F.filter(F.split(p, r"(?U)\s+"), lambda w: w != ""), lambda w, i: unit(w, i > 0, i == 0))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size, words(p)).otherwise(F.array(unit(p, F.lit(False), F.lit(False))))))

    def joined(state: Column, u: Column) -> Column:
        """A word after a word takes a space, anything else a blank line; the first word of a long paragraph begins anew, and
        so does what does not fit."""
        now = state["now"]
        gap = F.when(u["inner"], F.lit(" ")).otherwise(F.lit("\n\n"))
        room = F.length(now) + F.length(u["text"]) + F.length(gap) <= size
        together = (now != "") & room & ~u["fresh"]
        closed = F.when((now == "") | together, state["done"]).otherwise(F.concat(state["done"], F.array(now)))
        return F.struct(closed.alias("done"), F.when(together, F.concat(now, gap, u["text"])).otherwise(u["text"]).alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    plain_chunks = F.aggregate(units, start, joined, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    if not overlap:
        return plain_chunks
    lead = lambda every: F.transform(every, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.get(every, i - 1), F.lit(overlap)), F.lit("\n\n"), c)))
    return F.get(F.transform(F.array(plain_chunks), lead), F.lit(0))


def one_trim(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@pandas_udf(DoubleType())
def nid(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 less the insertions and deletions between the texts over their lengths; 1 for two empty ones."""
    return pd.Series([_nid(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def _nid(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of a (Hyyrö 2004)."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]  # what both begin and end with is common
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        found = row & masks.get(c, 0)
        row = (row + found | row - found) & full
    return start + end + len(a) - row.bit_count()


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio; null beyond 20,000 characters, where it is not asked for."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() if max(len(x or ""), len(y or "")) <= 20_000 else None for x, y in zip(a, b)], dtype=float)
