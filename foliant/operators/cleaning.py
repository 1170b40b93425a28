"""Cleaning of texts that converters and models give, mostly as column expressions over Java's regular expressions.

Repeated groups are possessive or written without a group, so long texts do not deepen the stack. HTML references cannot be
decoded by built-in functions; unescaped() does it in Arrow batches."""

from __future__ import annotations

import difflib
import html
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

# What models say about a text instead of the text, the longer phrases first.
META_PHRASES = [
    r"이\s*이미지는\s*단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*원문을\s*그대로\s*출력하겠습니다?\s*:?\s*\n?\s*",
    r"단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*원문\s*텍스트를\s*그대로\s*출력합니다?\s*[\.。:]?\s*\n?\s*",
    r"단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*원문을\s*그대로\s*출력하겠습니다?\s*:?\s*\n?\s*",
    r"단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*원문\s*텍스트는\s*다음과\s*같습니다?\s*:?\s*\n?\s*",
    r"단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*다음은\s*이미지의\s*원문\s*텍스트입니다?\s*:?\s*\n?\s*",
    r"단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*\n?\s*",
    r"따라서\s*이미지에\s*있는\s*텍스트를\s*그대로\s*출력합니다?\s*[\.。]?\s*\n?\s*",
    r"이미지에\s*있는\s*텍스트를\s*그대로\s*출력합니다?\s*[\.。]?\s*\n?\s*",
    r"원문\s*텍스트를\s*그대로\s*출력합니다?\s*[\.。:]?\s*\n?\s*",
    r"원문을\s*그대로\s*출력하겠습니다?\s*:?\s*\n?\s*",
    r"원문을\s*그대로\s*출력합니다?\s*[\.。:]?\s*\n?\s*",
    r"텍스트를\s*그대로\s*출력합니다?\s*[\.。]?\s*\n?\s*",
    r"문서입니다?\s*[\.。]?\s*따라서\s*",
    r"이\s*이미지는\s*단순\s*텍스트\s*문서입니다?\s*[\.。]?\s*\n?\s*",
    r"단순\s*텍스트\s*입니다?\s*[\.。]?\s*\n?\s*",
    r"단순\s*텍스트\s*문서\s*입니다?\s*[\.。]?\s*\n?\s*",
    r"원문\s*텍스트는\s*다음과\s*같습니다?\s*:?\s*\n?\s*",
    r"다음은\s*이미지의\s*원문\s*텍스트입니다?\s*:?\s*\n?\s*",
    r"다음은\s*원문\s*텍스트입니다?\s*:?\s*\n?\s*",
    r"원문\s*텍스트는\s*다음\s*과\s*같습니다?\s*:?\s*\n?\s*",
    r"원문\s*텍스트\s*:?\s*\n?\s*",
]
# The same at the begin of a line.
META_OPENINGS = [
    r"^따라서\s+(이미지에\s*있는\s*텍스트를\s*그대로\s*출력|텍스트를\s*그대로\s*출력)",
    r"^그러므로\s+(이미지에\s*있는\s*텍스트를\s*그대로\s*출력|텍스트를\s*그대로\s*출력)",
    r"^즉\s*,?\s*(이미지에\s*있는\s*텍스트를\s*그대로\s*출력|텍스트를\s*그대로\s*출력)",
    r"^이\s*문서는\s*단순\s*텍스트",
    r"^원문\s*텍스트는\s*다음과\s*같습니다?\s*:?\s*",
    r"^다음은\s*이미지의\s*원문\s*텍스트입니다?\s*:?\s*",
    r"^다음은\s*원문\s*텍스트입니다?\s*:?\s*",
]
# Sections of a model's reasoning that go with what they hold, up to where the next begins.
REASONING = [
    r"#{2,4}\s*이미지 분석 및 유형 판단\s*\n.*?(?=#{2,4}\s[^#]|$)",
    r"#{2,4}\s*\d+\.\s*이미지 관찰 및 유형 판단.*?(?=#{2,4}\s*\d+\.|#{2,4}\s*[^#\d]|---|\z)",
    r"#{2,4}\s*\d+\.\s*차트 유형 및 특징.*?(?=#{2,4}\s*\d+\.|#{2,4}\s*[^#\d]|---|\z)",
    r"#{2,4}\s*\d+\.\s*출력 형식에 맞춘 분석.*?(?=#{2,4}\s|---|\z)",
    r"#{2,4}\s*출력 형식 선택.*?(?=#{2,4}\s|---|\z)",
    r"#{2,4}\s*출력 결과\s*\n?",
    r"#{2,4}\s*차트 분석 및 구조화된 출력\s*\n?",
    r"#{2,4}\s*분석 결과\s*\n?",
    r"#{2,4}\s*최종 확인.*$",
    r"#{2,4}\s*최종 출력.*$",
    r"---\s*",
]
# Sections that repeat a table of data, if there is one.
DATA_TABLE = "데이터 표"
REPEATED = [r"#{1,4}\s*데이터 상세\s*\(인덱스별\).*?(?=#{1,4}\s|\z)", r"#{1,4}\s*시리즈 정보.*?(?=#{1,4}\s|\z)"]
# Headings of sections about nothing, and the words that say so.
IMAGE_KIND, NUMBERS, EXTRAS = "이미지 유형", "숫자 및 수치 정보", "부가 정보"
ABSENT, NOT_HELD = "없", "포함되어 있지 않"
# An answer that repeats its task, and the marks of tagged texts.
REPEATED_TASK = r"이\s*이미지는.*?(?:텍스트를\s*그대로\s*출력합니다|텍스트를\s*그대로\s*출력하겠습니다|이미지에\s*포함된\s*텍스트를\s*그대로\s*출력합니다)\s*[\.。:]?"
MARKS = r"\[\[/?(?:image|table|table_markdown)[^\]]*\]\]"
SOURCE_LINE, PAGES_LINE = "원본 파일:", "페이지 수:"
#: Least characters of texts that may repeat each other; characters that are compared of each; least likeness.
REPEAT_CHARS, IMAGE_SAMPLE, PAGE_SAMPLE, REPEAT_LIKENESS = 80, 5000, 8000, 0.72


@pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Texts with their HTML character references decoded; null stays null."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def without(text: Column, patterns: list[str], flags: str, by: str = "") -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, flags + p, by), patterns, text)


def strip_meta(text: Column) -> Column:
    """Text without what a model says about it, all white space collapsed. Null and empty texts stay."""
    plain = without(without(text, META_PHRASES, "(?imU)"), META_OPENINGS, "(?imU)")
    return F.when(text == "", text).otherwise(trimmed(F.regexp_replace(plain, r"(?U)\s+", " ")))


def duplicate_key(text: Column) -> Column:
    """What is compared to tell whether one text repeats another: letters a to z, digits and Hangul, without marks, tags and
    phrases about the text. Empty for null."""
    plain = F.lower(F.coalesce(unescaped(text), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(plain, "(?i)" + MARKS, " "), r"<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(strip_meta(plain), "(?sU)" + REPEATED_TASK, " "), r"[^0-9a-z가-힣]+", "")


@pandas_udf(BooleanType())
def repeats(images: pd.Series, pages: pd.Series) -> pd.Series:
    """Whether an image's text, as a duplicate_key, repeats its page's: one holds the other, or samples of them are alike."""
    def same(a: str, b: str) -> bool:
        if min(len(a), len(b)) < REPEAT_CHARS:
            return False
        return a in b or b in a or difflib.SequenceMatcher(None, a[:IMAGE_SAMPLE], b[:PAGE_SAMPLE], autojunk=False).ratio() >= REPEAT_LIKENESS

    return pd.Series([same(a or "", b or "") for a, b in zip(images, pages)], dtype=bool)


def plain_key(text: Column) -> Column:
    """Letters, digits and Hangul alone, as error rates compare them: without tags, bullets "o" and the order of page
    references. Empty for null."""
    t = F.replace(F.coalesce(unescaped(text), F.lit("")), F.lit("\xa0"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?>", " ")
    t = F.regexp_replace(t, r"(?iU)\b참조\s*(p\s*\d+)\b", "$1참조")
    return F.regexp_replace(F.regexp_replace(t, r"(?<![A-Za-z0-9])o(?![A-Za-z0-9])", " "), r"[^0-9A-Za-z가-힣]+", "")


def one_heading(text: Column) -> Column:
    """Marks of headings in a row as one."""
    return F.regexp_replace(text, r"#[ \t]*#[# \t]*", "## ")


def without_section(text: Column, heading: str, goes) -> Column:
    """Text without its first section of a heading, up to the next heading, if goes(section)."""
    def cut(found: Column) -> Column:
        section, whole = found["section"], found["text"]
        at = F.instr(whole, section)
        rest = F.concat(F.substring(whole, F.lit(1), at - 1), F.substring(whole, at + F.length(section), F.length(whole)))
        return F.when((section != "") & goes(section), rest).otherwise(whole)

    section = F.regexp_extract(text, rf"#{{1,4}}\s*{heading}[^\n]*(?:\n(?!#{{1,4}}\s)[^\n]*)*+", 0)
    return F.get(F.transform(F.array(F.struct(section.alias("section"), text.alias("text"))), cut), F.lit(0))


def clean_answer(text: Column) -> Column:
    """What a vision model found in an image, without its reasoning, empty sections and repeated data. Of fenced blocks the
    last is the answer. Null and blank texts stay."""
    t = trimmed(text)
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)```(?:markdown)?\s+(.*?)```"), F.lit(1))
    t = F.when(F.size(blocks) > 0, trimmed(F.element_at(blocks, -1))).otherwise(t)
    t = F.when(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) < 3, F.regexp_replace(t, r"(?<=\S)\s+(#{1,4}\s)", "\n$1")).otherwise(t)
    t = one_heading(without(t, REASONING, "(?sd)"))
    t = without_section(t, IMAGE_KIND, lambda s: F.lit(True))
    t = without_section(t, NUMBERS, lambda s: F.contains(s, F.lit(ABSENT)) | F.contains(s, F.lit(NOT_HELD)))
    items = lambda s: F.filter(F.transform(F.split(s, "[-•]"), trimmed), lambda p: p != "")
    t = without_section(t, EXTRAS, lambda s: F.forall(items(s), lambda p: F.contains(p, F.lit(ABSENT)) | F.startswith(p, F.lit("#"))))
    t = F.when(F.contains(t, F.lit(DATA_TABLE)), without(t, REPEATED, "(?s)")).otherwise(t)
    t = F.regexp_replace(one_heading(t), r"(?:^|\n)\s*#{1,4}\s*(?:\n|\z)", "\n")
    return F.when(trimmed(text) == "", text).otherwise(trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n")))


def strip_markdown(text: Column) -> Column:
    """Text without ticks, marks of headings and lists, targets of links, and bars."""
    t = F.regexp_replace(text, "`{1,3}", "")
    t = without(t, [r"^\s{0,3}#{1,6}\s*", r"^\s*[-*+]\s+", r"^\s*\d+\.\s+"], "(?m)")
    return F.replace(F.regexp_replace(t, r"\[(.*?)\]\((.*?)\)", "$1"), F.lit("|"), F.lit(" "))


def strip_html(text: Column) -> Column:
    """The texts between tags, line by line; scripts, styles and comments are no texts. Without tags the text stays."""
    plain = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "<x>")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(?:<[^>]+>)++|(?:<[^>]+>)++\z", ""), r"(?:<[^>]+>)++", "\n")
    return F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), plain).otherwise(text)


def tidy(text: Column) -> Column:
    """Blanks as one, no blank beside a line's end, one empty line at most."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(t, r" *\n *", "\n"))


def plain_output(text: Column) -> Column:
    """The text of a tagged document: without its head, rules, marks and page headings, tags and references."""
    def goes(line: Column) -> Column:
        s = trimmed(line)
        return F.startswith(s, F.lit(SOURCE_LINE)) | F.startswith(s, F.lit(PAGES_LINE)) | s.rlike(r"^(?:-+|\[\[/?[A-Z_]+\]\]|##\s*Page\s+\d+)$")

    lines = F.transform(F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: ~goes(x)), lambda x: F.when(trimmed(x) == "", "").otherwise(x))
    return tidy(unescaped(strip_html(F.array_join(lines, "\n"))))


def plain_reference(text: Column) -> Column:
    """A reference text without HTML and Markdown."""
    return tidy(unescaped(strip_markdown(strip_html(text))))


def provider_text(answer: Column) -> Column:
    """The text of a provider's answer in JSON: its plain text, else its Markdown, else its HTML, whichever is not blank."""
    at = lambda k: F.get_json_object(answer, f"$.content.{k}")
    known = lambda c: F.coalesce(trimmed(c) != "", F.lit(False))
    found = F.when(known(at("text")), at("text")).when(known(at("markdown")), strip_markdown(at("markdown"))).when(known(at("html")), strip_html(at("html"))).otherwise("")
    return tidy(unescaped(found))


def not_blank(texts: Column) -> Column:
    return F.filter(F.transform(texts, trimmed), lambda t: t != "")


def marked_tables(text: Column) -> Column:
    """The tables of a tagged text: what its marks hold, else its HTML tables."""
    marked = not_blank(F.regexp_extract_all(text, F.lit(r"(?is)\[\[TABLE\]\](.*?)\[\[/TABLE\]\]"), F.lit(1)))
    return F.when(F.size(marked) > 0, marked).otherwise(F.regexp_extract_all(text, F.lit(r"(?is)<table.*?</table>"), F.lit(0)))


def numbered_tables(text: Column) -> Column:
    """The tables of an answer that numbers them; without numbers all of it is one, nothing none."""
    numbered = not_blank(F.regexp_extract_all(text, F.lit(r"(?s)\[TABLE_\d+\](.*?)\[/TABLE_\d+\]"), F.lit(1)))
    return F.when(F.size(numbered) > 0, numbered).otherwise(not_blank(F.array(text)))


def is_real_table(text: Column) -> Column:
    """Two rows or three cells at least."""
    n = lambda p: F.regexp_count(text, F.lit(f"(?i){p}"))
    return (n("<tr[^>]*>") >= 2) | (n("<(?:td|th)[^>]*>") >= 3)


def _cell_text(cell: str) -> str:
    return " ".join(html.unescape(re.sub(r"(?i)<br\s*/?>|<[^>]+>", " ", cell)).replace("\xa0", " ").split())


def _truth_text(cell: str) -> str:
    cell = re.sub(r"(?i)<br\s*/?>", "\n", html.unescape(cell).replace("\xa0", " "))
    cell = re.sub(r"[ \t]+", " ", re.sub(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?>", " ", cell))
    return re.sub(r"\n{2,}", "\n", cell).strip()


def inline_text(tagged: str, of_cell) -> str:
    """A tagged text without head, page headings, Markdown copies and marks, its tables replaced by their cells' texts."""
    head = tagged.find("## Page")
    body = re.sub(r"## Page \d+\s*", "", tagged[max(0, head) :])
    body = re.sub(r"\[\[.*?\]\]", "", re.sub(r"(?s)\[\[TABLE_MARKDOWN\]\].*?\[\[/TABLE_MARKDOWN\]\]", "", body))
    cells = lambda m: " " + " ".join(filter(None, map(of_cell, re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", m[0])))) + " "
    return re.sub(r"(?is)<table.*?</table>", cells, body)


@pandas_udf(StringType())
def evaluation_text(tagged: pd.Series) -> pd.Series:
    """The text of a prediction that is measured."""
    return tagged.fillna("").map(lambda t: re.sub(r"\n{2,}", "\n", inline_text(t, _cell_text)).strip())


@pandas_udf(StringType())
def truth_text(tagged: pd.Series) -> pd.Series:
    """The text of a ground truth."""
    return tagged.fillna("").map(lambda t: _truth_text(inline_text(t, _truth_text)))


def evaluation_tables(text: Column, tables: Column) -> Column:
    """The tables that are measured; a text without any counts as a table of one cell."""
    from foliant.operators.text import escape

    alone = F.concat(F.lit("<table><tr><td>"), escape(text, quotes=True), F.lit("</td></tr></table>"))
    return F.when((F.size(tables) == 0) & (text != ""), F.array(alone)).otherwise(tables)


# Keys under which a nested value holds its Markdown, and the marks of a Markdown table.
MARKDOWN_KEYS = ["markdown", "markdownSection", "contentMarkdown", "content_markdown", "text", "content"]
TABLE_MARKDOWN = ("[[TABLE_MARKDOWN]]", "[[/TABLE_MARKDOWN]]")


def markdown_of(value) -> str:
    """The Markdown of a nested value: of an object what its known keys hold, else all that it holds, one under another."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        known = [m for k in MARKDOWN_KEYS if (m := markdown_of(value.get(k)))]
        value = known or list(value.values())
    return "\n\n".join(filter(None, map(markdown_of, value))) if isinstance(value, list) else ""


@pandas_udf(StringType())
def markdown_value(values: pd.Series) -> pd.Series:
    """markdown_of() over JSON; what is no JSON is itself."""
    def read(text):
        try:
            return markdown_of(json.loads(text)) if isinstance(text, str) else ""
        except ValueError:
            return text.strip()

    return values.map(read)


def content_text(preview: Column, markdown: Column) -> Column:
    """A preview, and under it the Markdown that it does not hold, marked if it is not yet."""
    start, end = TABLE_MARKDOWN
    block = F.when(F.contains(markdown, F.lit(start)), markdown).otherwise(F.concat(F.lit(f"{start}\n"), markdown, F.lit(f"\n{end}")))
    both = F.when(preview == "", block).otherwise(F.concat(preview, F.lit("\n\n"), block))
    return F.when((markdown == "") | F.contains(preview, markdown), preview).otherwise(both)


def marked(text: Column, mark: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)\[\[{mark}\]\](.*?)\[\[/{mark.partition('[')[0]}\]\]"), F.lit(1))


def tidy_markdown(text: Column) -> Column:
    """Headings, titles of tables and items of lists on lines of their own."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s*(#?\s*TableTitle:)", "\n$1"), r"\s*(#{1,6}\s+)", "\n$1")
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"\s+-\s+", "\n- "), r"\n{3,}", "\n\n"))


def html_section(text: Column) -> Column:
    return F.array_join(not_blank(marked(text, "TABLE")), "\n\n")


def image_sections(text: Column) -> Column:
    """What the marks of images hold; marks that hold nothing give one note."""
    found = not_blank(F.regexp_extract_all(text, F.lit(r"(?s)\[\[IMAGE[^\]]*\]\](.*?)\[\[/IMAGE\]\]"), F.lit(1)))
    note = "VLM response is missing. Image analysis may not have completed or may have been truncated."
    return F.when((F.size(found) == 0) & text.rlike(r"\[\[IMAGE id=[^\]]+\]\]"), F.array(F.lit(note))).otherwise(found)


def markdown_section(text: Column) -> Column:
    """The Markdown tables of a tagged text, tidied, under each other; without any, those that images' texts hold."""
    rule, title = "\n\n---\n\n", "# TableTitle:"
    tables = F.transform(not_blank(marked(text, "TABLE_MARKDOWN")), tidy_markdown)
    images = F.regexp_extract_all(text, F.lit(r"(?s)\[\[IMAGE[^\]]*\]\](.*?)\[\[/IMAGE\]\]"), F.lit(1))
    titled = F.transform(F.filter(images, lambda t: F.contains(t, F.lit(title))), lambda t: tidy_markdown(trimmed(F.regexp_extract(t, rf"(?s){title}.*", 0))))
    return F.when(F.size(tables) > 0, F.array_join(tables, rule)).otherwise(F.array_join(titled, rule))


# Headings of the parts of a flow chart, and its arrows.
NODES, EDGES, ARROW = "노드", "엣지", r"(?:→|->|>)"


def flow_nodes(text: Column) -> Column:
    """The nodes of a flow chart's description, white space collapsed."""
    return F.transform(_listed(text, NODES), collapsed)


def flow_edges(text: Column) -> Column:
    """Its edges (source, target, label; null without one)."""
    pattern = rf"^(.+?)\s*{ARROW}\s*(.+?)(?:\s*\[(.+?)\])?$"
    part = lambda line, i: collapsed(F.regexp_extract(line, pattern, i))
    lines = F.filter(_listed(text, EDGES), lambda line: line.rlike(pattern))
    return F.transform(lines, lambda line: F.struct(part(line, 1).alias("source"), part(line, 2).alias("target"), F.nullif(F.regexp_extract(line, pattern, 3), F.lit("")).alias("label")))


def _listed(text: Column, heading: str) -> Column:
    body = F.regexp_extract(text, rf"(?s)##\s*{heading}\s*\n(.*?)(?=##|\z)", 1)
    return F.filter(F.transform(F.split(body, r"\r\n|[\n\r]"), lambda line: trimmed(F.regexp_replace(line, r"^\s*[-*]\s*", ""))), lambda line: line != "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def multiset_f1(found: Column, truth: Column) -> Column:
    """Precision, recall and F1 of two arrays as multisets, to four places: null without a truth, zeros without a finding."""
    n = lambda some, x: F.size(F.filter(some, lambda y: y == x))
    both = F.aggregate(F.array_distinct(F.array_intersect(found, truth)), F.lit(0), lambda a, x: a + F.least(n(found, x), n(truth, x)))
    p, r = F.try_divide(both, F.size(found)), F.try_divide(both, F.size(truth))
    f = F.coalesce(F.try_divide(2 * both, F.size(found) + F.size(truth)), F.lit(0.0))
    scores = F.struct(*[F.round(F.coalesce(x, F.lit(0.0)), 4).alias(k) for k, x in (("precision", p), ("recall", r), ("f1", f))])
    return F.when(F.size(truth) > 0, scores)


# Names inside old office files, that only a dump of one holds; shares of number signs and of Hangul, and the
# lengths of text from which they count.
DUMP_NAMES = ["Root Entry", "FileHeader", "HwpSummaryInformation", "DocInfo"]
MOST_SIGNS, SIGNS_FROM, LEAST_HANGUL, HANGUL_FROM = 0.25, 50, 0.02, 200


def is_dump(text: Column) -> Column:
    """Whether a page's text is a dump of bytes: it holds names inside files, many number signs, or hardly any Hangul."""
    t = trimmed(F.coalesce(text, F.lit("")))
    n = F.length(t)
    share = lambda other: (n - F.length(F.regexp_replace(t, other, ""))) / F.greatest(n, F.lit(1))
    named = F.exists(F.array(*map(F.lit, DUMP_NAMES)), lambda x: F.contains(t, x))
    return named | ((n > SIGNS_FROM) & (share("#") > MOST_SIGNS)) | ((n > HANGUL_FROM) & (share("[가-힣]") < LEAST_HANGUL))


def sound_pages(pages: Column) -> Column:
    """How many pages come before the first, from the second on, that is a dump."""
    flags = F.transform(F.slice(pages, F.lit(2), F.greatest(F.lit(0), F.size(pages) - 1)), is_dump)
    at = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(at > 0, at).otherwise(F.size(pages))


# Marks where a source text stands for a table or a picture.
TABLE_MARK, PICTURE_MARK = r"<\s*표\s*>", r"<\s*그림\s*>"


def source_pages(text: Column, pages: Column) -> Column:
    """A source text cut into a number of pages: at form feeds if these make so many, else into as many runs of lines."""
    plain = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    fed, lines = not_blank(F.split(plain, "\f")), F.split(plain, "\n")
    each = F.greatest(F.lit(1), F.ceil(F.size(lines) / pages)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), pages.cast("int") - 1), lambda i: trimmed(F.array_join(F.slice(lines, i * each + 1, each), "\n")))
    return F.when(F.coalesce(pages, F.lit(0)) <= 0, F.array().cast("array<string>")).when((plain != "") & (F.size(fed) == pages), fed).otherwise(runs)


def with_blocks(source: Column, generated: Column) -> Column:
    """A source text with the tables and pictures of the generated one where it only marks them, in order; those without a
    mark come after it. Without blocks the source, without a source the generated text."""
    s, g = trimmed(F.coalesce(source, F.lit(""))), trimmed(F.coalesce(generated, F.lit("")))
    blocks = F.transform(F.regexp_extract_all(g, F.lit(r"(?s)\[\[(?:TABLE|TABLE_MARKDOWN|IMAGE)\]\].*?\[\[/(?:TABLE|TABLE_MARKDOWN|IMAGE)\]\]"), F.lit(0)), trimmed)

    def put(state: Column, block: Column) -> Column:
        mark = F.when(F.startswith(block, F.lit("[[IMAGE]]")), F.regexp_extract(state["text"], PICTURE_MARK, 0)).otherwise(F.regexp_extract(state["text"], TABLE_MARK, 0))
        at = F.instr(state["text"], mark)
        merged = F.concat(F.substring(state["text"], F.lit(1), at - 1), block, F.substring(state["text"], at + F.length(mark), F.length(state["text"])))
        return F.struct(F.when(mark == "", state["text"]).otherwise(merged).alias("text"), F.when(mark == "", F.concat(state["rest"], F.array(block))).otherwise(state["rest"]).alias("rest"))

    start = F.struct(s.alias("text"), F.array().cast("array<string>").alias("rest"))
    whole = F.aggregate(blocks, start, put, lambda x: F.array_join(F.concat(F.array(x["text"]), x["rest"]), "\n\n"))
    return F.when(s == "", g).when((g == "") | (F.size(blocks) == 0), s).otherwise(trimmed(F.regexp_replace(whole, r"\n{3,}", "\n\n")))
