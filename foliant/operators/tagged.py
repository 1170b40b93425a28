"""The tagged text of a document: a head, pages, and marked tables and images; written from elements and read back as blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
RULE = "-" * 60
SOURCE, PAGES = "원본 파일: ", "페이지 수: "
MARKED = {"table": "TABLE", "image": "IMAGE", "table_markdown": "TABLE_MARKDOWN"}
_BLOCK = re.compile(r"\[\[(TABLE_MARKDOWN|TABLE|IMAGE)\]\]\n?(.*?)\n?\[\[/\1\]\]", re.DOTALL)


def element_text(kind: Column, text: Column) -> Column:
    out = text
    for name, mark in MARKED.items():
        out = F.when(kind == name, F.concat(F.lit(f"[[{mark}]]\n"), text, F.lit(f"\n[[/{mark}]]"))).otherwise(out)
    return out


def documents(elements: DataFrame, doc: str, source: str) -> DataFrame:
    """One text for each document from elements (page, place, kind, text): gathered by page first, then by document, so what
    one task holds is a document, which is what comes out."""
    lines = elements.groupBy(doc, source, "page").agg(F.array_sort(F.collect_list(F.struct("place", element_text(F.col("kind"), F.col("text")).alias("t")))).alias("x"))
    page = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.array_join(F.transform("x", lambda e: e["t"]), "\n\n"))
    whole = lines.groupBy(doc, source).agg(F.array_sort(F.collect_list(F.struct("page", page.alias("t")))).alias("p"))
    head = F.concat(F.lit(SOURCE), F.col(source), F.lit(f"\n{PAGES}"), F.size("p").cast("string"), F.lit(f"\n{RULE}\n\n"))
    return whole.select(doc, F.concat(head, F.array_join(F.transform("p", lambda e: e["t"]), "\n\n")).alias("text"))


def blocks(text: str) -> list[tuple[str, str]]:
    """Kind and text of the blocks in order: headings, paragraphs, lists, tables and images; Markdown copies of tables and
    the head are hidden."""
    text = re.sub(rf"\A원본 파일(?: 경로)?:[^\n]*\n(?:{PAGES}[^\n]*\n)?-+\n*", "", text)
    out, at = [], 0
    for m in [*_BLOCK.finditer(text), None]:
        for part in re.split(r"\n\s*\n", text[at : m.start() if m else len(text)]):
            if part := part.strip():
                out.append(("header" if part.startswith("#") else "list" if re.match(r"(?:[-*•]|\d+[.)])\s", part) else "paragraph", part))
        if m:
            at = m.end()
            if m[1] != "TABLE_MARKDOWN":
                out.append((m[1].lower(), m[2].strip()))
    return out
