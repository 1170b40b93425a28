"""Readers of office files: bytes in, rows of texts out. They use the standard library alone and refuse XML with entities."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order in which they are tried, delimiters, and the first bytes of kinds of files.
ENCODINGS = ["utf-8-sig", "cp949", "euc-kr", "latin-1"]
DELIMITERS = ",\t;|"
MAGIC = {"pdf": b"%PDF", "zip": b"PK\x03\x04", "ole": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "gif": b"GIF8"}
SUFFIX_KIND = {"pdf": "pdf", "docx": "zip", "xlsx": "zip", "pptx": "zip", "hwpx": "zip", "xls": "ole", "hwp": "ole", "png": "png", "jpg": "jpg", "jpeg": "jpg", "gif": "gif"}


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder, without hidden ones: path, modificationTime, length, content. Spark lists and reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.filter(~F.element_at(F.split("path", "/"), -1).startswith("."))


def decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    raise AssertionError("the last encoding takes any bytes")


def csv_rows(content: bytes) -> list[list[str]]:
    """Cells stripped, rows padded to one width, empty rows and columns at the end left out. The delimiter is the one that
    the first 8192 characters hold most often in like numbers a line; a comma if none is."""
    text = decode(content)
    lines = [line for line in text[:8192].splitlines()[:20] if line.strip()]
    counts = {d: [line.count(d) for line in lines] for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: (min(counts[d], default=0), sum(counts[d])))
    rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text), delimiter=best if any(counts[best]) else ",")]
    while rows and not any(rows[-1]):
        rows.pop()
    wide = max((i + 1 for r in rows for i, c in enumerate(r) if c), default=0)
    return [(r + [""] * wide)[:wide] for r in rows]


def xml(content: bytes) -> ElementTree.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", content[:65536], re.IGNORECASE):
        raise ValueError("XML with a document type or entities is refused")
    return ElementTree.fromstring(content)


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def texts_of(element: ElementTree.Element, name: str) -> str:
    return "".join(e.text or "" for e in element.iter() if local(e) == name)


def paragraphs(content: bytes, paragraph: str = "p", text: str = "t") -> list[str]:
    """Paragraph texts of a word-processor part, nested paragraphs of tables on their own."""
    found = []
    for p in (e for e in xml(content).iter() if local(e) == paragraph):
        inner = {id(t) for q in p.iter() if q is not p and local(q) == paragraph for t in q.iter()}
        found.append("".join(t.text or "" for t in p.iter() if local(t) == text and id(t) not in inner))
    return found


def numbered(names: list[str], pattern: str) -> list[str]:
    """Parts whose names match, in the order of their numbers: section2 before section10."""
    some = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(some)]


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n".join(filter(None, paragraphs(z.read("word/document.xml"))))


def pptx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n\n".join("\n".join(filter(None, paragraphs(z.read(n)))) for n in numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"))


def hwpx_text(content: bytes) -> str:
    """Text of all sections, or the preview where there is none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = "\n".join(t for n in numbered(z.namelist(), r"Contents/section(\d+)\.xml") for t in paragraphs(z.read(n)) if t)
        return text or (z.read("Preview/PrvText.txt").decode("utf-8", "replace") if "Preview/PrvText.txt" in z.namelist() else "")


def hwpx_tables(content: bytes) -> list[str]:
    """The tables of the first section as HTML with their spans."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root, out = xml(z.read("Contents/section0.xml")), []
    for table in (e for e in root.iter() if local(e) == "tbl"):
        rows = []
        for tr in (e for e in table if local(e) == "tr"):
            cells = []
            for tc in (e for e in tr if local(e) == "tc"):
                said = next((dict(e.attrib) for e in tc if local(e) == "cellSpan"), {})
                spans = "".join(f' {a}="{said[k]}"' for a, k in (("rowspan", "rowSpan"), ("colspan", "colSpan")) if said.get(k, "1") != "1")
                cells.append(f"<td{spans}>{texts_of(tc, 't')}</td>")
            rows.append("<tr>" + "".join(cells) + "</tr>")
        out.append("<table>" + "".join(rows) + "</table>")
    return out


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows of every sheet that has a cell, in the workbook's order; numbers and truth values as they are shown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [texts_of(e, "t") for e in xml(z.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        links = {e.get("Id"): e.get("Target").lstrip("/").removeprefix("xl/") for e in xml(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (e for e in xml(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            rows: dict[int, dict[int, str]] = {}
            for c in (e for e in xml(z.read(f"xl/{links[link]}")).iter() if local(e) == "c"):
                value, kind = texts_of(c, "v"), c.get("t")
                value = shared[int(value)] if kind == "s" else texts_of(c, "t") if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
                if value:
                    rows.setdefault(int(re.search(r"\d+", c.get("r"))[0]) - 1, {})[column_number(c.get("r"))] = value
            if rows:
                wide = max(max(r) for r in rows.values()) + 1
                out.append((sheet.get("name"), [[rows.get(i, {}).get(j, "") for j in range(wide)] for i in range(max(rows) + 1)]))
        return out


def sheets_text(sheets: list[tuple[str, list[list[str]]]]) -> str:
    """Each sheet's name and its rows' cells with spaces, a blank line between sheets."""
    return "\n\n".join("\n".join([name, *(" ".join(filter(None, r)) for r in rows if any(r))]) for name, rows in sheets)


def kind_of(content: Column) -> Column:
    """Kind of a file by its first bytes; null for others."""
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(F.startswith(content, F.lit(magic)), kind).otherwise(out)
    return out


def accepted(name: Column, content: Column, limit: int = 100 << 20) -> Column:
    """Whether an upload is not empty, not too large, of a known suffix and of the content that the suffix promises."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    promised = F.try_element_at(F.create_map(*[F.lit(x) for pair in SUFFIX_KIND.items() for x in pair]), suffix)
    plain = suffix.isin("csv", "txt", "md")
    return F.coalesce((F.length(content) > 0) & (F.length(content) <= limit) & (plain | (kind_of(content) == promised)), F.lit(False))
