"""Reports as lines, messages of events, settings of schedules and servers: small results for people and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles and rows of the evaluation report, and of the benchmark's.
TITLE, ENGINE, HEAD = "# 성능 평가 보고서", "## 엔진: ", "| 지표 | 값 |\n|---|---|"
RUNS_HEAD = "| 모델 | 백엔드 | 병렬도 | 문서 수 | 상태 | 완료 수 | 전체 소요 시간(초) | 처리량(문서/분) |"
EVENT_TYPES = ["VIEW", "PROGRESS", "RETRY_REQUESTED", "FAILED", "SIGNUP"]


def shown(value: Column, suffix: str = "") -> Column:
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.concat(value.cast("string"), F.lit(suffix)))


def report_lines(summaries: DataFrame, engine: str, rows: dict[str, Column]) -> DataFrame:
    """engine and text: the section of each engine, its measures as a table."""
    lines = [F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in rows.items()]
    return summaries.select(engine, F.concat_ws("\n", F.concat(F.lit(ENGINE), F.col(engine)), F.lit(""), F.lit(HEAD), *lines).alias("text"))


def seconds(ms: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", ms.cast("double") / 1000), F.lit(""))


def csv_line(values: list[Column]) -> Column:
    """Values as a line of CSV: quoted where they hold a comma, a quote or a line's end; nulls are empty."""
    texts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.concat_ws(",", *[F.when(t.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts])


def event_messages(events: DataFrame, items: DataFrame, job: str = "job_id") -> DataFrame:
    """What subscribers get for each event of a known type: the event and how far its job is. items: job, status."""
    counts = items.groupBy(job).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETED", "FAILED", "CANCELED")])
    finished = F.col("completed") + F.col("failed") + F.col("canceled")
    known = events.filter(F.col("event_type").isin(*EVENT_TYPES))
    return known.join(counts, job, "left").fillna(0, ["total", "completed", "failed", "canceled"]).withColumns({"finished": finished, "percent": F.coalesce(F.floor(F.try_divide(finished * 100, F.col("total"))), F.lit(0))})


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Whether a time of day lies between two HH:MM, both included, over midnight if the first is later; what is no time is no
    limit."""
    def minutes(text: Column) -> Column:
        h, m = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{1,2})\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{1,2})\s*$", 2).try_cast("int")
        return F.when((h <= 23) & (m <= 59), h * 60 + m)

    now, a, b = F.hour(at) * 60 + F.minute(at), minutes(start), minutes(end)
    return F.when(a.isNull() | b.isNull(), True).when(a <= b, now.between(a, b)).otherwise((now >= a) | (now <= b))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parallelism(cpus: Column, ram_gb: Column) -> Column:
    """Workers that a server bears: two for each CPU, one for each two GB, 16 at most; 8 if its memory is unknown."""
    by_cpu = F.greatest(F.lit(1), F.when(cpus > 0, F.least(cpus * 2, F.lit(16))).otherwise(4))
    by_ram = F.greatest(F.lit(1), F.floor(ram_gb / 2))
    return F.when(ram_gb.isNull(), F.least(by_cpu, F.lit(8))).otherwise(F.least(by_cpu, by_ram, F.lit(16))).cast("int")


def usage_percent(used: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(used / total * 100, 2)).otherwise(0.0)


def fifo(keys: Column, size: int) -> Column:
    """What a cache of a size holds after keys were asked for in order: the last to enter; asking again for one that is there
    changes nothing."""
    keep = lambda held, k: F.when(F.array_contains(held, k), held).otherwise(F.slice(F.concat(held, F.array(k)), F.greatest(F.lit(1), F.size(held) + 2 - size), size))
    return F.aggregate(keys, F.filter(keys, lambda k: F.lit(False)), keep)


def tables_by_page(tagged: Column) -> Column:
    """The marked tables of a tagged text with their pages (null before the first heading): page and html."""
    pages = F.filter(F.split(tagged, r"(?m)^(?=##\s*Page\s+\d+\s*$)"), lambda p: p != "")
    number = lambda p: F.regexp_extract(p, r"^##\s*Page\s+(\d+)", 1).try_cast("int")
    held = lambda p: F.regexp_extract_all(p, F.lit(r"(?ms)^\s*\[\[TABLE\]\]\s*$\n?(.*?)^\s*\[\[/TABLE\]\]\s*$"), F.lit(1))
    return F.flatten(F.transform(pages, lambda p: F.transform(held(p), lambda t: F.struct(number(p).alias("page"), F.regexp_replace(t, r"(?U)^\s+|\s+\z", "").alias("html")))))


# Tables that are looked at ahead, characters of a table's text that are looked for, and the least that is
# replaced: a share of the table's text, or so many characters.
AHEAD, LONG_START, SHORT_START, LEAST_FLAT, LEAST_SHARE, LEAST_TEXT = 15, 80, 60, 20, 0.25, 50


def tables_into_texts(elements: list[tuple[str, str]], tables: list[dict]) -> list[tuple[str, str]]:
    """Elements (kind, content) of a page with texts replaced by the tables whose texts they are. Tables are used in order,
    up to AHEAD are passed over; a table takes as many texts in a row as hold its first line or the begin of its text."""
    norm = lambda t: " ".join((t or "").split())
    said = [(norm(t.get("first_line")), norm(t.get("flat_text"))) for t in tables]
    out, at, i = [], 0, 0
    while i < len(elements):
        stop = next((k for k in range(i, len(elements)) if elements[k][0] != "text"), len(elements))
        ahead = norm("\n".join(c for _, c in elements[i:stop]))
        starts = lambda first, flat: first and first in ahead or len(flat) > LEAST_FLAT and (flat[:LONG_START] in ahead or flat[:SHORT_START] in ahead)
        hit = next((n for n in range(at, min(at + AHEAD, len(tables))) if starts(*said[n])), None) if ahead else None
        if hit is None:
            out.append(elements[i])
            i += 1
            continue
        first, flat = said[hit]
        end = stop - 1
        for k in range(i, stop):
            have = norm("\n".join(c for _, c in elements[i : k + 1]))
            if (first and first in have or flat and flat[:SHORT_START] in have) and (not flat or len(have) >= max(LEAST_TEXT, len(flat) * LEAST_SHARE)):
                end = k
                break
        out.append(("table", tables[hit].get("html", "")))
        at, i = hit + 1, end + 1
    return out
