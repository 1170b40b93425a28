"""Tables on pages from what is drawn: cells from rectangles, regions and containers from ruling lines.

Functions here are plain Python over one page, which is small; pages() runs them over a table of pages in Arrow batches."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Box = tuple[float, float, float, float]
# Fixed values, in points: how far positions of one line lie apart, how thin and long a ruling line is, how near lines touch,
# and how far a region reaches beyond its lines.
CELL_GAP, LINE_GAP, THIN, LONG, TOUCH, MARGIN = 2.0, 3.0, 1.5, 8.0, 4.0, 4.0
# Least width, height and area of a region; shares of the page that a container is wide and high.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA, WIDE, HIGH = 80, 18, 1500, 0.70, 0.30


def lines_of(values: list[float], gap: float) -> list[float]:
    """The means of runs of values, in order: a value within the gap of the run's mean joins it."""
    runs: list[list[float]] = []
    for v in sorted(values):
        if runs and v - (runs[-1][0] if len(runs[-1]) == 1 else sum(runs[-1]) / len(runs[-1])) <= gap:
            runs[-1].append(v)
        else:
            runs.append([v])
    return [r[0] if len(r) == 1 else sum(r) / len(r) for r in runs]


def nearest(lines: list[float], value: float) -> int:
    """The number of the line, of some in order, that is nearest to a value, the first of equals."""
    i = bisect_left(lines, value)
    return i - 1 if i == len(lines) or i and value - lines[i - 1] <= lines[i] - value else i


def cells_of(rects: list[Box], texts: list[list[str | None]]) -> list[dict]:
    """row, col, rowspan, colspan, bbox and text of each rectangle that spans a row and a column, by the lines on which the
    rectangles' sides lie. Nothing without two lines each way."""
    xs, ys = (lines_of([r[i] for r in rects for i in side], CELL_GAP) for side in ((0, 2), (1, 3)))
    if len(xs) < 2 or len(ys) < 2 or not texts:
        return []
    out = []
    for box in rects:
        (col, right), (row, down) = ((nearest(lines, box[i]), nearest(lines, box[i + 2])) for lines, i in ((xs, 0), (ys, 1)))
        if right > col and down > row:
            text = texts[row][col] if row < len(texts) and col < len(texts[row]) else None
            out.append({"row": row, "col": col, "rowspan": down - row, "colspan": right - col, "bbox": box, "text": (text or "").strip()})
    return out


def cells_html(cells: list[dict]) -> str:
    """The cells as a table: each where no other one's span covers it, the first row as headings, a paragraph for each line."""
    anchors = {(c["row"], c["col"]): c for c in cells}
    covered = {(r, j) for at, c in anchors.items() if c["rowspan"] > 1 or c["colspan"] > 1 for r in range(at[0], at[0] + c["rowspan"]) for j in range(at[1], at[1] + c["colspan"]) if (r, j) != at}
    rows: dict[int, list[str]] = {r: [] for r in range(max((c["row"] + c["rowspan"] for c in cells), default=0))}
    for at in sorted(set(anchors) - covered):
        c, tag = anchors[at], "th" if at[0] == 0 else "td"
        spans = "".join(f' {k}="{c[k]}"' for k in ("colspan", "rowspan") if c[k] > 1)
        rows[at[0]].append(f"<{tag}{spans}>" + "".join(f"<p>{escape(line.strip())}</p>" for line in c["text"].split("\n") if line.strip()) + f"</{tag}>")
    return "<table>" + "".join(f"<tr>{''.join(r)}</tr>" for r in rows.values()) + "</table>" if cells else ""


def segments(drawn: list[tuple[str, float, float, float, float]]) -> list[tuple[str, Box]]:
    """The ruling lines (h or v, box) of what is drawn: lines, and the sides of rectangles, that are thin and long enough."""
    out = []
    for kind, x0, y0, x1, y1 in drawn:
        for a, b, c, d in [(x0, y0, x1, y1)] if kind == "line" else [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]:
            if abs(d - b) <= THIN and abs(c - a) >= LONG:
                out.append(("h", (min(a, c), (b + d) / 2, max(a, c), (b + d) / 2)))
            elif abs(c - a) <= THIN and abs(d - b) >= LONG:
                out.append(("v", ((a + c) / 2, min(b, d), (a + c) / 2, max(b, d))))
    return out


def touch(a: Box, b: Box, gap: float) -> bool:
    """Whether two boxes overlap or lie within the gap of each other."""
    return a[2] + gap >= b[0] and b[2] + gap >= a[0] and a[3] + gap >= b[1] and b[3] + gap >= a[1]


def groups_of(boxes: list[Box], gap: float) -> list[list[int]]:
    """The numbers of the boxes that touch, also by way of others, in order of the least of each group. Boxes are compared
    with those that they may touch in x only."""
    root = list(range(len(boxes)))

    def of(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    near: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][0]):
        near = [j for j in near if boxes[j][2] + gap >= boxes[i][0]]
        for j in near:
            a, b = of(i), of(j)
            if a != b and touch(boxes[i], boxes[j], gap):
                root[max(a, b)] = min(a, b)
        near.append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        groups.setdefault(of(i), []).append(i)
    return [*groups.values()]


def grid_regions(drawn: list[tuple[str, float, float, float, float]], texts: list[Box], width: float, height: float) -> list[Box]:
    """The regions of grids: ruling lines that touch, with three lines across and two down, or two across and three down,
    large enough and with a text at them; clipped to the page."""
    found = segments(drawn)
    down = sum(o == "v" for o, _ in found)
    if not texts or min(down, len(found) - down) < 2 or len(found) < 5:
        return []
    out = []
    for group in groups_of([b for _, b in found], TOUCH):
        some = [found[i] for i in group]
        xs, ys = lines_of([b[0] for o, b in some if o == "v"], LINE_GAP), lines_of([b[1] for o, b in some if o == "h"], LINE_GAP)
        if not (len(xs) >= 3 and len(ys) >= 2 or len(xs) >= 2 and len(ys) >= 3):
            continue
        x0, y0, x1, y1 = (most(b[i] for _, b in some) for i, most in enumerate((min, min, max, max)))
        if x1 - x0 < LEAST_WIDTH or y1 - y0 < LEAST_HEIGHT or (x1 - x0) * (y1 - y0) < LEAST_AREA:
            continue
        if any(touch((x0, y0, x1, y1), b, 2 * TOUCH) for b in texts):
            out.append((max(0.0, x0 - MARGIN), max(0.0, y0 - MARGIN), min(width, x1 + MARGIN), min(height, y1 + MARGIN)))
    return out


def merged_regions(regions: list[Box], gap: float = 8.0) -> list[Box]:
    """Regions from the top, each joined to the first before it that it touches."""
    out: list[Box] = []
    for r in sorted(regions, key=lambda r: (r[1], r[0])):
        at = next((i for i, o in enumerate(out) if o[0] - gap <= r[2] and r[0] - gap <= o[2] and o[1] - gap <= r[3] and r[1] - gap <= o[3]), None)
        if at is None:
            out.append(r)
        else:
            out[at] = (*map(min, out[at][:2], r[:2]), *map(max, out[at][2:], r[2:]))
    return out


def container(drawn: list[tuple[str, float, float, float, float]], texts: list[tuple[Box, str]], tables: list[tuple[Box, str]], width: float, height: float) -> tuple[Box, str] | None:
    """The largest frame of one column around most of the page's width, as a box and a table of a row for each band between
    its lines, with the texts and tables inside in reading order; None without one."""
    found = segments(drawn)
    across, down = ([b for o, b in found if o == k] for k in "hv")
    xs, ys = lines_of([b[0] for b in down], LINE_GAP), lines_of([b[1] for b in across], LINE_GAP)
    full = lambda x, y0, y1: any(abs(b[0] - x) <= LINE_GAP and b[1] <= y0 + 6 and b[3] >= y1 - 6 for b in down)
    best = None
    for i, x0 in enumerate(xs):
        for x1 in xs[i + 1 :]:
            if (x1 - x0) / max(width, 1) < WIDE:
                continue
            wide = [b[1] for b in across if b[0] <= x0 + 6 and b[2] >= x1 - 6]
            bands = [y for y in ys if any(abs(v - y) <= LINE_GAP for v in wide)]
            if len(bands) < 3 or (bands[-1] - bands[0]) / max(height, 1) < HIGH:
                continue
            if not full(x0, bands[0], bands[-1]) or not full(x1, bands[0], bands[-1]):
                continue
            if any(x0 + 6 < b[0] < x1 - 6 and b[1] <= bands[0] + 6 and b[3] >= bands[-1] - 6 for b in down):
                continue
            box = (max(0.0, x0 - MARGIN), max(0.0, bands[0] - MARGIN), min(width, x1 + MARGIN), min(height, bands[-1] + MARGIN))
            area = (box[2] - box[0]) * (box[3] - box[1])
            if best is not None and area <= best[0]:
                continue
            rows = [band_html((x0, a, x1, b), texts, tables) for a, b in zip(bands, bands[1:])]
            if any(rows):
                best = (area, box, "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>")
    return best and best[1:]


def within(inner: Box, outer: Box, gap: float) -> bool:
    return inner[0] >= outer[0] - gap and inner[1] >= outer[1] - gap and inner[2] <= outer[2] + gap and inner[3] <= outer[3] + gap


def band_html(band: Box, texts: list[tuple[Box, str]], tables: list[tuple[Box, str]]) -> str:
    """What a band holds: tables inside it, and texts whose centre is in it and that no such table holds."""
    held = [(b, h) for b, h in tables if within(b, band, 8.0)]
    centred = lambda b: band[0] <= (b[0] + b[2]) / 2 <= band[2] and band[1] <= (b[1] + b[3]) / 2 <= band[3]
    own = [(b, "".join(f"<p>{escape(' '.join(line.split()))}</p>" for line in t.splitlines() if line.strip())) for b, t in texts if centred(b) and not any(within(b, o, 2.0) for o, _ in held)]
    return "".join(h for _, h in sorted(own + held, key=lambda x: (x[0][1], x[0][0])))


def values(column: pa.Array) -> list:
    """The column as Python values; structs are dicts, also in lists, made field by field from whole columns."""
    if pa.types.is_struct(column.type):
        names = column.type.names
        rows = [dict(zip(names, row)) for row in zip(*map(values, column.flatten()))] if names else column.to_pylist()
        return [None if null else row for null, row in zip(column.is_null().to_pylist(), rows)] if column.null_count else rows
    if pa.types.is_list(column.type) and not column.null_count:
        items, ends = values(column.flatten()), np.append(0, np.cumsum(column.value_lengths())).tolist()
        return [items[a:b] for a, b in zip(ends, ends[1:])]
    numbers = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy().tolist() if numbers and not column.null_count else column.to_pylist()


def pages(df: DataFrame, schema: str, function: Callable[[dict], list[tuple]]) -> DataFrame:
    """The rows that function gives for each row of df, a page."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = [out for page in zip(*map(values, batch.columns)) for out in function(dict(zip(batch.schema.names, page)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(types), types)], schema=types)

    return df.mapInArrow(run, schema)
