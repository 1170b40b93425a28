"""Boxes on pages: areas, overlaps, containment, reading order, tables that go on over pages.

A join of boxes is an equi-join on the page with conditions on the boxes, so its size is bounded by what a page holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{s}") for s in SIDES)


def area(b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes share."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of a's area that b covers; 0 without area."""
    return F.when(area(a) > 0, overlap(a, b) / F.when(area(a) > 0, area(a))).otherwise(0.0)


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...], tolerance: float) -> Column:
    return (inner[0] >= outer[0] - tolerance) & (inner[1] >= outer[1] - tolerance) & (inner[2] <= outer[2] + tolerance) & (inner[3] <= outer[3] + tolerance)


def pairs(boxes: DataFrame, page: str, element: str) -> DataFrame:
    """Each two boxes of a page, those of the second with the prefix o_."""
    other = boxes.select(page, *[F.col(c).alias(f"o_{c}") for c in (element, *SIDES)])
    return boxes.join(other, page).filter(F.col(element) != F.col(f"o_{element}"))


def contained(boxes: DataFrame, page: str, element: str, tolerance: float = 3.0, factor: float = 1.35) -> DataFrame:
    """Boxes within a box of the same page that is larger by the factor."""
    rows = pairs(boxes, page, element).filter(contains(box("o_"), box(), tolerance) & (area(box("o_")) > factor * area(box())))
    return rows.select(page, element, F.col(f"o_{element}").alias("container"))


def largest(boxes: DataFrame, page: str, element: str) -> DataFrame:
    """The largest box of each page, the first of equals."""
    return boxes.groupBy(page).agg(F.max_by(element, F.struct(area(box()), -F.col(element))).alias("largest"))


def reading_order(boxes: DataFrame, page: str, element: str) -> DataFrame:
    """Place of each box on its page: by bands of ten in y, then by x, then as given."""
    order = Window.partitionBy(page).orderBy((F.col("y0") / 10).cast("int"), "x0", element)
    return boxes.select(page, element, F.row_number().over(order).alias("place"))


def continuation_score(a: Column, b: Column, height: float) -> Column:
    """How much table b of the next page looks like the rest of table a: same columns 2, like width 2, like left edge 1,
    a at the bottom 2, b at the top 2, same header 3, no header 1."""
    wide = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]) / F.greatest(a["x1"] - a["x0"], b["x1"] - b["x0"], F.lit(1e-9))
    rules = [(a["cols"] == b["cols"], 2), (wide >= 0.82, 2), (F.abs(a["x0"] - b["x0"]) <= 20, 1), (a["y1"] >= height * 0.7, 2), (b["y0"] <= height * 0.3, 2), (a["header"] == b["header"], 3), (b["header"].isNull(), 1)]
    total = F.lit(0)
    for condition, points in rules:
        total = total + F.when(condition, points).otherwise(0)
    return total


def chains(tables: DataFrame, doc: str, page: str, height: float, least: int = 7) -> DataFrame:
    """Groups of tables that go on from page to page: adjacent pages whose score is high enough. The group's number is the
    running count of tables that begin anew."""
    w = Window.partitionBy(doc).orderBy(page)
    this = F.struct("x0", "y0", "x1", "y1", "cols", "header")
    before, page_before = F.lag(this).over(w), F.lag(page).over(w)
    goes_on = (F.col(page) == page_before + 1) & (continuation_score(before, this, height) >= least)
    rows = tables.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("chain", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def covered_images(images: DataFrame, regions: DataFrame, page: str, element: str, share: float = 0.85, factor: float = 1.3) -> DataFrame:
    """Regions that hold most of an image and are larger by the factor, so that they are no regions of their own, and the
    first such image of each."""
    other = regions.select(page, F.col(element).alias("region"), *[F.col(s).alias(f"o_{s}") for s in SIDES])
    hit = (area(box()) > 0) & (overlap(box(), box("o_")) >= share * area(box())) & (area(box("o_")) > factor * area(box()))
    return images.join(other, page).filter(hit).groupBy(page, "region").agg(F.min(element).alias("image"))


def image_cells(images: DataFrame, cells: DataFrame, tables: DataFrame, page: str, element: str, tolerance: float = 6.0, share: float = 0.70) -> DataFrame:
    """The first cell that holds an image's centre and most of it, for images within a table."""
    frames = tables.select(page, *[F.col(s).alias(f"t_{s}") for s in SIDES])
    within = images.join(frames, page).filter(contains(box("t_"), box(), tolerance)).select(page, element, *SIDES).distinct()
    other = cells.select(page, F.col(element).alias("cell"), *[F.col(s).alias(f"o_{s}") for s in SIDES])
    a, b = box(), box("o_")
    centre = ((a[0] + a[2]) / 2).between(b[0], b[2]) & ((a[1] + a[3]) / 2).between(b[1], b[3])
    return within.join(other, page).filter(centre & (overlap_share(a, b) >= share)).groupBy(page, element).agg(F.min("cell").alias("cell"))


def rows_of(spans: DataFrame, page: str, y: str, order: list[str], tolerance: float = 3.0) -> DataFrame:
    """The number of the visual row of each span: in order of y a new row begins after a gap over the tolerance."""
    w = Window.partitionBy(page).orderBy(y, *order)
    gap = F.col(y) - F.lag(y).over(w) > tolerance
    begins = spans.withColumn("begins", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    return begins.withColumn("line", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def needs_full_page(pages: DataFrame, least_text: int = 200, most_share: float = 0.7) -> DataFrame:
    """Pages that are read as one image: little text, and no image or only images of a part of the page. Pages merged into a
    table before, with a table read as text, or with images in cells beside native tables, are not."""
    exempt = F.col("merged") | (F.col("text_tables") > 0) | ((F.col("cell_images") > 0) & (F.col("native_tables") > 0))
    partial = (F.col("images") == 0) | (F.col("image_area") < F.col("page_area") * most_share)
    return pages.withColumn("full_page", ~exempt & (F.col("text_length") < least_text) & partial)
