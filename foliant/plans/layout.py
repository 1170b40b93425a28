"""Boxes made from line items: an order is a page, a line an element."""

from pyspark.sql import functions as F

from foliant.operators import layout as lo
from foliant.plans.bindings import table
from foliant.registry import query

BOXES = """SELECT l_orderkey AS page, l_linenumber AS element, x0, y0, x0 + w AS x1, y0 + h AS y1, l_returnflag AS kind FROM (SELECT *, CAST(l_partkey % 60 * 10 AS DOUBLE) AS x0, CAST(l_suppkey % 80 * 10 AS DOUBLE) AS y0,
    CAST(l_quantity * 6 AS DOUBLE) AS w, CAST(l_quantity * (1 + l_linenumber % 3) * 2 AS DOUBLE) AS h FROM lineitem)"""
AREA = "greatest(0, {0}x1 - {0}x0) * greatest(0, {0}y1 - {0}y0)"
SHARED = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def _boxes(spark, sf_dir):
    x0, y0, q = (F.col("l_partkey") % 60 * 10).cast("double"), (F.col("l_suppkey") % 80 * 10).cast("double"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("element"), x0.alias("x0"), y0.alias("y0"), (x0 + q * 6).alias("x1"), (y0 + q * (1 + F.col("l_linenumber") % 3) * 2).alias("y1"), F.col("l_returnflag").alias("kind"))


def boxed(sql: str) -> str:
    return f"WITH boxes AS ({BOXES}) {sql}"


@query(boxed("SELECT page, element, " + AREA.format("") + " AS area, y1 - y0 < 50 OR x1 - x0 < 50 OR " + AREA.format("") + " < 5000 AS small FROM boxes"))
def flt_small_image(spark, sf_dir):
    b = lo.box()
    return _boxes(spark, sf_dir).select("page", "element", lo.area(b).alias("area"), ((b[3] - b[1] < 50) | (b[2] - b[0] < 50) | (lo.area(b) < 5000)).alias("small"))


@query(boxed("SELECT a.page, a.element, b.element AS other, round(" + SHARED + " / (" + AREA.format("a.") + "), 6) AS share FROM boxes a JOIN boxes b ON a.page = b.page AND a.element <> b.element WHERE " + SHARED + " > 0"))
def jn_bbox_overlap(spark, sf_dir):
    rows = lo.pairs(_boxes(spark, sf_dir), "page", "element").filter(lo.overlap(lo.box(), lo.box("o_")) > 0)
    return rows.select("page", "element", F.col("o_element").alias("other"), F.round(lo.overlap_share(lo.box(), lo.box("o_")), 6).alias("share"))


@query(boxed("SELECT a.page, a.element, b.element AS container FROM boxes a JOIN boxes b ON a.page = b.page AND a.element <> b.element WHERE a.x0 >= b.x0 - 3 AND a.y0 >= b.y0 - 3 AND a.x1 <= b.x1 + 3 AND a.y1 <= b.y1 + 3 AND " + AREA.format("b.") + " > 1.35 * " + AREA.format("a.")))
def jn_bbox_contain(spark, sf_dir):
    return lo.contained(_boxes(spark, sf_dir), "page", "element")


@query(boxed("SELECT page, arg_max(element, " + AREA.format("") + " * 100 - element) AS largest FROM boxes GROUP BY 1"))
def srt_largest_bbox(spark, sf_dir):
    return lo.largest(_boxes(spark, sf_dir), "page", "element")


@query(boxed("SELECT page, element, CAST(row_number() OVER (PARTITION BY page ORDER BY CAST(trunc(y0 / 10) AS INTEGER), x0, element) AS INTEGER) AS place FROM boxes"))
def srt_reading_order(spark, sf_dir):
    return lo.reading_order(_boxes(spark, sf_dir), "page", "element")


@query(boxed("SELECT page, element FROM boxes n WHERE kind = 'N' AND NOT EXISTS (SELECT 1 FROM boxes a JOIN boxes b ON b.page = a.page WHERE a.page = n.page AND a.element = n.element AND a.kind = 'N' AND b.kind = 'R' AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 AND " + SHARED + " >= 0.85 * " + AREA.format("a.") + ")"))
def jn_text_in_table(spark, sf_dir):
    """Texts that no table of their page covers."""
    boxes = _boxes(spark, sf_dir)
    texts = boxes.filter("kind = 'N'")
    regions = boxes.filter("kind = 'R'").select("page", *[F.col(s).alias(f"o_{s}") for s in lo.SIDES])
    a, b = lo.box(), lo.box("o_")
    covered = ((a[0] + a[2]) / 2).between(b[0], b[2]) & ((a[1] + a[3]) / 2).between(b[1], b[3]) & (lo.overlap(a, b) >= 0.85 * lo.area(a))
    hit = texts.join(regions, "page").filter(covered).select("page", "element").distinct()
    return texts.select("page", "element").join(hit, ["page", "element"], "left_anti")


@query(boxed("SELECT DISTINCT a.page, a.element FROM boxes a JOIN boxes b ON a.page = b.page AND a.kind = 'A' AND b.kind = 'R' WHERE " + AREA.format("a.") + " < 15000 AND (a.x0 + a.x1) / 2 BETWEEN b.x0 - 20 AND b.x1 + 20 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 20 AND b.y1 + 20"))
def flt_table_near_image(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    images = boxes.filter("kind = 'A'").filter(lo.area(lo.box()) < 15_000)
    regions = boxes.filter("kind = 'R'").select("page", *[F.col(s).alias(f"o_{s}") for s in lo.SIDES])
    a, b = lo.box(), lo.box("o_")
    return images.join(regions, "page").filter(((a[0] + a[2]) / 2).between(b[0] - 20, b[2] + 20) & ((a[1] + a[3]) / 2).between(b[1] - 20, b[3] + 20)).select("page", "element").distinct()


@query(boxed("SELECT page, element, CAST(CASE WHEN share >= 0.5 THEN 2.0 WHEN share >= 0.2 OR longest < 300 THEN 2.5 ELSE 3.0 END AS DOUBLE) AS scale FROM (SELECT page, element, " + AREA.format("") + " / 480000 AS share, greatest(x1 - x0, y1 - y0) AS longest FROM boxes)"))
def ma_crop_scale(spark, sf_dir):
    share, longest = lo.area(lo.box()) / 480_000, F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return _boxes(spark, sf_dir).select("page", "element", F.when(share >= 0.5, 2.0).when((share >= 0.2) | (longest < 300), 2.5).otherwise(3.0).alias("scale"))


SCORE = """2 * CAST(p_cols = cols AS INTEGER) + 2 * CAST(least(p_x1 - p_x0, x1 - x0) / greatest(p_x1 - p_x0, x1 - x0, 1e-9) >= 0.82 AS INTEGER) + CAST(abs(p_x0 - x0) <= 20 AS INTEGER)
    + 2 * CAST(p_y1 >= 560 AS INTEGER) + 2 * CAST(y0 <= 240 AS INTEGER) + 3 * CAST(coalesce(p_header = header, false) AS INTEGER) + CAST(header IS NULL AS INTEGER)"""


@query(boxed(f"""SELECT page, element, sum(begins) OVER (PARTITION BY page ORDER BY element ROWS UNBOUNDED PRECEDING) AS chain FROM (SELECT page, element, CASE WHEN p_element + 1 = element AND {SCORE} >= 7 THEN 0 ELSE 1 END AS begins FROM (
    SELECT *, lag(element) OVER w AS p_element, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1, lag(cols) OVER w AS p_cols, lag(header) OVER w AS p_header FROM (
    SELECT page, element, x0, y0, x1, y1, element % 2 AS cols, CASE WHEN kind <> 'N' THEN kind END AS header FROM (SELECT *, row_number() OVER (PARTITION BY page, element ORDER BY x0, y0, x1, y1, kind) AS one FROM boxes) WHERE one = 1) WINDOW w AS (PARTITION BY page ORDER BY element)))"""))
def jn_adjacent_tables(spark, sf_dir):
    """Tables that go on: lines of an order stand for its pages' tables."""
    first = _boxes(spark, sf_dir).groupBy("page", "element").agg(F.min(F.struct("x0", "y0", "x1", "y1", "kind")).alias("b")).select("page", "element", "b.*")
    tables = first.withColumns({"cols": F.col("element") % 2, "header": F.when(F.col("kind") != "N", F.col("kind"))})
    return lo.chains(tables, "page", "element", 800.0).select("page", "element", "chain")


COVERED = SHARED + " >= 0.85 * " + AREA.format("a.") + " AND " + AREA.format("a.") + " > 0 AND " + AREA.format("b.") + " > 1.3 * " + AREA.format("a.")


@query(boxed(f"SELECT b.page, b.element AS region, min(a.element) AS image FROM boxes a JOIN boxes b ON a.page = b.page AND a.kind = 'A' AND b.kind = 'R' WHERE {COVERED} GROUP BY 1, 2"))
def jn_bbox_image_table(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return lo.covered_images(boxes.filter("kind = 'A'"), boxes.filter("kind = 'R'"), "page", "element")


@query(boxed(f"""SELECT a.page, a.element, min(b.element) AS cell FROM boxes a JOIN (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes WHERE kind = 'N' GROUP BY 1) t ON t.page = a.page AND a.x0 >= t.x0 - 6 AND a.y0 >= t.y0 - 6 AND a.x1 <= t.x1 + 6 AND a.y1 <= t.y1 + 6
    JOIN boxes b ON a.page = b.page AND b.kind = 'N' WHERE a.kind = 'A' AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 AND {SHARED} >= 0.70 * {AREA.format('a.')} AND {AREA.format('a.')} > 0 GROUP BY 1, 2"""))
def jn_image_cell(spark, sf_dir):
    """Images in cells: the unreturned lines of an order are the cells of its page's table."""
    boxes = _boxes(spark, sf_dir)
    cells = boxes.filter("kind = 'N'")
    tables = cells.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return lo.image_cells(boxes.filter("kind = 'A'"), cells, tables, "page", "element")


SPANS = "SELECT page, element, y0 + element % 5 AS y, x0 FROM boxes"


@query(boxed(f"SELECT page, element, y, sum(CASE WHEN y - p <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y, x0, element ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, lag(y) OVER (PARTITION BY page ORDER BY y, x0, element) AS p FROM ({SPANS}))"))
def win_row_group(spark, sf_dir):
    """Spans of a page in visual rows."""
    spans = _boxes(spark, sf_dir).select("page", "element", (F.col("y0") + F.col("element") % 5).alias("y"), "x0")
    return lo.rows_of(spans, "page", "y", ["x0", "element"]).select("page", "element", "y", "line")


@query(boxed(f"""SELECT page, NOT (page % 17 = 0 OR text_tables > 0 OR cell_images > 0 AND native > 0) AND text_length < 200 AND (images = 0 OR image_area < 0.7 * 480000) AS full_page FROM (SELECT page, CAST(sum(x0) AS BIGINT) % 300 AS text_length, count(*) FILTER (kind = 'A') AS images,
    coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (kind = 'A'), 0) AS image_area, count(*) FILTER (kind = 'R' AND element = 2) AS text_tables, count(*) FILTER (kind = 'A' AND element = 1) AS cell_images, count(*) FILTER (kind = 'N' AND element = 3) AS native FROM boxes GROUP BY 1)"""))
def flt_fullpage(spark, sf_dir):
    kind, element = F.col("kind"), F.col("element")
    pages = _boxes(spark, sf_dir).groupBy("page").agg((F.sum("x0").cast("long") % 300).alias("text_length"), F.count_if(kind == "A").alias("images"), F.coalesce(F.sum(F.when(kind == "A", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))), F.lit(0.0)).alias("image_area"), F.count_if((kind == "R") & (element == 2)).alias("text_tables"), F.count_if((kind == "A") & (element == 1)).alias("cell_images"), F.count_if((kind == "N") & (element == 3)).alias("native_tables"))
    return lo.needs_full_page(pages.withColumns({"merged": F.col("page") % 17 == 0, "page_area": F.lit(480000.0)})).select("page", "full_page")
