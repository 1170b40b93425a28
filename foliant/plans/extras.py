"""Smaller operators of the survey: notes in cells, marked sections, flow charts, Markdown tables, acknowledgements."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import layout as lo
from foliant.operators import tables as tb
from foliant.plans.bindings import records, table, with_records
from foliant.plans.layout import SCORE, _boxes, boxed
from foliant.registry import query


@query(boxed(f"SELECT page, element, {SCORE} AS score FROM (SELECT *, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1, lag(cols) OVER w AS p_cols, lag(header) OVER w AS p_header, lag(element) OVER w AS p_element FROM (SELECT page, element, x0, y0, x1, y1, element % 2 AS cols, CASE WHEN kind <> 'N' THEN kind END AS header FROM boxes QUALIFY count(*) OVER (PARTITION BY page, element) = 1) WINDOW w AS (PARTITION BY page ORDER BY element)) WHERE p_element IS NOT NULL"))
def ma_cont_score(spark, sf_dir):
    """How much each table looks like the rest of the one before."""
    once = _boxes(spark, sf_dir).groupBy("page", "element").agg(F.count("*").alias("n"), F.min(F.struct("x0", "y0", "x1", "y1", "kind")).alias("b")).filter("n = 1").select("page", "element", "b.*")
    rows = once.withColumns({"cols": F.col("element") % 2, "header": F.when(F.col("kind") != "N", F.col("kind"))})
    this = F.struct("x0", "y0", "x1", "y1", "cols", "header")
    rows = rows.select("page", "element", this.alias("this"), F.lag(this).over(Window.partitionBy("page").orderBy("element")).alias("before")).filter("before IS NOT NULL")
    return rows.select("page", "element", lo.continuation_score(F.col("before"), F.col("this"), 800.0).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = trunc(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS shown, CASE WHEN l_returnflag = 'A' THEN 'TRUE' ELSE 'FALSE' END AS truth, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS at FROM lineitem")
def fn_cell_str(spark, sf_dir):
    """Typed cells as texts: whole numbers without a point, truth values, dates."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(q == F.floor(q), q.cast("long").cast("string")).otherwise(q.cast("string")).alias("shown"), F.when(F.col("l_returnflag") == "A", "TRUE").otherwise("FALSE").alias("truth"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey, len(list_filter(range(1, n + 1), lambda i: i <= last)) AS kept FROM (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(max(l_linenumber) FILTER (l_discount > 0.02), 0) AS last FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def fn_trim(spark, sf_dir):
    """Cells of a row that stay when the empty ones at its end go."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max(F.when(F.col("l_discount") > 0.02, F.col("l_linenumber"))).alias("last"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce(F.least(F.col("n"), F.coalesce("last", F.lit(0))), F.lit(0)).cast("long").alias("kept"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) / 40) AS BIGINT) AS page FROM lineitem")
def src_hwpx_imgpage(spark, sf_dir):
    """The page of each picture: heights so far over the height of a page."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.sum("l_quantity").over(w) / 40).cast("long").alias("page"))


@query(with_records("SELECT item_id, max(value) AS progress, count(DISTINCT event_id) AS acknowledged FROM event_records WHERE item_id IS NOT NULL GROUP BY 1", "event_records"))
def st_ack(spark, sf_dir):
    """Messages delivered twice and acknowledged once: repeats of an id change nothing."""
    rows = records(spark, sf_dir, "event_records").filter("item_id IS NOT NULL").select("item_id", "event_id", "value")
    twice = rows.unionByName(rows).dropDuplicates(["event_id"])
    return twice.groupBy("item_id").agg(F.max("value").alias("progress"), F.count("*").alias("acknowledged"))


@query(with_records("""SELECT item_id, coalesce(string_agg(note, '; ' ORDER BY note), '') AS notes FROM (SELECT i.item_id, n.error_message AS note FROM (SELECT item_id, job_id, min(retry_count) AS lo FROM item_records GROUP BY 1, 2) i
    LEFT JOIN (SELECT DISTINCT job_id, retry_count, error_message FROM item_records WHERE error_message IS NOT NULL) n ON n.job_id = i.job_id AND n.retry_count BETWEEN i.lo AND i.lo + 1) GROUP BY 1""", "item_records"))
def jn_cell_notes(spark, sf_dir):
    """Notes put into the cells whose span covers their row, in order."""
    items = records(spark, sf_dir, "item_records")
    cells = items.groupBy("item_id", "job_id").agg(F.min("retry_count").alias("lo"))
    notes = items.filter("error_message IS NOT NULL").select("job_id", "retry_count", F.col("error_message").alias("note")).distinct()
    hit = cells.join(notes, "job_id").filter(F.col("retry_count").between(F.col("lo"), F.col("lo") + 1)).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("note")), "; ").alias("notes"))
    return cells.select("item_id").distinct().join(hit, "item_id", "left").select("item_id", F.coalesce("notes", F.lit("")).alias("notes"))


@query(with_records("SELECT item_id, document_id % 10 AS page, item_id % 7 AS image FROM item_records ORDER BY page, image, item_id", "item_records"))
def srt_infer(spark, sf_dir):
    """Tasks by page and image."""
    return records(spark, sf_dir, "item_records").select("item_id", (F.col("document_id") % 10).alias("page"), (F.col("item_id") % 7).alias("image")).orderBy("page", "image", "item_id")
