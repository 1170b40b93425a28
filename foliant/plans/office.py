"""Office files made from the test tables and read back, and the rest of the table and layout rules."""

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliant.operators import layout as lo
from foliant.operators import tables as tb
from foliant.operators import text as t
from foliant.plans.bindings import records, table, with_records
from foliant.plans.layout import AREA, SHARED, _boxes, boxed
from foliant.registry import query
from foliant.sources import files


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def _over(function, kind: str):
    """An Arrow function of one column."""
    def one(values: pd.Series) -> pd.Series:
        return values.map(function)

    return pandas_udf(one, kind)


def _regions(spark, sf_dir):
    """region and the names of its nations in order."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return rows.select("region", F.transform("x", lambda r: r["n_name"]).alias("names"))


def _xlsx(names) -> bytes:
    cells = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="C{i}" t="inlineStr"><is><t>{n}</t></is></c></row>' for i, n in enumerate(names, 1))
    return _zip({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})


def _hwpx(names) -> bytes:
    rows = "".join(f"<tr><tc><t>{n}</t></tc></tr>" for n in names)
    return _zip({"Contents/section0.xml": f"<sec><p><run><t>head</t></run></p><tbl>{rows}</tbl></sec>"} | {f"Contents/section{i + 1}.xml": f"<sec><p><t>{n}</t></p></sec>" for i, n in enumerate(names)})


def _docx(names) -> bytes:
    return _zip({"word/document.xml": "<d>" + "".join(f"<p><t>{n}</t></p>" for n in names) + "</d>"})


JOINED = "SELECT n_regionkey AS region, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"


@query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR) AS a, '' AS b, n_name AS c FROM nation")
def src_xlsx(spark, sf_dir):
    made = _regions(spark, sf_dir).select("region", _over(_xlsx, "binary")("names").alias("content"))
    rows = made.select("region", F.posexplode(_over(lambda c: files.xlsx_sheets(bytes(c))[0][1], "array<array<string>>")("content")).alias("row", "x"))
    return rows.select("region", "row", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query("SELECT n_regionkey AS region, 'S' || chr(10) || string_agg(i || ' ' || n_name, chr(10) ORDER BY i) AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY 1")
def src_excel_text(spark, sf_dir):
    made = _regions(spark, sf_dir).select("region", _over(_xlsx, "binary")("names").alias("content"))
    return made.select("region", _over(lambda c: files.sheets_text(files.xlsx_sheets(bytes(c))), "string")("content").alias("text"))


@query(f"SELECT region, 'head' || chr(10) || names AS text FROM ({JOINED})")
def src_hwpx_text(spark, sf_dir):
    """Sections in the order of their numbers, ten after nine."""
    made = _regions(spark, sf_dir).select("region", _over(_hwpx, "binary")("names").alias("content"))
    return made.select("region", _over(lambda c: files.hwpx_text(bytes(c)), "string")("content").alias("text"))


@query("SELECT n_regionkey AS region, '<table>' || string_agg('<tr><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation GROUP BY 1")
def src_hwpx_tables(spark, sf_dir):
    made = _regions(spark, sf_dir).select("region", _over(_hwpx, "binary")("names").alias("content"))
    return made.select("region", F.get(_over(lambda c: files.hwpx_tables(bytes(c)), "array<string>")("content"), F.lit(0)).alias("html"))


@query(f"SELECT region, names AS text FROM ({JOINED})")
def src_original_text(spark, sf_dir):
    made = _regions(spark, sf_dir).select("region", _over(_docx, "binary")("names").alias("content"))
    return made.select("region", _over(lambda c: files.docx_text(bytes(c)), "string")("content").alias("text"))


@query("SELECT n_regionkey AS region, '<table><tr><td>' || string_agg(n_name, '</td></tr><tr><td>' ORDER BY n_nationkey) || '</td></tr></table>' AS html FROM nation GROUP BY 1")
def fn_html_table(spark, sf_dir):
    """Rows of cells as HTML, empty rows and columns at the end left out."""
    return _regions(spark, sf_dir).select("region", _over(lambda names: tb.to_html([[n, ""] for n in names] + [["", ""]], header=False), "string")("names").alias("html"))


def lcs_length(a: str, b: str) -> int:
    return round(t._nid(a, b) * (len(a) + len(b)) / 2)


@query()
def fn_lcs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tb.udf_of(lcs_length, "long")("p_name", "p_type").alias("common"))


@query(boxed("SELECT page, element, round(sqrt(power((x0 + x1) / 2 - 300, 2) + power((y0 + y1) / 2 - 400, 2)), 6) AS off, x1 > x0 AND y1 > y0 AS sound FROM boxes"))
def ma_bbox(spark, sf_dir):
    b = lo.box()
    return _boxes(spark, sf_dir).select("page", "element", F.round(F.sqrt(F.pow((b[0] + b[2]) / 2 - 300, 2) + F.pow((b[1] + b[3]) / 2 - 400, 2)), 6).alias("off"), ((b[2] > b[0]) & (b[3] > b[1])).alias("sound"))


def gap_clusters(values: list[float], tolerance: float) -> list[float]:
    """Means of the clusters of sorted values: a value within the tolerance of the running mean joins, else it begins anew."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and abs(v - float(np.mean(out[-1]))) <= tolerance:
            out[-1].append(v)
        else:
            out.append([v])
    return [round(float(np.mean(c)), 6) for c in out]


@query()
def win_gap_cluster(spark, sf_dir):
    edges = _boxes(spark, sf_dir).groupBy("page").agg(F.collect_list("x0").alias("v"))
    return edges.select("page", F.posexplode(_over(lambda v: gap_clusters(list(v), 25.0), "array<double>")("v")).alias("cluster", "mean"))


@query(with_records("SELECT i.item_id, CASE WHEN i.status IN ('COMPLETED', 'FAILED', 'CANCELED') THEN i.status ELSE 'CANCELED' END AS status FROM item_records i JOIN job_records j ON i.job_id = j.job_id WHERE j.cancel_requested", "item_records", "job_records"))
def st_force_cancel(spark, sf_dir):
    """Items of canceled jobs: all that are not over are canceled, running ones too."""
    wanted = records(spark, sf_dir, "job_records").filter("cancel_requested").select("job_id")
    over = F.col("status").isin("COMPLETED", "FAILED", "CANCELED")
    return records(spark, sf_dir, "item_records").join(wanted, "job_id", "left_semi").select("item_id", F.when(over, F.col("status")).otherwise("CANCELED").alias("status"))


@query("SELECT conv_id, turn, to_json({'index': turn, 'type': role, 'content': length(text)}) AS block FROM conversations")
def fn_json_view(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("turn").alias("index"), F.col("role").alias("type"), F.length("text").alias("content"))).alias("block"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest(l_tax, l_discount) = 0 THEN 1.0 ELSE least(l_tax, l_discount) / greatest(l_tax, l_discount) END, 6) AS ratio FROM lineitem")
def ma_ratio(spark, sf_dir):
    top = F.greatest("l_tax", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(top == 0, 1.0).otherwise(F.try_divide(F.least("l_tax", "l_discount"), top)), 6).alias("ratio"))


@query("SELECT event_id, strftime(ts, '%-m/%d') AS day_key FROM events")
def dt_day_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "M/dd").alias("day_key"))
