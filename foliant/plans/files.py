"""Files made from rows of the test tables, and what becomes of them."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliant.operators import tagged
from foliant.plans.bindings import table
from foliant.registry import query
from foliant.sources import files


@query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation")
def src_csv(spark, sf_dir):
    """A file with semicolons for each region, read back as rows of cells."""
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: files.csv_rows(bytes(c)))

    line = F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit("; "), "n_name", F.lit(" ; "))
    made = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("t")))).alias("x"))
    content = F.encode(F.concat(F.array_join(F.transform("x", lambda r: r["t"]), "\n"), F.lit("\n;;\n")), "UTF-8")
    rows = made.select(F.col("n_regionkey").alias("region"), F.posexplode(pandas_udf(read, "array<array<string>>")(content)).alias("row", "cells"))
    return rows.select("region", "row", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_name <> '' ELSE false END AS ok FROM part")
def flt_upload(spark, sf_dir):
    size = F.col("p_size") % 4
    name = F.when(size == 0, "a.PDF").when(size == 1, "a.png").when(size == 2, "a.csv").otherwise("a")
    content = F.when(size == 2, F.encode("p_name", "UTF-8")).otherwise(F.encode(F.lit("%PDF-1.7"), "UTF-8"))
    return table(spark, sf_dir, "part").select("p_partkey", files.accepted(name, content).alias("ok"))


@query("SELECT page_id, CASE WHEN html = '' THEN 'none' WHEN ends_with(url, '.html') THEN 'html' WHEN contains(url, '?') THEN 'query' ELSE 'text' END AS kind FROM pages")
def prj_preview_kind(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("html") == "", "none").when(F.endswith(url, F.lit(".html")), "html").when(F.contains(url, F.lit("?")), "query").otherwise("text").alias("kind"))


@query("SELECT page_id, octet_length(encode(html)) AS size, sha256(html) AS sha, regexp_extract(url, '\\.(html|php)', 1) IN ('html') AS processable FROM pages")
def prj_upload_payload(spark, sf_dir):
    content = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha"), F.regexp_extract("url", r"\.(html|php)", 1).isin("html").alias("processable"))


DOC_TEXT = f"""WITH e AS (SELECT conv_id, turn // 2 + 1 AS page, turn, CASE role WHEN 'user' THEN text WHEN 'system' THEN '[[IMAGE]]' || chr(10) || text || chr(10) || '[[/IMAGE]]' ELSE '[[TABLE]]' || chr(10) || text || chr(10) || '[[/TABLE]]' END AS t FROM conversations),
    p AS (SELECT conv_id, page, '## Page ' || page || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY turn, t) AS t FROM e GROUP BY 1, 2)
    SELECT conv_id, '{tagged.SOURCE}conv-' || conv_id || chr(10) || '{tagged.PAGES}' || count(*) || chr(10) || '{tagged.RULE}' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY 1"""


def _documents(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "system", "image").otherwise("table")
    elements = rows.select("conv_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source"), (F.floor(F.col("turn") / 2) + 1).alias("page"), F.col("turn").alias("place"), kind.alias("kind"), "text")
    return tagged.documents(elements, "conv_id", "source")


@query(DOC_TEXT)
def sink_doc_text(spark, sf_dir):
    return _documents(spark, sf_dir)


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS tables, count(*) FILTER (role = 'system') AS images, count(DISTINCT turn // 2) AS pages FROM conversations GROUP BY 1")
def fn_blocks(spark, sf_dir):
    """The blocks of the tagged texts, counted by kind."""
    def kinds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [k for k, _ in tagged.blocks(t)])

    rows = _documents(spark, sf_dir).select("conv_id", "text", F.explode(pandas_udf(kinds, "array<string>")("text")).alias("kind"))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "image").alias("images"), F.first(F.regexp_count("text", F.lit("(?m)^## Page "))).cast("long").alias("pages"))


@query(f"SELECT conv_id, regexp_replace(text, '^{tagged.SOURCE}[^\\n]*', '{tagged.SOURCE}renamed') AS text FROM ({DOC_TEXT})")
def sink_result(spark, sf_dir):
    """The head's file name rewritten, only where the first line is such a head."""
    return _documents(spark, sf_dir).select("conv_id", F.regexp_replace("text", rf"\A{tagged.SOURCE}[^\n]*", f"{tagged.SOURCE}renamed").alias("text"))
