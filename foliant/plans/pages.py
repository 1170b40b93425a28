"""Rules over pages and their lines, dates, numbers and boxes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import tables as tb
from foliant.operators import text as t
from foliant.plans.bindings import records, table, with_records
from foliant.registry import query

LINES = "SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"SELECT doc_id, pos FROM ({LINES}) WHERE NOT regexp_matches(trim(line), '^(-\\s*\\d+\\s*-|\\d{{1,5}})$')")
def flt_page_number(spark, sf_dir):
    """Lines that are no page numbers."""
    return _lines(spark, sf_dir).filter(~F.btrim("line").rlike(r"^(-\s*\d+\s*-|\d{1,5})$")).select("doc_id", "pos")


@query("SELECT page_id, length(html) < 2000 AND len(regexp_extract_all(html, '<p[ >]')) < 8 AS simple, len(regexp_extract_all(lower(html), '<tr[ >]')) >= 2 OR len(regexp_extract_all(lower(html), '<t[dh][ >]')) >= 3 AS real_table FROM pages")
def flt_simple_table(spark, sf_dir):
    n = lambda p: F.regexp_count(F.lower("html"), F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", ((F.length("html") < 2000) & (F.regexp_count("html", F.lit("<p[ >]")) < 8)).alias("simple"), ((n("<tr[ >]") >= 2) | (n("<t[dh][ >]") >= 3)).alias("real_table"))


@query("SELECT l_orderkey, count(*) AS rows, count(*) >= 2 AND count(*) FILTER (l_discount > 0) * 1.0 / count(*) >= 0.3 AS reliable FROM lineitem GROUP BY 1")
def flt_native_reliable(spark, sf_dir):
    filled = F.count_if(F.col("l_discount") > 0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"), ((F.count("*") >= 2) & (filled / F.count("*") >= 0.3)).alias("reliable"))


@query("SELECT doc_id, trim(regexp_replace(replace(text, chr(127), ' '), '[ \\t\\n]+', ' ', 'g')) AS clean FROM documents")
def fn_sanitize(spark, sf_dir):
    """Control and private-use characters become spaces; white space is collapsed."""
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFF}\x00\x7F]", " "), r"[ \t\n]+", " ")).alias("clean"))


@query(f"SELECT doc_id, pos FROM ({LINES}) WHERE regexp_matches(trim(line), '^(Table|표|Licensed|Released)\\s+\\S+') AND length(line) < 120")
def fn_caption(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).filter(F.btrim(line).rlike(r"^(Table|표|Licensed|Released)\s+\S+") & (F.length(line) < 120)).select("doc_id", "pos")


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS edits FROM part")
def fn_levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("edits"))


@query("SELECT event_id, CAST(try_strptime(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS at FROM events")
def dt_parse_iso(spark, sf_dir):
    """ISO-8601 with Z; what is none is null."""
    text = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, greatest(0, (epoch_us(prev) - epoch_us(ts)) // 1000 * -1) AS ms FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL AND (epoch_us(ts) - epoch_us(prev)) % 1000 = 0")
def dt_to_ms(spark, sf_dir):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")).alias("prev")).filter("prev IS NOT NULL")
    return rows.filter((us("ts") - us("prev")) % 1000 == 0).select("event_id", F.greatest(F.lit(0), ((us("ts") - us("prev")) / 1000).cast("long")).alias("ms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE l_shipdate + to_seconds(CAST(l_quantity * 60 AS BIGINT)) END AS expires FROM lineitem")
def dt_expiry(spark, sf_dir):
    ttl = F.when(F.col("l_quantity") % 7 != 0, (F.col("l_quantity") * 60).cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_shipdate") + F.make_dt_interval(secs=ttl)).alias("expires"))


@query("SELECT n_nationkey, coalesce(b.v, a.v) AS v, a.v IS NOT NULL AS had FROM nation n LEFT JOIN (SELECT n_nationkey AS k, 'old' AS v FROM nation WHERE n_nationkey < 15) a ON a.k = n_nationkey LEFT JOIN (SELECT n_nationkey AS k, 'new' AS v FROM nation WHERE n_nationkey > 10) b ON b.k = n_nationkey")
def js_merge(spark, sf_dir):
    """Maps merged, the later value of a key wins."""
    k = F.col("n_nationkey")
    old, new = F.when(k < 15, F.create_map(F.lit("v"), F.lit("old"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.when(k > 10, F.create_map(F.lit("v"), F.lit("new"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(old, lambda x, y: ~F.map_contains_key(new, x)), new)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.try_element_at(merged, F.lit("v")).alias("v"), F.map_contains_key(old, F.lit("v")).alias("had"))


@query("SELECT doc_id, sha256(lang || chr(0) || source || chr(0) || n_chars || chr(0) || text) AS key FROM documents")
def hs_describe_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("\x00", "lang", "source", F.col("n_chars").cast("string"), "text"), 256).alias("key"))


@query(with_records("SELECT item_id, status, stage, first_value(status) OVER (PARTITION BY job_id ORDER BY queued_at, item_id, document_id, retry_count ROWS UNBOUNDED PRECEDING) AS first_status FROM (SELECT *, CASE status WHEN 'QUEUED' THEN 0 WHEN 'PROCESSING' THEN 1 ELSE 2 END AS stage FROM item_records)", "item_records"))
def st_stage(spark, sf_dir):
    stage = F.when(F.col("status") == "QUEUED", 0).when(F.col("status") == "PROCESSING", 1).otherwise(2)
    w = Window.partitionBy("job_id").orderBy("queued_at", "item_id", "document_id", "retry_count").rowsBetween(Window.unboundedPreceding, 0)
    return records(spark, sf_dir, "item_records").select("item_id", "status", stage.alias("stage"), F.first("status").over(w).alias("first_status"))


@query(with_records("SELECT item_id, CASE WHEN status = 'PROCESSING' THEN 'QUEUED' ELSE status END AS status, CASE WHEN status = 'PROCESSING' THEN 0.0::DOUBLE ELSE progress END AS progress, retry_count + CAST(status = 'PROCESSING' AS INTEGER) AS retries FROM item_records", "item_records"))
def st_retry(spark, sf_dir):
    """Running items queued again: one more retry, progress from the start."""
    runs = F.col("status") == "PROCESSING"
    return records(spark, sf_dir, "item_records").select("item_id", F.when(runs, "QUEUED").otherwise(F.col("status")).alias("status"), F.when(runs, 0.0).otherwise(F.col("progress")).alias("progress"), (F.col("retry_count") + runs.cast("int")).alias("retries"))


@query(with_records("SELECT document_id, concat('doc_', document_id) AS record_id, coalesce(file_name, 'document') AS name, CASE WHEN file_type IN ('pdf', 'docx') THEN file_type ELSE 'other' END AS kind, 'QUEUED' AS status FROM doc_records", "doc_records"))
def prj_build_doc(spark, sf_dir):
    return records(spark, sf_dir, "doc_records").select("document_id", F.concat(F.lit("doc_"), F.col("document_id").cast("string")).alias("record_id"), F.coalesce("file_name", F.lit("document")).alias("name"), F.when(F.col("file_type").isin("pdf", "docx"), F.col("file_type")).otherwise("other").alias("kind"), F.lit("QUEUED").alias("status"))


@query("SELECT page_id, strlen(html) AS bytes, html LIKE '<!DOCTYPE html>%' AS typed FROM pages")
def src_html_preview(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.startswith(F.col("html"), F.lit("<!DOCTYPE html>")).alias("typed"))
