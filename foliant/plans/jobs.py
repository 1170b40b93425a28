from pyspark.sql import functions as F

from foliant.operators import jobs as j
from foliant.plans.bindings import records, with_records
from foliant.registry import query

COUNTS = """c AS (SELECT job_id, count(*) AS total, """ + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in j.STATES) + " FROM item_records GROUP BY 1)"


def counted(select: str, *names: str) -> str:
    return with_records("", "item_records", *names).rstrip() + ", " + COUNTS + " " + select


@query(counted("SELECT job_id, total, queued, processing, completed, failed, canceled FROM c"))
def agg_job_states(spark, sf_dir):
    return j.state_counts(records(spark, sf_dir, "item_records"))


@query(counted("""SELECT job_id, total, status, CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELED') THEN 100 ELSE percent END AS progress FROM (SELECT job_id, total,
    CASE WHEN total > 0 AND done >= total THEN CASE WHEN canceled = total THEN 'CANCELED' WHEN completed = 0 AND failed > 0 AND canceled = 0 THEN 'FAILED' ELSE 'COMPLETED' END
         WHEN cancel_requested AND queued + processing = 0 THEN 'CANCELED' WHEN processing > 0 THEN 'PROCESSING' ELSE 'QUEUED' END AS status,
    CASE WHEN total > 0 THEN CAST(trunc(done * 100.0 / total) AS INTEGER) ELSE 0 END AS percent
    FROM (SELECT j.job_id, cancel_requested, coalesce(total, 0) AS total, coalesce(queued, 0) AS queued, coalesce(processing, 0) AS processing, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(canceled, 0) AS canceled,
        coalesce(completed + failed + canceled, 0) AS done FROM job_records j LEFT JOIN c ON c.job_id = j.job_id))""", "job_records"))
def agg_job_recompute(spark, sf_dir):
    return j.recompute(records(spark, sf_dir, "job_records"), records(spark, sf_dir, "item_records"))


@query(counted("SELECT job_id, CASE WHEN canceled > 0 THEN 'CANCELED' WHEN completed = 0 AND failed > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CAST(floor((completed + failed + canceled) * 100.0 / total) AS INTEGER) AS percent FROM c"))
def agg_sync_status(spark, sf_dir):
    return j.sync_status(records(spark, sf_dir, "item_records"))


@query(with_records("SELECT job_id, CAST(trunc(sum(CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELED') THEN 100 ELSE least(100, greatest(0, CAST(trunc(progress) AS INTEGER))) END) * 1.0 / count(*)) AS INTEGER) AS percent FROM item_records GROUP BY 1", "item_records"))
def agg_job_progress(spark, sf_dir):
    return j.job_progress(records(spark, sf_dir, "item_records"))


@query(with_records("SELECT job_id, CAST(floor(avg(CASE WHEN status = 'COMPLETED' THEN 100.0 ELSE progress END)) AS INTEGER) AS file_percent, CAST(floor(count(*) FILTER (status IN ('COMPLETED', 'FAILED')) * 100.0 / count(*)) AS INTEGER) AS batch_percent FROM item_records GROUP BY 1", "item_records"))
def agg_client_progress(spark, sf_dir):
    return j.client_progress(records(spark, sf_dir, "item_records"))


BARRIER = counted("""SELECT j.job_id, coalesce(completed + failed + canceled = total, true) AS all_over, coalesce(completed = total, true) AS all_succeeded, coalesce(failed > 0, false) AS any_failed,
    coalesce(20 + CAST(trunc((completed + failed + canceled) * 65.0 / total) AS INTEGER), 20) AS percent FROM job_records j LEFT JOIN c ON c.job_id = j.job_id""", "job_records")


@query(BARRIER)
def agg_infer_all(spark, sf_dir):
    return j.barrier(records(spark, sf_dir, "job_records"), records(spark, sf_dir, "item_records"))


@query(f"SELECT job_id, percent FROM ({BARRIER})")
def agg_infer_progress(spark, sf_dir):
    return j.barrier(records(spark, sf_dir, "job_records"), records(spark, sf_dir, "item_records")).select("job_id", "percent")


CLAIM = counted("""SELECT w.job_id, w.item_id, w.place FROM (SELECT job_id, item_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY queued_at, item_id) AS INTEGER) AS place FROM item_records WHERE status = 'QUEUED') w
    JOIN job_records j ON j.job_id = w.job_id JOIN c ON c.job_id = w.job_id WHERE NOT j.cancel_requested AND place <= parallelism - processing""", "job_records")


@query(counted("SELECT job_id, processing AS running FROM c"))
def agg_claim_count(spark, sf_dir):
    return j.state_counts(records(spark, sf_dir, "item_records")).select("job_id", F.col("processing").alias("running"))


@query(with_records("SELECT route, count(item_id) AS n FROM (VALUES ('api'), ('gpu'), ('cpu'), ('spare')) r(route) LEFT JOIN item_records ON status = 'QUEUED' AND route = CASE document_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'gpu' ELSE 'cpu' END GROUP BY 1", "item_records"))
def agg_queue_sizes(spark, sf_dir):
    route = F.when(F.col("document_id") % 3 == 0, "api").when(F.col("document_id") % 3 == 1, "gpu").otherwise("cpu")
    return j.queue_sizes(records(spark, sf_dir, "item_records"), ["api", "gpu", "cpu", "spare"], route)


TIMINGS = """SELECT item_id, job_id, status, CASE WHEN started_at IS NOT NULL THEN greatest(0, (started_at - queued_at) * 1000) END AS queue_ms,
    CASE WHEN started_at IS NOT NULL AND completed_at IS NOT NULL THEN greatest(0, (completed_at - started_at) * 1000) END AS processing_ms,
    CASE WHEN completed_at IS NOT NULL THEN greatest(0, (completed_at - queued_at) * 1000) END AS total_ms FROM item_records"""


@query(with_records(TIMINGS, "item_records"))
def prj_item_timing(spark, sf_dir):
    return j.item_timings(records(spark, sf_dir, "item_records"))


@query(with_records(f"SELECT status, min(total_ms) AS min_ms, round(avg(total_ms), 2) AS avg_ms, max(total_ms) AS max_ms FROM ({TIMINGS}) GROUP BY 1", "item_records"))
def agg_ms_stats(spark, sf_dir):
    return j.ms_stats(j.item_timings(records(spark, sf_dir, "item_records")), "total_ms", "status")


@query(with_records("""SELECT job_id % 50 AS model, good, round(CASE WHEN good > 0 THEN a ELSE b END, 6) AS mean, round(CASE WHEN good > 0 THEN sa ELSE sb END, 6) AS stdev FROM (
    SELECT job_id % 50 AS job_id, count(*) FILTER (status = 'COMPLETED') AS good, avg(progress) FILTER (status = 'COMPLETED') AS a, avg(progress) AS b, stddev_samp(progress) FILTER (status = 'COMPLETED') AS sa, stddev_samp(progress) AS sb FROM item_records GROUP BY 1)""", "item_records"))
def agg_repeat_stats(spark, sf_dir):
    rows = records(spark, sf_dir, "item_records").withColumn("model", F.col("job_id") % 50)
    return j.repeat_stats(rows, "progress", F.col("status") == "COMPLETED", "model").select("model", "good", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query(with_records("SELECT job_id % 20 AS run, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, round(count(*) FILTER (status = 'COMPLETED') * 60.0 / nullif(max(completed_at) - min(queued_at), 0), 6) AS docs_per_minute FROM item_records GROUP BY 1", "item_records"))
def agg_run_summary(spark, sf_dir):
    rows = records(spark, sf_dir, "item_records").groupBy((F.col("job_id") % 20).alias("run"))
    done = F.count_if(F.col("status") == "COMPLETED")
    return rows.agg(done.alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.round(F.try_divide(done * 60.0, F.max("completed_at") - F.min("queued_at")), 6).alias("docs_per_minute"))


@query(with_records("SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IN ('QUEUED', 'PROCESSING')) AS remaining, count(*) FILTER (status IN ('QUEUED', 'PROCESSING')) > 0 AS can_resume FROM item_records", "item_records"))
def agg_batch_status(spark, sf_dir):
    left = F.count_if(F.col("status").isin("QUEUED", "PROCESSING"))
    return records(spark, sf_dir, "item_records").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), left.alias("remaining"), (left > 0).alias("can_resume"))


@query(with_records("""SELECT e.event_id, e.created_at FROM event_records e LEFT JOIN job_records j ON j.job_id = e.job_id * 11 WHERE e.created_at > 50000 OR j.job_id IS NOT NULL AND NOT (j.cancel_requested AND j.created_at <= 50000)""", "event_records", "job_records"))
def st_retention(spark, sf_dir):
    events = records(spark, sf_dir, "event_records").withColumn("job_id", F.col("job_id") * 11)
    return j.retained(events, records(spark, sf_dir, "job_records"), 50_000, F.col("cancel_requested"), F.col("created_at")).select("event_id", "created_at")


MONOTONE = """, r AS (SELECT *, sum(CASE WHEN event_type = 'RETRY_REQUESTED' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM event_records WHERE item_id IS NOT NULL)
    SELECT event_id, item_id, max(value) OVER (PARTITION BY item_id, epoch ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM r"""


@query(with_records("", "event_records").rstrip() + MONOTONE)
def win_monotone(spark, sf_dir):
    events = records(spark, sf_dir, "event_records").filter("item_id IS NOT NULL")
    return j.monotone(events, "item_id", ["created_at", "event_id"], "value", F.col("event_type") == "RETRY_REQUESTED").select("event_id", "item_id", "progress")


@query(with_records("SELECT i.item_id, CASE WHEN j.cancel_requested AND i.status IN ('QUEUED', 'PROCESSING') THEN 'CANCELED' ELSE i.status END AS forced, CASE WHEN j.cancel_requested AND i.status = 'QUEUED' THEN 'CANCELED' ELSE i.status END AS status FROM item_records i JOIN job_records j ON i.job_id = j.job_id", "item_records", "job_records"))
def st_cancel(spark, sf_dir):
    rows = records(spark, sf_dir, "item_records").select("job_id", "item_id", "status").join(records(spark, sf_dir, "job_records").select("job_id", "cancel_requested"), "job_id")
    stop = lambda *states: F.when(F.col("cancel_requested") & F.col("status").isin(*states), "CANCELED").otherwise(F.col("status"))
    return rows.select("item_id", stop("QUEUED", "PROCESSING").alias("forced"), stop("QUEUED").alias("status"))


@query(with_records("SELECT item_id, retry_count FROM item_records WHERE started_at IS NULL AND retry_count <= 5", "item_records"))
def st_bounded_retry(spark, sf_dir):
    return records(spark, sf_dir, "item_records").filter("started_at IS NULL AND retry_count <= 5").select("item_id", "retry_count")


@query(with_records("SELECT job_id, item_id FROM item_records WHERE completed_at > 5000", "item_records"))
def flt_lease_active(spark, sf_dir):
    return records(spark, sf_dir, "item_records").filter(F.col("completed_at") > 5000).select("job_id", "item_id")


@query(with_records("SELECT document_id, updated_at FROM doc_records WHERE owner = 'u8' AND updated_at >= 2000", "doc_records"))
def flt_session_valid(spark, sf_dir):
    return records(spark, sf_dir, "doc_records").filter((F.col("owner") == "u8") & ~(F.col("updated_at") < 2000)).select("document_id", "updated_at")


@query(with_records("SELECT d.document_id, d.file_type, d.owner FROM doc_records d WHERE status = 'COMPLETED' AND output_path IS NOT NULL AND owner = 'u6' AND updated_at > 1000", "doc_records"))
def flt_cache_valid(spark, sf_dir):
    return records(spark, sf_dir, "doc_records").filter("status = 'COMPLETED' AND output_path IS NOT NULL AND owner = 'u6' AND updated_at > 1000").select("document_id", "file_type", "owner")


@query(with_records("SELECT document_id, output_path FROM doc_records WHERE status = 'COMPLETED' AND output_path IS NOT NULL", "doc_records"))
def flt_rag_ready(spark, sf_dir):
    return records(spark, sf_dir, "doc_records").filter((F.col("status") == "COMPLETED") & F.col("output_path").isNotNull()).select("document_id", "output_path")


@query(with_records("SELECT d.document_id, i.status AS item_status, coalesce(i.status, d.status) AS status FROM doc_records d LEFT JOIN (SELECT document_id, status FROM item_records QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY queued_at DESC, item_id DESC, status DESC) = 1) i ON d.document_id = i.document_id", "doc_records", "item_records"))
def jn_doc_sync(spark, sf_dir):
    last = records(spark, sf_dir, "item_records").groupBy("document_id").agg(F.max(F.struct("queued_at", "item_id", "status")).alias("x")).select("document_id", F.col("x.status").alias("item_status"))
    return records(spark, sf_dir, "doc_records").join(last, "document_id", "left").select("document_id", "item_status", F.coalesce("item_status", "status").alias("status"))


@query(with_records("SELECT job_id, item_id, created_at % 100 AS bucket, coalesce(CASE WHEN value > 50 THEN value END, 10 + value / 10) AS percent FROM event_records WHERE item_id IS NOT NULL", "event_records"))
def prj_ws_snapshot(spark, sf_dir):
    return records(spark, sf_dir, "event_records").filter("item_id IS NOT NULL").select("job_id", "item_id", (F.col("created_at") % 100).alias("bucket"), F.coalesce(F.when(F.col("value") > 50, F.col("value")), 10 + F.try_divide(F.col("value"), F.lit(10))).alias("percent"))
