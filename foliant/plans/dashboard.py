from foliant.operators import dashboard as d
from foliant.plans.bindings import records, table, with_records
from foliant.registry import query


@query(with_records("SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IS NULL OR status NOT IN ('COMPLETED', 'FAILED', 'CANCELED')) AS processing FROM doc_records", "doc_records"))
def agg_doc_summary(spark, sf_dir):
    return d.document_summary(records(spark, sf_dir, "doc_records"))


@query(with_records("SELECT coalesce(nullif(file_type, ''), 'unknown') AS file_type, count(*) AS n FROM doc_records GROUP BY 1", "doc_records"))
def agg_file_types(spark, sf_dir):
    return d.file_types(records(spark, sf_dir, "doc_records"))


@query(with_records("SELECT document_id, coalesce(updated_at, uploaded_at, 0) AS last_at, status FROM doc_records ORDER BY last_at DESC, document_id DESC LIMIT 10", "doc_records"))
def top_recent_docs(spark, sf_dir):
    return d.recent_documents(records(spark, sf_dir, "doc_records"))


@query(with_records("SELECT document_id, coalesce(updated_at, uploaded_at, 0) AS last_at, status FROM doc_records", "doc_records"))
def srt_documents(spark, sf_dir):
    return d.recent_documents(records(spark, sf_dir, "doc_records"), None)


SHOWN = """SELECT document_id, file_name, file_type, CASE WHEN document_id % 3 = 0 THEN file_name || '.V2.PDF' WHEN document_id % 3 = 1 THEN '' END AS source_name, CASE WHEN document_id % 2 = 0 THEN 'hwp' END AS source_type,
    CASE WHEN document_id % 11 = 0 THEN 'GPU_WAITING' WHEN document_id % 13 = 0 THEN 'PREPROCESSING' ELSE status END AS status, CAST(progress / 10 - 100 AS INTEGER) AS percent, updated_at % 60 AS pages_done, CASE WHEN document_id % 5 = 0 THEN uploaded_at % 50 END AS pages FROM doc_records"""


def _shown(spark, sf_dir):
    records(spark, sf_dir, "doc_records").createOrReplaceTempView("doc_records_shown")
    return spark.sql(SHOWN.replace("FROM doc_records", "FROM doc_records_shown").replace("CAST(progress / 10 - 100 AS INTEGER)", "CAST(round(progress / 10 - 100) AS INTEGER)"))


def _display(states: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in states.items())
    kind = "CASE WHEN source_name <> '' THEN coalesce(source_type, 'pdf') ELSE file_type END"
    return with_records(f"SELECT document_id, CASE WHEN source_name <> '' THEN source_name ELSE file_name END AS file_name, {kind} AS file_type, least(100, greatest(0, coalesce(CASE WHEN pages > 0 THEN CAST(trunc(pages_done * 100.0 / pages) AS INTEGER) END, percent, CASE coalesce(status, 'UPLOADED') {cases} END, 0))) AS progress FROM ({SHOWN})", "doc_records")


@query(_display(d.DISPLAY_PROGRESS))
def prj_doc_display(spark, sf_dir):
    return d.for_display(_shown(spark, sf_dir))


@query(_display(d.PARSER_PROGRESS))
def prj_doc_progress(spark, sf_dir):
    return d.for_display(_shown(spark, sf_dir), d.PARSER_PROGRESS)


@query(with_records("SELECT status, n, round(n * 100.0 / sum(n) OVER (), 1) AS percent FROM (SELECT status, count(*) AS n FROM doc_records WHERE status IS NOT NULL GROUP BY 1)", "doc_records"))
def agg_success_rate(spark, sf_dir):
    return d.success_rate(records(spark, sf_dir, "doc_records"))


@query("""SELECT CAST(day AS DATE) AS day, strftime(day, '%-m/%d') AS label, count(event_id) AS n
    FROM generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY) s(day) LEFT JOIN events ON CAST(ts AS DATE) = CAST(day AS DATE) GROUP BY 1, 2""")
def agg_trend7(spark, sf_dir):
    return d.daily_trend(table(spark, sf_dir, "events"), "ts", "2024-02-02")


@query("SELECT 'documents' AS store, count(*) AS n FROM part UNION ALL SELECT 'jobs', count(*) FROM orders UNION ALL SELECT 'items', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def agg_counts_overview(spark, sf_dir):
    return d.store_counts({"documents": records(spark, sf_dir, "doc_records"), "jobs": records(spark, sf_dir, "job_records"), "items": records(spark, sf_dir, "item_records"), "events": records(spark, sf_dir, "event_records")})
