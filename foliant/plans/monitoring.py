from pyspark.sql import functions as F

from foliant.operators import monitoring as m
from foliant.plans.bindings import records, table, with_records
from foliant.registry import query

LOOKUP = """SELECT e.event_id, e.item_id, e.job_id, i.document_id, i.status AS item_status, d.file_name, d.owner AS doc_owner, j.owner AS job_owner
    FROM event_records e LEFT JOIN item_records i ON e.item_id = i.item_id LEFT JOIN doc_records d ON i.document_id = d.document_id LEFT JOIN job_records j ON e.job_id = j.job_id"""
FEED = """, told AS (SELECT coalesce('item-' || item_id, 'err_event_' || sha256(event_id || '|' || coalesce(CAST(job_id AS VARCHAR), ''))[:16]) AS error_id, item_id,
        CASE WHEN event_type = 'FAILED' THEN 'error' ELSE 'warning' END AS severity, event_type AS kind, created_at AS occurred_at, event_id AS source_order FROM event_records WHERE event_type IN ('FAILED', 'RETRY_REQUESTED')),
    last AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY occurred_at DESC, source_order DESC) = 1),
    silent AS (SELECT 'item-' || item_id AS error_id, item_id, CASE WHEN status = 'FAILED' THEN 'error' ELSE 'warning' END AS severity, status AS kind, queued_at AS occurred_at, item_id AS source_order
        FROM item_records i WHERE (status = 'FAILED' OR status = 'QUEUED' AND (error_code IS NOT NULL OR error_message IS NOT NULL)) AND NOT EXISTS (SELECT 1 FROM told t WHERE t.item_id = i.item_id)),
    feed AS (SELECT error_id, item_id, severity, kind, occurred_at, source_order FROM last UNION ALL SELECT error_id, item_id, severity, kind, occurred_at, source_order FROM silent)
    """


def feed_sql(select: str) -> str:
    return with_records("", "event_records", "item_records").rstrip() + FEED + select


def _feed(spark, sf_dir):
    return m.error_feed(records(spark, sf_dir, "event_records"), records(spark, sf_dir, "item_records"))


@query(with_records(LOOKUP, "event_records", "item_records", "doc_records", "job_records"))
def jn_event_lookup(spark, sf_dir):
    return m.lookup_events(*(records(spark, sf_dir, n) for n in ("event_records", "item_records", "doc_records", "job_records"))).select("event_id", "item_id", "job_id", "document_id", "item_status", "file_name", "doc_owner", "job_owner")


@query(with_records("""SELECT i.item_id, coalesce(error_message, error_code, 'unknown error') AS message, d.file_name, j.owner FROM item_records i LEFT JOIN doc_records d ON i.document_id = d.document_id
    LEFT JOIN job_records j ON i.job_id = j.job_id WHERE i.status = 'FAILED' OR i.status = 'QUEUED' AND (error_code IS NOT NULL OR error_message IS NOT NULL)""", "item_records", "doc_records", "job_records"))
def jn_item_lookup(spark, sf_dir):
    wrong = records(spark, sf_dir, "item_records").filter(m.has_error())
    out = wrong.join(records(spark, sf_dir, "doc_records").select("document_id", "file_name"), "document_id", "left").join(records(spark, sf_dir, "job_records").select("job_id", "owner"), "job_id", "left")
    return out.select("item_id", m.error_text(F.col("error_code"), F.col("error_message")).alias("message"), "file_name", "owner")


@query(feed_sql("SELECT error_id, severity, kind, occurred_at FROM feed"))
def set_union_errors(spark, sf_dir):
    return _feed(spark, sf_dir).select("error_id", "severity", "kind", "occurred_at")


@query(feed_sql("SELECT error_id, occurred_at FROM silent"))
def jn_error_anti(spark, sf_dir):
    events, items = records(spark, sf_dir, "event_records"), records(spark, sf_dir, "item_records")
    told = m.event_errors(events).select("item_id").filter("item_id IS NOT NULL").distinct()
    return m.item_errors(items).join(told, "item_id", "left_anti").select("error_id", "occurred_at")


@query(feed_sql("SELECT severity, kind, count(*) AS n FROM feed GROUP BY 1, 2"))
def agg_error_types(spark, sf_dir):
    return _feed(spark, sf_dir).groupBy("severity", "kind").agg(F.count("*").alias("n"))


@query(feed_sql("SELECT error_id, occurred_at, severity FROM feed ORDER BY occurred_at DESC, error_id LIMIT 50"))
def srt_errors(spark, sf_dir):
    return m.newest(_feed(spark, sf_dir).select("error_id", "occurred_at", "severity"), [F.desc("occurred_at"), F.col("error_id")], 50)


@query(feed_sql("SELECT error_id, occurred_at, (SELECT count(*) FROM feed WHERE severity = 'warning') AS total FROM feed WHERE severity = 'warning' ORDER BY occurred_at DESC, error_id LIMIT 20 OFFSET 40"))
def pg_offset(spark, sf_dir):
    rows = m.equal_filters(_feed(spark, sf_dir), severity="warning").select("error_id", "occurred_at")
    return m.page(rows, [F.desc("occurred_at"), F.col("error_id")], 40, 20)


@query(with_records("SELECT item_id, status FROM item_records WHERE status = 'FAILED' AND (contains(lower(coalesce(error_message, '')), 'part 1') OR contains(lower(coalesce(error_code, '')), 'part 1'))", "item_records"))
def flt_error_search(spark, sf_dir):
    return m.equal_filters(records(spark, sf_dir, "item_records"), status="FAILED").filter(m.any_contains("PART 1", "error_message", "error_code")).select("item_id", "status")


@query(with_records("SELECT event_id, source_type FROM event_records WHERE event_type = 'FAILED' AND job_id = 3", "event_records"))
def flt_audit(spark, sf_dir):
    return m.equal_filters(records(spark, sf_dir, "event_records"), event_type="FAILED", job_id=3, item_id=None).select("event_id", "source_type")


@query("SELECT event_id FROM events WHERE contains(lower(event_type), 'pur') OR contains(lower(props), '\"k\": 7')")
def flt_admin_search(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.filter(m.any_contains("pur", "event_type") | m.any_contains('"k": 7', "props")).select("event_id")


@query(with_records("SELECT document_id, owner FROM doc_records WHERE owner = 'u7'", "doc_records"))
def flt_owner(spark, sf_dir):
    return m.owned_by(records(spark, sf_dir, "doc_records"), "u7", "owner").select("document_id", "owner")


@query(with_records("SELECT i.item_id FROM item_records i LEFT JOIN doc_records d ON i.document_id = d.document_id LEFT JOIN job_records j ON i.job_id = j.job_id WHERE d.owner = 'u7' OR j.owner = 'u7' OR d.owner IS NULL AND j.owner IS NULL", "item_records", "doc_records", "job_records"))
def flt_monitor_visible(spark, sf_dir):
    rows = records(spark, sf_dir, "item_records").select("item_id", "document_id", "job_id").join(records(spark, sf_dir, "doc_records").select("document_id", F.col("owner").alias("doc_owner")), "document_id", "left").join(records(spark, sf_dir, "job_records").select("job_id", F.col("owner").alias("job_owner")), "job_id", "left")
    return m.visible_to(rows, "u7", "doc_owner", "job_owner").select("item_id")


@query(with_records("SELECT document_id FROM doc_records WHERE document_id IN (8, 12, 20) AND (owner = 'u8' OR owner IS NULL)", "doc_records"))
def flt_access(spark, sf_dir):
    rows = records(spark, sf_dir, "doc_records").filter(F.col("document_id").isin(8, 12, 20))
    return m.visible_to(rows, "u8", "owner").select("document_id")


@query(with_records("SELECT event_id, created_at FROM event_records ORDER BY created_at DESC, event_id DESC LIMIT 100", "event_records"))
def srt_audit(spark, sf_dir):
    return m.newest(records(spark, sf_dir, "event_records").select("event_id", "created_at"), [F.desc("created_at"), F.desc("event_id")], 100)


@query(with_records("SELECT document_id, owner, updated_at FROM doc_records ORDER BY owner ASC NULLS LAST, updated_at DESC NULLS FIRST, document_id LIMIT 60", "doc_records"))
def srt_admin_multi(spark, sf_dir):
    return m.newest(records(spark, sf_dir, "doc_records").select("document_id", "owner", "updated_at"), [F.asc_nulls_last("owner"), F.desc_nulls_first("updated_at"), F.col("document_id")], 60)


@query(with_records("SELECT job_id, created_at FROM job_records ORDER BY created_at DESC, job_id DESC LIMIT 8", "job_records"))
def srt_recent_entries(spark, sf_dir):
    return m.newest(records(spark, sf_dir, "job_records").select("job_id", "created_at"), [F.desc("created_at"), F.desc("job_id")], 8)


@query(with_records("SELECT document_id, created_at FROM (SELECT document_id, uploaded_at AS created_at FROM doc_records) ORDER BY document_id LIMIT 25 OFFSET 50", "doc_records"))
def pg_client(spark, sf_dir):
    return records(spark, sf_dir, "doc_records").select("document_id", F.col("uploaded_at").alias("created_at")).orderBy("document_id").offset(50).limit(25)


@query(with_records("SELECT job_id, event_id, from_end FROM (SELECT job_id, event_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, event_id DESC) AS INTEGER) AS from_end FROM event_records) WHERE from_end <= 20", "event_records"))
def win_last_n(spark, sf_dir):
    return m.last_per_key(records(spark, sf_dir, "event_records"), "job_id", [F.desc("created_at"), F.desc("event_id")], 20).select("job_id", "event_id", "from_end")
