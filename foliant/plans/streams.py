from pyspark.sql import functions as F

from foliant.plans.bindings import table, with_records
from foliant.registry import query
from foliant.streaming import events as ev
from foliant.streaming import items


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windowed_counts(spark, sf_dir):
    """The stream's windows of a day, complete after all that is there has been read."""
    done = ev.run_once(ev.windowed_counts(_stream(spark, sf_dir), "1 day", "10 minutes"), "complete")
    return done.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, user_id % 4 AS part, count(*) AS n, max(event_id) AS last_id FROM events WHERE value > 10 GROUP BY 1, 2")
def st_progress_bus(spark, sf_dir):
    """Progress of each topic as its subscribers see it: filtered, then folded by key."""
    rows = _stream(spark, sf_dir).filter("value > 10").groupBy("event_type", (F.col("user_id") % 4).alias("part")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return ev.run_once(rows, "complete")


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def st_idempotent(spark, sf_dir):
    """Tasks with deterministic keys, of a day each: repeats are dropped by state, which the watermark lets go."""
    rows = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    rows = rows.withColumn("day", F.to_date("ts")).dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])
    return ev.run_once(rows.select("user_id", "event_type", "day"), "append")


@query("SELECT user_id AS key, last(value ORDER BY event_id) AS value, last(event_type ORDER BY event_id) FILTER (event_type <> 'view') AS kind FROM events GROUP BY 1")
def st_client_merge(spark, sf_dir):
    """The latest known value of each field by key; nulls do not overwrite. A running fold of the stream."""
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    rows = _stream(spark, sf_dir).groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", "event_id").alias("value"), F.max_by(kind, F.when(kind.isNotNull(), F.col("event_id"))).alias("kind"))
    return ev.run_once(rows, "update", ["key"])


KINDS = {"signup": "COMPLETED", "error": "FAILED", "click": "PROGRESS", "purchase": "RETRY_REQUESTED", "view": "STARTED"}
TTL, RETRIES = 20_000, 3


def _events(spark, sf_dir):
    """Events of items; some have no item."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type")), F.upper("event_type"))
    item = F.when(F.col("event_id") % 19 != 0, F.col("user_id"))
    return _stream(spark, sf_dir).select(item.alias("item_id"), (F.col("event_id") * 7919 % 100003).alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), F.col("value").cast("double").alias("value"))


def _ended(spark, sf_dir):
    return ev.run_once(items.lives(_events(spark, sf_dir), "item_id"), "update", ["item_id"])


FINAL = with_records("", "event_records").rstrip() + """, t AS (SELECT *, CASE WHEN source_type = 'signup' THEN 'COMPLETED' ELSE event_type END AS kind FROM event_records WHERE item_id IS NOT NULL),
    w AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('COMPLETED', 'FAILED', 'CANCELED') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM t)
    SELECT item_id, max(kind) FILTER (ended = 0 AND kind IN ('COMPLETED', 'FAILED', 'CANCELED')) AS ended_as, count(*) FILTER (ended = 0 AND kind = 'RETRY_REQUESTED') AS retries, count(*) FILTER (ended > 0) AS late FROM w GROUP BY 1"""


@query(FINAL)
def st_final(spark, sf_dir):
    """The first end of each item, and the retries before it."""
    over = F.when(F.col("status").isin(*items.TERMINAL), F.col("status"))
    return _ended(spark, sf_dir).select("item_id", over.alias("ended_as"), "retries", "late")


@query(f"SELECT item_id, late FROM ({FINAL}) WHERE late > 0")
def st_late_drop(spark, sf_dir):
    """Events that came after an item's end and changed nothing."""
    return _ended(spark, sf_dir).select("item_id", "late").filter("late > 0")



OVER = "IN ('COMPLETED', 'FAILED', 'CANCELED')"
OUT = "(s.status = 'PROCESSING' AND s.expires < e.tm)"
AGAIN = f"({OUT} AND s.retries < {RETRIES})"
STATUS = f"(CASE WHEN {AGAIN} THEN 'QUEUED' WHEN {OUT} THEN 'FAILED' ELSE s.status END)"
PROGRESS = f"(CASE WHEN {AGAIN} THEN 0 ELSE s.progress END)"
RUNS = f"({STATUS} = 'PROCESSING')"
LIVES = f"""WITH ev AS (SELECT user_id AS item_id, event_id * 7919 % 100003 AS tm, event_id AS id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE upper(event_type) END AS kind, CAST(value AS DOUBLE) AS value FROM events WHERE event_id % 19 <> 0),
    l AS (SELECT item_id, list({{'tm': tm, 'kind': kind, 'value': value, 'status': 'QUEUED', 'progress': 0::BIGINT, 'retries': 0::BIGINT, 'refused': 0::BIGINT, 'late': 0::BIGINT, 'timeouts': 0::BIGINT, 'expires': NULL::BIGINT}} ORDER BY tm, id) AS es FROM ev GROUP BY 1),
    r AS (SELECT item_id, list_reduce(list_prepend({{'tm': -1::BIGINT, 'kind': '', 'value': 0::DOUBLE, 'status': 'QUEUED', 'progress': 0::BIGINT, 'retries': 0::BIGINT, 'refused': 0::BIGINT, 'late': 0::BIGINT, 'timeouts': 0::BIGINT, 'expires': NULL::BIGINT}}, es), lambda s, e: {{'tm': e.tm, 'kind': e.kind, 'value': e.value,
        'status': CASE WHEN {STATUS} {OVER} THEN {STATUS} WHEN e.kind {OVER} THEN e.kind WHEN e.kind = 'STARTED' THEN 'PROCESSING' WHEN e.kind = 'RETRY_REQUESTED' AND {RUNS} THEN 'QUEUED' ELSE {STATUS} END,
        'progress': CASE WHEN {STATUS} {OVER} THEN {PROGRESS} WHEN e.kind {OVER} THEN 100 WHEN e.kind = 'STARTED' AND NOT {RUNS} THEN greatest(5, {PROGRESS}) WHEN e.kind = 'PROGRESS' AND {RUNS} THEN greatest({PROGRESS}, least(100, CAST(trunc(e.value) AS BIGINT))) WHEN e.kind = 'RETRY_REQUESTED' AND {RUNS} THEN 0 ELSE {PROGRESS} END,
        'retries': s.retries + CAST({AGAIN} AS BIGINT) + CAST(e.kind = 'RETRY_REQUESTED' AND {RUNS} AS BIGINT),
        'refused': s.refused + CAST(NOT {STATUS} {OVER} AND NOT e.kind {OVER} AND NOT (e.kind = 'STARTED' AND NOT {RUNS} OR e.kind IN ('PROGRESS', 'RETRY_REQUESTED') AND {RUNS}) AS BIGINT),
        'late': s.late + CAST({STATUS} {OVER} AS BIGINT), 'timeouts': s.timeouts + CAST(coalesce({OUT}, false) AS BIGINT),
        'expires': CASE WHEN {STATUS} {OVER} OR e.kind {OVER} THEN NULL WHEN e.kind = 'STARTED' AND NOT {RUNS} OR e.kind = 'PROGRESS' AND {RUNS} THEN e.tm + {TTL} WHEN e.kind = 'RETRY_REQUESTED' AND {RUNS} THEN NULL WHEN coalesce({OUT}, false) THEN NULL ELSE s.expires END}}) AS x FROM l)
    SELECT item_id, @ FROM r"""


def _lives(spark, sf_dir):
    return ev.run_once(items.lives(_events(spark, sf_dir), "item_id", TTL, RETRIES), "update", ["item_id"])


@query(LIVES.replace("@", "x.status AS status, x.refused AS refused"))
def st_claim(spark, sf_dir):
    """Items after claims that only queued ones accept."""
    return _lives(spark, sf_dir).select("item_id", "status", "refused")


@query(LIVES.replace("@", "x.progress AS progress, x.retries AS retries"))
def st_progress(spark, sf_dir):
    """Progress that never falls within an attempt, and the attempts."""
    return _lives(spark, sf_dir).select("item_id", "progress", "retries")


@query(LIVES.replace("@", "x.expires AS expires"))
def st_lease(spark, sf_dir):
    """When the leases of running items end, renewed by their progress."""
    return _lives(spark, sf_dir).select("item_id", "expires")


@query(LIVES.replace("@", "x.timeouts AS timeouts, x.late AS late"))
def st_timeout(spark, sf_dir):
    """Attempts whose lease ran out, after which an item was queued again or failed."""
    return _lives(spark, sf_dir).select("item_id", "timeouts", "late")
