"""Stores of keyed records and blobs, catalogs, queues and append-only logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.plans.bindings import records, table, with_records
from foliant.registry import query


def upsert(old, new, key):
    """old with the rows of new in place of those of the same key: an anti-join and a union, no rewrite of a whole row."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


@query("SELECT 'customer' AS namespace, CAST(c_custkey AS VARCHAR) AS entry_key, c_name AS name FROM customer ORDER BY 2")
def src_kv(spark, sf_dir):
    """A namespace's entries in the order of their keys, decoded from JSON."""
    stored = table(spark, sf_dir, "customer").select(F.lit("customer").alias("namespace"), F.col("c_custkey").cast("string").alias("entry_key"), F.to_json(F.struct("c_name", "c_acctbal")).alias("value"))
    return stored.filter("namespace = 'customer'").select("namespace", "entry_key", F.from_json("value", "c_name string")["c_name"].alias("name")).orderBy("entry_key")


@query("SELECT page_id AS file_id, octet_length(encode(html)) AS size_bytes, sha256(html) AS sha256 FROM pages")
def src_blob(spark, sf_dir):
    """Blobs encrypted with their id as additional data, decrypted again, with size and digest."""
    key, aad = F.lit("0123456789abcdef"), F.concat(F.lit("stored-file:"), F.col("page_id").cast("string"))
    blobs = table(spark, sf_dir, "pages").select("page_id", F.aes_encrypt(F.encode("html", "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad).alias("payload"), aad.alias("aad"))
    plain = F.aes_decrypt("payload", key, F.lit("GCM"), F.lit("DEFAULT"), F.col("aad"))
    return blobs.select(F.col("page_id").alias("file_id"), F.octet_length(plain).cast("long").alias("size_bytes"), F.sha2(plain, 256).alias("sha256"))


@query("SELECT l_orderkey, l_linenumber, coalesce(a.p_name, b.p_name, 'path') AS asset FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey * 3 LEFT JOIN part b ON b.p_partkey = l_suppkey * 15")
def src_asset(spark, sf_dir):
    """A record's file by its id, else by its original's id, else by its path."""
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 3).alias("k"), (F.col("l_suppkey") * 15).alias("o"))
    rows = rows.join(part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")), "k", "left").join(part.select(F.col("p_partkey").alias("o"), F.col("p_name").alias("b")), "o", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("a", "b", F.lit("path")).alias("asset"))


@query("SELECT coalesce(o.k, n.k) AS model, coalesce(n.v, o.v) AS name, n.k IS NOT NULL AS is_active FROM (SELECT p_brand AS k, min(p_name) AS v FROM part WHERE p_size < 30 GROUP BY 1) o FULL JOIN (SELECT p_brand AS k, max(p_name) AS v FROM part WHERE p_size > 45 GROUP BY 1) n ON o.k = n.k")
def src_catalog(spark, sf_dir):
    """A catalog after its seed: known models are updated, new ones added, others switched off."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_size < 30").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_name").alias("o"))
    new = part.filter("p_size > 45").groupBy(F.col("p_brand").alias("model")).agg(F.max("p_name").alias("n"))
    return old.join(new, "model", "full").select("model", F.coalesce("n", "o").alias("name"), F.col("n").isNotNull().alias("is_active"))


@query(with_records("SELECT model AS route, job_id, CAST(row_number() OVER (PARTITION BY model ORDER BY created_at, job_id) AS INTEGER) AS place FROM job_records", "job_records"))
def src_queue(spark, sf_dir):
    """Messages of each route, first in first out."""
    order = Window.partitionBy("model").orderBy("created_at", "job_id")
    return records(spark, sf_dir, "job_records").select(F.col("model").alias("route"), "job_id", F.row_number().over(order).alias("place"))


@query(with_records("SELECT model AS route, job_id, row_number() OVER (ORDER BY place, model) AS turn FROM (SELECT model, job_id, row_number() OVER (PARTITION BY model ORDER BY created_at, job_id) AS place FROM job_records)", "job_records"))
def st_round_robin(spark, sf_dir):
    """The messages of all routes, taken from the routes in turn. A message's turn follows from its place and the routes'
    sizes, one row of all of which is joined, so that no task numbers all messages."""
    queued = src_queue(spark, sf_dir)
    sizes = queued.groupBy("route").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("route", "n")).alias("sizes"))
    before = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, r: a + F.least(r["n"], F.col("place") - 1) + F.when((r["route"] <= F.col("route")) & (r["n"] >= F.col("place")), 1).otherwise(0))
    return queued.join(F.broadcast(sizes)).select("route", "job_id", before.alias("turn"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sink_delete(spark, sf_dir):
    """What stays after records and what hangs on them are deleted."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(gone, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'signup' OR event_id IN (SELECT max(event_id) FROM events WHERE event_type = 'signup' GROUP BY user_id)")
def st_revoke(spark, sf_dir):
    """Sessions after all of a user's but the last are revoked."""
    events = table(spark, sf_dir, "events")
    keep = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    gone = events.filter("event_type = 'signup'").join(keep, ["user_id", "event_id"], "left_anti").select("event_id")
    return events.join(gone, "event_id", "left_anti").select("user_id", "event_id")


@query(with_records("SELECT job_id, count(*) AS tasks, count(*) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELED')) AS done, count(*) = count(*) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELED')) AS finalize FROM item_records GROUP BY 1", "item_records"))
def st_fanout_fanin(spark, sf_dir):
    """The barrier of a job's tasks: it may be finalized when all are over."""
    done = F.count_if(F.col("status").isin("COMPLETED", "FAILED", "CANCELED"))
    return records(spark, sf_dir, "item_records").groupBy("job_id").agg(F.count("*").alias("tasks"), done.alias("done"), (F.count("*") == done).alias("finalize"))


@query(with_records("""SELECT i.item_id, CASE WHEN i.status = 'PROCESSING' AND l.item_id IS NULL THEN 'retry' WHEN i.status = 'PROCESSING' AND l.expires <= 6000 THEN 'requeue' ELSE 'leave' END AS action
    FROM item_records i LEFT JOIN (SELECT item_id, max(queued_at + 500) AS expires FROM item_records WHERE retry_count % 2 = 0 GROUP BY 1) l ON l.item_id = i.item_id""", "item_records"))
def st_recovery(spark, sf_dir):
    """What becomes of items: running ones without a lease are tried again, those whose lease ran out are queued again."""
    items = records(spark, sf_dir, "item_records")
    leases = items.filter("retry_count % 2 = 0").groupBy("item_id").agg(F.max(F.col("queued_at") + 500).alias("expires"))
    runs = F.col("status") == "PROCESSING"
    return items.join(leases, "item_id", "left").select("item_id", F.when(runs & F.col("expires").isNull(), "retry").when(runs & (F.col("expires") <= 6000), "requeue").otherwise("leave").alias("action"))


@query(with_records("SELECT job_id, max(document_id) AS resume_from, count(*) AS done FROM item_records WHERE status = 'COMPLETED' GROUP BY 1", "item_records"))
def st_resume(spark, sf_dir):
    """Where each job goes on: after the last document that was completed."""
    return records(spark, sf_dir, "item_records").filter("status = 'COMPLETED'").groupBy("job_id").agg(F.max("document_id").alias("resume_from"), F.count("*").alias("done"))
