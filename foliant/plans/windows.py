"""Window-like operators: ranks, overlaps, paging, gaps, and cells of pages that are done."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.plans.bindings import records, table, with_records
from foliant.registry import query

WITHIN = "PARTITION BY conv_id ORDER BY turn"


@query("SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS INTEGER) AS rank FROM embeddings")
def win_rank(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id"))).alias("rank"))


@query(f"SELECT conv_id, turn, CASE WHEN lag(text) OVER ({WITHIN}) IS NULL THEN text ELSE right(lag(text) OVER ({WITHIN}), 50) || chr(10) || chr(10) || text END AS chunk FROM conversations")
def win_overlap(spark, sf_dir):
    """Each turn begins with the last 50 characters of the plain one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.right(before, F.lit(50)), F.lit("\n\n"), F.col("text"))).alias("chunk"))


@query("SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS chunk_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def win_chunk_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "line"))


@query("SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done, count(*) = count(*) FILTER (l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1")
def win_pages_done(spark, sf_dir):
    done = F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), done.alias("done"), (F.count("*") == done).alias("complete"))


@query("SELECT label, min(rank) FILTER (vec_id % 7 = 0) AS first_relevant FROM (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings) GROUP BY 1")
def win_first_relevant(spark, sf_dir):
    ranked = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return ranked.groupBy("label").agg(F.min(F.when(F.col("vec_id") % 7 == 0, F.col("rank"))).alias("first_relevant"))


@query(with_records("""SELECT event_id, item_id, max(CASE event_type WHEN 'VIEW' THEN 1 WHEN 'PROGRESS' THEN 2 WHEN 'SIGNUP' THEN 3 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS stage FROM event_records WHERE item_id IS NOT NULL""", "event_records"))
def win_stage_forward(spark, sf_dir):
    """The furthest stage so far; progress never takes an item back."""
    order = F.when(F.col("event_type") == "VIEW", 1).when(F.col("event_type") == "PROGRESS", 2).when(F.col("event_type") == "SIGNUP", 3).otherwise(0)
    w = Window.partitionBy("item_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return records(spark, sf_dir, "event_records").filter("item_id IS NOT NULL").select("event_id", "item_id", F.max(order).over(w).alias("stage"))


@query("SELECT doc_id, CASE WHEN len(ls) = 0 THEN 0 ELSE length(array_to_string(ls, chr(10) || chr(10))) END AS size FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)")
def agg_doc_text_rebuild(spark, sf_dir):
    """A document's text from its chunks: gathered by document in their order, joined by blank lines."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "chunk"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: F.btrim(x["chunk"]) != "")
    return parts.groupBy("doc_id").agg(kept.alias("x")).select("doc_id", F.length(F.array_join(F.transform("x", lambda y: y["chunk"]), "\n\n")).cast("long").alias("size"))


@query("SELECT user_id, grp AS session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2")
def win_gap_sessions(spark, sf_dir):
    """Runs of a user's events with gaps of six hours at most (an extension: the plain-gap form of clustering)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL '6' HOUR")), 1).otherwise(0)
    rows = table(spark, sf_dir, "events").withColumn("new", new)
    return rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def win_tumbling_day(spark, sf_dir):
    """Counts of each day's window (an extension; the stream form is in foliant.streaming)."""
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")
