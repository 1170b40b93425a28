"""Roll-ups, rules and states of processing jobs and their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED", "CANCELED")


def state_counts(items: DataFrame) -> DataFrame:
    """Items of each job by state, in one aggregation."""
    return items.groupBy("job_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATES])


def recompute(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Status and progress of each job from its items' states.

    All done: canceled if all are, failed if some failed and none was completed or canceled, else completed. Not all done:
    canceled if that was asked for and none waits or runs, processing if any runs, else queued. A job without items is
    queued. Progress is the whole percent of items done, 100 once the job is over.
    """
    c = jobs.select("job_id", "cancel_requested").join(state_counts(items), "job_id", "left").fillna(0)
    done = F.col("completed") + F.col("failed") + F.col("canceled")
    over = (F.col("total") > 0) & (done >= F.col("total"))
    ended = F.when(F.col("canceled") == F.col("total"), "CANCELED").when((F.col("completed") == 0) & (F.col("failed") > 0) & (F.col("canceled") == 0), "FAILED").otherwise("COMPLETED")
    idle = (F.col("queued") + F.col("processing")) == 0
    status = F.when(over, ended).when(F.col("cancel_requested") & idle, "CANCELED").when(F.col("processing") > 0, "PROCESSING").otherwise("QUEUED")
    percent = F.when(over, 100).otherwise(F.coalesce(F.try_divide(done * 100, F.col("total")).cast("int"), F.lit(0)))
    return c.select("job_id", "total", status.alias("status"), F.when(status.isin("COMPLETED", "FAILED", "CANCELED"), 100).otherwise(percent).alias("progress"))


def sync_status(items: DataFrame) -> DataFrame:
    """The rule of conversions that are waited for: canceled if any item is, failed if none was completed and some failed."""
    c = state_counts(items)
    status = F.when(F.col("canceled") > 0, "CANCELED").when((F.col("completed") == 0) & (F.col("failed") > 0), "FAILED").otherwise("COMPLETED")
    return c.select("job_id", status.alias("status"), F.floor(F.try_divide((F.col("completed") + F.col("failed") + F.col("canceled")) * 100, F.col("total"))).cast("int").alias("percent"))


def job_progress(items: DataFrame) -> DataFrame:
    """The whole mean of the items' percents: 100 for those that are over, the stored one from 0 to 100 for the others."""
    one = F.when(F.col("status").isin("COMPLETED", "FAILED", "CANCELED"), 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.col("progress").cast("int"), F.lit(0)))))
    return items.groupBy("job_id").agg(F.try_divide(F.sum(one), F.count("*")).cast("int").alias("percent"))


def client_progress(items: DataFrame) -> DataFrame:
    """What the client shows: the floored mean of percents, and the floored share of items completed or failed."""
    one = F.when(F.col("status") == "COMPLETED", 100.0).otherwise(F.coalesce("progress", F.lit(0.0)))
    return items.groupBy("job_id").agg(F.floor(F.avg(one)).cast("int").alias("file_percent"), F.floor(F.count_if(F.col("status").isin("COMPLETED", "FAILED")) * 100 / F.count("*")).cast("int").alias("batch_percent"))


def barrier(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Whether all tasks of a job are over, all succeeded, any failed; of no tasks all are. And the staged percent,
    20 + 65 * the share that is over."""
    over = F.col("status").isin("COMPLETED", "FAILED", "CANCELED")
    some = items.groupBy("job_id").agg(F.bool_and(over).alias("all_over"), F.bool_and(F.col("status") == "COMPLETED").alias("all_succeeded"), F.bool_or(F.col("status") == "FAILED").alias("any_failed"), (F.lit(20) + F.try_divide(F.count_if(over) * 65, F.count("*")).cast("int")).alias("percent"))
    out = jobs.select("job_id").join(some, "job_id", "left")
    return out.select("job_id", F.coalesce("all_over", F.lit(True)).alias("all_over"), F.coalesce("all_succeeded", F.lit(True)).alias("all_succeeded"), F.coalesce("any_failed", F.lit(False)).alias("any_failed"), F.coalesce("percent", F.lit(20)).alias("percent"))


def claimable(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Queued items that may be claimed now: the first of a job, as many as its parallelism leaves beside those that run."""
    running = items.groupBy("job_id").agg(F.count_if(F.col("status") == "PROCESSING").alias("running"))
    waiting = items.filter(F.col("status") == "QUEUED").withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("queued_at", "item_id")))
    free = jobs.filter(~F.col("cancel_requested")).join(running, "job_id").select("job_id", (F.col("parallelism") - F.col("running")).alias("free"))
    return waiting.join(free, "job_id").filter(F.col("place") <= F.col("free")).select("job_id", "item_id", "place")


def queue_sizes(items: DataFrame, routes: list[str], route: Column) -> DataFrame:
    """Waiting items of each route; a route without any is zero."""
    spark = items.sparkSession
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, routes))).alias("route"))
    sizes = items.filter(F.col("status") == "QUEUED").groupBy(route.alias("route")).agg(F.count("*").alias("n"))
    return known.join(sizes, "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"))


def milliseconds(start: Column, end: Column) -> Column:
    """From start to end in whole milliseconds, not below zero; null if either is."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), ((end - start) * 1000).cast("long")))


def item_timings(items: DataFrame) -> DataFrame:
    q, s, c = F.col("queued_at"), F.col("started_at"), F.col("completed_at")
    return items.select("item_id", "job_id", "status", milliseconds(q, s).alias("queue_ms"), milliseconds(s, c).alias("processing_ms"), milliseconds(q, c).alias("total_ms"))


def ms_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least, mean to two places and greatest; nulls are left out."""
    return rows.groupBy(*keys).agg(F.min(value).alias("min_ms"), F.round(F.avg(value), 2).alias("avg_ms"), F.max(value).alias("max_ms"))


def repeat_stats(rows: DataFrame, value: str, ok: Column, *keys: str) -> DataFrame:
    """Mean, sample deviation, least and greatest by keys over the rows that went well; over all where none did. One
    aggregation holds both."""
    def both(f):
        return F.coalesce(f(F.when(ok, F.col(value))), F.when(F.count_if(ok) == 0, f(F.col(value))))

    return rows.groupBy(*keys).agg(F.count_if(ok).alias("good"), both(F.avg).alias("mean"), both(F.stddev_samp).alias("stdev"), both(F.min).alias("least"), both(F.max).alias("greatest"))


def retained(events: DataFrame, jobs: DataFrame, cutoff: int, now_terminal: Column, completed_at: Column) -> DataFrame:
    """Events that stay: newer ones, and older ones of a job that is known and not over by the cutoff."""
    known = jobs.select("job_id", (now_terminal & (completed_at <= cutoff)).alias("over"))
    joined = events.join(known, "job_id", "left")
    return joined.filter((F.col("created_at") > cutoff) | ~F.coalesce("over", F.lit(True))).drop("over")


def monotone(events: DataFrame, key: str, order: list[str], value: str, reset: Column) -> DataFrame:
    """The running maximum of value, from each reset anew."""
    w = Window.partitionBy(key).orderBy(*order)
    epoch = F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("epoch", epoch)
    return rows.withColumn("progress", F.max(value).over(Window.partitionBy(key, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
