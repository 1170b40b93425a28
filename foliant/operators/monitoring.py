"""The error feed, lookups of jobs and documents, filters, searches and pages of the monitoring views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_id(prefix: str, *parts: Column) -> Column:
    """prefix and 16 hexadecimal digits of the SHA-256 of the parts joined by a bar; a null part is empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def error_text(code: Column, message: Column) -> Column:
    return F.coalesce(message, code, F.lit("unknown error"))


def lookup_events(events: DataFrame, items: DataFrame, docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events with what is known of their item, its document and their job: three left equi-joins in one plan."""
    out = events.join(items.select("item_id", "document_id", F.col("status").alias("item_status")), "item_id", "left")
    out = out.join(docs.select("document_id", "file_name", F.col("owner").alias("doc_owner")), "document_id", "left")
    return out.join(jobs.select("job_id", F.col("owner").alias("job_owner")), "job_id", "left")


def event_errors(events: DataFrame) -> DataFrame:
    """Errors told by events: those that failed are of severity error, retries are warnings. The id is the item's, or else
    a hash of what the event has."""
    some = events.filter(F.col("event_type").isin("FAILED", "RETRY_REQUESTED"))
    return some.select(F.coalesce(F.concat(F.lit("item-"), F.col("item_id").cast("string")), hashed_id("err_event_", F.col("event_id"), F.col("job_id"))).alias("error_id"), "item_id", F.when(F.col("event_type") == "FAILED", "error").otherwise("warning").alias("severity"), F.col("event_type").alias("kind"), F.col("created_at").alias("occurred_at"), F.col("event_id").alias("source_order"))


def has_error() -> Column:
    return (F.col("status") == "FAILED") | (F.col("status") == "QUEUED") & F.coalesce("error_code", "error_message").isNotNull()


def item_errors(items: DataFrame) -> DataFrame:
    """Errors told by items: failed ones, and queued ones that failed before."""
    some = items.filter(has_error())
    return some.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("error_id"), "item_id", F.when(F.col("status") == "FAILED", "error").otherwise("warning").alias("severity"), F.col("status").alias("kind"), F.col("queued_at").alias("occurred_at"), F.col("item_id").alias("source_order"))


def error_feed(events: DataFrame, items: DataFrame) -> DataFrame:
    """Errors of both sources, one for each id: of events the last, of items only those that no event tells of."""
    told = event_errors(events)
    last = told.groupBy("error_id").agg(F.max_by(F.struct("item_id", "severity", "kind", "occurred_at", "source_order"), F.struct("occurred_at", "source_order")).alias("x")).select("error_id", "x.*")
    silent = item_errors(items).join(told.select("item_id").filter("item_id IS NOT NULL").distinct(), "item_id", "left_anti")
    return last.unionByName(silent)


def any_contains(term: str, *columns: str) -> Column:
    """Whether a text column holds the term, whatever the case; a null column is empty."""
    found = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower())) for c in columns]
    out = found[0]
    for one in found[1:]:
        out = out | one
    return out


def equal_filters(rows: DataFrame, **wanted) -> DataFrame:
    """Rows with the wanted values; a wanted None filters nothing."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(name) == F.lit(value))
    return rows


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in a total order, each with the count of all rows before slicing."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def owned_by(rows: DataFrame, user: str | None, *owners: str) -> DataFrame:
    """Rows whose first known owner is the user; rows without owner are hidden. No user sees all."""
    return rows if user is None else rows.filter(F.coalesce(*owners) == user)


def visible_to(rows: DataFrame, user: str | None, *owners: str) -> DataFrame:
    """Rows of which any known owner is the user, and rows without owner. No user sees all."""
    if user is None:
        return rows
    known = F.array_compact(F.array(*owners))
    return rows.filter((F.size(known) == 0) | F.array_contains(known, user))


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def last_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key, with their place from the end; the limit is pushed below the shuffle by Spark."""
    return rows.withColumn("from_end", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("from_end") <= n)
