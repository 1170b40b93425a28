"""Counts and lists of the dashboard, over stores of document and job records. Every count is one aggregation, every list a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("COMPLETED", "FAILED", "CANCELED")
# Percent that a status stands for, on lists of documents and in the parser's own view.
DISPLAY_PROGRESS = {"UPLOADED": 0, "QUEUED": 0, "PROCESSING": 5, "PREPROCESSING": 10, "GPU_WAITING": 20, "GPU_PROCESSING": 25, "POSTPROCESSING": 90, "COMPLETED": 100, "FAILED": 100, "CANCELED": 100}
PARSER_PROGRESS = {"QUEUED": 0, "PROCESSING": 50, "COMPLETED": 100, "FAILED": 0, "CANCELED": 0}


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def document_summary(docs: DataFrame) -> DataFrame:
    """One row: total, completed, failed, processing (no status counts as processing, canceled as none of these)."""
    return docs.agg(F.count("*").alias("total"), count_where(F.col("status") == "COMPLETED").alias("completed"), count_where(F.col("status") == "FAILED").alias("failed"), F.count_if(~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))).alias("processing"))


def file_types(docs: DataFrame) -> DataFrame:
    """Documents by file type; an empty or missing one is "unknown"."""
    return docs.groupBy(F.coalesce(F.nullif("file_type", F.lit("")), F.lit("unknown")).alias("file_type")).agg(F.count("*").alias("n"))


def recent_documents(docs: DataFrame, limit: int | None = 10) -> DataFrame:
    """The documents last updated, or uploaded if never updated; ties to the larger id. All of them without a limit."""
    rows = docs.withColumn("last_at", F.coalesce("updated_at", "uploaded_at", F.lit(0))).orderBy(F.desc("last_at"), F.desc("document_id"))
    return (rows if limit is None else rows.limit(limit)).select("document_id", "last_at", "status")


def progress_of(docs_status: Column, by_status: dict[str, int], percent: Column, done: Column, pages: Column) -> Column:
    """A whole percent from 0 to 100: of pages that are done; without pages the stored percent; without that, what the status
    stands for (no status counts as uploaded)."""
    known = F.create_map(*[F.lit(x) for pair in by_status.items() for x in pair])
    by_pages = F.when((pages > 0) & done.isNotNull(), F.try_divide(done * 100, pages).cast("int"))
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(by_pages, percent.cast("int"), F.try_element_at(known, F.coalesce(docs_status, F.lit("UPLOADED"))), F.lit(0))))


def for_display(docs: DataFrame, by_status: dict[str, int] = DISPLAY_PROGRESS) -> DataFrame:
    """Id, name, type and progress as the lists show them. docs: document_id, file_name, file_type, source_name, source_type,
    status, percent, pages_done and pages. A source's name, and its type or suffix, take the place of the file's."""
    from foliant.operators.text import suffix

    sourced = F.coalesce(F.col("source_name") != "", F.lit(False))
    known = lambda c: F.nullif(c, F.lit(""))
    kind = F.coalesce(known(F.col("source_type")), known(F.replace(suffix(F.col("source_name")), F.lit("."), F.lit(""))), F.col("file_type"))
    return docs.select("document_id", F.when(sourced, F.col("source_name")).otherwise(F.col("file_name")).alias("file_name"), F.when(sourced, kind).otherwise(F.col("file_type")).alias("file_type"), progress_of(F.col("status"), by_status, F.col("percent"), F.col("pages_done"), F.col("pages")).alias("progress"))


def success_rate(docs: DataFrame) -> DataFrame:
    """Share of completed documents in percent to one decimal, and the counts; slices of none are left out."""
    counts = docs.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))  # one row
    return counts.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("all"), 1).alias("percent")).filter("n > 0")


def daily_trend(rows: DataFrame, at: str, last_day: str, days: int = 7) -> DataFrame:
    """Rows of each of the days up to last_day, none counted as zero."""
    spark = rows.sparkSession
    last = F.to_date(F.lit(last_day))
    every = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = rows.filter((F.to_date(at) <= last) & (F.to_date(at) > F.date_sub(last, days))).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return every.join(counts, "day", "left").select("day", F.date_format("day", "M/dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    """Rows of each store."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n") for name, df in stores.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
