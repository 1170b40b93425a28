"""Operational records over the shared test tables: SQL that Spark and the oracle both run, so that both see equal records.

documents, jobs, items, events, errors and sessions stand for the stores of a document service; their columns are made
from keys, dates and texts of the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = {
    "doc_records": ("part", """SELECT p_partkey AS document_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS file_name,
        CASE p_size % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'hwpx' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'csv' ELSE '' END AS file_type,
        CASE p_partkey % 7 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'CANCELED' WHEN 4 THEN NULL ELSE 'COMPLETED' END AS status,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('u', CAST(p_partkey % 20 AS VARCHAR(10))) END AS owner,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS progress,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey * 37 % 5003 END AS updated_at, p_partkey * 13 % 4001 AS uploaded_at,
        CASE WHEN p_partkey % 7 IN (5, 6) THEN concat('out/', CAST(p_partkey AS VARCHAR(20)), '.txt') END AS output_path FROM part"""),
    "job_records": ("orders", """SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('u', CAST(o_custkey % 20 AS VARCHAR(10))) END AS owner,
        o_orderkey % 11 = 0 AS cancel_requested, o_orderkey % 3 + 1 AS parallelism, o_orderkey * 31 % 9001 AS created_at, o_orderpriority AS model FROM orders"""),
    "item_records": ("lineitem", """SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS job_id, l_partkey AS document_id,
        CASE WHEN l_orderkey % 13 = 0 THEN 'CANCELED' WHEN l_orderkey % 17 = 0 THEN 'FAILED' WHEN l_orderkey % 4 = 0 THEN 'COMPLETED'
             WHEN (l_partkey + l_linenumber) % 6 = 0 THEN 'QUEUED' WHEN (l_partkey + l_linenumber) % 6 = 1 THEN 'PROCESSING' WHEN (l_partkey + l_linenumber) % 6 = 2 THEN 'FAILED'
             WHEN (l_partkey + l_linenumber) % 6 = 3 THEN 'CANCELED' ELSE 'COMPLETED' END AS status,
        CAST(l_quantity AS DOUBLE) * 2 AS progress, l_suppkey * 100 AS queued_at, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_suppkey * 100 + l_partkey % 977 - 100 END AS started_at,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_suppkey * 100 + l_partkey % 1511 END AS completed_at, l_linenumber AS retry_count,
        CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'TIMEOUT' ELSE 'MODEL' END AS error_code,
        CASE WHEN l_partkey % 4 < 2 THEN NULL ELSE concat('failed on part ', CAST(l_partkey % 50 AS VARCHAR(10))) END AS error_message FROM lineitem"""),
    "event_records": ("events", """SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE user_id END AS item_id, user_id % 7 AS job_id,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROGRESS' WHEN 'purchase' THEN 'RETRY_REQUESTED' ELSE upper(event_type) END AS event_type, event_type AS source_type,
        CAST(value AS DOUBLE) AS value, event_id * 7919 % 100003 AS created_at FROM events"""),
}


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A store's records as a DataFrame."""
    source, sql = RECORDS[name]
    view = f"{source}_source"
    spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(view)
    head, _, _ = sql.rpartition(f"FROM {source}")
    return spark.sql(f"{head}FROM {view}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_records(sql: str, *names: str) -> str:
    """The oracle's SQL over the stores it names."""
    return "WITH " + ", ".join(f"{n} AS ({RECORDS[n][1]})" for n in names) + " " + sql
