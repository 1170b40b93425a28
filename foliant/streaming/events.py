"""Structured Streaming forms: windows over event time with late data, and running a stream over what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.scratch import shared_path


def windowed_counts(events: DataFrame, width: str, late: str, at: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts of each window and key; rows later than `late` behind the latest are dropped. Works on streams and tables."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_once(query: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives over all that there is now, as a table in the shared folder, its checkpoint beside it.

    Each micro-batch overwrites a part of its own number, so one that is run again changes nothing. In complete mode the last
    part is the result, in update mode each key's row of the last part that has it, in append mode all rows."""
    folder = shared_path(query.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    running = query.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    schema = StructType([*query.schema.fields, StructField("batch", LongType())])
    parts = query.sparkSession.read.schema(schema).option("basePath", f"{folder}/parts").parquet(f"{folder}/parts")
    if mode == "complete":
        last = parts.agg(F.max("batch")).first()[0]
        return parts.filter(F.col("batch") == last).drop("batch")
    if mode == "update":
        row = F.struct(*query.columns)
        return parts.groupBy(*keys).agg(F.max_by(row, "batch").alias("row")).select("row.*")
    return parts.drop("batch")
