"""Files written to and listed from a shared folder, stores of entries behind a cache, kinds of word processor files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.files import scan

# Suffixes of inputs, names that are no inputs, and the first bytes of word processor files.
SUFFIXES = ["pdf", "hwp", "hwpx", "xlsx", "xls", "csv", "png", "jpg", "jpeg", "bmp", "tiff", "gif"]
NO_INPUTS = [".gitkeep", ".gitignore", ".DS_Store", "Thumbs.db", "desktop.ini", ".directory"]
OLE, ZIP, NAMED = "D0CF11E0A1B11AE1", "504B", "HWP Document File"


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write each row (path below folder, content) as a file; the table of path and bytes written. A file is written under a
    name of its own first and then moved, so a task that is run again replaces it whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, _, name = f"{top}/{path}".rpartition("/")
                store.create_dir(place, recursive=True)
                draft = f"{place}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                store.move(draft, f"{place}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    written = rows.select("path", F.col("content").cast("binary")).mapInArrow(write, "path string, bytes long")
    spark = rows.sparkSession
    written.write.mode("overwrite").parquet(f"{folder}/_written")
    return spark.read.parquet(f"{folder}/_written")


def listing(spark: SparkSession, folder: str, deep: bool = True) -> DataFrame:
    """relative_path, name, suffix and size of the inputs below a folder, or only in it; hidden and other files are none, and
    Spark lists no empty ones."""
    top = folder.partition(":")[2].lstrip("/") if ":" in folder else folder.lstrip("/")
    files = scan(spark, folder).select(F.split_part("path", F.lit(f"{top}/"), F.lit(2)).alias("relative_path"), F.col("length").alias("size"))
    name = F.element_at(F.split("relative_path", "/"), -1)
    files = files.withColumns({"name": name, "suffix": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})
    files = files.filter(F.col("suffix").isin(*SUFFIXES) & ~F.col("name").isin(*NO_INPUTS))
    return files if deep else files.filter(~F.contains("relative_path", F.lit("/")))


def convert_all(files: DataFrame, convert) -> DataFrame:
    """Each file (path, content) through convert(content) -> text: path, text and error; a file that fails has an error and
    no text, the others are not touched by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(convert(content))
                    errors.append(None)
                except Exception as problem:  # whatever a converter raises is that file's error
                    texts.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def processor_kind(content: Column) -> Column:
    """hwpx for a ZIP archive, hwp5 for an OLE file, legacy for an older file that names its version, else unknown."""
    start = F.substring(content, 1, 512)
    head = F.hex(F.substring(content, 1, 8))
    legacy = F.decode(start, "ISO-8859-1").rlike(NAMED + r"[^\x00\r\n]{0,80}V[0-4]\.")
    return F.when(F.startswith(head, F.lit(ZIP)), "hwpx").when(head == OLE, "hwp5").when(legacy, "legacy").otherwise("unknown")


def read_through(cached: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Entries as a cache before a store sees them: dirty cached ones over stored ones, clean ones only where they are still
    stored, deleted ones (null value) not at all. cached: key, value, dirty; stored: key, value."""
    both = cached.withColumnRenamed("value", "c").join(stored.withColumnRenamed("value", "s"), key, "full")
    dirty = F.coalesce(F.col("dirty"), F.lit(False))
    return both.select(key, F.when(dirty, F.col("c")).otherwise(F.col("s")).alias("value")).filter("value IS NOT NULL")


def unprocessed(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (relative_path) without an output of their folder and stem; an input's suffix does not count, so a.pdf and a.csv
    have one output."""
    without_suffix = F.regexp_replace("relative_path", r"(?<=[^/])\.[^./]*$", "")
    done = outputs.filter(F.endswith("relative_path", F.lit(".txt"))).select(without_suffix.alias("stem")).distinct()
    return inputs.withColumn("stem", without_suffix).join(done, "stem", "left_anti").drop("stem")


def ground_truths(spark: SparkSession, folder: str) -> DataFrame:
    """stem, path, file and valid of each ground truth below a folder, the first by path of equal stems. A file that is no JSON
    or lacks the key file is not valid, and is told so rather than left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    stem = F.regexp_extract("path", r"([^/]*)\.json$", 1)
    name = F.get_json_object(F.decode("content", "UTF-8"), "$.file")
    first = files.select(stem.alias("stem"), "path", name.alias("file")).groupBy("stem").agg(F.min(F.struct("path", "file")).alias("x"))
    return first.select("stem", "x.path", "x.file", F.col("x.file").isNotNull().alias("valid"))


def distinct_inputs(files: DataFrame, path: str) -> DataFrame:
    """Files by their path, each once; no files are an error."""
    out = files.dropDuplicates([path])
    if out.isEmpty():
        raise ValueError("there are no inputs")
    return out


def append(rows: DataFrame, folder: str) -> DataFrame:
    """Append rows to the log in a folder; all of the log."""
    rows.write.mode("append").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
