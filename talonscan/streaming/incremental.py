"""Continuous scans: files as they arrive, and running statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.functions.tables import shared_dir
from talonscan.operators.rules import PACK, line_matches

FILES = "file string, content string, modified timestamp"


def read_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of Parquet files of (file, content, modified)."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def scan_stream(files: DataFrame, delay: str = "1 day", pack: list[tuple[str, str, str]] = PACK) -> DataFrame:
    """Findings of changed files; a content that comes again within the delay is scanned once, so state is bounded."""
    fresh = files.withWatermark("modified", delay).withColumn("_h", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicatesWithinWatermark(["file", "_h"])
    return line_matches(fresh, pack)


def windowed_findings(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(ts, tool, n_findings) to scans and findings of tumbling windows; later rows than the delay are left out."""
    spans = log.withWatermark("ts", delay).groupBy(F.window("ts", width), "tool").agg(F.count("*").alias("scans"), F.sum("n_findings").alias("findings"))
    return spans.select(F.col("window.start").alias("start"), "tool", "scans", "findings")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream; the table may be one file or a directory of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")  # a stream takes a single file only from a pattern


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table: appended rows, or the last state (mode ``complete``). State and rows lie in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    last = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows-{batch}")
        last[:] = [batch]

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows-{last[0]}") if last else spark.createDataFrame([], stream.schema)
