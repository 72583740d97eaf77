"""Definitions that arrive as a stream of chunk files, and running counts over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search
from ..sources import archive

FILE = "path string, modificationTime timestamp, length long, content binary"


def chunk_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, as archive.chunks() gives them for one that stands still."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content", (~F.col("path").rlike(r"\.js\z")).alias("skipped"))


def definition_stream(spark: SparkSession, path: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the definitions in new files to a Parquet folder, once each."""
    rows = archive.definitions(chunk_stream(spark, path)).where("name is not null")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def matching_lines(texts: DataFrame, pattern: str) -> DataFrame:
    """name, line and text of matching lines in a stream (or table) of (name, text)."""
    found = search.line_matches(texts, pattern, most=1 << 30)
    return found.select("name", F.explode("matches").alias("m")).select("name", "m.line", "m.text")


def for_each(rows: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls do(batch, number) for what is there now."""
    return rows.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
