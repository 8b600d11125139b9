"""Documents that arrive as files: an extension, not part of the book operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bookloom.operators.boilerplate import repeated_lines
from bookloom.sources.lines import lines_of

SCHEMA = "doc_id long, text string, arrived timestamp"


def arrivals(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Stream of Parquet files dropped into folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def repeated_per_hour(docs: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counts of lines per hour of arrival; hours older than the watermark are closed."""
    lines = docs.withWatermark("arrived", lateness).select("arrived", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.window("arrived", "1 hour").alias("hour"), F.md5("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def write_repeated_lines(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Repeated lines of every batch of documents, appended to target. A batch that is
    repeated after a failure overwrites its own folder."""

    def batch(frame: DataFrame, number: int) -> None:
        found = repeated_lines(lines_of(frame.select("doc_id", "text")))
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
