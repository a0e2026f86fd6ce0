"""Beyond the reference: linting files as they arrive, and windows over diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from treeloom.plans import lint
from treeloom.sources.registry import read_documents


def watch_files(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: list[lint.Rule] | None = None, glob: str = "*", once: bool = True) -> StreamingQuery:
    """Lint new files below a folder into parquet, each batch under its number, so that a repeated batch replaces itself."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        lint.lint(read_documents(batch.select("path", "content")), rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) over tumbling windows; rows later than `late` are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
