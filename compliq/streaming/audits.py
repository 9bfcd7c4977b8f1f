"""Streams of documents to streams of results, and rolling compliance by event time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq import audit
from compliq.plans.spec import load
from compliq.sources import documents


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", file_type: str = "txt", per_batch: int = 8) -> DataFrame:
    """Parsed documents from parquet files as they arrive."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return documents.from_text(raw, file_type)


def audit_stream(docs: DataFrame, spec: Any) -> DataFrame:
    """One row per document and requirement; stateless, so it needs no watermark and no state."""
    return audit.audit(docs, load(spec))


def compliance_by_window(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rolling share of passing results over event time. ``events``: ts, status."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    n = events.withWatermark("ts", late).groupBy(window).agg(F.count(F.lit(1)).alias("decided"), F.count_if(F.col("status") == "PASS").alias("passed"))
    return n.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "decided", "passed")


def sink(results: DataFrame, path: str, checkpoint: str):
    """Append to parquet, exactly once; handles what has arrived and stops."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
