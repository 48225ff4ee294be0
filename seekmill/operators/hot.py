"""Hot documents: clicks per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def click_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("doc_id").agg(F.count("*").alias("click_count"))


def hot(counts: DataFrame, k: int = 10) -> DataFrame:
    """rank, doc_id, click_count of the ``k`` most clicked documents; ties go to the larger id."""
    best = counts.orderBy(F.desc("click_count"), F.desc("doc_id")).limit(max(k, 0))
    by = Window.orderBy(F.desc("click_count"), F.desc("doc_id"))
    return best.select(F.row_number().over(by).alias("rank"), "doc_id", "click_count")


def hot_stats(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("unique_docs"), F.coalesce(F.sum("click_count"), F.lit(0)).alias("total_clicks"))


def event_clicks(events: DataFrame) -> DataFrame:
    """doc_id of click events, from their JSON properties."""
    return events.where(F.col("event_type") == "click").select(F.get_json_object("props", "$.k").cast("long").alias("doc_id"))
