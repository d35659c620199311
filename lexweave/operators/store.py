"""Segment store: persist, update, page, count. Rows are keyed by id = file_id and segment number, numbered from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inline, text as X


def rows_of(segments: DataFrame, now: Column) -> DataFrame:
    """Store rows of segments(file_id, seg_no, id, source_elements, target_elements, status): both sides with placeholders."""
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_no"))
    s, t = inline.serialize(F.col("source_elements")), inline.serialize(F.col("target_elements"))
    numbered = segments.withColumns({"segment_number": n, "_s": s, "_t": t})
    return numbered.select(
        F.concat_ws("_", "file_id", "segment_number").alias("id"),
        "file_id",
        "segment_number",
        F.col("_s.text").alias("source_text"),
        F.col("_t.text").alias("target_text"),
        F.col("_s.tags").alias("source_tags"),
        F.col("_t.tags").alias("target_tags"),
        "status",
        X.count_words(X.plain_text(F.col("source_elements"))).alias("word_count"),
        F.col("id").alias("source_segment_id"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def persisted(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after insert-or-replace of `new` by id."""
    return store.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def updated(store: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """The store after updates(id, target_text, status): null keeps what is there. Updates that aren't allowed
    (`violations`) change nothing."""
    u = updates.select("id", F.col("target_text").alias("_t"), F.col("status").alias("_s"))
    allowed = ~((F.col("status") == "approved") & F.col("_s").isNotNull() & (F.col("_s") != "approved"))
    hit = F.coalesce(F.col("_hit") & allowed, F.lit(False))
    joined = store.join(u.withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumns(
        {
            "target_text": F.when(hit, F.coalesce("_t", "target_text")).otherwise(F.col("target_text")),
            "status": F.when(hit, F.coalesce("_s", "status")).otherwise(F.col("status")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).drop("_t", "_s", "_hit")


def violations(store: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, reason) of updates to missing segments, or that would take an approved one back."""
    j = updates.select("id", F.col("status").alias("_s")).join(store.select("id", "status"), "id", "left")
    reason = F.when(F.col("status").isNull(), "missing").when((F.col("status") == "approved") & (F.col("_s") != "approved"), "approved")
    return j.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def page(store: DataFrame, file_id: str | int, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = store.where(F.col("file_id") == file_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy("segment_number").offset(offset).limit(limit)


def segment(store: DataFrame, id: str) -> DataFrame:
    return store.where(F.col("id") == id)


def counts(store: DataFrame) -> DataFrame:
    return store.groupBy("file_id", "status").agg(F.count("*").alias("n"))


def hydrated(store: DataFrame, file_id: str | int) -> DataFrame:
    """The pairs of a file in order, placeholders turned back into elements."""
    rows = store.where(F.col("file_id") == file_id).orderBy("segment_number")
    return rows.select("segment_number", "source_segment_id", inline.deserialize("source_text", "source_tags").alias("source_elements"), inline.deserialize("target_text", "target_tags").alias("target_elements"), "status")
