"""Counts that jobs report: one row each, worked out in one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(hit: Column, name: str) -> Column:
    return F.count_if(F.coalesce(hit, F.lit(False))).alias(name)


def anchor_counts(rows: DataFrame) -> DataFrame:
    """total, kept and duplicates of flattened anchors."""
    return rows.agg(F.count(F.lit(1)).alias("total"), _count(F.col("keep_for_step2"), "kept"), _count(F.col("is_duplicate"), "duplicates"))


def status_counts(anchors: DataFrame) -> DataFrame:
    """Anchors of grounded or segmented samples: all, those ok with detections, without box, failed, and with a fallback."""
    status = F.col("status")
    fallback = F.col("fallback_used") if "fallback_used" in anchors.columns else F.lit(False)
    return anchors.agg(
        F.count(F.lit(1)).alias("anchors"),
        _count((status == "ok") & (F.size("detections") > 0), "ok"),
        _count(status == "no_box", "no_box"),
        _count(status == "sam_failed", "sam_failed"),
        _count(fallback, "fallback"),
    )


def relation_counts(relations: DataFrame) -> DataFrame:
    """Relations: all, those with both ends ok, and those with an end that can't be grounded."""
    a, b = F.col("subject_status"), F.col("object_status")
    out = F.lit("non_groundable")
    return relations.agg(
        F.count(F.lit(1)).alias("relations"), _count((a == "ok") & (b == "ok"), "both_ok"),
        _count(a.eqNullSafe(out) | b.eqNullSafe(out), "non_groundable")
    )


def record_counts(records: DataFrame) -> DataFrame:
    """Extraction records by outcome."""
    status = F.col("status")
    return records.agg(
        F.count(F.lit(1)).alias("total"), _count(status == "ok", "ok"),
        _count(status == "missing_image", "missing_image"),
        _count(~status.isin("ok", "missing_image"), "failed")
    )


def joined(*reports: DataFrame) -> DataFrame:
    """Reports of one row each as one row."""
    numbered = [r.withColumn("_one", F.lit(1)) for r in reports]
    return reduce(lambda a, b: a.join(b, "_one"), numbered).drop("_one")
