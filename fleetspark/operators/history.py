"""Questions to the history table; the filters reach its folders and Parquet statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def track(history: DataFrame, node_id: str, t0: str, t1: str) -> DataFrame:
    """One asset's pings in [t0, t1], newest first."""
    return in_time(history.filter(F.col("node_id") == node_id), t0, t1).orderBy(F.desc("recorded_at"), F.desc("seq"))


def in_bbox(history: DataFrame, box: tuple[float, float, float, float], t0: str, t1: str) -> DataFrame:
    """Pings in the box (x, y, width, height), edges included, and in [t0, t1]."""
    x, y, w, h = box
    return in_time(history.filter(F.col("lat").between(x, x + w) & F.col("lon").between(y, y + h)), t0, t1)


def in_time(history: DataFrame, t0: str, t1: str) -> DataFrame:
    a, b = (F.lit(t).cast("timestamp_ntz") for t in (t0, t1))
    out = history.filter(F.col("recorded_at").between(a, b))
    return out.filter(F.col("date").between(F.to_date(a), F.to_date(b))) if "date" in history.columns else out
