"""Gauges over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(value: str = "uplinks", warning: int = 20_000, danger: int = 40_000):
    return F.when(F.col(value) > danger, "danger").when(F.col(value) > warning, "warning").otherwise("normal")


def uplinks(pings: DataFrame, last: int = 60) -> DataFrame:
    """Distinct assets heard in each of the last seconds with any, and the alarm level."""
    second = F.date_trunc("second", "recorded_at").cast("timestamp_ntz").alias("second")
    return pings.groupBy(second).agg(F.count_distinct("node_id").alias("uplinks")).orderBy(F.desc("second")).limit(last).withColumn("level", level())


def rate(pings: DataFrame) -> DataFrame:
    """Messages of each second and of all time up to it. Days are summed first, so no task holds all seconds."""
    second = F.date_trunc("second", "recorded_at").cast("timestamp_ntz").alias("second")
    counts = pings.groupBy(second).agg(F.count("*").alias("messages")).withColumn("_day", F.to_date("second"))
    days = counts.groupBy("_day").agg(F.sum("messages").alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_day", "_before")
    within = F.sum("messages").over(Window.partitionBy("_day").orderBy("second").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_within", within).join(before, "_day").select("second", "messages", (F.col("_within") + F.col("_before")).alias("total"))


def sketches(pings: DataFrame, by: Column, lg_k: int = 12) -> DataFrame:
    """(second, sketch, messages): of each ``by``, a sketch of the assets heard. A sketch has at most about 2^lg_k bytes,
    however many assets; its relative error is about 0.83 / sqrt(2^lg_k), and it is all but exact up to 2^lg_k / 8 assets."""
    return pings.groupBy(by.alias("second")).agg(F.hll_sketch_agg("node_id", lg_k).alias("sketch"), F.count("*").alias("messages"))


def sketched_uplinks(sketched: DataFrame, unit: str = "second") -> DataFrame:
    """(second, uplinks, messages, level) of sketches, those of a longer unit by union: an asset heard in many seconds counts once."""
    out = sketched.groupBy(F.date_trunc(unit, "second").alias("second")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("uplinks"), F.sum("messages").alias("messages"))
    return out.withColumn("level", level())
