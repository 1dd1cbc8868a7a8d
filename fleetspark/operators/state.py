"""Latest state per key: folding, expiry, upserts and replays. Order is (time, seq); seq breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import geo


def newest(df: DataFrame, key: str, time: str = "recorded_at", tie: str = "seq") -> DataFrame:
    """The last row of each key. Partial aggregation keeps one row a key and task, whatever the history's length."""
    row = F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(row).select("_row.*")


def latest(pings: DataFrame, area: tuple[float, float, float, float] | None = (12.0, 79.5, 2.0, 1.5)) -> DataFrame:
    """Each asset's last ping, if that lies in the service area: an asset that left it is gone."""
    out = newest(pings, "node_id")
    return out.filter(geo.in_service_area(box=area)) if area else out


def active(drivers: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Drivers not offline and seen in the last seconds."""
    return drivers.filter((F.col("status") != "offline") & (F.col("updated_at") >= as_of - F.make_dt_interval(secs=F.lit(seconds))))


def expire(rows: DataFrame, as_of: Column, seconds: int, time: str) -> DataFrame:
    """Rows heard of within the last seconds."""
    return rows.filter(F.col(time) >= as_of - F.make_dt_interval(secs=F.lit(seconds)))


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", time: str = "updated_at", tie: str = "seq") -> DataFrame:
    """``base`` with each key's last update in place of its row, new keys added; ``updates`` has base's columns and a tie."""
    last = newest(updates, key, time, tie).select([F.col(c).alias(f"_{c}") for c in base.columns])
    both = base.join(last, base[key] == last[f"_{key}"], "full_outer")
    return both.select(*(F.when(F.col(f"_{key}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns))


def heartbeat(base: DataFrame, beats: DataFrame, default_asset: int = 4) -> DataFrame:
    """Beats (id, lat, lon, updated_at, seq) move known drivers and add unknown ones as available."""
    last = newest(beats, "id", "updated_at").select(*(F.col(c).alias(f"_{c}") for c in ("id", "lat", "lon", "updated_at")))
    both = base.join(last, base["id"] == last["_id"], "full_outer")
    moved = {c: F.coalesce(f"_{c}", c).alias(c) for c in ("id", "lat", "lon", "updated_at")}
    kept = {"status": F.when(F.col("id").isNull(), "available").otherwise(F.col("status")).alias("status"), "asset": F.when(F.col("id").isNull(), default_asset).otherwise(F.col("asset")).alias("asset")}
    return both.select(*((moved | kept)[c] for c in base.columns))


def asset_view(pings: DataFrame, commands: DataFrame) -> DataFrame:
    """The newest telemetry and the newest directive of each asset; either may be missing."""
    seen = newest(pings.select("node_id", "lat", "lon", "battery", "velocity_mps", "heading_deg", "recorded_at", "seq"), "node_id").drop("seq")
    told = newest(commands.select("node_id", "directive", "target_lat", "target_lon", "issued_at", "seq"), "node_id", "issued_at").drop("seq")
    return seen.join(told, "node_id", "full_outer")


def change_events(messages: DataFrame, emitted_at: Column) -> DataFrame:
    """One change record for each telemetry message; other kinds are dropped."""
    known = messages.filter("kind = 'telemetry'")
    return known.select(F.col("node_id").alias("asset_id"), "lat", "lon", F.col("battery").alias("energy"), F.col("velocity_mps").alias("velocity"), F.col("heading_deg").alias("heading"), emitted_at.alias("ts"), "seq")


def replay(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """The state of every asset after the events up to a time."""
    some = events if upto is None else events.filter(F.col("ts") <= upto)
    return newest(some, "asset_id", "ts").select("asset_id", "lat", "lon", "energy")
