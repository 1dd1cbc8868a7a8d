"""Cell handovers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import geo, hexgrid
from fleetspark.schemas import STATUSES


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon", prefix: str = "hex") -> DataFrame:
    out = df
    for step in hexgrid.steps(lat, lon, f"{prefix}_q", f"{prefix}_r"):
        out = out.withColumns({name: F.expr(e) for name, e in step.items()})
    return out.select(*df.columns, f"{prefix}_q", f"{prefix}_r")


def leaving(pings: DataFrame, threshold_km: float = 1.0, ahead_km: float = 0.2) -> DataFrame:
    """(node_id, at, turn 1, seq, node_type, target_cell): pings far from their cell's centre whose heading leads to another cell."""
    here = with_cell(pings)
    lat, lon = hexgrid.center("hex_q", "hex_r")
    here = here.withColumns({"_clat": F.expr(lat), "_clon": F.expr(lon)})
    here = here.withColumn("_off", F.expr(geo.haversine_km("lat", "lon", "_clat", "_clon")))
    to_lat, to_lon = geo.project("lat", "lon", "heading_deg", f"{ahead_km!r}e0")
    ahead = with_cell(here.withColumn("_lat", F.expr(to_lat)).withColumn("_lon", F.expr(to_lon)), "_lat", "_lon", "to")
    # a row for each cell entered: a filter would be pushed down and repeat the whole geometry in its condition
    entered = F.when((F.col("_off") >= threshold_km) & ((F.col("hex_q") != F.col("to_q")) | (F.col("hex_r") != F.col("to_r"))), F.array(F.expr(hexgrid.cell_id("to_q", "to_r"))))
    return ahead.select("node_id", F.col("recorded_at").alias("at"), F.lit(1).alias("turn"), "seq", "node_type", F.explode(entered).alias("target_cell"))


def told(commands: DataFrame) -> DataFrame:
    """(node_id, at, turn 0, seq, _c): the directives; at the same time they come before pings."""
    return commands.select("node_id", F.col("issued_at").alias("at"), F.lit(0).alias("turn"), "seq", F.struct("directive", "target_lat", "target_lon").alias("_c"))


def detect(pings: DataFrame, commands: DataFrame, threshold_km: float = 1.0, ahead_km: float = 0.2) -> DataFrame:
    """Handovers of ``leaving`` with the asset's last directive at or before the ping: an as-of join by a window over
    both, boundary pings only."""
    both = leaving(pings, threshold_km, ahead_km).unionByName(told(commands), allowMissingColumns=True)
    last = F.last("_c", ignorenulls=True).over(Window.partitionBy("node_id").orderBy("at", "turn", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_c", last).filter("turn = 1").select("seq", "node_id", "node_type", "target_cell", F.col("at").alias("recorded_at"), "_c.directive", "_c.target_lat", "_c.target_lon")


def prewarm(positions: DataFrame, handovers: DataFrame) -> DataFrame:
    """Latest positions with an active placeholder over those whose last event is a handover; the position stays known
    and the directive is carried along."""
    active = next(k for k, v in STATUSES.items() if v == "ACTIVE")
    last = handovers.groupBy("node_id").agg(F.max_by(F.struct("recorded_at", "seq", "directive"), F.struct("recorded_at", "seq")).alias("_h"))
    out = positions.join(last, "node_id", "left")
    warm = F.coalesce(F.struct(F.col("_h.recorded_at"), F.col("_h.seq")) >= F.struct("recorded_at", "seq"), F.lit(False))
    out = out.withColumn("prewarmed", F.when(F.col("_h").isNull(), False).otherwise(warm))
    return out.select("node_id", "lat", "lon", F.when(F.col("prewarmed"), active).otherwise(F.col("status")).alias("status"), "prewarmed", F.when(F.col("prewarmed"), F.col("_h.directive")).alias("directive"))
