"""Zones in deficit and the commands that fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.match import place, ranked, within


def _asked(zones: DataFrame, radius: str) -> DataFrame:
    return zones.select(F.col("zone_id").alias("query_id"), "tenant_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), F.expr(radius).alias("radius_km"), F.col("target_class").alias("class_mask"))


def supply(zones: DataFrame, positions: DataFrame | tuple[DataFrame, DataFrame], cap: int = 500) -> DataFrame:
    """(zone_id, required_assets, supply, deficit); the cap also limits what is counted."""
    met = ranked(within(_asked(zones, "radius_km"), positions), cap, "flat").groupBy(F.col("query_id").alias("zone_id")).agg(F.count("*").alias("supply"))
    out = zones.join(met, "zone_id", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    return out.withColumn("deficit", F.greatest(F.col("required_assets") - F.col("supply"), F.lit(0)))


def relocate(zones: DataFrame, positions: DataFrame, reach_km: float = 25.0, cap: int = 500, reachable: DataFrame | None = None) -> DataFrame:
    """RELOCATE commands of zones in deficit to their nearest assets outside: within reach, capped, then those inside
    left out. ``reachable`` (node_id): assets that can be told; others use up no deficit."""
    positions = place(positions)
    short = supply(zones, positions, cap).filter("deficit > 0").select("zone_id", "radius_km", "lat", "lon", "tenant_id", "target_class", "deficit")
    near = ranked(within(_asked(short, f"{reach_km!r}e0"), positions), cap, "flat").select(F.col("query_id").alias("zone_id"), "node_id", "distance_km", "rank")
    outside = near.join(short.select("zone_id", "radius_km", "deficit", F.col("lat").alias("target_lat"), F.col("lon").alias("target_lon")), "zone_id").filter("distance_km > radius_km")
    if reachable is not None:
        outside = outside.join(reachable.select("node_id").distinct(), "node_id", "left_semi")
    chosen = outside.withColumn("turn", F.row_number().over(Window.partitionBy("zone_id").orderBy("rank"))).filter("turn <= deficit")
    return chosen.select("zone_id", "turn", "node_id", F.lit("RELOCATE").alias("directive"), "target_lat", "target_lon", "distance_km")


def envelope(plan: DataFrame) -> DataFrame:
    """The commands as messages: node_id and the nested command as JSON."""
    return plan.select("zone_id", "node_id", F.to_json(F.struct("node_id", F.struct("directive", "target_lat", "target_lon").alias("command"))).alias("message"))


def read_commands(messages: DataFrame, value: str = "value") -> DataFrame:
    """``messages`` with node_id, directive, target_lat, target_lon and ``shape``: 'nested' as ``envelope`` writes them,
    'flat' with the directive beside the node, or null where the message is no object with a text node_id and directive; the other
    columns are null then. A nested directive goes before a flat one; a missing or unfitting target is null."""
    message = F.try_parse_json(value)

    def text(path: str) -> Column:  # a number is no name
        return F.when(F.schema_of_variant(F.try_variant_get(message, path, "variant")) == "STRING", F.try_variant_get(message, path, "string"))

    nested = text("$.command.directive")
    directive = F.coalesce(nested, text("$.directive"))
    node = text("$.node_id")
    shape = F.when(node.isNotNull() & directive.isNotNull(), F.when(nested.isNotNull(), "nested").otherwise("flat"))
    out = messages.withColumn("shape", shape).withColumns({"node_id": F.when(F.col("shape").isNotNull(), node), "directive": F.when(F.col("shape").isNotNull(), directive)})
    for name in ("target_lat", "target_lon"):
        inner, outer = (F.try_variant_get(message, f"$.{at}{name}", "double") for at in ("command.", ""))
        out = out.withColumn(name, F.when(F.col("shape") == "nested", inner).when(F.col("shape") == "flat", outer))
    return out


def in_use(predicted: DataFrame, fixed: DataFrame) -> DataFrame:
    """The predicted zones, or the fixed ones where none is predicted."""
    some = predicted.limit(1).select(F.lit(1).alias("_some"))
    return predicted.unionByName(fixed.withColumn("_some", F.lit(1)).join(F.broadcast(some), "_some", "left_anti").drop("_some"))


def from_hotspots(places: DataFrame, tenant: str = "alpha_logistics", radius_km: float = 2.0, required: int = 5, target_class: int = 16) -> DataFrame:
    """A zone around each hotspot."""
    return places.select(
        F.concat(F.lit("Predicted-Hotspot-"), F.col("rank").cast("string")).alias("zone_id"), "lat", "lon", F.lit(radius_km).alias("radius_km"), F.lit(required).alias("required_assets"), F.lit(target_class).alias("target_class"), F.lit(tenant).alias("tenant_id")
    )
