"""Telemetry in: decoding, dead letters, stamps and the history table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark import schemas
from fleetspark.functions import geo


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with the typed fields of its JSON payloads and ``parsed``; broken payloads have null fields."""
    schema = schemas.PAYLOAD + ", _broken string"
    body = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = raw.withColumn("_p", body)
    fields = [c for c in schemas.PAYLOAD.replace("map<string,string>", "map").split(", ")]
    names = [c.split(" ")[0] for c in fields]
    good = F.col("_p").isNotNull() & F.col("_p._broken").isNull()
    return out.select(*raw.columns, *(F.when(good, F.col(f"_p.{n}")).alias(n) for n in names), good.alias("parsed"))


def error_reason() -> Column:
    """The first reason against a decoded row, null for a good one."""
    reason = F.when(~F.col("parsed"), F.lit("unparsable"))
    for name in schemas.REQUIRED:
        reason = reason.when(F.col(name).isNull(), F.lit(f"{name}_null"))
    for name, width in schemas.WIDTHS.items():
        reason = reason.when(F.length(name) > width, F.lit(f"{name}_too_long"))
    return reason


def split_dead_letters(decoded: DataFrame, failed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead rows with error_reason and failed_at)."""
    marked = decoded.withColumn("error_reason", error_reason())
    return marked.filter("error_reason is null").drop("error_reason"), marked.filter("error_reason is not null").withColumn("failed_at", failed_at)


def stamp(decoded: DataFrame, received_at: Column, conn: str = "conn_id", order: str = "seq") -> DataFrame:
    """Receive time for device time; ``routed_id`` is the first non-empty id of the connection so far."""
    ids = decoded.filter(F.coalesce("node_id", F.lit("")) != "").groupBy(conn).agg(F.min_by("node_id", order).alias("_id"), F.min(order).alias("_from"))
    routed = F.when(F.col(order) >= F.col("_from"), F.col("_id")).otherwise("")
    return decoded.join(ids, conn, "left").withColumn("routed_id", routed).withColumn("recorded_at", received_at).drop("_id", "_from")


def archive_rows(pings: DataFrame) -> DataFrame:
    """Pings as rows of the history table."""
    return pings.selectExpr(
        "seq", "tenant_id", "node_id", "node_type AS asset_type", "status", "lat", "lon", "velocity_mps", "heading_deg", "battery", "recorded_at", "to_date(recorded_at) AS date"
    )


def archive(pings: DataFrame, path: str, mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """Append to the history table, in folders by tenant and date; a task writes few of them, and the days of a large
    tenant are split over several tasks. Rows of a folder follow a space-filling curve, so each file and page covers a
    small area, and node_id has bloom filters: questions for a box or an asset pass most of a day by."""
    rows = geo.with_curve(archive_rows(pings), "lat", "lon", "_z").hint("rebalance", "tenant_id", "date")
    ordered = rows.sortWithinPartitions("tenant_id", "date", "_z").drop("_z")
    out = ordered.write.mode(mode).partitionBy("tenant_id", "date").option("maxRecordsPerFile", rows_per_file)
    out.option("parquet.bloom.filter.enabled#node_id", "true").option("parquet.bloom.filter.expected.ndv#node_id", "100000").parquet(path)
