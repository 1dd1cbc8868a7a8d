"""The streaming queries: fixture views written as several files, read as a stream, with the oracle of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.operators import metrics, roads
from fleetspark.plans import catalog
from fleetspark.plans.catalog import now, r6
from fleetspark.sources.fixtures import ctes, load
from fleetspark.sources.storage import shared_folder
from fleetspark.streaming import jobs


#: Rows of a file of ``_stream``, about: larger parts have several files, written at the same time.
FILE_ROWS = 250_000


def _stream(spark: SparkSession, sf_dir: str, view: str, time: str | None = None) -> tuple[DataFrame, str]:
    """The view as a stream of four parts of later and later rows, one a batch; and a folder for the job. A part has as
    many files as its rows ask for, the same number in each."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, view)
    files = max(1, rows.count() // (4 * FILE_ROWS))
    if time is None:
        rows.repartition(4 * files).write.parquet(f"{folder}/in")
    else:
        cuts = rows.select(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [0.25, 0.5, 0.75]).alias("c")).first()["c"] or [0, 0, 0]
        at = F.unix_micros(F.col(time).cast("timestamp"))
        for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
            part = rows if low is None else rows.filter((at > low) | at.isNull() if high is None else at > low)  # null times come last
            part = part if high is None else part.filter(at <= high)
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapping cells of the road nodes, as a table."""
    return roads.snap_cells(load(spark, sf_dir, "road_nodes"))


def stream_archive(spark, sf_dir):
    raw, folder = _stream(spark, sf_dir, "raw_telemetry")
    return jobs.archive(raw, folder, now()).select("seq", "error_reason")


def stream_latest_position(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry", "recorded_at")
    return jobs.latest_position(pings, folder).select("seq", "tenant_id", "node_id", "asset_class", "status", "lat", "lon", "battery", "recorded_at")


def stream_live_positions(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry", "recorded_at")
    return jobs.live_positions(pings, folder)


def stream_rebalance(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry", "recorded_at")
    return jobs.rebalance(pings, load(spark, sf_dir, "zones"), folder).withColumn("distance_km", F.round("distance_km", 6)).withColumn("turn", F.col("turn").cast("long"))


def stream_congestion(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry")
    return jobs.congestion(pings, _cells(spark, sf_dir), folder).select("node_id", r6("multiplier"), "recorded_at")


def stream_snap_to_node(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry")
    return jobs.snapped(pings.select("seq", "lat", "lon"), _cells(spark, sf_dir), folder).select("seq", F.col("road_node").alias("node_id"), r6("km"))


def stream_handover_events(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry", "recorded_at")
    commands, _ = _stream(spark, sf_dir, "commands", "issued_at")
    return jobs.handovers(pings, commands, folder)


def stream_stabilize(spark, sf_dir):
    proposals, folder = _stream(spark, sf_dir, "weight_proposals", "ts")
    return jobs.stabilized(proposals, folder).withColumn("weight", F.round("weight", 6))


def stream_demand(spark, sf_dir):
    requests, folder = _stream(spark, sf_dir, "rides", "ts")
    return jobs.demand(requests, folder).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_uplinks(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry", "recorded_at")
    return jobs.uplinks(pings, folder).withColumn("second", F.col("second").cast("timestamp_ntz"))


def stream_uplink_sketches(spark, sf_dir):
    pings, folder = _stream(spark, sf_dir, "telemetry", "recorded_at")
    seconds = metrics.sketched_uplinks(jobs.uplink_sketches(pings, folder))
    return seconds.withColumn("second", F.col("second").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (stream_archive, stream_latest_position, stream_live_positions, stream_rebalance, stream_congestion, stream_snap_to_node, stream_handover_events, stream_stabilize, stream_demand, stream_uplinks, stream_uplink_sketches)}
ORACLES = {
    "stream_archive": f"SELECT r.seq, d.error_reason FROM ({catalog.ORACLES['decode_telemetry']}) r LEFT JOIN ({catalog.ORACLES['dead_letters']}) d ON d.seq = r.seq",
    "stream_latest_position": catalog.ORACLES["latest_position"],
    "stream_live_positions": f"SELECT seq, node_id, lat, lon, recorded_at FROM ({catalog.ORACLES['latest_position']}) p QUALIFY recorded_at >= max(recorded_at) OVER () - INTERVAL '120' SECOND",
    "stream_rebalance": catalog.ORACLES["relocation_plan"],
    "stream_congestion": f"SELECT node_id, multiplier, recorded_at FROM ({catalog.ORACLES['congestion_events']}) c QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY recorded_at DESC, seq DESC) = 1",
    "stream_snap_to_node": catalog.ORACLES["snap_to_node"],
    "stream_handover_events": catalog.ORACLES["handover_events"],
    "stream_stabilize": catalog.ORACLES["stabilize_weights"],
    "stream_demand": f"WITH {ctes('rides')}\nSELECT date_trunc('minute', ts) - k * INTERVAL '1' MINUTE AS start, CAST(floor(lat / 0.2e0) AS bigint) AS x, CAST(floor(lon / 0.2e0) AS bigint) AS y, count(*) AS requests FROM rides, (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY 1, 2, 3",
    "stream_uplinks": f"WITH {ctes('telemetry')}\nSELECT date_trunc('second', recorded_at) AS second, count(DISTINCT node_id) AS uplinks, count(*) AS messages FROM telemetry GROUP BY 1",
    # a second hears few assets, of which a sketch is exact
    "stream_uplink_sketches": f"WITH {ctes('telemetry')}\nSELECT date_trunc('second', recorded_at) AS second, count(DISTINCT node_id) AS uplinks, count(*) AS messages, CASE WHEN count(DISTINCT node_id) > 40000 THEN 'danger' WHEN count(DISTINCT node_id) > 20000 THEN 'warning' ELSE 'normal' END AS level FROM telemetry GROUP BY 1",
}
