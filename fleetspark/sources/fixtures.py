"""Inputs derived from the driver tables: SQL that Spark and DuckDB run unchanged."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that stands for "now" in the queries.
AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "telemetry": """
SELECT event_id AS seq,
  CASE user_id % 3 WHEN 0 THEN 'alpha_logistics' WHEN 1 THEN 'beta_freight' ELSE 'gamma_air' END AS tenant_id,
  'NODE-' || CAST(user_id AS varchar(20)) AS node_id,
  CAST(1 + user_id % 7 AS int) AS node_type,
  CAST(power(2, user_id % 7) AS int) AS asset_class,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS status,
  1.285e1 + (user_id * 7919 % 3000) / 1e4 + (event_id * 31 % 200) / 1e4 AS lat,
  8.005e1 + (user_id * 104729 % 3000) / 1e4 + (event_id * 17 % 200) / 1e4 AS lon,
  (event_id * 13 % 250) / 1e1 AS velocity_mps,
  (event_id * 37 % 360) * 1e0 AS heading_deg,
  CAST(event_id * 11 % 101 AS int) AS battery,
  ts AS recorded_at
FROM events
""",
    "raw_telemetry": """
SELECT event_id AS seq, 'CONN-' || CAST(user_id AS varchar(20)) AS conn_id,
  CASE WHEN event_id % 50 = 7 THEN '{"node_id": broken'
       WHEN event_id % 50 = 11 THEN '{"node_id":"N","lat":1.0,"lon":2.0}'
       ELSE '{"tenant_id":"alpha_logistics","node_id":"NODE-' || CAST(user_id AS varchar(20)) ||
            '","asset_class":16,"lat":13.04,"lon":80.24,"status":"idle","battery":' ||
            CAST(event_id % 101 AS varchar(20)) || '}' END AS value
FROM events
""",
    "commands": """
SELECT event_id AS seq, 'NODE-' || CAST(user_id AS varchar(20)) AS node_id,
  CASE WHEN event_id % 4 = 0 THEN 'HOLD' ELSE 'RELOCATE' END AS directive,
  1.3e1 + (event_id % 100) / 1e4 AS target_lat, 8.02e1 + (event_id % 90) / 1e4 AS target_lon, ts AS issued_at
FROM events WHERE event_type = 'click'
""",
    "command_messages": """
SELECT event_id AS seq, ts AS issued_at,
  CASE WHEN event_id % 50 = 7 THEN '{"node_id": broken'
       WHEN event_id % 50 = 11 THEN '{"node_id":"NODE-1","command":{"target_lat":13.5}}'
       WHEN event_id % 50 = 13 THEN '{"node_id":7,"directive":"HOLD"}'
       WHEN event_id % 3 = 0 THEN '{"node_id":"NODE-' || CAST(user_id AS varchar(20)) || '","directive":"HOLD"}'
       WHEN event_id % 3 = 1 THEN '{"node_id":"NODE-' || CAST(user_id AS varchar(20)) || '","directive":"RELOCATE","target_lat":13.' || CAST(event_id % 100 AS varchar(20)) || ',"target_lon":80.25}'
       ELSE '{"node_id":"NODE-' || CAST(user_id AS varchar(20)) || '","command":{"directive":"RELOCATE","target_lat":13.' || CAST(event_id % 100 AS varchar(20)) || ',"target_lon":80.5}}' END AS value
FROM events
""",
    "zones": """
SELECT * FROM (VALUES
 ('Hub-Guindy', 1.30067e1, 8.02206e1, 5e0, 3, 16, 'alpha_logistics'),
 ('Hub-Adyar', 1.30012e1, 8.02565e1, 3e0, 2, 16, 'alpha_logistics'),
 ('Hub-North', 1.31e1, 8.03e1, 4e0, 9, 127, 'beta_freight'),
 ('Hub-Full', 1.3e1, 8.02e1, 2e1, 1, 127, 'gamma_air'))
AS z(zone_id, lat, lon, radius_km, required_assets, target_class, tenant_id)
""",
    "query_points": """
SELECT o_orderkey AS query_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'alpha_logistics' WHEN 1 THEN 'beta_freight' ELSE 'gamma_air' END AS tenant_id,
  1.285e1 + (o_orderkey * 7919 % 3163) / 1e4 AS lat, 8.005e1 + (o_orderkey * 104729 % 3187) / 1e4 AS lon,
  5e0 + o_orderkey % 6 AS radius_km,
  CASE o_orderkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 15 WHEN 2 THEN 96 ELSE 255 END AS class_mask
FROM orders WHERE o_orderkey % 20 = 0
""",
    "reachable": """
SELECT DISTINCT 'NODE-' || CAST(user_id AS varchar(20)) AS node_id FROM events WHERE user_id % 4 <> 1
""",
    "road_nodes": """
SELECT p_partkey AS id, 1.285e1 + (p_partkey * 7919 % 3163) / 1e4 AS lat, 8.005e1 + (p_partkey * 104729 % 3187) / 1e4 AS lon
FROM part WHERE p_partkey % 50 <> 49
""",
    "ways": """
SELECT o_orderkey AS way_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential'
    WHEN '4' THEN 'footway' ELSE 'river' END AS highway,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE NULL END AS oneway
FROM orders
""",
    "way_nodes": """
SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos,
  l_partkey AS node_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)
""",
    "route_pairs": """
SELECT p_partkey AS pair_id, p_partkey AS source_id, CASE WHEN p_partkey = 13 THEN 149 ELSE (p_partkey * 17 + 5) % 200 END AS target_id
FROM part WHERE p_partkey < 60 AND p_partkey % 6 = 1 OR p_partkey % 20 = 0
""",
    "route_risk": """
SELECT p_partkey AS route_id, (p_partkey * 37 % 100) / 1e2 AS risk FROM part WHERE p_partkey % 5 <> 0
""",
    "drivers": """
SELECT 'D-' || CAST(c_custkey AS varchar(20)) AS id,
  1.285e1 + (c_custkey * 7919 % 3163) / 1e4 AS lat, 8.005e1 + (c_custkey * 104729 % 3187) / 1e4 AS lon,
  CASE WHEN c_custkey % 5 < 3 THEN 'available' WHEN c_custkey % 5 = 3 THEN 'booked' ELSE 'offline' END AS status,
  CAST(power(2, c_nationkey % 4) AS int) AS asset,
  TIMESTAMP '2024-01-31 00:00:00' - (c_custkey * 7 % 300) * INTERVAL '1' SECOND AS updated_at
FROM customer
""",
    "rides": """
SELECT o_orderkey AS request_id,
  1.285e1 + (o_orderkey * 6151 % 3163) / 1e4 AS lat, 8.005e1 + (o_orderkey * 49157 % 3187) / 1e4 AS lon,
  CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 255 END AS asset_req,
  TIMESTAMP '2024-01-31 00:00:00' + (o_orderkey * 37 % 7200) * INTERVAL '1' SECOND AS ts
FROM orders
""",
    "ride_requests": """
SELECT o_orderkey AS request_id,
  1.285e1 + (o_orderkey * 6151 % 3163) / 1e4 AS lat, 8.005e1 + (o_orderkey * 49157 % 3187) / 1e4 AS lon,
  CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 255 END AS asset_req,
  TIMESTAMP '2024-01-31 00:00:00' + (o_orderkey * 37 % 7200) * INTERVAL '1' SECOND AS ts
FROM orders WHERE o_orderkey % 20 = 0
""",
    "booking_events": """
SELECT event_id AS seq, 'D-' || CAST(user_id AS varchar(20)) AS driver_id,
  CASE event_type WHEN 'signup' THEN 'release' ELSE 'book' END AS kind,
  1.3e1 + (event_id % 100) / 1e3 AS rider_lat, 8.02e1 + (event_id % 70) / 1e3 AS rider_lon, ts
FROM events WHERE event_type IN ('purchase', 'signup')
""",
    "trip_requests": """
SELECT seq, trip_id, driver_id,
  CASE step WHEN 0 THEN 'requested' WHEN 1 THEN 'driver_assigned' WHEN 2 THEN 'driver_arrived' ELSE 'trip_started' END AS current_status,
  CASE WHEN seq % 7 = 0 THEN 'canceled' WHEN seq % 11 = 0 THEN 'completed'
       WHEN step = 0 THEN 'driver_assigned' WHEN step = 1 THEN 'driver_arrived' WHEN step = 2 THEN 'trip_started'
       ELSE 'completed' END AS new_status, ts
FROM (SELECT event_id AS seq, ts, 'D-' || CAST(user_id AS varchar(20)) AS driver_id,
        user_id * 1000000 + CAST(floor((n - 1) / 4) AS bigint) AS trip_id, (n - 1) % 4 AS step
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) AS a) AS b
""",
    "weight_proposals": """
SELECT event_id AS seq, 'EDGE-' || CAST(event_id % 97 AS varchar(20)) AS edge_id,
  1e1 + (event_id * 29 % 40) / 1e1 AS proposed_weight,
  (event_id * 7 % 101) / 1e2 AS confidence, 1e1 AS base_weight, ts
FROM events
""",
}
_TABLES = "region|nation|customer|supplier|part|orders|lineitem|events"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables in ``sf_dir``; zoned times become plain ones."""
    mark = f"fx{zlib.crc32(sf_dir.encode()):08x}"
    for table in set(re.findall(rf"FROM ({_TABLES})\b", VIEWS[name])):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"{mark}_{table}")
    out = spark.sql(re.sub(rf"FROM ({_TABLES})\b", rf"FROM {mark}_\1", VIEWS[name]))
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in out.dtypes))


def ctes(*names: str) -> str:
    """The views as the start of a WITH list."""
    return ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
