"""The registered queries over the fixture views, each beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark import schemas
from fleetspark.functions import geo, hexgrid, pricing
from fleetspark.operators import demand, handover, history, match, metrics, roads, routing, stabilize, state, trips, zones
from fleetspark.sources import ingest, storage
from fleetspark.sources.fixtures import AS_OF, ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"
HUB_LAT, HUB_LON = "1.30067e1", "8.02206e1"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def r6(name: str):
    return F.round(name, 6).alias(name)


def query(sql: str, *views: str):
    """Registers a function of loaded views under its name, with its SQL. The views go in front; SQL that begins with
    STEP or RECURSIVE goes on with its own WITH list."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(load(spark, sf_dir, v) for v in views))
        views_sql = ctes(*dict.fromkeys(views))
        head, _, rest = sql.partition(" ")
        if head == "STEP":
            ORACLES[f.__name__] = f"WITH {views_sql}, {rest}"
        elif head == "RECURSIVE":
            ORACLES[f.__name__] = f"WITH RECURSIVE {views_sql}, {rest}"
        else:
            ORACLES[f.__name__] = f"WITH {views_sql}\n{sql}"
        return f

    return add


# --- sources and sinks

_JSON = """STEP j AS (SELECT *, json_valid(value) AS parsed, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS b FROM raw_telemetry),
d AS (SELECT seq, conn_id, value, parsed, json_extract_string(b, '$.tenant_id') AS tenant_id, json_extract_string(b, '$.node_id') AS node_id,
  CAST(json_extract_string(b, '$.asset_class') AS int) AS asset_class, CAST(json_extract_string(b, '$.lat') AS double) AS lat,
  CAST(json_extract_string(b, '$.lon') AS double) AS lon, json_extract_string(b, '$.status') AS status,
  CAST(json_extract_string(b, '$.battery') AS int) AS battery FROM j)
"""


@query(_JSON + "SELECT seq, tenant_id, node_id, asset_class, lat, lon, status, battery, parsed FROM d", "raw_telemetry")
def decode_telemetry(raw):
    return ingest.decode(raw).select("seq", "tenant_id", "node_id", "asset_class", "lat", "lon", "status", "battery", "parsed")


@query(
    _JSON
    + """SELECT * FROM (SELECT seq, value, CASE WHEN NOT parsed THEN 'unparsable' WHEN tenant_id IS NULL THEN 'tenant_id_null' WHEN node_id IS NULL THEN 'node_id_null'
  WHEN asset_class IS NULL THEN 'asset_class_null' WHEN lat IS NULL THEN 'lat_null' WHEN lon IS NULL THEN 'lon_null' WHEN status IS NULL THEN 'status_null'
  WHEN length(tenant_id) > 50 THEN 'tenant_id_too_long' WHEN length(node_id) > 50 THEN 'node_id_too_long' WHEN length(status) > 20 THEN 'status_too_long' END AS error_reason FROM d)
WHERE error_reason IS NOT NULL""",
    "raw_telemetry",
)
def dead_letters(raw):
    return ingest.split_dead_letters(ingest.decode(raw), now())[1].select("seq", "value", "error_reason")


@query(
    _JSON
    + f""", f AS (SELECT conn_id, arg_min(node_id, seq) AS id, min(seq) AS start FROM d WHERE coalesce(node_id, '') <> '' GROUP BY conn_id)
SELECT d.seq, d.conn_id, CASE WHEN d.seq >= f.start THEN f.id ELSE '' END AS routed_id, {NOW} AS recorded_at FROM d LEFT JOIN f ON d.conn_id = f.conn_id""",
    "raw_telemetry",
)
def stamp_ingest(raw):
    return ingest.stamp(ingest.decode(raw), now()).select("seq", "conn_id", "routed_id", "recorded_at")


_HISTORY = "SELECT seq, tenant_id, node_id, node_type AS asset_type, status, lat, lon, velocity_mps, heading_deg, battery, recorded_at, CAST(recorded_at AS date) AS date FROM telemetry"


def _archived(telemetry):
    """The history table that the pings are written to, read again."""
    path = f"{storage.shared_folder(telemetry.sparkSession)}/history-{uuid.uuid4().hex}"
    ingest.archive(telemetry, path)
    return telemetry.sparkSession.read.parquet(path)


@query(_HISTORY, "telemetry")
def archive_history(telemetry):
    return _archived(telemetry).select("seq", "tenant_id", "node_id", "asset_type", "status", "lat", "lon", "velocity_mps", "heading_deg", "battery", "recorded_at", "date")


@query("SELECT seq, node_id, lat, lon, recorded_at FROM telemetry WHERE node_id = 'NODE-3' AND recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'", "telemetry")
def node_history(telemetry):
    return history.track(_archived(telemetry), "NODE-3", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("seq", "node_id", "lat", "lon", "recorded_at")


@query("SELECT seq, node_id, lat, lon, recorded_at FROM telemetry WHERE lat BETWEEN 1.29e1 AND 1.29e1 + 1e-1 AND lon BETWEEN 8.01e1 AND 8.01e1 + 1e-1 AND recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'", "telemetry")
def bbox_history(telemetry):
    return history.in_bbox(_archived(telemetry), (12.9, 80.1, 0.1, 0.1), "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("seq", "node_id", "lat", "lon", "recorded_at")


# --- geometry, predicates, projections

_TO_HUB = geo.haversine_km("lat", "lon", HUB_LAT, HUB_LON)


@query(f"SELECT seq, round(2 * 6371e0 * asin(least(1e0, sqrt(power(sin(radians(lat - {HUB_LAT}) / 2), 2) + cos(radians(lat)) * cos(radians({HUB_LAT})) * power(sin(radians(lon - {HUB_LON}) / 2), 2)))), 6) AS km FROM telemetry", "telemetry")
def haversine_distance(telemetry):
    return telemetry.select("seq", F.round(F.expr(_TO_HUB), 6).alias("km"))


@query("SELECT query_id, round(lat - radius_km / 111, 6) AS x, round(lon - radius_km / (111 * cos(radians(lat))), 6) AS y, round(2 * radius_km / 111, 6) AS width, round(2 * radius_km / (111 * cos(radians(lat))), 6) AS height FROM query_points", "query_points")
def bounding_box(points):
    return points.select("query_id", *(F.round(F.expr(e), 6).alias(n) for n, e in geo.bounding_box("lat", "lon", "radius_km").items()))


@query(
    """STEP p AS (SELECT seq, radians(lat) AS a, radians(lon) AS b, radians(heading_deg) AS h, 0.2e0 / 6371 AS d FROM telemetry),
n AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(h)) AS na FROM p)
SELECT seq, round(degrees(na), 6) AS new_lat, round(degrees(b + atan2(sin(h) * sin(d) * cos(a), cos(d) - sin(a) * sin(na))), 6) AS new_lon FROM n""",
    "telemetry",
)
def project_coordinate(telemetry):
    lat, lon = geo.project("lat", "lon", "heading_deg", "0.2e0")
    return telemetry.select("seq", F.round(F.expr(lat), 6).alias("new_lat"), F.round(F.expr(lon), 6).alias("new_lon"))


@query(f"SELECT seq, round(sqrt((lat - {HUB_LAT}) * (lat - {HUB_LAT}) + (lon - {HUB_LON}) * (lon - {HUB_LON})), 6) AS degrees FROM telemetry", "telemetry")
def planar_distance(telemetry):
    return telemetry.select("seq", F.round(F.expr(geo.planar("lat", "lon", HUB_LAT, HUB_LON)), 6).alias("degrees"))


@query(
    """SELECT seq, (lat BETWEEN 1.295e1 AND 1.295e1 + 1e-1 AND lon BETWEEN 8.015e1 AND 8.015e1 + 1e-1) AS inside,
  (lat <= 1.295e1 + 1e-1 AND lat + 5e-2 >= 1.295e1 AND lon <= 8.015e1 + 1e-1 AND lon + 5e-2 >= 8.015e1) AS meets FROM telemetry""",
    "telemetry",
)
def box_predicates(telemetry):
    box = ("1.295e1", "8.015e1", "1e-1", "1e-1")
    return telemetry.select("seq", F.expr(geo.contains(*box, "lat", "lon")).alias("inside"), F.expr(geo.intersects(box, ("lat", "lon", "5e-2", "5e-2"))).alias("meets"))


@query("SELECT seq, node_id FROM telemetry WHERE lat BETWEEN 1.29e1 AND 1.31e1 AND lon BETWEEN 8.01e1 AND 8.02e1 + 1e-1", "telemetry")
def service_area_filter(telemetry):
    return telemetry.filter("lat >= 1.29e1 AND lat <= 1.31e1").filter(geo.in_service_area(box=(12.0, 80.1, 2.0, 0.2))).select("seq", "node_id")


@query("SELECT seq, asset_class FROM telemetry WHERE (asset_class & 24) > 0", "telemetry")
def class_mask_filter(telemetry):
    return telemetry.filter(match.class_match("asset_class", "24")).select("seq", "asset_class")


@query("SELECT seq, tenant_id FROM telemetry WHERE tenant_id = 'beta_freight'", "telemetry")
def tenant_filter(telemetry):
    return match.for_tenant(telemetry, "beta_freight").select("seq", "tenant_id")


def _case(names: dict[int, str]) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in names.values()) + "], {} + 1)"


@query(f"SELECT seq, {_case(schemas.NODE_TYPES).format('node_type')} AS type_name, {_case(schemas.STATUSES).format('status')} AS status_name, CAST(1 << (node_type - 1) AS int) AS class_bit FROM telemetry", "telemetry")
def decode_enums(telemetry):
    return telemetry.select("seq", F.expr(schemas.name_of(schemas.NODE_TYPES, "node_type")).alias("type_name"), F.expr(schemas.name_of(schemas.STATUSES, "status")).alias("status_name"), F.expr("shiftleft(1, node_type - 1)").alias("class_bit"))


@query(
    f"""STEP k AS (SELECT seq, asset_class, {_TO_HUB} AS km FROM telemetry)
SELECT seq, CAST(trunc(CASE WHEN asset_class = 16 THEN km / 60 * 3600 ELSE km * 1.4e0 / 40 * 3600 END) AS int) AS by_mode, CAST(trunc(km / 40 * 3600) AS int) AS flat,
  CASE WHEN asset_class = 16 THEN 'euclidean_air' ELSE 'osrm_street' END AS route_type FROM k""",
    "telemetry",
)
def eta_by_mode(telemetry):
    km = telemetry.withColumn("km", F.expr(_TO_HUB))
    return km.select("seq", F.expr(pricing.eta_seconds("km", "asset_class")).alias("by_mode"), F.expr(pricing.eta_seconds("km", "asset_class", "flat")).alias("flat"), F.expr(pricing.route_type("asset_class")).alias("route_type"))


@query(
    """STEP t AS (SELECT * FROM (VALUES (1, 20, 5, 1e0), (2, 30, 10, 1.5e0), (4, 50, 15, 2e0), (8, 80, 20, 3e0)) AS v(a, base, km, mi))
SELECT id, round((t.base + 5.5e0 * t.km + 12.5e0 * t.mi) * 1.25e0, 6) AS fare FROM drivers JOIN t ON t.a = drivers.asset""",
    "drivers",
)
def fare(drivers):
    return drivers.select("id", F.round(F.expr(pricing.fare("asset", "5.5e3", "7.5e2", "1.25e0")), 6).alias("fare"))


# --- state

_LATEST = "(SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY recorded_at DESC, seq DESC) = 1)"
_AREA = "lat BETWEEN 12 AND 14 AND lon BETWEEN 7.95e1 AND 81"


@query(f"SELECT seq, tenant_id, node_id, asset_class, status, lat, lon, battery, recorded_at FROM {_LATEST} WHERE {_AREA}", "telemetry")
def latest_position(telemetry):
    return state.latest(telemetry).select("seq", "tenant_id", "node_id", "asset_class", "status", "lat", "lon", "battery", "recorded_at")


@query(f"SELECT id, status, updated_at FROM drivers WHERE status <> 'offline' AND updated_at >= {NOW} - INTERVAL '60' SECOND", "drivers")
def active_drivers(drivers):
    return state.active(drivers, now()).select("id", "status", "updated_at")


@query(f"SELECT 'driver' AS kind, id AS name FROM drivers WHERE updated_at >= {NOW} - INTERVAL '120' SECOND UNION ALL SELECT 'demand', CAST(request_id AS varchar(20)) FROM rides WHERE ts >= {NOW} + INTERVAL '3300' SECOND", "drivers", "rides")
def expire_stale(drivers, requests):
    kept = state.expire(drivers, now(), 120, "updated_at").select(F.lit("driver").alias("kind"), F.col("id").alias("name"))
    heard = state.expire(requests, now() + F.make_dt_interval(hours=F.lit(1)), 300, "ts").select(F.lit("demand"), F.col("request_id").cast("string"))
    return kept.union(heard)


_BEATS = "beats AS (SELECT event_id AS seq, 'D-' || CAST(user_id AS varchar(20)) AS id, 1.3e1 + (event_id % 97) / 1e3 AS lat, 8.02e1 + (event_id % 89) / 1e3 AS lon, ts AS updated_at FROM events)"


def _beats(telemetry):
    return telemetry.selectExpr("seq", "concat('D-', substr(node_id, 6)) AS id", "1.3e1 + (seq % 97) / 1e3 AS lat", "8.02e1 + (seq % 89) / 1e3 AS lon", "recorded_at AS updated_at")


@query(
    f"""STEP {_BEATS}, u AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'booked' ELSE 'available' END AS status, CAST(power(2, seq % 4) AS int) AS asset FROM beats
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) = 1)
SELECT id, lat, lon, status, asset, updated_at FROM u UNION ALL SELECT id, lat, lon, status, asset, updated_at FROM drivers WHERE id NOT IN (SELECT id FROM u)""",
    "drivers",
    "telemetry",
)
def upsert_drivers(drivers, telemetry):
    updates = _beats(telemetry).selectExpr("*", "CASE WHEN seq % 3 = 0 THEN 'booked' ELSE 'available' END AS status", "CAST(power(2, seq % 4) AS int) AS asset")
    return state.upsert(drivers, updates)


@query(
    f"""STEP {_BEATS}, u AS (SELECT * FROM beats QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) = 1)
SELECT coalesce(u.id, d.id) AS id, coalesce(u.lat, d.lat) AS lat, coalesce(u.lon, d.lon) AS lon, coalesce(d.status, 'available') AS status, coalesce(d.asset, 4) AS asset, coalesce(u.updated_at, d.updated_at) AS updated_at
FROM drivers d FULL JOIN u ON d.id = u.id""",
    "drivers",
    "telemetry",
)
def heartbeat_merge(drivers, telemetry):
    return state.heartbeat(drivers, _beats(telemetry))


@query(
    f"""STEP c AS (SELECT * FROM commands QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY issued_at DESC, seq DESC) = 1)
SELECT coalesce(p.node_id, c.node_id) AS node_id, p.lat, p.lon, p.battery, p.velocity_mps, p.heading_deg, p.recorded_at, c.directive, c.target_lat, c.target_lon, c.issued_at FROM {_LATEST} p FULL JOIN c ON p.node_id = c.node_id""",
    "telemetry",
    "commands",
)
def asset_state(telemetry, commands):
    return state.asset_view(telemetry, commands)


@query("SELECT node_id AS asset_id, lat, lon, battery AS energy, velocity_mps AS velocity, heading_deg AS heading, recorded_at AS ts, seq FROM telemetry WHERE seq % 10 <> 3", "telemetry")
def state_change_events(telemetry):
    kind = F.when(F.col("seq") % 10 == 3, "heartbeat").otherwise("telemetry")
    return state.change_events(telemetry.withColumn("kind", kind), F.col("recorded_at"))


@query("SELECT node_id AS asset_id, lat, lon, battery AS energy FROM telemetry WHERE recorded_at <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY recorded_at DESC, seq DESC) = 1", "telemetry")
def replay_state(telemetry):
    events = state.change_events(telemetry.withColumn("kind", F.lit("telemetry")), F.col("recorded_at"))
    return state.replay(events, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in schemas.TRANSITIONS) + ") AS v(a, b))"


@query(f"STEP {_RULES}\nSELECT seq, current_status, new_status, EXISTS (SELECT 1 FROM rules WHERE a = current_status AND b = new_status) AS valid FROM trip_requests", "trip_requests")
def trip_transitions(requests):
    return trips.valid(requests).select("seq", "current_status", "new_status", "valid")


@query(
    f"""RECURSIVE {_RULES}, q AS (SELECT t.*, r.a IS NOT NULL AS ok, row_number() OVER (PARTITION BY trip_id ORDER BY ts, seq) AS n FROM trip_requests t LEFT JOIN rules r ON r.a = t.current_status AND r.b = t.new_status),
f AS (SELECT CAST(0 AS bigint) AS n, trip_id, CAST(NULL AS bigint) AS seq, CAST(NULL AS boolean) AS accepted, CAST(NULL AS varchar) AS reason, 'requested' AS status, CAST(NULL AS timestamp) AS started_at, CAST(NULL AS timestamp) AS completed_at FROM (SELECT DISTINCT trip_id FROM trip_requests)
  UNION ALL SELECT q.n, q.trip_id, q.seq, q.ok AND q.current_status = f.status, CASE WHEN NOT q.ok THEN 'invalid_transition' WHEN q.current_status <> f.status THEN 'status_mismatch' END,
    CASE WHEN q.ok AND q.current_status = f.status THEN q.new_status ELSE f.status END,
    CASE WHEN q.ok AND q.current_status = f.status AND q.new_status = 'trip_started' THEN q.ts ELSE f.started_at END,
    CASE WHEN q.ok AND q.current_status = f.status AND q.new_status IN ('completed', 'canceled') THEN q.ts ELSE f.completed_at END
  FROM f JOIN q ON q.trip_id = f.trip_id AND q.n = f.n + 1)
SELECT seq, trip_id, accepted, reason, status, started_at, completed_at FROM f WHERE n > 0""",
    "trip_requests",
)
def trip_replay(requests):
    return trips.replay(requests)


@query(
    """RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY ts, seq) AS n FROM booking_events),
f AS (SELECT CAST(0 AS bigint) AS n, driver_id, true AS is_free, false AS won FROM (SELECT DISTINCT driver_id FROM booking_events)
  UNION ALL SELECT q.n, q.driver_id, q.kind = 'release', q.kind = 'book' AND f.is_free FROM f JOIN q ON q.driver_id = f.driver_id AND q.n = f.n + 1)
SELECT q.seq AS trip_id, q.driver_id, q.rider_lat, q.rider_lon, 'driver_assigned' AS status, q.ts AS created_at FROM f JOIN q ON q.driver_id = f.driver_id AND q.n = f.n WHERE f.won""",
    "booking_events",
)
def resolve_bookings(events):
    return trips.book(events)


# --- distance joins

_POS = f"pos AS (SELECT * FROM {_LATEST} WHERE {_AREA})"


def _near(queries: str, radius: str, mask: str, cap: int, model: str) -> str:
    km = geo.haversine_km("q.lat", "q.lon", "p.lat", "p.lon")
    eta = pricing.eta_seconds("km", "asset_class", model)
    return f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY eta_seconds, round(km, 9), node_id) AS rank FROM (
  SELECT *, {eta} AS eta_seconds FROM (SELECT q.*, p.node_id, p.asset_class, p.lat AS a_lat, p.lon AS a_lon, {km} AS km FROM {queries} q JOIN pos p ON q.tenant_id = p.tenant_id AND (p.asset_class & {mask}) > 0
    AND abs(p.lat - q.lat) <= {radius} / 111 AND abs(p.lon - q.lon) <= {radius} / (111 * cos(radians(q.lat)))) x WHERE km <= {radius.replace('q.', '')}) y QUALIFY rank <= {cap}"""


@query(
    f"STEP {_POS}, n AS ({_near('(SELECT query_id AS qid, * FROM query_points)', 'q.radius_km', 'q.class_mask', 50, 'mode')})\nSELECT qid AS query_id, rank, node_id, asset_class, a_lat AS lat, a_lon AS lon, round(km, 6) AS distance_km, eta_seconds, CASE WHEN asset_class = 16 THEN 'euclidean_air' ELSE 'osrm_street' END AS route_type FROM n",
    "telemetry",
    "query_points",
)
def radius_match(telemetry, points):
    return match.radius(points, state.latest(telemetry)).withColumn("distance_km", F.round("distance_km", 6)).withColumn("rank", F.col("rank").cast("long"))


_SURGE = """dem AS (SELECT r.request_id, count(*) AS demand FROM ride_requests r JOIN rides o ON o.ts <= r.ts AND o.ts >= r.ts - INTERVAL '300' SECOND AND sqrt(power(r.lat - o.lat, 2) + power(r.lon - o.lon, 2)) <= 0.2e0 GROUP BY r.request_id),
sup AS (SELECT r.request_id, count(*) AS supply FROM ride_requests r JOIN drivers d ON d.status = 'available' AND (d.asset & r.asset_req) > 0
  AND d.lat >= r.lat + -0.2e0 AND d.lat <= r.lat + -0.2e0 + 0.04e0 AND d.lon >= r.lon + -0.2e0 AND d.lon <= r.lon + -0.2e0 + 0.04e0 GROUP BY r.request_id),
surge AS (SELECT r.request_id, dem.demand, greatest(coalesce(sup.supply, 0), 1) AS supply, least(greatest(1 + 0.25e0 * dem.demand / greatest(coalesce(sup.supply, 0), 1), 1), 3) AS surge
  FROM ride_requests r JOIN dem ON dem.request_id = r.request_id LEFT JOIN sup ON sup.request_id = r.request_id)"""


@query(f"STEP {_SURGE}\nSELECT request_id, demand, supply, round(surge, 6) AS surge FROM surge", "ride_requests", "drivers", "rides")
def surge_price(requests, drivers, rides):
    return demand.surge(requests, drivers, rides).select("request_id", "demand", "supply", r6("surge"))


@query(
    f"""STEP {_SURGE}, c AS (SELECT r.request_id, d.id AS driver_id, d.asset, {geo.haversine_km("r.lat", "r.lon", "d.lat", "d.lon")} AS km,
  row_number() OVER (PARTITION BY r.request_id ORDER BY round(sqrt(power(r.lat - d.lat, 2) + power(r.lon - d.lon, 2)), 9), d.id) AS pre
  FROM ride_requests r JOIN drivers d ON d.status = 'available' AND (d.asset & r.asset_req) > 0 QUALIFY pre <= 50),
t AS (SELECT *, {pricing.road_seconds("km")} AS eta_seconds, km * 1.4e0 * 1e3 AS metres FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY eta_seconds, round(metres, 6), driver_id) AS rank FROM t QUALIFY rank <= 5)
SELECT k.request_id, k.rank, k.driver_id, k.asset, round(k.metres, 3) AS metres, k.eta_seconds, round(s.surge, 6) AS surge, round({pricing.fare("k.asset", "k.metres", "k.eta_seconds", "s.surge")}, 4) AS fare FROM k JOIN surge s ON s.request_id = k.request_id""",
    "ride_requests",
    "drivers",
    "rides",
)
def nearest_drivers(requests, drivers, rides):
    out = match.nearest_drivers(requests, drivers, demand.surge(requests, drivers, rides))
    return out.select("request_id", F.col("rank").cast("long").alias("rank"), "driver_id", "asset", F.round("metres", 3).alias("metres"), "eta_seconds", r6("surge"), F.round("fare", 4).alias("fare"))


_ROAD_TIMES = f"""road_times AS (SELECT request_id, driver_id, km * 1.4e0 * 1e3 AS metres, CAST({pricing.road_seconds("km")} * (1 + length(driver_id) % 3) AS int) AS eta_seconds FROM c WHERE request_id % 100 <> 0)"""


@query(
    f"""STEP {_SURGE}, c AS (SELECT r.request_id, d.id AS driver_id, d.asset, {geo.haversine_km("r.lat", "r.lon", "d.lat", "d.lon")} AS km,
  row_number() OVER (PARTITION BY r.request_id ORDER BY round(sqrt(power(r.lat - d.lat, 2) + power(r.lon - d.lon, 2)), 9), d.id) AS pre
  FROM ride_requests r JOIN drivers d ON d.status = 'available' AND (d.asset & r.asset_req) > 0 QUALIFY pre <= 50),
{_ROAD_TIMES},
t AS (SELECT c.request_id, c.driver_id, c.asset, c.pre, x.metres, x.eta_seconds, count(x.eta_seconds) OVER (PARTITION BY c.request_id) > 0 AS timed
  FROM c LEFT JOIN road_times x ON x.request_id = c.request_id AND x.driver_id = c.driver_id),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN timed THEN eta_seconds END NULLS LAST, CASE WHEN timed THEN round(metres, 6) END NULLS LAST, CASE WHEN timed THEN 0 ELSE pre END, driver_id) AS rank FROM t QUALIFY rank <= 5)
SELECT k.request_id, k.rank, k.driver_id, k.asset, round(k.metres, 3) AS metres, k.eta_seconds, CASE WHEN eta_seconds IS NOT NULL THEN round(s.surge, 6) END AS surge,
  round({pricing.fare("k.asset", "k.metres", "k.eta_seconds", "s.surge")}, 4) AS fare FROM k JOIN surge s ON s.request_id = k.request_id""",
    "ride_requests",
    "drivers",
    "rides",
)
def nearest_drivers_by_road(requests, drivers, rides):
    pairs, _ = storage.written(match.candidates(requests, drivers))
    km = geo.haversine_km("p_lat", "p_lon", "t_lat", "t_lon")
    # times as a road service would answer: slower to drivers with longer ids, and none at all for every hundredth request
    times = pairs.filter("point_id % 100 <> 0").select(F.col("point_id").alias("request_id"), "driver_id", F.expr(f"{km} * 1.4e0 * 1e3").alias("metres"), F.expr(f"CAST({pricing.road_seconds(km)} * (1 + length(driver_id) % 3) AS int)").alias("eta_seconds"))
    out = match.by_road(pairs, times, demand.surge(requests, drivers, rides))
    return out.select("request_id", F.col("rank").cast("long").alias("rank"), "driver_id", "asset", F.round("metres", 3).alias("metres"), "eta_seconds", r6("surge"), F.round("fare", 4).alias("fare"))


_ZQ = "(SELECT zone_id AS qid, *, target_class AS class_mask FROM zones)"
_SUPPLY = f"""{_POS}, ins AS ({_near(_ZQ, "q.radius_km", "q.class_mask", 500, "flat")}),
sup AS (SELECT z.*, coalesce(i.c, 0) AS supply, greatest(z.required_assets - coalesce(i.c, 0), 0) AS deficit FROM zones z LEFT JOIN (SELECT qid, count(*) AS c FROM ins GROUP BY qid) i ON i.qid = z.zone_id)"""
_PLAN = f"""{_SUPPLY}, out1 AS ({_near("(SELECT zone_id AS qid, *, target_class AS class_mask FROM sup WHERE deficit > 0)", "25", "q.class_mask", 500, "flat")}),
plan AS (SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY rank) AS turn, node_id, lat AS target_lat, lon AS target_lon, km, deficit FROM out1 WHERE km > radius_km"""


@query(f"STEP {_SUPPLY}\nSELECT zone_id, required_assets, supply, deficit FROM sup", "telemetry", "zones")
def zone_supply(telemetry, fixed):
    return zones.supply(fixed, state.latest(telemetry)).select("zone_id", "required_assets", "supply", "deficit")


@query(f"STEP {_PLAN} QUALIFY turn <= deficit)\nSELECT zone_id, turn, node_id, 'RELOCATE' AS directive, target_lat, target_lon, round(km, 6) AS distance_km FROM plan", "telemetry", "zones")
def relocation_plan(telemetry, fixed):
    return zones.relocate(fixed, state.latest(telemetry)).withColumn("distance_km", F.round("distance_km", 6)).withColumn("turn", F.col("turn").cast("long"))


@query(f"STEP {_PLAN} AND node_id IN (SELECT node_id FROM reachable) QUALIFY turn <= deficit)\nSELECT zone_id, turn, node_id FROM plan", "telemetry", "zones", "reachable")
def reachable_only(telemetry, fixed, reachable):
    return zones.relocate(fixed, state.latest(telemetry), reachable=reachable).select("zone_id", F.col("turn").cast("long").alias("turn"), "node_id")


@query(f"""STEP {_PLAN} QUALIFY turn <= deficit)
SELECT zone_id, node_id, '{{"node_id":"' || node_id || '","command":{{"directive":"RELOCATE","target_lat":' || CAST(target_lat AS varchar) || ',"target_lon":' || CAST(target_lon AS varchar) || '}}}}' AS message FROM plan""", "telemetry", "zones")
def command_envelope(telemetry, fixed):
    return zones.envelope(zones.relocate(fixed, state.latest(telemetry)))


@query(
    """STEP j AS (SELECT seq, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS b FROM command_messages),
k AS (SELECT seq, b, CASE WHEN json_type(b, '$.node_id') = 'VARCHAR' THEN json_extract_string(b, '$.node_id') END AS node, CASE WHEN json_type(b, '$.command.directive') = 'VARCHAR' THEN json_extract_string(b, '$.command.directive') END AS inside,
  CASE WHEN json_type(b, '$.directive') = 'VARCHAR' THEN json_extract_string(b, '$.directive') END AS beside FROM j),
s AS (SELECT *, CASE WHEN node IS NULL OR coalesce(inside, beside) IS NULL THEN NULL WHEN inside IS NOT NULL THEN 'nested' ELSE 'flat' END AS shape FROM k)
SELECT seq, shape, CASE WHEN shape IS NOT NULL THEN node END AS node_id, CASE WHEN shape IS NOT NULL THEN coalesce(inside, beside) END AS directive,
  CAST(CASE shape WHEN 'nested' THEN json_extract_string(b, '$.command.target_lat') WHEN 'flat' THEN json_extract_string(b, '$.target_lat') END AS double) AS target_lat,
  CAST(CASE shape WHEN 'nested' THEN json_extract_string(b, '$.command.target_lon') WHEN 'flat' THEN json_extract_string(b, '$.target_lon') END AS double) AS target_lon FROM s""",
    "command_messages",
)
def read_commands(messages):
    return zones.read_commands(messages).select("seq", "shape", "node_id", "directive", "target_lat", "target_lon")


@query(
    f"""STEP s AS (SELECT p.seq, n.id, {geo.haversine_km("p.lat", "p.lon", "n.lat", "n.lon")} AS km FROM telemetry p JOIN road_nodes n ON abs(p.lat - n.lat) < 0.1e0 AND abs(p.lon - n.lon) < 0.1e0),
b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(km, 9), id) AS k FROM s QUALIFY k = 1)
SELECT seq, id AS node_id, round(km, 6) AS km FROM b""",
    "telemetry",
    "road_nodes",
)
def snap_to_node(telemetry, nodes):
    return roads.snap(telemetry, nodes, "seq").select("seq", "node_id", r6("km"))


def _hex(lat: str, lon: str, name: str) -> str:
    q, r = hexgrid.axial(lat, lon)
    return f"{q} AS {name}_q, {r} AS {name}_r"


_HC = hexgrid.center("h_q", "h_r")
_PROJ = geo.project("lat", "lon", "heading_deg", "0.2e0")
_HANDOVER = f"""h1 AS (SELECT *, {_hex("lat", "lon", "h")} FROM telemetry),
h2 AS (SELECT *, {_PROJ[0]} AS n_lat, {_PROJ[1]} AS n_lon FROM h1 WHERE {geo.haversine_km("lat", "lon", *_HC)} >= 1),
h3 AS (SELECT *, {_hex("n_lat", "n_lon", "t")} FROM h2),
h4 AS (SELECT * FROM h3 WHERE h_q <> t_q OR h_r <> t_r),
h5 AS (SELECT h.seq, max({{'a': c.issued_at, 's': c.seq, 'd': c.directive, 'y': c.target_lat, 'x': c.target_lon}}) AS m FROM h4 h JOIN commands c ON c.node_id = h.node_id AND c.issued_at <= h.recorded_at GROUP BY h.seq),
hand AS (SELECT h4.seq, h4.node_id, h4.node_type, {hexgrid.cell_id("t_q", "t_r")} AS target_cell, h4.recorded_at, h5.m.d AS directive, h5.m.y AS target_lat, h5.m.x AS target_lon FROM h4 LEFT JOIN h5 ON h4.seq = h5.seq)"""


@query(f"STEP {_HANDOVER}\nSELECT * FROM hand", "telemetry", "commands")
def handover_events(telemetry, commands):
    return handover.detect(telemetry, commands)


@query(
    f"""STEP {_HANDOVER}, lh AS (SELECT * FROM hand QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY recorded_at DESC, seq DESC) = 1),
j AS (SELECT p.node_id, p.lat, p.lon, p.status, lh.node_id IS NOT NULL AND (lh.recorded_at, lh.seq) >= (p.recorded_at, p.seq) AS prewarmed, lh.directive FROM {_LATEST} p LEFT JOIN lh ON lh.node_id = p.node_id)
SELECT node_id, lat, lon, CASE WHEN prewarmed THEN 3 ELSE status END AS status, prewarmed, CASE WHEN prewarmed THEN directive END AS directive FROM j""",
    "telemetry",
    "commands",
)
def handover_prewarm(telemetry, commands):
    return handover.prewarm(state.latest(telemetry), handover.detect(telemetry, commands))


@query("SELECT r.id AS route_id, coalesce(k.risk, 1) AS risk, coalesce(k.risk, 1) <= 0.5e0 AS allow FROM road_nodes r LEFT JOIN route_risk k ON k.route_id = r.id", "road_nodes", "route_risk")
def safety_gate(nodes, risk):
    return routing.gate(nodes.select(F.col("id").alias("route_id")), risk)


# --- aggregations and windows

_HOT_AT = "TIMESTAMP '2024-01-20 00:00:00'"
_HOT = f"""hot AS (SELECT CAST(round(CAST(lat AS decimal(18, 12)), 2) AS double) AS lat, CAST(round(CAST(lon AS decimal(18, 12)), 2) AS double) AS lon, count(*) AS pings FROM telemetry
  WHERE recorded_at BETWEEN {_HOT_AT} - INTERVAL '1' HOUR AND {_HOT_AT} GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (ORDER BY pings DESC, lat, lon) AS rank FROM hot QUALIFY rank <= 3)"""


def _hot(telemetry):
    return demand.hotspots(telemetry, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(f"STEP {_HOT}\nSELECT CAST(rank AS int) AS rank, lat, lon, pings FROM top", "telemetry")
def hotspots(telemetry):
    return _hot(telemetry)


@query(f"STEP {_HOT}\nSELECT 'Predicted-Hotspot-' || CAST(rank AS varchar) AS zone_id, lat, lon, 2e0 AS radius_km, 5 AS required_assets, 16 AS target_class, 'alpha_logistics' AS tenant_id FROM top", "telemetry")
def predicted_zones(telemetry):
    return zones.from_hotspots(_hot(telemetry))


_CHOSEN = f"""{_HOT}, predicted AS (SELECT 'Predicted-Hotspot-' || CAST(rank AS varchar) AS zone_id, lat, lon, 2e0 AS radius_km, 5 AS required_assets, 16 AS target_class, 'alpha_logistics' AS tenant_id FROM top),
chosen AS (SELECT * FROM predicted UNION ALL SELECT * FROM zones WHERE NOT EXISTS (SELECT 1 FROM predicted))"""


@query(f"STEP {_CHOSEN}, {_PLAN.replace('FROM zones', 'FROM chosen')} QUALIFY turn <= deficit)\nSELECT zone_id, turn, node_id, target_lat, target_lon, round(km, 6) AS distance_km FROM plan", "telemetry", "zones")
def predictive_relocation(telemetry, fixed):
    plan = zones.relocate(zones.in_use(zones.from_hotspots(_hot(telemetry)), fixed), state.latest(telemetry))
    return plan.select("zone_id", F.col("turn").cast("long").alias("turn"), "node_id", "target_lat", "target_lon", r6("distance_km"))


@query(f"STEP {_POS}\nSELECT CAST(round(CAST(lat AS decimal(18, 12)), 2) AS double) AS lat, CAST(round(CAST(lon AS decimal(18, 12)), 2) AS double) AS lon, count(*) AS weight FROM pos GROUP BY 1, 2", "telemetry")
def heat_grid(telemetry):
    return demand.heat(state.latest(telemetry))


@query("SELECT date_trunc('second', recorded_at) AS second, count(DISTINCT node_id) AS uplinks, CASE WHEN count(DISTINCT node_id) > 40000 THEN 'danger' WHEN count(DISTINCT node_id) > 20000 THEN 'warning' ELSE 'normal' END AS level FROM telemetry GROUP BY 1 ORDER BY 1 DESC LIMIT 60", "telemetry")
def active_uplinks(telemetry):
    return metrics.uplinks(telemetry)


@query("SELECT second, messages, CAST(sum(messages) OVER (ORDER BY second) AS bigint) AS total FROM (SELECT date_trunc('second', recorded_at) AS second, count(*) AS messages FROM telemetry GROUP BY 1) s", "telemetry")
def ingest_rate(telemetry):
    return metrics.rate(telemetry)


_CONGESTION = f"""sn AS (SELECT p.seq, n.id, {geo.haversine_km("p.lat", "p.lon", "n.lat", "n.lon")} AS km FROM telemetry p JOIN road_nodes n ON abs(p.lat - n.lat) < 0.1e0 AND abs(p.lon - n.lon) < 0.1e0 WHERE p.asset_class <> 64),
sb AS (SELECT seq, id, row_number() OVER (PARTITION BY seq ORDER BY round(km, 9), id) AS k FROM sn QUALIFY k = 1),
cong AS (SELECT p.seq, sb.id AS node_id, least(greatest(15 / greatest(p.velocity_mps, 1), 1), 10) AS multiplier, p.recorded_at FROM telemetry p JOIN sb ON sb.seq = p.seq)"""


@query(f"STEP {_CONGESTION}\nSELECT seq, node_id, round(multiplier, 6) AS multiplier, multiplier > 1.5e0 AS congested, recorded_at FROM cong", "telemetry", "road_nodes")
def congestion_events(telemetry, nodes):
    return roads.congestion(telemetry, nodes).withColumn("multiplier", F.round("multiplier", 6))


_EDGES = f"""sp AS (SELECT w.way_id, w.oneway, a.pos, a.node_id AS s, b.node_id AS t FROM ways w JOIN way_nodes a ON a.way_id = w.way_id JOIN way_nodes b ON b.way_id = w.way_id AND b.pos = a.pos + 1
  WHERE w.highway IN ({", ".join(f"'{d}'" for d in schemas.DRIVABLE)})),
sk AS (SELECT sp.*, {geo.haversine_km("a.lat", "a.lon", "b.lat", "b.lon")} AS km FROM sp JOIN road_nodes a ON a.id = sp.s JOIN road_nodes b ON b.id = sp.t),
edges AS (SELECT way_id, pos, s AS source_id, t AS target_id, km FROM sk UNION ALL SELECT way_id, pos, t, s, km FROM sk WHERE coalesce(oneway, 'no') <> 'yes')"""
_WEIGHTED = f"""{_CONGESTION}, {_EDGES}, lm AS (SELECT node_id, multiplier FROM cong QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY recorded_at DESC, seq DESC) = 1),
we AS (SELECT e.*, coalesce(lm.multiplier, 1) AS multiplier FROM edges e LEFT JOIN lm ON lm.node_id = e.source_id)"""
_MAP = ("telemetry", "road_nodes", "ways", "way_nodes")


def _weighted(telemetry, nodes, ways, way_nodes):
    return roads.apply_congestion(roads.segments(ways, way_nodes, nodes), roads.congestion(telemetry, nodes))


@query(f"STEP {_WEIGHTED}\nSELECT way_id, pos, source_id, target_id, round(km, 6) AS km, round(multiplier, 6) AS multiplier FROM we", *_MAP)
def segment_congestion(telemetry, nodes, ways, way_nodes):
    return _weighted(telemetry, nodes, ways, way_nodes).select("way_id", "pos", "source_id", "target_id", r6("km"), r6("multiplier"))


@query("SELECT seq, edge_id, count(*) OVER w AS density, round(10 * (1 + 0.15e0 * count(*) OVER w), 6) AS proposed_weight, 0.88e0 AS confidence, ts FROM weight_proposals WINDOW w AS (PARTITION BY edge_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)", "weight_proposals")
def edge_density(proposals):
    return stabilize.propose(proposals).withColumn("proposed_weight", F.round("proposed_weight", 6))


@query(
    """RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ts, seq) AS n FROM weight_proposals),
f AS (SELECT CAST(0 AS bigint) AS n, edge_id, CAST(NULL AS bigint) AS seq, CAST(NULL AS double) AS last, CAST(NULL AS double) AS weight, false AS accepted FROM (SELECT DISTINCT edge_id FROM weight_proposals)
  UNION ALL SELECT n, edge_id, seq, CASE WHEN go THEN ema ELSE last END, CASE WHEN NOT sure THEN base_weight WHEN go THEN ema ELSE stable END, go
  FROM (SELECT *, sure AND NOT (abs((ema - stable) / stable) < 0.04e0) AS go FROM (SELECT q.n, q.edge_id, q.seq, f.last, q.base_weight, q.confidence >= 0.75e0 AS sure, coalesce(f.last, q.base_weight) AS stable,
    0.3e0 * q.proposed_weight + (1 - 0.3e0) * coalesce(f.last, q.base_weight) AS ema FROM f JOIN q ON q.edge_id = f.edge_id AND q.n = f.n + 1) a) b)
SELECT seq, edge_id, round(weight, 6) AS weight, accepted FROM f WHERE n > 0""",
    "weight_proposals",
)
def stabilize_weights(proposals):
    return stabilize.hysteresis(proposals).withColumn("weight", F.round("weight", 6))


@query(f"SELECT seq, {hexgrid.cell_id(*hexgrid.axial('lat', 'lon'))} AS cell FROM telemetry", "telemetry")
def spatial_partition(telemetry):
    cells = handover.with_cell(telemetry).withColumn("cell", F.expr(hexgrid.cell_id("hex_q", "hex_r")))
    return cells.repartition("cell").select("seq", "cell")


# --- roads and routes


@query("SELECT way_id, highway FROM ways WHERE highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'residential')", "ways")
def drivable_ways(ways):
    return roads.drivable(ways).select("way_id", "highway")


@query(f"STEP {_EDGES}\nSELECT way_id, pos, source_id, target_id, round(km, 6) AS km FROM edges", "road_nodes", "ways", "way_nodes")
def build_segments(nodes, ways, way_nodes):
    return roads.segments(ways, way_nodes, nodes).withColumn("km", F.round("km", 6))


@query(f"STEP {_EDGES}\nSELECT (SELECT count(*) FROM road_nodes) AS nodes, (SELECT count(*) FROM ways WHERE highway IN ('motorway', 'primary', 'residential')) AS drivable_ways, (SELECT count(*) FROM edges) AS directed_segments", "road_nodes", "ways", "way_nodes")
def network_stats(nodes, ways, way_nodes):
    return roads.stats(nodes, ways, roads.segments(ways, way_nodes, nodes))


_RELAX = """ew AS (SELECT source_id, target_id, min(km * multiplier) AS w, arg_min(km, km * multiplier) AS km FROM we GROUP BY 1, 2),
bf(src, node, cost, pred) USING KEY (src, node) AS (SELECT DISTINCT source_id, source_id, 0e0, CAST(NULL AS bigint) FROM asked WHERE source_id IN (SELECT id FROM road_nodes) AND target_id IN (SELECT id FROM road_nodes)
  UNION SELECT b.src, e.target_id, min(b.cost + e.w), arg_min(b.node, b.cost + e.w) FROM bf b JOIN ew e ON e.source_id = b.node LEFT JOIN recurring.bf k ON k.src = b.src AND k.node = e.target_id WHERE b.cost + e.w < coalesce(k.cost, 1e300) GROUP BY b.src, e.target_id),
ends AS (SELECT a.pair_id, a.source_id, a.target_id, CASE WHEN a.source_id NOT IN (SELECT id FROM road_nodes) THEN 'source_missing' WHEN a.target_id NOT IN (SELECT id FROM road_nodes) THEN 'target_missing' WHEN b.cost IS NULL THEN 'no_path' ELSE 'ok' END AS status, b.cost
  FROM asked a LEFT JOIN bf b ON b.src = a.source_id AND b.node = a.target_id),
trail AS (SELECT pair_id, source_id, target_id AS node, 0 AS pos FROM ends WHERE status = 'ok' UNION ALL SELECT t.pair_id, t.source_id, b.pred, t.pos - 1 FROM trail t JOIN bf b ON b.src = t.source_id AND b.node = t.node WHERE b.pred IS NOT NULL),
paths AS (SELECT t.pair_id, list(t.node ORDER BY t.pos) AS path, sum(coalesce(e.km, 0)) AS km FROM trail t LEFT JOIN trail u ON u.pair_id = t.pair_id AND u.pos = t.pos - 1 LEFT JOIN ew e ON e.source_id = u.node AND e.target_id = t.node GROUP BY t.pair_id),
routes AS (SELECT e.pair_id, e.status, e.cost, p.km, p.path FROM ends e LEFT JOIN paths p ON p.pair_id = e.pair_id)"""


@query(f"RECURSIVE {_WEIGHTED}, asked AS (SELECT * FROM route_pairs), {_RELAX}\nSELECT pair_id, status, round(cost, 6) AS cost, round(km, 6) AS km, array_to_string(path, '-') AS path FROM routes", *_MAP, "route_pairs")
def shortest_paths(telemetry, nodes, ways, way_nodes, pairs):
    found = routing.shortest(_weighted(telemetry, nodes, ways, way_nodes), nodes, pairs)
    return found.select("pair_id", "status", r6("cost"), r6("km"), F.array_join("path", "-").alias("path"))


@query(
    f"""RECURSIVE {_WEIGHTED}, req AS (SELECT pair_id, 1.2851e1 + (pair_id * 7 % 100) / 1e3 AS lat1, 8.0051e1 + (pair_id * 11 % 100) / 1e3 AS lon1, 1.2951e1 + (pair_id * 13 % 100) / 1e3 AS lat2, 8.0151e1 + (pair_id * 17 % 100) / 1e3 AS lon2 FROM route_pairs),
za AS (SELECT pair_id, arg_min(id, {geo.haversine_km("lat1", "lon1", "lat", "lon")}) AS source_id FROM req CROSS JOIN road_nodes GROUP BY pair_id),
zb AS (SELECT pair_id, arg_min(id, {geo.haversine_km("lat2", "lon2", "lat", "lon")}) AS target_id FROM req CROSS JOIN road_nodes GROUP BY pair_id),
asked AS (SELECT za.pair_id, source_id, target_id FROM za JOIN zb ON za.pair_id = zb.pair_id), {_RELAX},
pts AS (SELECT pair_id, unnest(path) AS id, unnest(range(len(path))) AS pos FROM routes WHERE status = 'ok'),
lines AS (SELECT pair_id, string_agg(CAST(round(n.lat, 4) AS varchar) || ' ' || CAST(round(n.lon, 4) AS varchar), ';' ORDER BY pos) AS line FROM pts JOIN road_nodes n ON n.id = pts.id GROUP BY pair_id)
SELECT r.pair_id AS request_id, r.status, round(r.cost, 6) AS cost, round(r.km, 6) AS km, l.line FROM routes r LEFT JOIN lines l ON l.pair_id = r.pair_id""",
    *_MAP,
    "route_pairs",
)
def route_requests(telemetry, nodes, ways, way_nodes, pairs):
    asked = pairs.selectExpr(
        "pair_id AS request_id", "1.2851e1 + (pair_id * 7 % 100) / 1e3 AS lat1", "8.0051e1 + (pair_id * 11 % 100) / 1e3 AS lon1", "1.2951e1 + (pair_id * 13 % 100) / 1e3 AS lat2", "8.0151e1 + (pair_id * 17 % 100) / 1e3 AS lon2"
    )
    return routing.route(asked, nodes, _weighted(telemetry, nodes, ways, way_nodes)).select("request_id", "status", r6("cost"), r6("km"), "line")
