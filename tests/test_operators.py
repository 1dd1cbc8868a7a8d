import math
import random

import pytest
from pyspark.sql import functions as F

from fleetspark import schemas
from fleetspark.functions import geo, pricing
from fleetspark.operators import history, match, roads, routing, stabilize, state, trips, zones
from fleetspark.sources import ingest
from fleetspark.sources.fixtures import load

SF = "/root/testdata/sf0.001"


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


def test_haversine_by_hand(spark):
    assert value(spark, geo.haversine_km("0e0", "0e0", "0e0", "9e1")) == pytest.approx(6371 * math.pi / 2)
    assert value(spark, geo.haversine_km("1.3e1", "8.02e1", "1.3e1", "8.02e1")) == 0


def test_fares_and_times(spark):
    assert value(spark, pricing.fare("1", "1e3", "6e1", "1e0")) == 26
    assert value(spark, pricing.fare("64", "1e3", "6e1", "2e0")) == 134  # other types ride as sedans
    assert value(spark, pricing.eta_seconds("1e0", "16")) == 60
    assert value(spark, pricing.eta_seconds("1.23e0", "1")) == 154  # truncated


def test_transition_matrix(spark):
    names = ["requested", "driver_assigned", "driver_arrived", "trip_started", "completed", "canceled"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "current_status string, new_status string")
    assert {(r[0], r[1]) for r in trips.valid(rows).filter("valid").collect()} == set(schemas.TRANSITIONS)


def test_hysteresis_steps():
    row = {"seq": 1, "edge_id": "e", "base_weight": 10.0, "proposed_weight": 20.0, "confidence": 0.5}
    assert stabilize.evaluate(None, row) == (None, {"seq": 1, "edge_id": "e", "weight": 10.0, "accepted": False})
    last, made = stabilize.evaluate(None, row | {"confidence": 0.9})
    assert (last, made["accepted"]) == (13.0, True)
    last, made = stabilize.evaluate(None, row | {"confidence": 0.9, "proposed_weight": 10.5})
    assert (last, made["weight"], made["accepted"]) == (None, 10.0, False)
    assert stabilize.evaluate(0.0, row | {"confidence": 0.9})[1]["accepted"]


def test_radius_does_not_depend_on_cells(spark):
    pings, asked = state.latest(load(spark, SF, "telemetry")), load(spark, SF, "query_points")
    asked = asked.select("query_id", "tenant_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "radius_km", "class_mask")
    rows = [sorted((r.query_id, r.node_id) for r in match.within(asked, pings, size).collect()) for size in (0.02, 0.3)]
    assert rows[0] == rows[1] and rows[0]


def test_distance_joins_are_equi_joins(spark):
    plan = match.radius(load(spark, SF, "query_points"), state.latest(load(spark, SF, "telemetry")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_snap_starts_anywhere(spark):
    pings, nodes = load(spark, SF, "telemetry").limit(50), load(spark, SF, "road_nodes")
    got = {r.seq: r.node_id for r in roads.snap(pings, nodes, "seq").collect()}
    everything = nodes.collect()
    for p in pings.collect():
        far = lambda n: math.hypot(n.lat - p.lat, (n.lon - p.lon) * math.cos(math.radians(13)))  # noqa: E731, B023
        assert far(next(n for n in everything if n.id == got[p.seq])) <= min(map(far, everything)) + 1e-6


def test_no_path_and_own_node(spark):
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(4)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 5.0), (0, 2, 3.0, 1.0)], "source_id long, target_id long, km double, multiplier double")
    pairs = spark.createDataFrame([(1, 0, 2), (2, 2, 0), (3, 3, 3), (4, 9, 0), (5, 0, 9)], "pair_id long, source_id long, target_id long")
    got = {r.pair_id: (r.status, r.cost, r.path) for r in routing.shortest(edges, nodes, pairs).collect()}
    assert got == {1: ("ok", 3.0, [0, 2]), 2: ("no_path", None, None), 3: ("ok", 0.0, [3]), 4: ("source_missing", None, None), 5: ("target_missing", None, None)}


def test_rounds_follow_the_graph(spark):
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(3)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 0, 2.0, -1.0)], "source_id long, target_id long, km double, multiplier double")
    pairs = spark.createDataFrame([(1, 0, 2)], "pair_id long, source_id long, target_id long")
    with pytest.raises(RuntimeError, match="negative"):
        routing.shortest(edges, nodes, pairs)


def test_routes_equal_brute_force(spark):
    r = random.Random(3)
    roads_ = [(r.randrange(30), r.randrange(30), r.randint(1, 9) / 2, 1.0 + r.randrange(3)) for _ in range(70)]
    cost = {(s, s): 0.0 for s in range(30)}
    for _ in range(30):
        for a, b, km, m in roads_:
            for s in range(30):
                if (s, a) in cost:
                    cost[s, b] = min(cost.get((s, b), math.inf), cost[s, a] + km * m)
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(30)], "id long, lat double, lon double")
    edges = spark.createDataFrame(roads_, "source_id long, target_id long, km double, multiplier double")
    asked = [(30 * s + t, s, t) for s in range(6) for t in range(30)]
    pairs = spark.createDataFrame(asked, "pair_id long, source_id long, target_id long")
    assert {x.pair_id: x.cost for x in routing.shortest(edges, nodes, pairs).collect()} == {i: cost.get((s, t)) for i, s, t in asked}


def test_left_asset_is_gone(spark):
    rows = spark.createDataFrame([("a", 13.0, 80.0, 1, 1), ("a", 40.0, 80.0, 2, 2)], "node_id string, lat double, lon double, recorded_at int, seq int")
    assert state.latest(rows).isEmpty()


def test_replay_equals_live(spark):
    pings, none = load(spark, SF, "telemetry"), load(spark, SF, "commands").limit(0)
    live = state.asset_view(pings, none).select("node_id", "lat", "lon", "battery").collect()
    again = state.replay(state.change_events(pings.withColumn("kind", F.lit("telemetry")), F.col("recorded_at"))).collect()
    assert sorted(map(tuple, live)) == sorted(map(tuple, again))


def test_empty_tables(spark):
    pings, fixed = load(spark, SF, "telemetry"), load(spark, SF, "zones")
    assert zones.relocate(fixed, pings.limit(0)).isEmpty()
    assert [r.deficit == r.required_assets for r in zones.supply(fixed, pings.limit(0)).collect()] == [True] * 4
    assert roads.snap(pings, load(spark, SF, "road_nodes").limit(0), "seq").isEmpty()


def test_fixed_zones_stand_in_for_predicted_ones(spark):
    schema = "zone_id string, lat double, lon double"
    fixed, predicted = spark.createDataFrame([("f", 1.0, 2.0), ("g", 1.0, 2.0)], schema), spark.createDataFrame([("p", 3.0, 4.0)], schema)
    assert {r.zone_id for r in zones.in_use(predicted, fixed).collect()} == {"p"}
    assert {r.zone_id for r in zones.in_use(predicted.limit(0), fixed).collect()} == {"f", "g"}


def test_the_archive_splits_large_days_and_is_pruned(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "id AS seq", "if(id % 10 = 0, 'small', 'large') AS tenant_id", "concat('n', id % 7) AS node_id", "1 AS node_type", "2 AS status", "1.0 AS lat", "2.0 AS lon", "0.0 AS velocity_mps", "0.0 AS heading_deg", "5 AS battery", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 3 AS int)) AS recorded_at"
    )
    ingest.archive(rows, f"{tmp_path}/history")
    stored = spark.read.parquet(f"{tmp_path}/history")
    assert stored.count() == 3000 and set(stored.columns) >= {"tenant_id", "date"}
    asked = history.track(stored.filter("tenant_id = 'small'"), "n3", "2024-01-02 00:00:00", "2024-01-02 23:59:59")
    assert {(r.tenant_id, str(r.date)) for r in asked.collect()} == {("small", "2024-01-02")}
    plan = asked._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "PushedFilters: [IsNotNull(node_id)" in plan


def test_a_path_of_many_nodes(spark):
    n = 21
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(n + 1)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(i, i + 1, 1.0, 1.0) for i in range(n - 1)], "source_id long, target_id long, km double, multiplier double")
    pairs = spark.createDataFrame([(1, 0, n - 1), (2, 3, 3), (3, 4, 8), (4, 0, n)], "pair_id long, source_id long, target_id long")
    got = {r.pair_id: (r.status, r.km, r.path) for r in routing.shortest(edges, nodes, pairs).collect()}
    assert got == {1: ("ok", n - 1.0, list(range(n))), 2: ("ok", 0.0, [3]), 3: ("ok", 4.0, [4, 5, 6, 7, 8]), 4: ("no_path", None, None)}


def test_nearest_of_rare_and_missing_classes(spark):
    r = random.Random(5)
    at = lambda: (r.uniform(12, 14), r.uniform(79, 81))
    targets = [(i, *at(), 4 if i in (7, 11, 90) else 1 + i % 2) for i in range(200)] + [(500, None, 80.0, 1), (501, 13.0, 80.0, None)]
    asked = [(i, *at(), (1, 3, 4, 5, 8, None)[i % 6]) for i in range(60)]
    want = {}
    for i, lat, lon, mask in asked:
        fit = sorted((round(math.hypot(t[1] - lat, t[2] - lon), 9), t[0]) for t in targets if None not in t and mask and t[3] & mask)
        want |= {(i, rank): t for rank, (_, t) in enumerate(fit[:5], 1)}
    points = spark.createDataFrame(asked, "point_id long, p_lat double, p_lon double, mask int")
    found = match.nearest(points, spark.createDataFrame(targets, "t long, t_lat double, t_lon double, kind int"), geo.planar("p_lat", "p_lon", "t_lat", "t_lon"), "{step}", 5, "t", kinds=("kind", "mask"))
    assert {(x.point_id, x.rank): x.t for x in found.collect()} == want
