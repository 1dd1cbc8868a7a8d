"""Crowded places: surge by sums over a grid, density-adapted cells, drivers with several rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import demand, match

T0 = datetime.datetime(2024, 1, 31)


def test_demand_equals_a_count_of_all_pairs(spark):
    r = random.Random(1)
    moment = lambda: T0 + datetime.timedelta(seconds=r.randrange(900), microseconds=r.choice([0, 0, 1, 500_000, 999_999]))
    spot = lambda: (r.choice([13.0, 13.2, 12.8, -0.1]) + r.choice([0, 0.2, r.uniform(-0.3, 0.3)]), 80.2 + r.choice([0, 0.2, r.uniform(-0.3, 0.3)]))
    rides = [(*spot(), moment()) for _ in range(3_000)] + [(13.0, 80.2, T0)] * 50 + [(None, 80.0, T0), (13.0, 80.2, None)]
    asked = [(i, *spot(), moment()) for i in range(300)] + [(1_000, 13.0, 80.2, T0), (1_001, None, 1.0, T0)]
    want = {}
    for i, lat, lon, ts in asked:
        n = sum(1 for x, y, t in rides if None not in (x, t, lat) and t <= ts and t >= ts - datetime.timedelta(seconds=300) and math.sqrt((x - lat) ** 2 + (y - lon) ** 2) <= 0.2)
        if n:
            want[i] = n
    a = spark.createDataFrame(asked, "request_id long, lat double, lon double, ts timestamp_ntz")
    b = spark.createDataFrame(rides, "lat double, lon double, ts timestamp_ntz")
    for blocks in ({}, {"ride_block": 40, "request_block": 7}):
        assert {x.request_id: x.demand for x in demand.requested(a, b, **blocks).collect()} == want
    assert demand.requested(a, b.limit(0)).isEmpty() and demand.requested(a.limit(0), b).isEmpty()


def test_only_the_rim_is_tested(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    tested = []
    spread = demand._spread
    monkeypatch.setattr(demand, "_spread", lambda a, b: (tested.append(len(k)) or (o, k) for o, k in spread(a, b)))
    key = {"_x": [65] * 40, "_y": [401] * 40, "_t": [7] * 40}
    at = 7 * 300_000_000 + np.arange(40) * 7_000_000
    asked = pa.table(key | {"request_id": np.arange(40), "p_lat": 13 + r.random(40) * 0.2, "p_lon": 80.2 + r.random(40) * 0.2, "micros": at})
    for n in (2_000, 20_000):
        rides = pa.table({"lat": 13 + r.random(n) * 0.2, "lon": 80.2 + r.random(n) * 0.2, "micros": 7 * 300_000_000 + r.integers(0, 300, n) * 1_000_000, "n": np.ones(n, np.int64)})
        tested.clear()
        demand._counted(asked, rides, 0.2, 300)
        assert sum(tested) < 0.15 * 40 * n


def crowd(spark, n=20_000):
    # nine in ten positions in one cell of 90 m, the others all over the town
    far = "CAST(pmod(xxhash64(id, {}), 1000000) AS double) / 1e6"
    hot = "id % 10 <> 0"
    return spark.range(n).selectExpr("concat('N', id) AS node_id", "'t' AS tenant_id", "1 AS asset_class", f"CASE WHEN {hot} THEN 13.0801e0 + {far.format(1)} * 4e-4 ELSE 12.9e0 + {far.format(2)} * 0.3e0 END AS lat", f"CASE WHEN {hot} THEN 80.2701e0 + {far.format(3)} * 4e-4 ELSE 80.1e0 + {far.format(4)} * 0.3e0 END AS lon")


def test_a_crowded_cell_is_no_crowded_key(spark):
    placed, cells = match.place(crowd(spark), most=200)
    keys = placed.groupBy("tenant_id", "_level", "_x", "_y", "_part").count()
    assert keys.agg(F.max("count")).first()[0] <= 300 and keys.agg(F.sum("count")).first()[0] == 20_000
    tasks = placed.repartition(8, "tenant_id", "_level", "_x", "_y", "_part").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(t["count"] for t in tasks)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("most", [1, 50, 2_000])
def test_pairs_do_not_depend_on_density_cells(spark, most):
    positions = crowd(spark, 2_000).cache()
    asked = spark.createDataFrame([(i, "t", 12.9 + 0.03 * i, 80.1 + 0.02 * i, 3.0, 1) for i in range(10)] + [(10, "t", 13.0803, 80.2703, 0.02, 1), (11, "u", 13.08, 80.27, 9.0, 1)], "query_id long, tenant_id string, q_lat double, q_lon double, radius_km double, class_mask int")
    got = {(r.query_id, r.node_id) for r in match.within(asked, positions, most).collect()}
    inside = "distance_km <= radius_km"
    from fleetspark.functions import geo

    want = asked.crossJoin(positions.withColumnRenamed("tenant_id", "own")).filter("own = tenant_id").filter(geo.in_circle_box("lat", "lon", "q_lat", "q_lon", "radius_km")).withColumn("distance_km", F.expr(geo.haversine_km("q_lat", "q_lon", "lat", "lon"))).filter(inside)
    assert got == {(r.query_id, r.node_id) for r in want.collect()} and got


def test_a_driver_with_two_rows_is_at_the_newest_place(spark):
    rows = [("a", 13.0, 80.0, "available", 4, T0), ("a", 13.1, 80.0, "booked", 4, T0 + datetime.timedelta(1)), ("b", 13.0, 80.0, "available", 4, T0), ("b", 13.0, 80.3, "available", 4, T0)]
    schema = "id string, lat double, lon double, status string, asset int, updated_at timestamp_ntz"
    for order in (rows, rows[::-1]):
        got = {r.id: (r.lat, r.lon, r.status) for r in match.one_each(spark.createDataFrame(order, schema).coalesce(1)).collect()}
        assert got == {"a": (13.1, 80.0, "booked"), "b": (13.0, 80.3, "available")}
