"""Surge: work that grows with the input. Rides are not copied to blocks of requests, a request tests few of them, and
supply is counted without pairs."""

import datetime
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetspark.operators import demand

T0 = datetime.datetime(2024, 1, 31)


def test_tested_rides_grow_with_the_root_of_all(monkeypatch):
    r = np.random.default_rng(2)
    tested, spread = [], demand._spread
    monkeypatch.setattr(demand, "_spread", lambda a, b: (tested.append(len(k)) or (o, k) for o, k in spread(a, b)))
    many = 300
    for micros in (1_000_000, 1):  # whole seconds, and moments of which hardly two are equal
        at = lambda k: 7 * 300_000_000 + r.integers(0, 300_000_000 // micros, k) * micros  # noqa: B023, E731
        asked = pa.table({"_x": [65] * many, "_y": [401] * many, "_t": [7] * many, "request_id": np.arange(many), "p_lat": 13 + r.random(many) * 0.2, "p_lon": 80.2 + r.random(many) * 0.2, "micros": at(many) + (r.random(many) < 0.5) * 300_000_000})
        for n in (10_000, 160_000):
            x, y, t, k = 13 + r.random(n) * 0.2, 80.2 + r.random(n) * 0.2, at(n), r.integers(1, 3, n)
            tested.clear()
            got = demand._counted(asked, pa.table({"lat": x, "lon": y, "micros": t, "n": k}), 0.2, 300)["demand"].to_numpy()
            assert sum(tested) < (5 * n**0.5 + n / 60) * many
            for i in range(0, many, 7):
                now, lat, lon = (asked.column(c)[i].as_py() for c in ("micros", "p_lat", "p_lon"))
                near = (t <= now) & (t >= now - 300_000_000) & (np.sqrt((lat - x) ** 2 + (lon - y) ** 2) <= 0.2)
                assert got[i] == k[near].sum()


def test_rides_of_a_crowded_cell_are_sent_once(spark, monkeypatch):
    sent, counted = spark.sparkContext.accumulator(0), demand._counted

    def watched(asked, rides, degrees, seconds):
        sent.add(rides.num_rows)
        return counted(asked, rides, degrees, seconds)

    monkeypatch.setattr(demand, "_counted", watched)
    asked = spark.range(25_000).selectExpr("id AS request_id", "13.01e0 + id % 997 / 1e5 AS lat", "80.21e0 + id % 991 / 1e5 AS lon", "timestamp_ntz'2024-01-31 00:00:30' AS ts")
    rides = spark.range(2_000).selectExpr("13.01e0 + id / 1e5 AS lat", "80.21e0 AS lon", "timestamp_ntz'2024-01-31 00:00:10' AS ts")
    assert demand.requested(asked, rides).filter("demand > 0").count() == 25_000
    assert sent.value == 2_000


def test_supply_equals_a_count_of_all_pairs(spark):
    r = random.Random(5)
    spot = lambda: (r.choice([13.0, 12.8, 12.84, -0.1]) + r.choice([0, 0.04, r.uniform(-0.05, 0.05)]), 80.0 + r.choice([0, 0.04, r.uniform(-0.05, 0.05)]))
    free = [(*spot(), r.choice([1, 2, 4, None])) for _ in range(1_500)] + [(12.8, 80.0, 1)] * 30 + [(None, 80.0, 1), (12.8, None, 1)]
    asked = [(i, *((v + 0.2) for v in spot()), r.choice([1, 3, 6, 255, 8, None])) for i in range(400)] + [(1_000, 13.0, 80.2, 1), (1_001, None, 1.0, 1)]
    want = {}
    for i, lat, lon, mask in asked:
        if lat is not None and mask is not None:
            s, w = lat + -0.2, lon + -0.2
            n = sum(1 for x, y, kind in free if None not in (x, y, kind) and kind & mask and s <= x <= s + 0.04 and w <= y <= w + 0.04)
            if n:
                want[i] = n
    a = spark.createDataFrame(asked, "request_id long, lat double, lon double, asset_req int")
    b = spark.createDataFrame(free, "lat double, lon double, asset int")
    for blocks in ({}, {"driver_block": 40, "request_block": 7}):
        assert {x.request_id: x.supply for x in demand.available(a, b, -0.2, 0.04, **blocks).collect()} == want
    assert len(want) > 50
    assert demand.available(a, b.limit(0), -0.2, 0.04).isEmpty() and demand.available(a.filter(F.lit(False)), b, -0.2, 0.04).isEmpty()
