"""Trips replayed without Python, commands in both shapes, road times, sketches and congestion as state."""

import datetime
import json
import random

from pyspark.sql import functions as F

from fleetspark.operators import match, metrics, roads, trips, zones
from fleetspark.schemas import TRANSITIONS
from fleetspark.streaming import jobs

AT = datetime.datetime(2024, 1, 1)
STATES = ["requested", "driver_assigned", "driver_arrived", "trip_started", "completed", "canceled", None, "lost"]
REQUESTS = "seq long, trip_id long, current_status string, new_status string, ts timestamp_ntz"


def one_by_one(rows):
    """The plain reading: each trip's requests in order, one after the other."""
    held, out = {}, {}
    for seq, trip, now, new, ts in sorted(rows, key=lambda r: (r[4] is not None, r[4] or AT, r[0])):
        state = held.setdefault(trip, {"status": "requested", "started_at": None, "completed_at": None})
        reason = "invalid_transition" if (now, new) not in set(TRANSITIONS) else "status_mismatch" if now != state["status"] else None
        if reason is None:
            state["status"] = new
            if new == "trip_started":
                state["started_at"] = ts
            if new in ("completed", "canceled"):
                state["completed_at"] = ts
        out[seq] = (trip, reason is None, reason, *state.values())
    return out


def requests(n, seed):
    pick = random.Random(seed)
    good = TRANSITIONS * 3
    rows = []
    for seq in range(n):
        now, new = pick.choice(good) if pick.random() < 0.8 else (pick.choice(STATES), pick.choice(STATES))
        trip = 1 if pick.random() < 0.4 else pick.choice([None, *range(2, 60)])  # one trip holds a good third
        rows.append((seq, trip, now, new, None if pick.random() < 0.02 else AT + datetime.timedelta(seconds=pick.randrange(40))))
    return rows


def test_replay_equals_one_by_one_also_where_a_trip_is_dealt_to_parts(spark):
    rows = requests(3_000, 5)
    expected = one_by_one(rows)
    df = spark.createDataFrame(rows, REQUESTS)
    for most in (1_000_000, 100):
        got = trips.replay(df, most=most)
        assert {r.seq: tuple(r)[1:] for r in got.collect()} == expected
        assert got.count() == len(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_replay_of_nothing_and_of_repeated_rows(spark):
    assert trips.replay(spark.createDataFrame([], REQUESTS)).collect() == []
    twice = [(1, 7, "requested", "driver_assigned", AT)] * 2 + [(2, 7, "requested", "canceled", AT)]
    got = sorted((r.seq, r.accepted, r.status) for r in trips.replay(spark.createDataFrame(twice, REQUESTS)).collect())
    assert got == [(1, True, "driver_assigned")] * 2 + [(2, False, "driver_assigned")]


def test_commands_come_back_as_they_were_sent(spark):
    plan = spark.createDataFrame([("z", "n1", "RELOCATE", 13.25, 80.5), ("z", "n2", "HOLD", None, None)], "zone_id string, node_id string, directive string, target_lat double, target_lon double")
    sent = zones.envelope(plan)
    back = zones.read_commands(sent.drop("node_id"), "message").select("node_id", "directive", "target_lat", "target_lon", "shape")
    assert {tuple(r) for r in back.collect()} == {("n1", "RELOCATE", 13.25, 80.5, "nested"), ("n2", "HOLD", None, None, "nested")}


def test_commands_that_are_none(spark):
    messages = {
        1: json.dumps({"node_id": "a", "directive": "HOLD", "target_lat": "13.5"}),
        2: json.dumps({"node_id": "a", "directive": "HOLD", "command": {"directive": "RELOCATE", "target_lat": 1, "target_lon": 2.5}}),
        3: json.dumps({"node_id": None, "directive": "HOLD"}),
        4: json.dumps({"node_id": "a", "directive": 5}),
        5: json.dumps([1, 2]),
        6: "no json",
        7: None,
        8: "",
        9: json.dumps({"node_id": "a", "command": "HOLD"}),
        10: json.dumps({"node_id": "b" * 100_000, "directive": "HOLD"}),
        11: json.dumps({"node_id": "a", "directive": "HOLD", "target_lat": "north"}),
    }
    got = {r.id: (r.shape, r.node_id, r.directive, r.target_lat, r.target_lon) for r in zones.read_commands(spark.createDataFrame(list(messages.items()), "id int, value string")).collect()}
    none = (None,) * 5
    assert got == {1: ("flat", "a", "HOLD", 13.5, None), 2: ("nested", "a", "RELOCATE", 1.0, 2.5), 3: none, 4: none, 5: none, 6: none, 7: none, 8: none, 9: none, 10: ("flat", "b" * 100_000, "HOLD", None, None), 11: ("flat", "a", "HOLD", None, None)}


def test_road_times_and_their_absence(spark):
    pairs = spark.createDataFrame([(q, d, 4, i + 1) for q in (1, 2, 3) for i, d in enumerate("abc")], "point_id long, driver_id string, asset int, rank int")
    times = spark.createDataFrame([(1, "a", 900.0, 90), (1, "b", 700.0, 70), (1, "c", 800.0, 80), (1, "c", 850.0, 60), (3, "c", 100.0, 10), (3, "b", 5.0, None)], "request_id long, driver_id string, metres double, eta_seconds int")
    surge = spark.createDataFrame([(1, 1.5), (2, 1.5), (3, 1.0)], "request_id long, surge double")
    got = match.by_road(pairs, times, surge, 2).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.driver_id, r.eta_seconds) for r in got] == [(1, "c", 60), (1, "b", 70), (2, "a", None), (2, "b", None), (3, "c", 10), (3, "a", None)]
    assert [r.fare is None and r.surge is None and r.metres is None for r in got] == [False, False, True, True, False, True]
    assert abs(got[0].fare - (50 + 0.85 * 15 + 1 * 2) * 1.5) < 1e-9


def test_sketches_are_near_and_their_state_does_not_grow_with_assets(spark, tmp_path):
    rows = spark.range(40_000).select(F.concat(F.lit("n"), F.col("id") % 20_000).alias("node_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 4)).cast("timestamp_ntz").alias("recorded_at"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    progress = []
    kept = jobs.uplink_sketches(stream, str(tmp_path), progress=progress)
    for unit, real, size in (("second", 5_000, 4), ("hour", 20_000, 1)):  # a longer unit counts an asset once
        got = metrics.sketched_uplinks(kept, unit).collect()
        assert len(got) == size and sum(r.messages for r in got) == 40_000
        assert all(abs(r.uplinks - real) < 0.05 * real for r in got)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 4


def test_congestion_keeps_one_row_a_node_and_two_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 13.0, 80.0), (2, 13.1, 80.1)], "id long, lat double, lon double")
    schema = "seq long, asset_class int, lat double, lon double, velocity_mps double, recorded_at timestamp_ntz"
    at = [AT + datetime.timedelta(seconds=s) for s in range(10)]
    batches = [[(1, 4, 13.0, 80.0, 5.0, at[5])], [(2, 4, 13.0, 80.0, 1.0, at[3]), (3, 4, 13.1, 80.1, 7.5, at[3])], [(4, 64, 13.0, 80.0, 15.0, at[9])], [(5, 4, 13.1, 80.1, 3.0, at[4])]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.congestion(stream, roads.snap_cells(nodes), str(tmp_path))
    assert {(r.node_id, r.multiplier, r.recorded_at) for r in got.collect()} == {(1, 3.0, at[5]), (2, 5.0, at[4])}
    assert len(list((tmp_path / "nodes").glob("batch=*"))) == 2
    assert spark.read.parquet(f"{tmp_path}/nodes/batch=3").count() == 2
