"""Snapping by cells, handovers as state, newest positions by span, weights across batches."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import handover, roads, stabilize
from fleetspark.sources.fixtures import load
from fleetspark.streaming import jobs

SF = "/root/testdata/sf0.001"
AT = datetime.datetime(2024, 1, 1)


def stream(spark, folder, name, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


NODES = "id long, lat double, lon double"
POINTS = "seq long, lat double, lon double"


@pytest.mark.parametrize("center", [(13.0, 80.2), (-33.9, -70.6), (68.0, 20.0)])
def test_cells_hold_the_nearest_node_of_every_point(spark, center):
    pick = random.Random(3)
    near = lambda spread: (center[0] + pick.uniform(-spread, spread), center[1] + pick.uniform(-spread, spread))
    nodes = [(i, *near(0.15)) for i in range(150)] + [(150 + i, *near(0.002)) for i in range(250)]  # and a crowd at one place
    nodes += [(500 + i, nodes[i][1], nodes[i][2]) for i in range(3)]  # ties
    points = [(i, *near(0.25)) for i in range(250)] + [(250 + i, *near(0.003)) for i in range(100)] + [(400 + i, *nodes[i][1:]) for i in range(3)]
    cells = roads.snap_cells(spark.createDataFrame(nodes, NODES), most=16)
    assert cells.select("_level").distinct().count() > 2
    got = {r.seq: (r.road_node, round(r.km, 6)) for r in roads.snap_by_cells(spark.createDataFrame(points, POINTS), cells).collect()}
    expected = {}
    for seq, lat, lon in points:
        d, _, node, exact = min((round(k, 9), n, n, k) for n, k in ((n[0], km(lat, lon, n[1], n[2])) for n in nodes))
        if exact <= 10:
            expected[seq] = (node, round(exact, 6))
    assert got == expected
    assert len(expected) < len(points)  # some are out of reach


def test_cells_of_crowds_nothing_and_nulls(spark):
    crowd = spark.createDataFrame([(i, 13.0, 80.0) for i in range(100)] + [(None, 13.0, 80.0), (7, None, 80.0)], NODES)
    cells = roads.snap_cells(crowd, most=16)  # all at one place: the finest cells hold them all
    got = roads.snap_by_cells(spark.createDataFrame([(1, 13.0, 80.0), (1, 13.0, 80.0), (2, None, 80.0), (3, 50.0, 80.0)], POINTS), cells).collect()
    assert [(r.seq, r.road_node) for r in got] == [(1, 0), (1, 0)]
    none = roads.snap_cells(spark.createDataFrame([], NODES))
    assert none.count() == 0 and roads.snap_by_cells(spark.createDataFrame([(1, 13.0, 80.0)], POINTS), none).count() == 0


def test_handovers_shuffled_within_the_lateness_give_the_batch_rows(spark, tmp_path):
    pick = random.Random(8)
    pings = load(spark, SF, "telemetry").withColumn("node_id", F.expr("concat('n', seq % 5)")).withColumn("recorded_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq * 7 % 7200)")).limit(600)
    rows = [tuple(r) for r in pings.collect()]
    told = [(10_000 + i, f"n{i % 6}", "HOLD" if i % 2 else "RELOCATE", 13.0 + i / 100, 80.0, AT + datetime.timedelta(seconds=pick.randrange(7200))) for i in range(80)]
    told.sort(key=lambda r: r[5])
    told += [(20_000, "n1", None, None, None, AT + datetime.timedelta(seconds=9)), (20_001, told[1][1], "HOLD", None, None, told[1][5])]
    schema = "seq long, node_id string, directive string, target_lat double, target_lon double, issued_at timestamp_ntz"
    expected = handover.detect(spark.createDataFrame(rows, pings.schema), spark.createDataFrame(told, schema))

    def shuffled(values, time):  # no row comes more than ten minutes late
        values = sorted(values, key=lambda r: r[time] + datetime.timedelta(seconds=pick.uniform(0, 590)))
        return [values[i * len(values) // 6 : (i + 1) * len(values) // 6] for i in range(6)]

    a = stream(spark, tmp_path, "pings", pings.schema, shuffled(rows, len(pings.columns) - 1))
    b = stream(spark, tmp_path, "commands", schema, [[told[0]], *shuffled(told[1:], 5)])  # a batch behind the pings
    progress = []
    got = jobs.handovers(a, b, str(tmp_path), late="30 minutes", progress=progress)
    assert expected.count() > 20
    assert sorted(map(tuple, got.select(*expected.columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    emitted = spark.read.parquet(f"{tmp_path}/handovers").count()
    assert expected.count() < emitted  # some were put right by a late command
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_handovers_without_commands_or_time(spark, tmp_path):
    pings = load(spark, SF, "telemetry").limit(200)
    rows = [tuple(r) for r in pings.collect()]
    lost = [(*r[:-1], None) for r in rows[:50]]
    schema = "seq long, node_id string, directive string, target_lat double, target_lon double, issued_at timestamp_ntz"
    a, b = stream(spark, tmp_path, "pings", pings.schema, [lost + rows[50:]]), stream(spark, tmp_path, "commands", schema, [[(1, "n", "HOLD", 1.0, 1.0, None)]])
    got = jobs.handovers(a, b, str(tmp_path))
    expected = handover.detect(spark.createDataFrame(rows[50:], pings.schema), spark.createDataFrame([], schema))
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in expected.collect())
    assert got.filter("directive is not null").count() == 0


def test_newest_positions_free_the_state_of_past_hours(spark, tmp_path):
    schema = "node_id string, seq long, lat double, lon double, recorded_at timestamp_ntz"
    at = lambda s: AT + datetime.timedelta(seconds=s)
    first = [(f"n{i}", i, 13.0, 80.0, at(i % 30)) for i in range(50)]
    second = [("n1", 100, 13.1, 80.0, at(20_000)), ("n2", 101, 13.2, 80.0, at(19_900)), ("x", 5, 13.0, 80.0, None)]
    third = [("n1", 99, 13.3, 80.0, at(19_999)), ("n2", 102, 13.4, 80.0, at(19_900))]
    progress = []
    got = {r.node_id: (r.seq, r.lat) for r in jobs.latest_position(stream(spark, tmp_path, "in", schema, [first, second, third]), str(tmp_path), progress=progress).collect()}
    assert got == {f"n{i}": (i, 13.0) for i in range(50)} | {"n1": (100, 13.1), "n2": (102, 13.4)}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) >= 50 and states[-1] <= 4
    assert len(list((tmp_path / "latest").glob("batch=*"))) <= 2


def test_weights_go_on_across_batches(spark, tmp_path):
    pick = random.Random(2)
    rows = [(i, pick.choice(["a", "b", None]), pick.uniform(5, 20), pick.choice([0.5, 0.9]), 10.0, AT + datetime.timedelta(seconds=i // 2)) for i in range(400)]
    rows += [rows[-1]] * 3  # repeated rows
    schema = "seq long, edge_id string, proposed_weight double, confidence double, base_weight double, ts timestamp_ntz"
    expected = stabilize.hysteresis(spark.createDataFrame(rows, schema)).collect()
    parts = [rows[:1], rows[1:150], rows[150:300], rows[300:]]
    got = jobs.stabilized(stream(spark, tmp_path, "in", schema, parts), str(tmp_path)).collect()
    key = lambda r: (r.seq, r.edge_id or "", r.weight, r.accepted)
    assert sorted(map(key, got)) == sorted(map(key, expected)) and len(got) == len(rows)
    assert spark.read.parquet(str(sorted((tmp_path / "stable").glob("batch=*"))[-1])).count() <= 3


def test_rebalance_keeps_no_state_and_hears_late_assets(spark, tmp_path):
    schema = "node_id string, seq long, tenant_id string, asset_class int, lat double, lon double, recorded_at timestamp_ntz"
    at = lambda s: AT + datetime.timedelta(seconds=s)
    first = [("n1", 1, "t", 1, 13.0, 80.2, at(20_000)), ("x", 9, "t", 1, 13.05, 80.2, None)]
    second = [("n1", 2, "t", 1, 13.5, 80.2, at(19_000)), ("n2", 3, "t", 1, 13.1, 80.2, at(100))]  # an old place; a late asset
    fixed = spark.createDataFrame([("z", 13.0, 80.2, 1.0, 2, 1, "t")], "zone_id string, lat double, lon double, radius_km double, required_assets int, target_class int, tenant_id string")
    got = jobs.rebalance(stream(spark, tmp_path, "in", schema, [first, second]), fixed, str(tmp_path)).collect()
    assert [(r.zone_id, r.node_id, r.turn) for r in got] == [("z", "n2", 1)]
    assert not (tmp_path / "checkpoint" / "state").exists()
