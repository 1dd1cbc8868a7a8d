"""The archive's order and pruning, and state that expires."""

import datetime

from pyspark.sql import functions as F

from fleetspark.operators import history
from fleetspark.sources import ingest
from fleetspark.sources.fixtures import load
from fleetspark.streaming import jobs

SF = "/root/testdata/sf0.01"


def scanned(df):
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    metric = lambda name: leaf.metrics().apply(name).value()
    return rows, metric("numFiles"), metric("numOutputRows")


def test_questions_to_the_archive_read_a_part_of_it(spark, tmp_path):
    pings = load(spark, SF, "telemetry").withColumn("recorded_at", F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(seq % 3, 0, 0, seq % 1000)"))
    path = str(tmp_path / "history")
    ingest.archive(pings, path, rows_per_file=250)
    stored = spark.read.parquet(path)
    total, files = stored.count(), len(stored.inputFiles())
    box = (12.9, 80.1, 0.05, 0.05)
    rows, read, passed = scanned(history.in_bbox(stored, box, "2024-01-05 00:00:00", "2024-01-05 23:00:00"))
    plain = history.in_bbox(ingest.archive_rows(pings), box, "2024-01-05 00:00:00", "2024-01-05 23:00:00").count()
    assert len(rows) == plain > 0
    assert read < 0.4 * files  # one day of three
    assert passed < 0.5 * total / 3  # and of that day, the files near the box


def live(spark, folder, rows):
    schema = "node_id string, seq long, lat double, lon double, recorded_at timestamp_ntz"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_state_of_silent_assets_is_dropped(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    first = [(f"n{i}", i, 13.0, 80.0, at(i % 30)) for i in range(50)]
    second = [("n1", 100, 13.1, 80.0, at(5_000)), ("late", 101, 13.0, 80.0, at(4_990)), ("away", 102, 40.0, 80.0, at(4_999))]
    third = [("n2", 200, 13.2, 80.0, at(5_050)), ("n1", 99, 13.3, 80.0, at(5_000)), ("x", 7, 13.0, 80.0, None)]
    progress = []
    got = jobs.live_positions(live(spark, str(tmp_path), [first, second, third]), str(tmp_path), progress=progress)
    assert {(r.node_id, r.seq, r.lat) for r in got.collect()} == {("n1", 100, 13.1), ("late", 101, 13.0), ("n2", 200, 13.2)}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) >= 50 and states[-1] <= 5
