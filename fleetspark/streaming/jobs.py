"""Structured Streaming forms of the stateful jobs. Sources are file streams (or any other stream of the same
columns); each job writes to tables in a folder and returns what they hold when the stream has ended.

Every job keeps a checkpoint, so it goes on where it stopped; a micro-batch that runs again overwrites its own
folder, so sinks hold it once.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import geo
from fleetspark.operators import handover, metrics, roads, stabilize, state, zones
from fleetspark.sources import ingest, storage


def drive(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append", trigger: dict | None = None) -> list[dict]:
    """Run ``stream`` to the end of what there is (or by another trigger), handing each micro-batch on; returns the
    progress of the last micro-batches."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch writer: one sub-folder a batch, overwritten if the batch runs again."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def archive(raw: DataFrame, folder: str, failed_at) -> DataFrame:
    """Raw payloads to good and dead rows: (seq, error_reason), null for good ones."""

    def each(batch: DataFrame, number: int) -> None:
        good, dead = ingest.split_dead_letters(ingest.decode(batch), failed_at)
        sink(f"{folder}/good")(good.drop("metadata"), number)
        sink(f"{folder}/dead")(dead.drop("metadata"), number)

    drive(raw, each, folder)
    read = raw.sparkSession.read.parquet
    return read(f"{folder}/good").select("seq", F.lit(None).cast("string").alias("error_reason")).union(read(f"{folder}/dead").select("seq", "error_reason"))


def newest_by_span(pings: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Updates (mode "update") of the newest ping of each asset, by (time, seq). State is held by asset and ``span`` and
    freed once the watermark (``late`` behind the newest ping) passes the span's end, so it holds the assets heard lately
    and not all that ever were; the newest over the spans is the newest of all. Rows without a time are left out."""
    timed = pings.withColumn("_at", F.col("recorded_at").cast("timestamp")).filter("_at is not null").withWatermark("_at", late)
    row = F.max_by(F.struct(*pings.columns), F.struct("recorded_at", "seq")).alias("_row")
    return timed.groupBy(F.window("_at", span), F.col("node_id").alias("_key")).agg(row).select("_row.*")


def merge(batch: DataFrame, folder: str, number: int, key: str, time: str = "recorded_at", tie: str = "seq") -> DataFrame:
    """The table of each key's newest row after micro-batch ``number``: that of the one before, merged with the batch.
    A batch that runs again reads the table before it, so the last two stay and older ones go."""
    spark = batch.sparkSession
    if number:
        batch = spark.read.parquet(f"{folder}/batch={number - 1}").unionByName(batch)
    sink(folder)(state.newest(batch, key, time, tie), number)
    if number > 1:
        storage.drop(spark, f"{folder}/batch={number - 2}")
    return spark.read.parquet(f"{folder}/batch={number}")


def last_table(spark, folder: str) -> DataFrame:
    """What the last micro-batch of ``merge`` left."""
    tables = spark.read.parquet(folder)
    return tables.filter(F.col("batch") == tables.agg(F.max("batch")).first()[0]).drop("batch")


def latest_position(pings: DataFrame, folder: str, area=(12.0, 79.5, 2.0, 1.5), late: str = "10 minutes", progress: list | None = None) -> DataFrame:
    """The newest ping of each asset: a late one never overwrites a newer one. ``progress`` gets the progress of the
    micro-batches."""
    steps = drive(newest_by_span(pings, late), lambda batch, number: merge(batch, f"{folder}/latest", number, "node_id"), folder, "update")
    if progress is not None:
        progress += steps
    return state.latest(last_table(pings.sparkSession, f"{folder}/latest"), area)


def rebalance(pings: DataFrame, fixed: DataFrame, folder: str, trigger: dict | None = None) -> DataFrame:
    """After each micro-batch the commands that the latest positions ask for; returns those of the last one. In
    production the trigger is ``{'processingTime': '15 seconds'}``. A batch is folded to one row an asset and merged with
    the table of newest rows, so there is no state by hour and asset, and a late ping counts unless a newer one was heard;
    the plans of the batches stay, as they were sent. Rows without a time are left out."""
    spark = pings.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        seen = merge(batch, f"{folder}/latest", number, "node_id")
        zones.relocate(fixed, state.latest(seen)).write.mode("overwrite").parquet(f"{folder}/plan/batch={number}")

    drive(pings.filter("recorded_at is not null"), each, folder, "append", trigger)
    return last_table(spark, f"{folder}/plan")


def snapped(points: DataFrame, cells: DataFrame, folder: str) -> DataFrame:
    """Every point with its nearest road node, by one join with ``roads.snap_cells`` and no state."""
    drive(roads.snap_by_cells(points, cells), sink(f"{folder}/snapped"), folder)
    return points.sparkSession.read.parquet(f"{folder}/snapped").drop("batch")


def congestion(pings: DataFrame, cells: DataFrame, folder: str) -> DataFrame:
    """(node_id, multiplier, recorded_at): the newest multiplier of each road node. Pings are snapped in the stream by
    ``cells`` (``roads.snap_cells``); what is kept is one table of the newest event of each node."""
    events = roads.congestion_by_cells(pings, cells).select("node_id", "multiplier", "recorded_at", "seq")
    drive(events, lambda batch, number: merge(batch, f"{folder}/nodes", number, "node_id"), folder)
    return last_table(pings.sparkSession, f"{folder}/nodes").select("node_id", "multiplier", "recorded_at")


def stabilized(proposals: DataFrame, folder: str, **limits: float) -> DataFrame:
    """Every proposal with the weight that holds after it; batches arrive in time order. What is kept is a table of one
    stable weight an edge; the rows of an edge stream through the fold from there, however many a batch brings."""
    spark = proposals.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        stable = spark.read.parquet(f"{folder}/stable/batch={number - 1}") if number else None
        sink(f"{folder}/weights")(stabilize.hysteresis_from(batch, stable, **limits), number)
        rows = spark.read.parquet(f"{folder}/weights/batch={number}").filter("accepted").select("edge_id", F.col("weight").alias("stable"), F.lit(number).alias("at"), "turn")
        merge(rows, f"{folder}/stable", number, "edge_id", "at", "turn")

    drive(proposals, each, folder)
    return spark.read.parquet(f"{folder}/weights").drop("batch", "turn")


def demand(requests: DataFrame, folder: str, late: str = "10 minutes", degrees: float = 0.2) -> DataFrame:
    """(start, x, y, requests): demand of every five minutes, each minute anew, per cell."""
    cells = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), F.floor(F.col("lat") / degrees).alias("x"), F.floor(F.col("lon") / degrees).alias("y")).agg(F.count("*").alias("requests"))
    drive(cells.select(F.col("w.start").alias("start"), "x", "y", "requests"), sink(f"{folder}/demand"), folder, "update")
    # an update replaces the count of its window and cell
    return requests.sparkSession.read.parquet(f"{folder}/demand").groupBy("start", "x", "y").agg(F.max("requests").alias("requests"))


def uplinks(pings: DataFrame, folder: str, late: str = "10 minutes") -> DataFrame:
    """(second, uplinks, messages): assets heard and messages of every second."""
    heard = pings.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", late).groupBy(F.window("recorded_at", "1 second").alias("w"), "node_id").agg(F.count("*").alias("n"))
    drive(heard.select(F.col("w.start").alias("second"), "node_id", "n"), sink(f"{folder}/heard"), folder, "update")
    last = pings.sparkSession.read.parquet(f"{folder}/heard").groupBy("second", "node_id").agg(F.max("n").alias("n"))
    return last.groupBy("second").agg(F.count("*").alias("uplinks"), F.sum("n").alias("messages"))


def uplink_sketches(pings: DataFrame, folder: str, late: str = "10 minutes", progress: list | None = None) -> DataFrame:
    """(second, sketch, messages) of every second: the state holds one sketch a second, not one row an asset and second,
    and lets go of it when the watermark passes. Units longer than a second are unions of these; see
    ``metrics.sketched_uplinks``. Rows without a time are left out."""
    timed = pings.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).filter("recorded_at is not null").withWatermark("recorded_at", late)
    seconds = metrics.sketches(timed, F.window("recorded_at", "1 second")).select(F.col("second.start").alias("second"), "sketch", "messages")
    steps = drive(seconds, sink(f"{folder}/sketches"), folder, "update")
    if progress is not None:
        progress += steps
    # an update replaces the sketch of its second; it holds all that the one before it held
    rows = pings.sparkSession.read.parquet(f"{folder}/sketches")
    return rows.groupBy("second").agg(F.max_by("sketch", "messages").alias("sketch"), F.max("messages").alias("messages"))


HEARD = "node_id string, seq long, lat double, lon double, recorded_at timestamp, gone boolean"


def _heard(key: tuple, frames: Iterator[pd.DataFrame], held, ttl: int) -> Iterator[pd.DataFrame]:
    """The newest ping of one asset as state, in one row; a timer of event time takes it away ``ttl`` milliseconds later."""
    if held.hasTimedOut:
        seq, lat, lon, micros = held.get
        held.remove()
        yield pd.DataFrame([(key[0], seq, lat, lon, pd.Timestamp(micros, unit="us"), True)], columns=["node_id", "seq", "lat", "lon", "recorded_at", "gone"])
        return
    best = held.get if held.exists else None
    for rows in frames:
        last = rows.sort_values(["recorded_at", "seq"]).iloc[-1]
        mine = (int(last["seq"]), float(last["lat"]), float(last["lon"]), int(last["recorded_at"].value // 1000))
        if best is None or (mine[3], mine[0]) > (best[3], best[0]):
            best = mine
    ends = best[3] // 1000 + ttl
    gone = ends <= held.getCurrentWatermarkMs()
    if gone:
        if held.exists:
            held.remove()
    else:
        held.update(best)
        held.setTimeoutTimestamp(ends)
    yield pd.DataFrame([(key[0], best[0], best[1], best[2], pd.Timestamp(best[3], unit="us"), gone)], columns=["node_id", "seq", "lat", "lon", "recorded_at", "gone"])


def live_positions(pings: DataFrame, folder: str, ttl_seconds: int = 120, late: str = "10 minutes", area=(12.0, 79.5, 2.0, 1.5), progress: list | None = None) -> DataFrame:
    """(seq, node_id, lat, lon, recorded_at) of the assets heard within the time to live of the newest ping of all.

    An asset is one row of state, with a timer: once the watermark (``late`` behind the newest ping) passes the time to
    live, the asset's leaving is emitted and its state is dropped, so the state holds the assets in use and not all that
    ever were. Rows without a time are left out. ``progress`` gets the progress of the micro-batches."""
    timed = pings.select("node_id", "seq", "lat", "lon", F.col("recorded_at").cast("timestamp").alias("recorded_at")).filter("recorded_at is not null").withWatermark("recorded_at", late)
    fold = partial(_heard, ttl=ttl_seconds * 1000)
    changes = timed.groupBy("node_id").applyInPandasWithState(lambda k, f, s: fold(k, f, s), HEARD, "seq long, lat double, lon double, micros long", "update", "EventTimeTimeout")
    steps = drive(changes, sink(f"{folder}/live"), folder, "update")
    if progress is not None:
        progress += steps
    rows = pings.sparkSession.read.parquet(f"{folder}/live").drop("batch")
    # an asset that left and came back is live again: its newest row decides, and of equal ones its leaving
    last = rows.groupBy("node_id").agg(F.max(F.struct("recorded_at", "seq", "gone", "lat", "lon")).alias("r")).select("node_id", "r.*")
    inside = last.filter(geo.in_service_area(box=area))
    newest = inside.agg(F.max("recorded_at").alias("_now"))
    alive = inside.filter("not gone").join(F.broadcast(newest), F.col("recorded_at") >= F.col("_now") - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return alive.select("seq", "node_id", "lat", "lon", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


HANDOVER = "seq long, node_id string, node_type int, target_cell string, recorded_at timestamp, directive string, target_lat double, target_lon double"
_WAITING = "pings array<struct<at:long,seq:long,node_type:int,cell:string,told_at:long,told_seq:long>>, commands array<struct<at:long,seq:long,directive:string,lat:double,lon:double>>"


def _directed(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    """Handovers of one asset with the last command at or before each; those whose command is new or another one are
    emitted. Pings and commands wait until the watermark has passed them; of the commands before it the last one stays."""
    pings, commands = ([tuple(r) for r in rows] for rows in held.get) if held.exists else ([], [])
    fresh = len(pings)
    for rows in frames if not held.hasTimedOut else ():
        rows = rows.astype(object).where(rows.notna(), None)
        for r in rows.itertuples(index=False):
            if r.turn:
                pings.append((int(r.micros), int(r.seq), None if r.node_type is None else int(r.node_type), r.target_cell, None, None))
            else:
                commands.append((int(r.micros), int(r.seq), r.directive, r.target_lat, r.target_lon))
    commands.sort(key=lambda c: c[:2])
    times, waiting, out = [c[0] for c in commands], [], []
    for i, (at, seq, kind, cell, *told) in enumerate(pings):
        j = bisect_right(times, at) - 1
        now = list(commands[j][:2]) if j >= 0 else [None, None]
        if i >= fresh or now != told:
            out.append((seq, key[0], kind, cell, pd.Timestamp(at, unit="us"), *(commands[j][2:] if j >= 0 else (None,) * 3)))
        waiting.append((at, seq, kind, cell, *now))
    passed = held.getCurrentWatermarkMs() * 1000
    waiting = [p for p in waiting if p[0] > passed]
    commands = commands[max(bisect_right(times, passed) - 1, 0) :]
    if waiting or commands:
        held.update((waiting, commands))
        last = max(r[0] for r in [*waiting, *commands])
        if last > passed:
            held.setTimeoutTimestamp(last // 1000 + 1)
    elif held.exists:
        held.remove()
    if out:
        yield pd.DataFrame(out, columns=[part.split()[0] for part in HANDOVER.split(", ")]).astype({"node_type": "Int32"})


def handovers(pings: DataFrame, commands: DataFrame, folder: str, late: str = "10 minutes", progress: list | None = None) -> DataFrame:
    """The rows of ``handover.detect``, one a ping ``seq``: a streaming as-of join of two streams in any order within ``late``.

    A handover is emitted at once with the directive known by then, and again when a late command changes it, until the
    watermark passes the ping; the last row emitted counts. State of an asset: its handovers and commands within the
    lateness, and its last command before. Rows without a time, and later ones than ``late``, are left out.
    ``progress`` gets the progress of the micro-batches."""
    left = handover.leaving(pings).withColumn("at", F.col("at").cast("timestamp")).filter("at is not null").withWatermark("at", late)
    told = handover.told(commands).select("node_id", F.col("at").cast("timestamp").alias("at"), "turn", "seq", "_c.*").filter("at is not null").withWatermark("at", late)
    both = left.unionByName(told, allowMissingColumns=True).withColumn("micros", F.unix_micros("at"))
    directed = both.groupBy("node_id").applyInPandasWithState(lambda k, f, s: _directed(k, f, s), HANDOVER, _WAITING, "update", "EventTimeTimeout")
    steps = drive(directed, sink(f"{folder}/handovers"), folder, "update")
    if progress is not None:
        progress += steps
    rows = pings.sparkSession.read.parquet(f"{folder}/handovers")
    last = rows.groupBy("seq").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("seq", "batch"))), "batch").alias("_r")).select("seq", "_r.*")
    return last.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
