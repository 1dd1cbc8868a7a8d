"""Where rides are asked for: surge, hotspots, heat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import geo
from fleetspark.operators.match import one_each

_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'2020-01-01 00:00:00', {})"
#: Most strips of a cell, and fine cells along a strip for each of them.
STRIPS, ALONG = 1024, 4
#: Steps of time that sums are taken at: at least and at most.
STEPS = (64, 512)
#: Pairs of a request and a strip that are looked at together, and rides that are tested one by one at a time.
LOOKED, TESTED = 65_536, 1_000_000


def _spread(start: np.ndarray, stop: np.ndarray):
    """The numbers of the ranges [start, stop), with the range of each, in parts of about ``TESTED``."""
    some = np.flatnonzero(stop > start)
    size = (stop - start)[some]
    for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(size) // TESTED)) + 1) if len(some) else ():
        many = size[part]
        owner = np.repeat(some[part], many)
        yield owner, np.repeat(start[some[part]] - np.cumsum(many) + many, many) + np.arange(many.sum())


def _counted(asked: pa.Table, rides: pa.Table, degrees: float, seconds: int) -> pa.Table:
    """For each request of one cell and bucket of time, how many rides of them are within reach of it.

    The cell is cut in strips and these in fine cells, as many strips as the root of the rides. A request's window begins
    or ends in the bucket, so it needs the sums of the rides up to one moment, which are made step by step for the
    requests in order of time. What lies inside the circle then takes two look-ups a strip; only rides in fine cells on
    its rim are tested, and those of the step that the moment lies in where a step has several moments. So a request
    costs the root of the rides.
    """
    if not rides.num_rows or not asked.num_rows:
        return pa.table({"request_id": pa.array([], asked.schema.field("request_id").type), "demand": pa.array([], pa.int64())})
    width = seconds * 1_000_000
    x0, y0, t0 = asked.column("_x")[0].as_py() * degrees, asked.column("_y")[0].as_py() * degrees, asked.column("_t")[0].as_py() * width
    x, y, at, n = (rides.column(c).to_numpy() for c in ("lat", "lon", "micros", "n"))
    strips = int(np.clip(0.8 * np.sqrt(len(x)), 8, STRIPS))
    along = ALONG * strips
    g, h = degrees / strips, degrees / along
    cell = lambda v, origin, side, most: np.clip(np.floor((v - origin) / side), 0, most - 1).astype(np.int64)
    place = cell(x, x0, g, strips) * along + cell(y, y0, h, along)
    order = np.argsort(place, kind="stable")
    x, y, at, n, place = x[order], y[order], at[order], n[order], place[order]
    starts = np.append(0, np.cumsum(np.bincount(place, minlength=strips * along)))
    moments = np.unique(at)
    each = -(-len(moments) // int(np.clip(np.sqrt(len(x) * asked.num_rows) / 150, *STEPS)))
    cuts = moments[::each]
    step = np.searchsorted(cuts, at, "right") - 1
    by_step = np.argsort(step, kind="stable")
    step_starts = np.searchsorted(step[by_step], np.arange(len(cuts) + 1))

    px, py, now = (asked.column(c).to_numpy() for c in ("p_lat", "p_lon", "micros"))
    late = now >= t0 + width  # requests of the next bucket count the rides after a moment, those of this one up to it
    until = np.where(late, now - width - 1, now)
    own = np.searchsorted(cuts, until, "right") - 1
    found, everything = np.zeros(len(px), np.int64), np.append(0, np.cumsum(n))
    sure, maybe = degrees * (1 - 1e-9), degrees * (1 + 1e-9)

    def look(q: np.ndarray, sums: np.ndarray, after: bool, some: tuple[int, int]) -> None:
        first, last = np.clip([np.floor((px[q].min() - maybe - x0) / g) - 1, np.floor((px[q].max() + maybe - x0) / g) + 2], 0, strips).astype(np.int64)
        if first >= last:
            return
        column = np.arange(first, last)
        low, left, line = column * g + x0, px[q, None], (py[q, None] - y0) / h
        far = np.maximum(np.abs(left - low), np.abs(left - low - g))
        near = np.maximum(0, np.maximum(low - left, left - low - g))
        inner, outer = (np.sqrt(np.maximum(0, r * r - d * d)) / h for r, d in ((sure, far), (maybe, near)))
        v0, v1 = np.ceil(line - inner + 1e-6), np.floor(line + inner - 1e-6)
        u0, u1 = np.floor(line - outer - 1e-6), np.floor(line + outer + 1e-6) + 1
        v0, v1, u0, u1 = (np.clip(v, 0, along).astype(np.int64) for v in (v0, v1, u0, u1))
        v1 = np.where(far < sure, np.maximum(v0, v1), v0)  # full cells are [v0, v1), touched ones [u0, u1)
        u1 = np.where(near <= maybe, np.maximum(u0, u1), u0)
        v0, v1 = np.clip(v0, u0, u1), np.clip(v1, u0, u1)
        base = column * along
        a, b, c, d = (starts[base + v] for v in (u0, v0, v1, u1))
        count = (sums[c] - sums[b]).sum(axis=1)
        for begin, end in ((a, b), (c, d)):
            for owner, k in _spread(begin.ravel(), end.ravel()):
                i = q[owner // len(column)]
                good = ((at[k] <= until[i]) != after) & (np.sqrt((px[i] - x[k]) ** 2 + (py[i] - y[k]) ** 2) <= degrees)
                count += np.bincount(owner[good] // len(column), n[k[good]], len(q)).astype(np.int64)
        # the step that the moment lies in
        for owner, k in _spread(np.full(len(q), some[0]), np.full(len(q), some[1])):
            ride = by_step[k]
            strip, fine = place[ride] // along - first, place[ride] % along
            inside = (strip >= 0) & (strip < len(column))
            strip = np.where(inside, strip, 0)
            good = inside & (at[ride] <= until[q[owner]]) & (fine >= v0[owner, strip]) & (fine < v1[owner, strip])
            count += (-1 if after else 1) * np.bincount(owner[good], n[ride[good]], len(q)).astype(np.int64)
        found[q] = count

    turn = np.lexsort((px, own, late))
    for group in np.split(turn, np.flatnonzero((np.diff(own[turn]) != 0) | np.diff(late[turn])) + 1):
        j, after = int(own[group[0]]), bool(late[group[0]])
        sums = np.append(0, np.cumsum(np.where(step < (j + 1 if each == 1 else j), n, 0)))
        if after:
            sums = everything - sums
        some = (0, 0) if each == 1 or j < 0 else (int(step_starts[j]), int(step_starts[j + 1]))
        size = max(1, LOOKED // strips)
        for i in range(0, len(group), size):
            look(group[i : i + size], sums, after, some)
    return pa.table({"request_id": asked.column("request_id"), "demand": pa.array(found, pa.int64())})


def _paired(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str, left_block: int, right_block: int):
    """Both sides grouped by ``key`` for a cogroup; a crowded key is cut in blocks on both sides, so that a task is bounded."""
    sizes = right.groupBy(*key).agg(F.ceil(F.count("*") / right_block).cast("int").alias("_rights")).join(left.groupBy(*key).agg(F.ceil(F.count("*") / left_block).cast("int").alias("_lefts")), key)
    a = left.join(sizes, key).withColumn("_q", F.expr(f"CAST(pmod(xxhash64({left_id}), _lefts) AS int)")).withColumn("_r", F.explode(F.expr("sequence(0, _rights - 1)")))
    b = right.join(sizes, key).withColumn("_r", F.expr(f"CAST(pmod(xxhash64({right_id}), _rights) AS int)")).withColumn("_q", F.explode(F.expr("sequence(0, _lefts - 1)")))
    both = [*key, "_q", "_r"]
    # few keys become much work: a fixed number of parts, or the runtime joins them into one
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (side.drop("_lefts", "_rights").repartition(parts, *both).groupBy(*both) for side in (a, b))


def _kind(df: DataFrame, column: str) -> str:
    return next(f.dataType.simpleString() for f in df.schema if f.name == column)


def requested(requests: DataFrame, rides: DataFrame, degrees: float = 0.2, seconds: int = 300, ride_block: int = 1_000_000, request_block: int = 250_000) -> DataFrame:
    """(request_id, demand) of each request (request_id, lat, lon, ts) that has any: the ``rides`` (lat, lon, ts) within
    ``degrees`` of it in the ``seconds`` up to it. Requests and rides meet by cell and bucket of time; a crowded one is
    cut in blocks on both sides, so that a task is bounded, and the blocks' counts are added up."""
    wide = f"{degrees!r}e0"
    bucket = f"CAST(floor({_MICROS} / {seconds * 1_000_000}) AS bigint)"
    # rows of one place and time count as one with a number
    heard = rides.filter("lat is not null and lon is not null and ts is not null").groupBy("lat", "lon", "ts").agg(F.count("*").alias("n"))
    placed = heard.select("lat", "lon", "n", F.expr(_MICROS.format("ts")).alias("micros"), F.expr(geo.cell("lat", wide)).alias("_x"), F.expr(geo.cell("lon", wide)).alias("_y"), F.expr(bucket.format("ts")).alias("_t"))
    own = requests.filter("lat is not null and lon is not null and ts is not null").select("request_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.expr(_MICROS.format("ts")).alias("micros"), F.expr(geo.cell("lat", wide)).alias("_x0"), F.expr(geo.cell("lon", wide)).alias("_y0"), F.expr(bucket.format("ts")).alias("_t0"))
    near = own.select("*", F.expr("explode(array(_x0 - 1, _x0, _x0 + 1)) AS _x")).select("*", F.expr("explode(array(_y0 - 1, _y0, _y0 + 1)) AS _y")).select("*", F.expr("explode(array(_t0 - 1, _t0)) AS _t"))
    reach = [F.col(p).between(F.col(c) * degrees - maybe, (F.col(c) + 1) * degrees + maybe) for p, c, maybe in (("p_lat", "_x", degrees * (1 + 1e-9)), ("p_lon", "_y", degrees * (1 + 1e-9)))]
    near = near.filter(reach[0] & reach[1]).drop("_x0", "_y0", "_t0")
    left, right = _paired(near, placed, ["_x", "_y", "_t"], "request_id", "lat, lon, micros", request_block, ride_block)
    counts = left.cogroup(right).applyInArrow(lambda a, r: _counted(a, r, degrees, seconds), f"request_id {_kind(requests, 'request_id')}, demand long")
    return counts.groupBy("request_id").agg(F.sum("demand").alias("demand")).filter("demand > 0")


def _below(rank: np.ndarray, n: np.ndarray, start: np.ndarray, stop: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over the positions [start, stop) whose ``rank`` (each of 0, 1, ... once) is under ``most``: bit by bit,
    the positions with a 0 ahead of those with a 1, so a question takes as many look-ups as ranks have bits."""
    out = np.zeros(len(start), np.int64)
    for bit in reversed(range(len(rank).bit_length())):
        zero = (rank >> bit) & 1 == 0
        zeros, sums = np.append(0, np.cumsum(zero)), np.append(0, np.cumsum(np.where(zero, n, 0)))
        one = (most >> bit) & 1 == 1
        out += np.where(one, sums[stop] - sums[start], 0)
        start, stop = (np.where(one, zeros[-1] + v - zeros[v], zeros[v]) for v in (start, stop))
        order = np.argsort(~zero, kind="stable")
        rank, n = rank[order], n[order]
    return out


def _boxed(asked: pa.Table, free: pa.Table, side: float) -> pa.Table:
    """For each request of one cell, how many of its free drivers are of the request's types and in the box that starts at
    (s_lat, s_lon), edges included."""
    if not free.num_rows or not asked.num_rows:
        return pa.table({"request_id": pa.array([], asked.schema.field("request_id").type), "supply": pa.array([], pa.int64())})
    found = np.zeros(asked.num_rows, np.int64)
    lat, lon, kind, n = (free.column(c).to_numpy() for c in ("lat", "lon", "asset", "n"))
    south, west, masks = (asked.column(c).to_numpy() for c in ("s_lat", "s_lon", "asset_req"))
    for mask in np.unique(masks):
        q, some = np.flatnonzero(masks == mask), np.flatnonzero((kind & mask) > 0)
        some = some[np.argsort(lat[some], kind="stable")]
        by_lon = np.argsort(lon[some], kind="stable")
        rank = np.empty(len(some), np.int64)
        rank[by_lon] = np.arange(len(some))
        start, stop = np.searchsorted(lat[some], south[q], "left"), np.searchsorted(lat[some], south[q] + side, "right")
        low, high = np.searchsorted(lon[some][by_lon], west[q], "left"), np.searchsorted(lon[some][by_lon], west[q] + side, "right")
        found[q] = _below(rank, n[some], start, stop, high) - _below(rank, n[some], start, stop, low)
    return pa.table({"request_id": asked.column("request_id"), "supply": pa.array(found, pa.int64())})


def available(requests: DataFrame, free: DataFrame, offset: float, side: float, driver_block: int = 1_000_000, request_block: int = 250_000) -> DataFrame:
    """(request_id, supply) of each request (request_id, lat, lon, asset_req) that has any: the drivers ``free`` (lat, lon,
    asset) of its types in the box of ``side`` degrees that starts at ``offset`` from it. Both meet by cell, crowded ones
    in blocks; drivers of a cell are counted by their order, so a request costs the logarithm of them."""
    off, wide = f"{offset!r}e0", f"{side!r}e0"
    own = requests.filter("lat is not null and lon is not null and asset_req is not null").select("request_id", F.expr(f"lat + {off}").alias("s_lat"), F.expr(f"lon + {off}").alias("s_lon"), F.col("asset_req").cast("long").alias("asset_req"))
    cells = {c: F.expr(f"explode(sequence({geo.cell(p, wide)}, {geo.cell(f'{p} + {wide}', wide)}))") for c, p in (("_x", "s_lat"), ("_y", "s_lon"))}
    looking = own.withColumn("_x", cells["_x"]).withColumn("_y", cells["_y"])
    there = free.filter("lat is not null and lon is not null and asset is not null").groupBy("lat", "lon", F.col("asset").cast("long").alias("asset")).agg(F.count("*").alias("n"))
    there = there.withColumn("_x", F.expr(geo.cell("lat", wide))).withColumn("_y", F.expr(geo.cell("lon", wide)))
    left, right = _paired(looking, there, ["_x", "_y"], "request_id", "lat, lon, asset", request_block, driver_block)
    counts = left.cogroup(right).applyInArrow(lambda a, d: _boxed(a, d, side), f"request_id {_kind(requests, 'request_id')}, supply long")
    return counts.groupBy("request_id").agg(F.sum("supply").alias("supply")).filter("supply > 0")


def surge(requests: DataFrame, drivers: DataFrame, rides: DataFrame, degrees: float = 0.2, seconds: int = 300, supply_box: tuple[float, float] = (-0.2, 0.04), alpha: float = 0.25, most: float = 3.0) -> DataFrame:
    """(request_id, demand, supply, surge) of each request: demand is the ``rides`` (lat, lon, ts) asked for within
    ``degrees`` in the seconds before it; supply the available drivers of its types in a box at an offset, one at least."""
    demand = requested(requests, rides, degrees, seconds)
    supply = available(requests, one_each(drivers).filter("status = 'available'"), *supply_box)
    both = requests.select("request_id").join(demand, "request_id", "left").join(supply, "request_id", "left")
    return both.select("request_id", F.coalesce("demand", F.lit(0)).alias("demand"), F.greatest(F.coalesce("supply", F.lit(0)), F.lit(1)).alias("supply")).withColumn(
        "surge", F.least(F.greatest(1 + F.col("demand") / F.col("supply").cast("double") * alpha, F.lit(1.0)), F.lit(most))
    )


def rounded(value: str) -> str:
    """Two decimals, half away from zero, by exact decimals."""
    return f"round(CAST({value} AS decimal(18, 12)), 2)"


def hotspots(history: DataFrame, as_of: Column, hours: int = 1, n: int = 3) -> DataFrame:
    """(rank, lat, lon, pings) of the n busiest rounded places of the last hours."""
    recent = history.filter((F.col("recorded_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("recorded_at") <= as_of))
    places = recent.groupBy(F.expr(rounded("lat")).alias("lat"), F.expr(rounded("lon")).alias("lon")).agg(F.count("*").alias("pings"))
    top = places.orderBy(F.desc("pings"), "lat", "lon").limit(n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("pings")).alias("order"), "lat", "lon", "pings")))  # n rows
    return top.agg(ordered.alias("_rows")).select(F.posexplode("_rows").alias("_i", "_r")).select((F.col("_i") + 1).alias("rank"), F.col("_r.lat").cast("double").alias("lat"), F.col("_r.lon").cast("double").alias("lon"), "_r.pings")


def heat(positions: DataFrame, places: int = 2) -> DataFrame:
    """Live positions summed per rounded cell."""
    at = [F.expr(f"round(CAST({c} AS decimal(18, 12)), {places})").cast("double").alias(c) for c in ("lat", "lon")]
    return positions.groupBy(*at).agg(F.count("*").alias("weight"))
