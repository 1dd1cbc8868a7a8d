"""Trips: transition rules, replay of requests, bookings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.schemas import TRANSITIONS


def rules(spark) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "current_status string, new_status string")


def valid(requests: DataFrame) -> DataFrame:
    """``requests`` with ``valid``: whether the rules allow the transition."""
    known = F.broadcast(rules(requests.sparkSession).withColumn("_ok", F.lit(True)))  # seven rows
    return requests.join(known, ["current_status", "new_status"], "left").withColumn("valid", F.col("_ok").isNotNull()).drop("_ok")


def _allowed() -> Column:
    pairs = [(F.col("current_status") == a) & (F.col("new_status") == b) for a, b in TRANSITIONS]
    return F.coalesce(reduce(or_, pairs), F.lit(False))


def _longest() -> int:
    """The most transitions that one trip can make; the rules lead nowhere back."""
    levels, at = 0, {FIRST}
    while at := {b for a, b in TRANSITIONS if a in at}:
        levels += 1
        if levels > len(TRANSITIONS):
            raise ValueError("the transition rules go round in a circle")
    return levels


FIRST = "requested"


def replay(requests: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Every request in its trip's order: accepted or refused with a reason, and the trip's state after it.

    A trip makes a few transitions, however many requests name it. The next one is the first request in order that the
    rules allow from the state reached, a minimum that tasks take in parts; so each level is a join and an aggregation,
    and the trip's steps decide all its requests. Trips of over ``most`` requests are dealt to parts of that size. A
    request is its (ts, seq), a null time first; rows equal in trip, time, seq and states share one result. A null trip
    is a trip, and null states are refused."""
    rows = requests.select("seq", "trip_id", "current_status", "new_status", "ts").withColumn("at", F.struct("ts", "seq", "current_status", "new_status"))
    sizes = rows.groupBy("trip_id").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    long = sizes.filter("parts > 1").select(F.col("trip_id").alias("_trip"), F.col("parts").alias("_parts"))
    part = F.pmod(F.xxhash64("seq", "ts"), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(long, F.col("trip_id").eqNullSafe(F.col("_trip")), "left").withColumn("part", part).drop("_trip", "_parts")

    step = "array<struct<at:struct<ts:timestamp_ntz,seq:bigint,current_status:string,new_status:string>,status:string>>"
    trips = sizes.select(F.col("trip_id").alias("trip"), "parts", F.lit(FIRST).alias("status"), F.lit(None).cast(step).alias("steps"))
    trips = trips.withColumn("steps", F.coalesce("steps", F.array().cast(step)))

    def asked(trips: DataFrame) -> DataFrame:
        return trips.withColumn("in_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    same = F.col("trip_id").eqNullSafe(F.col("trip")) & (F.col("part") == F.col("in_part"))
    offers = dealt.filter(_allowed()).select("trip_id", "part", "at")
    for _ in range(_longest()):
        last = F.try_element_at("steps", F.lit(-1))["at"]
        later = (F.col("at.current_status") == F.col("status")) & (F.size("steps").eqNullSafe(0) | (F.col("at") > last))
        met = asked(trips).join(offers, same, "left").withColumn("_offer", F.when(later, F.col("at")))
        best = met.groupBy("trip").agg(F.min("_offer").alias("next"), *(F.any_value(c).alias(c) for c in ("parts", "status", "steps")))
        made = F.array_append("steps", F.struct(F.col("next").alias("at"), F.col("next.new_status").alias("status")))
        found = F.col("next").isNotNull()
        trips = best.select("trip", "parts", F.when(found, F.col("next.new_status")).otherwise(F.col("status")).alias("status"), F.when(found, made).otherwise(F.col("steps")).alias("steps"))

    passed = dealt.join(asked(trips.drop("status")), same).withColumn("steps", F.expr("filter(steps, s -> s.at <= at)"))
    accepted = F.expr("exists(steps, s -> s.at = at)")
    reason = F.when(~_allowed(), "invalid_transition").when(~accepted, "status_mismatch")

    def when(*states: str) -> Column:
        return F.try_element_at(F.filter("steps", lambda s: s["status"].isin(*states)), F.lit(-1))["at"]["ts"]

    status = F.coalesce(F.try_element_at("steps", F.lit(-1))["status"], F.lit(FIRST))
    return passed.select("seq", "trip_id", accepted.alias("accepted"), reason.alias("reason"), status.alias("status"), when("trip_started").alias("started_at"), when("completed", "canceled").alias("completed_at"))


def book(events: DataFrame) -> DataFrame:
    """Trips of the bookings that won: any book leaves a driver booked and any release free, so a booking wins if the
    driver's event before it is a release or missing. A trip's id is the number of its booking."""
    before = F.lag("kind").over(Window.partitionBy("driver_id").orderBy("ts", "seq"))
    won = events.withColumn("_before", before).filter("kind = 'book' AND coalesce(_before, 'release') = 'release'")
    return won.select(F.col("seq").alias("trip_id"), "driver_id", "rider_lat", "rider_lon", F.lit("driver_assigned").alias("status"), F.col("ts").alias("created_at"))
