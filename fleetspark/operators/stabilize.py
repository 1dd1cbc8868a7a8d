"""Edge weights: proposals from density, and their stabilisation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.folds import ordered_fold

OUTPUT = "seq long, edge_id string, weight double, accepted boolean"


def propose(events: DataFrame, base: DataFrame | None = None, default: float = 10.0, per_event: float = 0.15, confidence: float = 0.88) -> DataFrame:
    """(seq, edge_id, density, proposed_weight, confidence, ts): the running number of events of each edge raises the
    weight it proposes. ``base`` has (edge_id, base_weight); other edges count as the default."""
    rows = events.select("seq", "edge_id", "ts")
    rows = rows.join(base, "edge_id", "left") if base is not None else rows.withColumn("base_weight", F.lit(None).cast("double"))
    running = Window.partitionBy("edge_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("density", F.count("*").over(running))
    weight = F.coalesce("base_weight", F.lit(default)) * (1 + F.col("density") * per_event)
    return rows.select("seq", "edge_id", "density", weight.alias("proposed_weight"), F.lit(confidence).alias("confidence"), "ts")


def evaluate(last: float | None, row: dict, min_conf: float = 0.75, alpha: float = 0.3, step: float = 0.04) -> tuple[float | None, dict]:
    """One proposal against the last stable weight (None: none yet). A suppressed change stores nothing."""
    made = {"seq": row["seq"], "edge_id": row["edge_id"]}
    if row["confidence"] < min_conf:
        return last, made | {"weight": row["base_weight"], "accepted": False}
    stable = row["base_weight"] if last is None else last
    smoothed = alpha * row["proposed_weight"] + (1 - alpha) * stable
    if stable != 0 and abs((smoothed - stable) / stable) < step:
        return last, made | {"weight": stable, "accepted": False}
    return smoothed, made | {"weight": smoothed, "accepted": True}


def _turn(held: tuple[float | None, int], row: dict, **limits: float) -> tuple[tuple[float | None, int], dict]:
    last, made = evaluate(held[0], row, **limits)
    return (last, held[1] + 1), made | {"turn": held[1]}


def hysteresis_from(proposals: DataFrame, stable: DataFrame | None = None, **limits: float) -> DataFrame:
    """``hysteresis`` that goes on from the weights in ``stable`` (edge_id, stable; None: none yet), with ``turn``, the
    number of the row in its edge."""
    rows = proposals.select("seq", "edge_id", "proposed_weight", "confidence", "base_weight", "ts")
    if stable is None:
        rows = rows.withColumn("_last", F.lit(None).cast("double"))
    else:
        known = stable.select(F.col("edge_id").alias("_edge"), F.col("stable").alias("_last"))
        rows = rows.join(known, rows["edge_id"].eqNullSafe(known["_edge"]), "left").drop("_edge")
    return ordered_fold(rows, "edge_id", ["ts", "seq"], lambda row: (row["_last"], 0), partial(_turn, **limits), f"{OUTPUT}, turn long")


def hysteresis(proposals: DataFrame, min_conf: float = 0.75, alpha: float = 0.3, step: float = 0.04) -> DataFrame:
    """Every proposal in its edge's order: the weight that holds after it and whether it was accepted."""
    rows = proposals.select("seq", "edge_id", "proposed_weight", "confidence", "base_weight", "ts")
    return ordered_fold(rows, "edge_id", ["ts", "seq"], lambda _row: None, partial(evaluate, min_conf=min_conf, alpha=alpha, step=step), OUTPUT)
