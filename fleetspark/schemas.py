"""Columns, enumerations and constraints of the telemetry tables."""

from __future__ import annotations

PAYLOAD = "tenant_id string, node_id string, asset_class int, lat double, lon double, status string, battery int, metadata map<string,string>"
# The numbered types and states of assets; type t has the class bit 2^(t-1).
NODE_TYPES = {0: "UNKNOWN", 1: "BIKE", 2: "AUTO", 3: "SEDAN", 4: "SUV", 5: "DRONE", 6: "ROBOT", 7: "STATIC_SENSOR"}
STATUSES = {0: "UNKNOWN", 1: "IDLE", 2: "EN_ROUTE", 3: "ACTIVE", 4: "MAINTENANCE", 5: "OFFLINE"}
SENSOR_CLASS, ALL_CLASSES = 64, 255
# Longest texts that the history table takes.
WIDTHS = {"tenant_id": 50, "node_id": 50, "status": 20}
REQUIRED = ["tenant_id", "node_id", "asset_class", "lat", "lon", "status"]
# The road kinds that vehicles may use.
DRIVABLE = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential"]
# Which trip state may follow which.
TRANSITIONS = [
    ("requested", "driver_assigned"),
    ("requested", "canceled"),
    ("driver_assigned", "driver_arrived"),
    ("driver_assigned", "canceled"),
    ("driver_arrived", "trip_started"),
    ("driver_arrived", "canceled"),
    ("trip_started", "completed"),
]


def name_of(names: dict[int, str], number: str) -> str:
    """A SQL expression for the name of a number; unknown numbers are UNKNOWN."""
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'UNKNOWN' END"
