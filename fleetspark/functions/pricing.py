"""Travel times and fares, as SQL expressions."""

from __future__ import annotations

import numpy as np

# Base, per km, per minute of each asset type; other types ride at the third.
FARES = {1: (20, 5, 1), 2: (30, 10, 1.5), 4: (50, 15, 2), 8: (80, 20, 3)}
DRONE = 16


def road_seconds(km: str) -> str:
    """Whole seconds of a street ride: 1.4 times the distance at 40 km/h."""
    return f"CAST(floor(({km}) * 1.4e0 / 4e1 * 3600e0) AS int)"


def eta_seconds(km: str, asset_class: str, model: str = "mode") -> str:
    """'mode': drones fly straight at 60 km/h, others ride; 'flat': all straight at 40 km/h."""
    if model == "flat":
        return f"CAST(floor(({km}) / 4e1 * 3600e0) AS int)"
    return f"CASE WHEN {asset_class} = {DRONE} THEN CAST(floor(({km}) / 6e1 * 3600e0) AS int) ELSE {road_seconds(km)} END"


def seconds(km, drone, model: str = "mode"):
    """``eta_seconds`` of arrays; ``drone`` says which ones fly."""
    if model == "flat":
        return np.floor(km / 40.0 * 3600.0)
    return np.where(drone, np.floor(km / 60.0 * 3600.0), np.floor(km * 1.4 / 40.0 * 3600.0))


def route_type(asset_class: str) -> str:
    return f"CASE WHEN {asset_class} = {DRONE} THEN 'euclidean_air' ELSE 'osrm_street' END"


def fare(asset: str, metres: str, seconds: str, surge: str) -> str:
    def part(i: int) -> str:
        return f"CASE {asset} " + " ".join(f"WHEN {a} THEN {float(v[i])}e0" for a, v in FARES.items()) + f" ELSE {float(FARES[4][i])}e0 END"

    return f"(({part(0)}) + ({metres}) / 1e3 * ({part(1)}) + ({seconds}) / 6e1 * ({part(2)})) * ({surge})"
