"""Geometry on a sphere of 6371 km and in plain degrees, as SQL expressions.

Arguments are SQL expressions (column names); results are expressions for ``F.expr`` or a SQL text. They use
only functions that Spark compiles into its generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_KM = "6371e0"
KM_PER_DEGREE = "111e0"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in km, in its atan2 form."""
    a = f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return f"({EARTH_KM} * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def bounding_box(lat: str, lon: str, radius_km: str) -> dict[str, str]:
    """The smallest corner and the size of the box around a circle."""
    dlat, dlon = f"(({radius_km}) / {KM_PER_DEGREE})", f"(({radius_km}) / ({KM_PER_DEGREE} * cos(radians({lat}))))"
    return {"x": f"({lat}) - {dlat}", "y": f"({lon}) - {dlon}", "width": f"2 * {dlat}", "height": f"2 * {dlon}"}


def in_circle_box(lat: str, lon: str, center_lat: str, center_lon: str, radius_km: str) -> str:
    """Whether a point is in the box around a circle, edges included."""
    b = bounding_box(center_lat, center_lon, radius_km)
    return contains(b["x"], b["y"], b["width"], b["height"], lat, lon)


def contains(x: str, y: str, width: str, height: str, lat: str, lon: str) -> str:
    return f"({lat} >= {x} AND {lat} <= {x} + {width} AND {lon} >= {y} AND {lon} <= {y} + {height})"


def intersects(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """Whether two boxes (x, y, width, height) meet, edges included."""
    return f"(NOT ({b[0]} > {a[0]} + {a[2]} OR {b[0]} + {b[2]} < {a[0]} OR {b[1]} > {a[1]} + {a[3]} OR {b[1]} + {b[3]} < {a[1]}))"


def project(lat: str, lon: str, heading: str, km: str) -> tuple[str, str]:
    """Latitude and longitude reached from a point after some km on a heading."""
    d = f"(({km}) / {EARTH_KM})"
    new_lat = f"asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians({heading})))"
    new_lon = f"(radians({lon}) + atan2(sin(radians({heading})) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin({new_lat})))"
    return f"degrees({new_lat})", f"degrees({new_lon})"


def planar(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Distance in degrees."""
    return f"sqrt(power(({lat1}) - ({lat2}), 2) + power(({lon1}) - ({lon2}), 2))"


def in_service_area(lat: str = "lat", lon: str = "lon", box: tuple[float, float, float, float] = (12.0, 79.5, 2.0, 1.5)) -> str:
    x, y, w, h = (f"{v!r}e0" for v in box)
    return contains(x, y, w, h, lat, lon)


def cell(value: str, size: str) -> str:
    """The number of the grid step that holds a coordinate."""
    return f"CAST(floor(({value}) / {size}) AS bigint)"


def with_curve(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """``df`` with each row's place on a space-filling curve (Z order): the bits of 24-bit latitude and longitude in turn.
    Rows near each other on it are near each other on the map."""
    out = df
    for column, value, shift, width in (("_cy", lat, "9e1", "1.8e2"), ("_cx", lon, "1.8e2", "3.6e2")):
        out = out.withColumn(column, F.expr(f"CAST(floor((({value}) + {shift}) / {width} * 16777215e0) AS bigint)"))
        # each step moves the upper half of every group of bits away, until there is a gap after every bit
        for gap, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = out.withColumn(column, F.expr(f"({column} | shiftleft({column}, {gap})) & {mask}L"))
    return out.withColumn(name, F.expr("shiftleft(_cy, 1) | _cx")).drop("_cy", "_cx")
