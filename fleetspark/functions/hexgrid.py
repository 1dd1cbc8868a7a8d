"""Pointy-top hexagons of 1.22 km edge on a local plane. Their ids are not those of any global grid."""

from __future__ import annotations

EDGE_KM = "1.22e0"
_LAT0, _LON0, _KM = "1.3e1", "8.02e1", "1.11195e2"
_COS = "cos(radians(1.3e1))"


#: Axial coordinates count in millionths of an edge (about a millimetre), as whole numbers. A position nearer than that to
#: the border of two hexagons goes to one of them by the same rule everywhere: the last bit of a cosine, which engines
#: round differently, does not decide.
_ONE, _ONES = "1e6", "1000000"


def _millionths(x: str, y: str) -> tuple[str, str]:
    q, r = f"((sqrt(3e0) / 3 * {x} - {y} / 3) / {EDGE_KM})", f"((2e0 / 3 * {y}) / {EDGE_KM})"
    return f"CAST(floor({q} * {_ONE} + 0.5e0) AS bigint)", f"CAST(floor({r} * {_ONE} + 0.5e0) AS bigint)"


def _whole(v: str) -> str:
    return f"CAST(floor(({v} + 500000) / {_ONE}) AS bigint)"


def axial(lat: str, lon: str) -> tuple[str, str]:
    """Whole axial coordinates (q, r) of the hexagon that holds a point, by cube rounding."""
    x, y = f"((({lon}) - {_LON0}) * {_COS} * {_KM})", f"((({lat}) - {_LAT0}) * {_KM})"
    q, r = _millionths(x, y)
    s = f"(-{q} - {r})"
    rq, rr, rs = (_whole(v) for v in (q, r, s))
    dq, dr, ds = f"abs({rq} * {_ONES} - {q})", f"abs({rr} * {_ONES} - {r})", f"abs({rs} * {_ONES} - {s})"
    return (
        f"CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{rr} - {rs} ELSE {rq} END AS bigint)",
        f"CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN {rr} WHEN {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END AS bigint)",
    )


def steps(lat: str, lon: str, q: str, r: str) -> list[dict[str, str]]:
    """The same by columns: each dict of expressions may use the columns of those before it. Columns whose names
    begin with an underscore are not wanted afterwards. Spark evaluates a shared column once."""
    x, y = f"((({lon}) - {_LON0}) * {_COS} * {_KM})", f"((({lat}) - {_LAT0}) * {_KM})"
    of_q, of_r = _millionths("_hx", "_hy")
    return [
        {"_hx": x, "_hy": y},
        {"_hq": of_q, "_hr": of_r},
        {"_hs": "-_hq - _hr"},
        {"_hrq": _whole("_hq"), "_hrr": _whole("_hr"), "_hrs": _whole("_hs")},
        {"_hdq": f"abs(_hrq * {_ONES} - _hq)", "_hdr": f"abs(_hrr * {_ONES} - _hr)", "_hds": f"abs(_hrs * {_ONES} - _hs)"},
        {
            q: "CAST(CASE WHEN _hdq > _hdr AND _hdq > _hds THEN -_hrr - _hrs ELSE _hrq END AS bigint)",
            r: "CAST(CASE WHEN _hdq > _hdr AND _hdq > _hds THEN _hrr WHEN _hdr > _hds THEN -_hrq - _hrs ELSE _hrr END AS bigint)",
        },
    ]


def center(q: str, r: str) -> tuple[str, str]:
    """Latitude and longitude of a hexagon's centre."""
    x, y = f"({EDGE_KM} * sqrt(3e0) * ({q} + {r} / 2e0))", f"({EDGE_KM} * 1.5e0 * {r})"
    return f"({_LAT0} + {y} / {_KM})", f"({_LON0} + {x} / ({_KM} * {_COS}))"


def cell_id(q: str, r: str) -> str:
    return f"concat(CAST({q} AS varchar(20)), ':', CAST({r} AS varchar(20)))"
