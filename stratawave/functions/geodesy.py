"""Satellite fixes and local coordinates (equirectangular about a reference), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratawave.functions import vectors as v

EARTH_RADIUS = 6378137.0


def navsat_to_enu(lat, lon, alt, ref_lat, ref_lon, ref_alt=0.0) -> v.Vector:
    lat, lon, alt, rlat, rlon, ralt = map(v.col, (lat, lon, alt, ref_lat, ref_lon, ref_alt))
    return [F.radians(lon - rlon) * EARTH_RADIUS * F.cos(F.radians(rlat)), F.radians(lat - rlat) * EARTH_RADIUS, alt - ralt]


def enu_to_ned(enu) -> v.Vector:
    e, n, u = v.vector(enu, 3)
    return [n, e, -u]


def ned_to_enu(ned) -> v.Vector:
    n, e, d = v.vector(ned, 3)
    return [e, n, -d]


def navsat_to_ned(lat, lon, alt, ref_lat, ref_lon, ref_alt=0.0) -> v.Vector:
    return enu_to_ned(navsat_to_enu(lat, lon, alt, ref_lat, ref_lon, ref_alt))


def enu_to_navsat(enu, ref_lat, ref_lon, ref_alt=0.0) -> v.Vector:
    e, n, u = v.vector(enu, 3)
    rlat, rlon, ralt = map(v.col, (ref_lat, ref_lon, ref_alt))
    return [rlat + F.degrees(n / EARTH_RADIUS), rlon + F.degrees(e / (EARTH_RADIUS * F.cos(F.radians(rlat)))), ralt + u]


def ned_to_navsat(ned, ref_lat, ref_lon, ref_alt=0.0) -> v.Vector:
    return enu_to_navsat(ned_to_enu(ned), ref_lat, ref_lon, ref_alt)


def local(frame: str) -> bool:
    if frame.lower() not in ("enu", "ned"):
        raise ValueError("a local frame is enu or ned")
    return frame.lower() == "ned"


def local_to_navsat(local_coordinates, ref_lat, ref_lon, ref_alt=0.0, frame: str = "enu") -> v.Vector:
    return (ned_to_navsat if local(frame) else enu_to_navsat)(local_coordinates, ref_lat, ref_lon, ref_alt)


def geographic_bounds_mask(coordinates, min_lat, min_lon, max_lat, max_lon, columns=(0, 1), wrap_longitude: bool = True) -> Column:
    """Within a closed box; a box whose west edge lies east of its east edge crosses the date line if ``wrap_longitude``."""
    if min_lat > max_lat:
        raise ValueError("min_lat is above max_lat")
    data = [v.col(x) for x in coordinates] if isinstance(coordinates, (list, tuple)) else None
    lat, lon = (data[c] if data else F.get(v.col(coordinates), F.lit(c)) for c in columns)
    inside = v.between(lat, min_lat, max_lat)
    if min_lon <= max_lon:
        return inside & v.between(lon, min_lon, max_lon)
    if not wrap_longitude:
        raise ValueError("min_lon is above max_lon")
    return inside & v.is_finite(lon) & ((lon >= min_lon) | (lon <= max_lon))
