"""Selection of points by boxes, as boolean columns and as filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.functions import vectors as v
from stratawave.functions.geodesy import geographic_bounds_mask


def elements(points, columns) -> list[Column]:
    if isinstance(points, (list, tuple)):
        return [v.col(points[c]) for c in columns]
    return [F.get(v.col(points), F.lit(c)) for c in columns]


def bounds_mask(points, min_bound=None, max_bound=None, columns=None) -> Column:
    """Within a closed box on ``columns`` (by default as many as the bounds have); a missing bound is open; NaN is outside."""
    n = len(min_bound if min_bound is not None else max_bound if max_bound is not None else columns or ())
    columns = tuple(columns) if columns is not None else tuple(range(n))
    if any(b is not None and len(b) != len(columns) for b in (min_bound, max_bound)):
        raise ValueError("bounds and columns differ in length")
    out = F.lit(True)
    for i, x in enumerate(elements(points, columns)):
        out = out & v.between(x, None if min_bound is None else min_bound[i], None if max_bound is None else max_bound[i])
    return out


def oriented_bounds_mask(points, center, extent, rotation=None) -> Column:
    """Within a box of the given extent about ``center``, turned by ``rotation`` (3x3, box to world)."""
    if min(extent) < 0:
        raise ValueError("an extent is not negative")
    r = np.eye(3) if rotation is None else np.asarray(rotation, float)
    p = v.subtract(elements(points, range(3)), list(center))
    own = v.times([[float(x) for x in row] for row in r.T], p)
    out = v.is_finite(*p)
    for x, e in zip(own, extent):
        out = out & (F.abs(x) <= float(e) / 2)
    return out


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask is true; a null mask is false."""
    return df.filter(mask)


def crop_bounds(df: DataFrame, points, min_bound=None, max_bound=None, columns=None) -> DataFrame:
    return df.filter(bounds_mask(points, min_bound, max_bound, columns))


def crop_oriented_bounds(df: DataFrame, points, center, extent, rotation=None) -> DataFrame:
    return df.filter(oriented_bounds_mask(points, center, extent, rotation))


def crop_geographic_bounds(df: DataFrame, coordinates, min_lat, min_lon, max_lat, max_lon, columns=(0, 1), wrap_longitude: bool = True) -> DataFrame:
    return df.filter(geographic_bounds_mask(coordinates, min_lat, min_lon, max_lat, max_lon, columns, wrap_longitude))


def frame_of(frame: Column, name: Column, data_frame: Column | None = None) -> Column:
    """A row's frame: its own, else that of its payload."""
    del name
    return F.coalesce(frame, data_frame) if data_frame is not None else frame
