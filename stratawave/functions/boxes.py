"""Axis-aligned boxes in images, as columns x0, y0, x1, y1 (inclusive pixels)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratawave.functions import vectors as v


def to_corners(box: Sequence | Column, mode: str = "xyxy") -> v.Vector:
    a, b, c, d = v.vector(box, 4)
    if mode == "xyxy":
        return [a, b, c, d]
    if mode == "xywh":
        return [a, b, a + F.greatest(c - 1, F.lit(0.0)), b + F.greatest(d - 1, F.lit(0.0))]
    raise ValueError("a box is xyxy or xywh")


def to_sizes(box) -> v.Vector:
    a, b, c, d = v.vector(box, 4)
    return [a, b, c - a + 1, d - b + 1]


def resize(box, ratio_x: float, ratio_y: float | None = None) -> v.Vector:
    a, b, c, d = v.vector(box, 4)
    ry = ratio_x if ratio_y is None else ratio_y
    return [a * ratio_x, b * ry, c * ratio_x, d * ry]


def transpose(box, width: float, height: float, horizontal: bool = True) -> v.Vector:
    """Mirrored left to right, or top to bottom."""
    a, b, c, d = v.vector(box, 4)
    return [width - 1 - c, b, width - 1 - a, d] if horizontal else [a, height - 1 - d, c, height - 1 - b]


def clip(box, width: float, height: float) -> v.Vector:
    hold = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.lit(float(most - 1))))
    a, b, c, d = v.vector(box, 4)
    return [hold(a, width), hold(b, height), hold(c, width), hold(d, height)]


def crop(box, window: Sequence[float]) -> v.Vector:
    """Within a window (x0, y0, x1, y1), from its corner on."""
    a, b, c, d = v.vector(box, 4)
    w, h = window[2] - window[0], window[3] - window[1]
    hold = lambda x, low, most: F.greatest(F.lit(0.0), F.least(x - low, F.lit(float(most))))
    return [hold(a, window[0], w), hold(b, window[1], h), hold(c, window[0], w), hold(d, window[1], h)]


def area(box) -> Column:
    a, b, c, d = v.vector(box, 4)
    return (c - a + 1) * (d - b + 1)


def clip_boxes(df, box: str, width: float, height: float, remove_empty: bool = True):
    """A table of boxes (an array column of four) clipped to an image; other columns stay, boxes without an area go."""
    held = F.array(*clip(box, width, height))
    out = df.withColumn(box, held)
    return out.filter((F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))) if remove_empty else out
