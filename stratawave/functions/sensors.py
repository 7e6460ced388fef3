"""Fixed array layouts of sensor messages, packed from struct columns; binary images and clouds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratawave.functions import vectors as v

#: Sample type and channels of image encodings.
ENCODINGS = {
    "mono16": ("u2", 1), "16uc1": ("u2", 1), "rgb8": ("u1", 3), "bgr8": ("u1", 3), "rgb": ("u1", 3), "bgr": ("u1", 3),
    "rgba8": ("u1", 4), "bgra8": ("u1", 4), "mono8": ("u1", 1), "8uc1": ("u1", 1),
}
MAX_POINTS = 30000


def stamp(header: Column) -> Column:
    """Seconds of a header's stamp (sec, nanosec)."""
    return header["stamp"]["sec"].cast("double") + header["stamp"]["nanosec"].cast("double") * 1e-9


def parts(struct: Column, names: str) -> list[Column]:
    return [struct[n].cast("double") for n in names]


def diagonal(array: Column, places: Sequence[int]) -> list[Column]:
    return [F.get(array, F.lit(p)).cast("double") for p in places]


def rows_of_four(*rows: list) -> Column:
    return F.array(*(v.col(x) for row in rows for x in [*row, 0.0][:4]))


def imu_array(m: Column) -> Column:
    """6 x 4 of an IMU message: orientation, rates and acceleration, each before its covariance diagonal."""
    d = (0, 4, 8)
    return rows_of_four(
        parts(m["orientation"], "xyzw"), diagonal(m["orientation_covariance"], d), parts(m["angular_velocity"], "xyz"), diagonal(m["angular_velocity_covariance"], d),
        parts(m["linear_acceleration"], "xyz"), diagonal(m["linear_acceleration_covariance"], d),
    )


def odometry_array(m: Column) -> Column:
    """8 x 4 of an odometry message: position, orientation, linear and angular velocity, each before its covariance diagonal."""
    pose, twist = m["pose"], m["twist"]
    first, second = (0, 7, 14), (21, 28, 35)
    return rows_of_four(
        parts(pose["pose"]["position"], "xyz"), diagonal(pose["covariance"], first), parts(pose["pose"]["orientation"], "xyzw"), diagonal(pose["covariance"], second),
        parts(twist["twist"]["linear"], "xyz"), diagonal(twist["covariance"], first), parts(twist["twist"]["angular"], "xyz"), diagonal(twist["covariance"], second),
    )


def navsat_array(m: Column) -> Column:
    return F.array(*(m[n].cast("double") for n in ("latitude", "longitude", "altitude")))


def pose_array(pose: Column) -> Column:
    """Position and orientation of a pose."""
    return F.array(*parts(pose["position"], "xyz"), *parts(pose["orientation"], "xyzw"))


def pad_points(data: Column, width: int = 3, max_points: int = MAX_POINTS) -> Column:
    """A cloud padded with zeros to ``max_points`` rows for export; a larger one is an error."""
    n = max_points * width
    too_large = F.raise_error(F.lit(f"a cloud has more than {max_points} points")).cast("array<double>")
    return F.when(F.size(data) > n, too_large).otherwise(F.concat(data, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(data))))


def image_values(data: bytes, encoding: str, height: int, width: int, step: int | None = None, big_endian: bool = False) -> tuple[np.ndarray, list[int]]:
    """Samples and shape of a raw image; padding at the ends of rows is dropped, an unknown encoding gives its bytes."""
    if encoding.lower() not in ENCODINGS:
        raw = np.frombuffer(data, np.uint8)
        return raw, [len(raw)]
    kind, channels = ENCODINGS[encoding.lower()]
    own = width * channels * int(kind[1])
    step = own if step is None else int(step)
    if step < own:
        raise ValueError(f"rows of {step} bytes are too short for {width} pixels of {encoding}")
    if len(data) < height * step:
        raise ValueError(f"{len(data)} bytes are too few for {height} rows of {step}")
    rows = np.frombuffer(data, np.uint8, height * step).reshape(height, step)[:, :own]
    values = np.ascontiguousarray(rows).view(f"{'>' if big_endian else '<'}{kind}")
    return values.ravel(), [height, width] + ([channels] if channels > 1 else [])


def image_array(data: Column, encoding: Column, height: Column, width: Column, step: Column, big_endian: Column) -> Column:
    """Struct (data, shape, dtype) of raw image columns, decoded in Arrow batches."""

    @F.pandas_udf("struct<data: array<double>, shape: array<int>, dtype: string>")
    def decode(d: pd.Series, e: pd.Series, h: pd.Series, w: pd.Series, s: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x in zip(d, e, h, w, s, b):
            values, shape = image_values(bytes(x[0]), x[1], int(x[2]), int(x[3]), None if pd.isna(x[4]) else int(x[4]), bool(x[5]))
            out.append((values.astype(float), shape, values.dtype.newbyteorder("=").name))
        return pd.DataFrame(out, columns=["data", "shape", "dtype"])

    return decode(data, encoding, height, width, step, big_endian)
