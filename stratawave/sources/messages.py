"""Binary and JSON messages of recordings, decoded one at a time.

A decoded message is a dict with data (flat floats), shape, name, timestamp, frame_id and
extra (a dict of texts).
"""

from __future__ import annotations

import base64
import json
import struct

import numpy as np

from stratawave.functions.sensors import image_values

#: Fields of a calibration message in the order of their encoding, with their types (u32, f64, str).
CALIBRATION = (
    ("schema_version", "I"), ("source", "s"), ("relative_pointcloud_topic", "s"), ("overlay_mesh_source", "s"), ("frame_id", "s"), ("relative_depth_width", "I"), ("relative_depth_height", "I"),
    ("image_width", "I"), ("image_height", "I"), ("scale", "d"), ("offset", "d"), ("equation", "s"), ("relative_depth_units", "s"), ("metric_depth_units", "s"), ("calibration_source", "s"), ("metadata_json", "s"),
)
#: Those of them that make up the payload.
PAYLOAD = ("scale", "offset", "relative_depth_width", "relative_depth_height", "image_width", "image_height")
#: Sample types of cloud fields by number.
POINT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


class Cursor:
    """Reads aligned values of a CDR stream behind its four-byte header."""

    def __init__(self, raw: bytes):
        if len(raw) < 4:
            raise ValueError("too short for a CDR message")
        self.raw, self.at, self.order = raw, 4, "<" if raw[1] & 1 else ">"

    def align(self, size: int) -> None:
        self.at += -(self.at - 4) % size

    def take(self, kind: str):
        size = struct.calcsize(kind)
        self.align(size)
        (value,) = struct.unpack_from(self.order + kind, self.raw, self.at)
        self.at += size
        return value

    def doubles(self, n: int) -> np.ndarray:
        """A fixed number of 64-bit floats."""
        self.align(8)
        return np.frombuffer(self.block(8 * n), self.order + "f8")

    def block(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("a message ends within a field")
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self) -> str:
        return self.block(self.take("I")).rstrip(b"\0").decode(errors="replace")

    def value(self, kind: str):
        return self.text() if kind == "s" else self.take(kind)

    def header(self) -> tuple[float, str]:
        seconds, nanos = self.take("i"), self.take("I")
        return seconds + nanos * 1e-9, self.text()


class Packed(Cursor):
    """Reads values of the older serialization, which has no header, no padding and no zero behind texts."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.order = raw, 0, "<"

    def align(self, size: int) -> None:
        pass

    def text(self) -> str:
        return self.block(self.take("I")).decode(errors="replace")

    def header(self) -> tuple[float, str]:
        self.take("I")  # a running number
        seconds, nanos = self.take("I"), self.take("I")
        return seconds + nanos * 1e-9, self.text()


def message(data, name: str, timestamp: float, frame_id: str | None, extra: dict | None = None, dtype: str = "float64") -> dict:
    a = np.asarray(data, float)
    return {"data": a.ravel(), "shape": list(a.shape), "dtype": dtype, "name": name, "timestamp": float(timestamp), "frame_id": frame_id, "extra": {k: str(x) for k, x in (extra or {}).items()}}


def pointcloud_xyz(point_bytes: bytes, fields: list[dict], height: int, width: int, point_step: int, row_step: int, is_bigendian: bool) -> np.ndarray:
    """N x 3 coordinates of packed points, as 32-bit floats.

    Rows of an organised cloud may be padded: row_step counts where it is larger than the
    points and the bytes are enough for it; some writers state it and pack densely.
    """
    where = {f["name"]: f for f in fields}
    if lacking := [c for c in "xyz" if c not in where]:
        raise ValueError(f"the cloud has no field {lacking}")
    own = width * point_step
    padded = height > 1 and row_step > own and len(point_bytes) >= (height - 1) * row_step + own
    raw = np.frombuffer(point_bytes, np.uint8)
    if padded:
        starts = (np.arange(height)[:, None] * row_step + np.arange(width) * point_step).ravel()
    else:
        starts = np.arange(height * width) * point_step
    if len(starts) and starts[-1] + point_step > len(raw):
        raise ValueError("the cloud has fewer bytes than points")
    out = np.empty((len(starts), 3), np.float32)
    for i, c in enumerate("xyz"):
        kind = np.dtype((">" if is_bigendian else "<") + POINT_TYPES[int(where[c]["datatype"])])
        places = starts[:, None] + int(where[c]["offset"]) + np.arange(kind.itemsize)
        out[:, i] = np.ascontiguousarray(raw[places]).view(kind)[:, 0] if len(starts) else 0
    return out


def decode_pose_stamped(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    return message(c.doubles(7), "PoseStamped", time, frame)


def decode_pose(raw: bytes, cursor=Cursor) -> dict:
    """A pose without a header: its time is that of the recording."""
    return message(cursor(raw).doubles(7), "Pose", 0.0, None)


def decode_pointcloud2(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    height, width = c.take("I"), c.take("I")
    fields = [{"name": c.text(), "offset": c.take("I"), "datatype": c.take("B"), "count": c.take("I")} for _ in range(c.take("I"))]
    big, point_step, row_step = bool(c.take("B")), c.take("I"), c.take("I")
    return message(pointcloud_xyz(c.block(c.take("I")), fields, height, width, point_step, row_step, big), "PointCloud2", time, frame)


def decode_depth_anything_calibration(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    values = {name: c.value(kind) for name, kind in CALIBRATION}
    return message([values[p] for p in PAYLOAD], "DepthAnythingCalibration", time, frame, values)


def four(rows) -> np.ndarray:
    """Rows of up to four values, filled with zeros."""
    return np.array([[*row, 0.0][:4] for row in rows])


def imu_rows(orientation, orientation_covariance, rates, rates_covariance, acceleration, acceleration_covariance) -> np.ndarray:
    d = [0, 4, 8]
    return four([orientation, np.asarray(orientation_covariance)[d], rates, np.asarray(rates_covariance)[d], acceleration, np.asarray(acceleration_covariance)[d]])


def odometry_rows(pose, pose_covariance, twist, twist_covariance) -> np.ndarray:
    a, b, p, t = [0, 7, 14], [21, 28, 35], np.asarray(pose_covariance), np.asarray(twist_covariance)
    return four([pose[:3], p[a], pose[3:], p[b], twist[:3], t[a], twist[3:], t[b]])


def decode_imu(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    return message(imu_rows(c.doubles(4), c.doubles(9), c.doubles(3), c.doubles(9), c.doubles(3), c.doubles(9)), "Imu", time, frame)


def decode_odometry(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    child = c.text()
    return message(odometry_rows(c.doubles(7), c.doubles(36), c.doubles(6), c.doubles(36)), "Odometry", time, frame, {"child_frame_id": child})


def decode_navsatfix(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    status, _ = c.take("b"), c.take("H")
    return message(c.doubles(3), "NavSatFix", time, frame, {"status": status})


def decode_image(raw: bytes, cursor=Cursor) -> dict:
    c = cursor(raw)
    time, frame = c.header()
    height, width, encoding, big, step = c.take("I"), c.take("I"), c.text(), bool(c.take("B")), c.take("I")
    values, shape = image_values(c.block(c.take("I")), encoding, height, width, step, big)
    return message(values.reshape(shape), "Image", time, frame, {"encoding": encoding}, values.dtype.newbyteorder("=").name)


#: Decoders by the name of a message's type, whatever package defines it.
CDR = {
    "PoseStamped": decode_pose_stamped, "Pose": decode_pose, "PointCloud2": decode_pointcloud2, "DepthAnythingCalibration": decode_depth_anything_calibration,
    "Imu": decode_imu, "Odometry": decode_odometry, "NavSatFix": decode_navsatfix, "Image": decode_image,
}


def decode_rosbridge_json_message(raw: bytes, kind: str) -> dict | None:
    """A message in JSON, bare or as msg of an envelope; absent fields are 0, and w of an orientation 1. None for what is no such message."""
    try:
        outer = json.loads(raw.decode(errors="replace"))
    except ValueError:
        return None
    m = outer.get("msg", outer) if isinstance(outer, dict) else None
    if not isinstance(m, dict):
        return None
    head = m.get("header") or {}
    at = head.get("stamp") or {}
    time = float(at.get("sec", 0)) + float(at.get("nanosec", at.get("nsec", 0))) * 1e-9
    name, frame = kind.rsplit("/", 1)[-1], head.get("frame_id")
    number = lambda d, k, absent=0.0: float((d or {}).get(k, absent))
    if name == "PoseStamped":
        pose = m.get("pose") or {}
        return message([*(number(pose.get("position"), k) for k in "xyz"), *(number(pose.get("orientation"), k, float(k == "w")) for k in "xyzw")], name, time, frame)
    vector = lambda d, keys="xyz", one="": [number(d, k, float(k == one)) for k in keys]
    if name == "Pose":
        return message([*vector(m.get("position")), *vector(m.get("orientation"), "xyzw", "w")], name, 0.0, None)
    if name == "Imu":
        spread = [m.get(k) or [0.0] * 9 for k in ("orientation_covariance", "angular_velocity_covariance", "linear_acceleration_covariance")]
        return message(imu_rows(vector(m.get("orientation"), "xyzw", "w"), spread[0], vector(m.get("angular_velocity")), spread[1], vector(m.get("linear_acceleration")), spread[2]), name, time, frame)
    if name == "Odometry":
        pose, twist = m.get("pose") or {}, m.get("twist") or {}
        inner, speed = pose.get("pose") or {}, twist.get("twist") or {}
        rows = odometry_rows(
            [*vector(inner.get("position")), *vector(inner.get("orientation"), "xyzw", "w")], pose.get("covariance") or [0.0] * 36,
            [*vector(speed.get("linear")), *vector(speed.get("angular"))], twist.get("covariance") or [0.0] * 36,
        )
        return message(rows, name, time, frame, {"child_frame_id": m.get("child_frame_id", "")})
    if name == "Image":
        data = m.get("data", "")
        raw_pixels = base64.b64decode(data) if isinstance(data, str) else bytes(data)
        values, shape = image_values(raw_pixels, str(m.get("encoding", "")), int(m.get("height", 0)), int(m.get("width", 0)), m.get("step"), bool(m.get("is_bigendian", False)))
        return message(values.reshape(shape), name, time, frame, {"encoding": m.get("encoding", "")}, values.dtype.newbyteorder("=").name)
    if name == "NavSatFix":
        return message([number(m, k) for k in ("latitude", "longitude", "altitude")], name, time, frame)
    if name == "PointCloud2":
        data = m.get("data", "")
        packed = base64.b64decode(data) if isinstance(data, str) else bytes(data)
        sizes = [int(m.get(k, 0)) for k in ("height", "width", "point_step", "row_step")]
        return message(pointcloud_xyz(packed, m.get("fields") or [], *sizes, bool(m.get("is_bigendian", False))), name, time, frame)
    if name == "DepthAnythingCalibration":
        return message([number(m, k) for k in PAYLOAD], name, time, frame, {k: m[k] for k, _ in CALIBRATION if k in m})
    return None


def decode_supported_cdr_message(raw: bytes, kind: str, cursor=Cursor) -> dict | None:
    """A message of a supported kind, in JSON or as ``cursor`` reads it (CDR); None for other kinds."""
    text = raw.strip()
    if raw[:1] in (b"{", b" ") and text[:1] == b"{" and text[-1:] == b"}":
        return decode_rosbridge_json_message(raw, kind)
    decode = CDR.get(kind.rsplit("/", 1)[-1])
    return decode(raw, cursor) if decode else None
