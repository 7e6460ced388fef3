"""Rigid transforms of points, vectors, poses, odometry and fixes; graphs of frames."""

from __future__ import annotations

from collections import deque
from functools import partialmethod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.functions import geodesy
from stratawave.functions import quaternion as q
from stratawave.functions import vectors as v


def apply_transform(points, transform) -> Column:
    """R·p + t on the first three elements of an array; further elements are kept."""
    data = v.col(points)
    t = v.transform4(transform)
    p = v.unpack(data, 3)
    moved = [v.dot(row[:3], p) + row[3] for row in t]
    return F.concat(F.array(*moved), F.slice(data, 4, F.greatest(F.size(data) - 3, F.lit(0))))


def transform_vectors(vectors, transform) -> Column:
    """The rotation alone, on the first three elements; further elements are kept."""
    data = v.col(vectors)
    turned = v.times([row[:3] for row in v.transform4(transform)], v.unpack(data, 3))
    return F.concat(F.array(*turned), F.slice(data, 4, F.greatest(F.size(data) - 3, F.lit(0))))


def transform_poses(poses, transform) -> Column:
    """Pose arrays (x, y, z, qx, qy, qz, qw): position moved, orientation turned and normalised."""
    p = v.vector(poses, 7)
    t = v.transform4(transform)
    position = [v.dot(row[:3], p[:3]) + row[3] for row in t]
    turn = q.rotation_matrix_to_quaternion([row[:3] for row in t])
    return F.concat(F.array(*position), v.packed(q.normalize_quaternion(q.multiply(turn, F.slice(v.packed(poses, 7), 4, 4)))))


def transform_odometry(odometry, transform) -> Column:
    """Odometry arrays of 8x4: pose and velocities turned, covariance diagonals by the squared rotation."""
    data = v.col(odometry)
    rows = [v.unpack(data, 4, 4 * i) for i in range(8)]
    t = v.transform4(transform)
    r = [row[:3] for row in t]
    squared = [[x * x for x in row] for row in r]
    turn = q.rotation_matrix_to_quaternion(r)
    moved = [v.dot(row[:3], rows[0][:3]) + row[3] for row in t]
    out = [moved + rows[0][3:], v.times(squared, rows[1][:3]) + rows[1][3:], list(q.normalize_quaternion(q.multiply(turn, rows[2])))]
    for i in range(3, 8):
        out.append(v.times(squared if i % 2 else r, rows[i][:3]) + rows[i][3:])
    return F.array(*(x for row in out for x in row))


def transform_navsat(navsat, transform, ref_lat, ref_lon, ref_alt=0.0) -> Column:
    """Fixes (lat, lon, alt) moved in the local frame of the reference."""
    fix = v.vector(navsat, 3)
    moved = apply_transform(F.array(*geodesy.navsat_to_enu(*fix, ref_lat, ref_lon, ref_alt)), transform)
    return F.array(*geodesy.enu_to_navsat(moved, ref_lat, ref_lon, ref_alt))


def pose_to_matrix(pose) -> Column:
    """4x4 matrix of a pose, flat and row by row."""
    p = v.vector(pose, 7)
    r = q.quaternion_to_rotation_matrix(F.slice(v.packed(pose, 7), 4, 4))
    return F.array(*(x for i in range(3) for x in [*r[i], p[i]]), *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))


poses_to_matrices = pose_to_matrix


def as_matrix(transform) -> np.ndarray:
    t = np.asarray(transform, float)
    if t.shape not in ((3, 3), (3, 4), (4, 4)):
        raise ValueError("a transform is 3x3, 3x4 or 4x4")
    out = np.eye(4)
    out[: min(3, t.shape[0]), : t.shape[1]] = t[:3]
    return out


def slerp_matrix(a: np.ndarray, b: np.ndarray, f: float) -> np.ndarray:
    """Transform between two: translation linear, rotation along the shortest turn."""
    turn = a[:3, :3].T @ b[:3, :3]
    angle = float(np.arccos(np.clip((np.trace(turn) - 1) / 2, -1, 1)))
    out = np.eye(4)
    out[:3, 3] = (1 - f) * a[:3, 3] + f * b[:3, 3]
    if angle < 1e-12:
        out[:3, :3] = a[:3, :3]
        return out
    if np.pi - angle < 1e-6:
        values, axes = np.linalg.eigh((turn + turn.T) / 2)
        axis = axes[:, int(np.argmax(values))]
    else:
        axis = np.array([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]]) / (2 * np.sin(angle))
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    part = f * angle
    out[:3, :3] = a[:3, :3] @ (np.eye(3) + np.sin(part) * k + (1 - np.cos(part)) * k @ k)
    return out


class FrameGraph:
    """Named frames joined by fixed or time-varying rigid transforms.

    The graph describes a robot's frames and is small by nature; it lives on the driver
    and enters plans as literals. Each edge serves both directions; adding an edge again
    replaces it. Time-varying edges are interpolated and not extrapolated.
    """

    def __init__(self):
        self.edges: dict[str, dict[str, tuple[np.ndarray, np.ndarray | None, bool]]] = {}

    def add_transform(self, source_frame: str, target_frame: str, transform, timestamps=None) -> "FrameGraph":
        """``transform`` maps coordinates of the source frame to the target frame."""
        if source_frame == target_frame:
            raise ValueError("a frame needs no transform to itself")
        if timestamps is None:
            data, times = as_matrix(transform), None
        else:
            times = np.asarray(timestamps, float)
            data = np.stack([as_matrix(t) for t in transform])
            if len(times) != len(data) or not len(times) or np.any(np.diff(times) <= 0):
                raise ValueError("timestamps must be strictly increasing, one for each transform")
        self.edges.setdefault(source_frame, {})[target_frame] = (data, times, False)
        self.edges.setdefault(target_frame, {})[source_frame] = (data, times, True)
        return self

    def path(self, source: str, target: str) -> list[str]:
        """Frames of a shortest path from source to target."""
        if source not in self.edges and source != target:
            raise KeyError(source)
        came, waiting = {source: None}, deque([source])
        while waiting:
            at = waiting.popleft()
            if at == target:
                out = [at]
                while came[out[-1]] is not None:
                    out.append(came[out[-1]])
                return out[::-1]
            for other in self.edges.get(at, {}):
                if other not in came:
                    came[other] = at
                    waiting.append(other)
        raise KeyError(f"no transform leads from {source} to {target}")

    def edge(self, a: str, b: str, timestamp: float | None) -> np.ndarray:
        data, times, inverse = self.edges[a][b]
        if times is None:
            m = data
        else:
            if timestamp is None:
                raise ValueError(f"the transform from {a} to {b} varies with time: a timestamp is needed")
            if not times[0] <= timestamp <= times[-1]:
                raise ValueError(f"{timestamp} lies outside the transform from {a} to {b}")
            i = min(int(np.searchsorted(times, timestamp, "right")) - 1, max(len(times) - 2, 0))
            m = data[0] if len(times) == 1 else slerp_matrix(data[i], data[i + 1], (timestamp - times[i]) / (times[i + 1] - times[i]))
        return np.linalg.inv(m) if inverse else m

    def lookup_transform(self, source_frame: str, target_frame: str, timestamp: float | None = None) -> np.ndarray:
        """4x4 transform along a shortest path; an unknown or unconnected frame is a KeyError."""
        out, frames = np.eye(4), self.path(source_frame, target_frame)
        for a, b in zip(frames, frames[1:]):
            out = self.edge(a, b, timestamp) @ out
        return out

    def transformed(self, rule, data, source_frame: str, target_frame: str, timestamp: float | None = None) -> Column:
        """Data of one frame in another, by a rule that takes data and a 4x4 transform."""
        return rule(data, self.lookup_transform(source_frame, target_frame, timestamp))

    transform_points = partialmethod(transformed, apply_transform)
    transform_vectors = partialmethod(transformed, transform_vectors)
    transform_poses = partialmethod(transformed, transform_poses)


def dem_grid_to_points(cells: DataFrame, x=None, y=None, resolution: float = 1.0, origin=(0.0, 0.0)) -> DataFrame:
    """Cells (row, col, z) with their coordinates: x and y as given by column expressions, else origin + index · resolution."""
    if resolution <= 0:
        raise ValueError("resolution must be above 0")
    return cells.withColumns({
        "x": v.col(x) if x is not None else F.lit(float(origin[0])) + F.col("col") * float(resolution),
        "y": v.col(y) if y is not None else F.lit(float(origin[1])) + F.col("row") * float(resolution),
    })


def transform_dem_grid(cells: DataFrame, transform, x=None, y=None, resolution: float = 1.0, origin=(0.0, 0.0)) -> DataFrame:
    """Cells as transformed points (x, y, z)."""
    points = dem_grid_to_points(cells, x, y, resolution, origin)
    t = v.transform4(transform)
    p = [F.col("x"), F.col("y"), F.col("z")]
    return points.withColumns({name: v.dot(row[:3], p) + row[3] for name, row in zip("xyz", t)})
