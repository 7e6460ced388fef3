"""Pinhole cameras with Brown-Conrady distortion, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratawave.functions import vectors as v


def camera_matrix(fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    if not fx or not fy:
        raise ValueError("focal lengths must differ from 0")
    return np.array([[fx, 0.0, cx], [0.0, fy, cy], [0.0, 0.0, 1.0]])


def scale_camera_matrix(matrix, scale_x: float, scale_y: float | None = None) -> np.ndarray:
    scale_y = scale_x if scale_y is None else scale_y
    if scale_x <= 0 or scale_y <= 0:
        raise ValueError("scales must be above 0")
    return np.diag([scale_x, scale_y, 1.0]) @ checked(matrix)


def crop_camera_matrix(matrix, row_offset: float = 0.0, col_offset: float = 0.0) -> np.ndarray:
    out = checked(matrix).copy()
    out[0, 2] -= col_offset
    out[1, 2] -= row_offset
    return out


def checked(matrix) -> np.ndarray:
    m = np.asarray(matrix, float)
    if m.shape != (3, 3):
        raise ValueError("a camera matrix is 3x3")
    if not m[0, 0] or not m[1, 1]:
        raise ValueError("focal lengths must differ from 0")
    return m


def coefficients(distortion) -> list[float]:
    """k1, k2, p1, p2, k3, k4, k5, k6 of four, five or eight coefficients."""
    if distortion is None:
        return [0.0] * 8
    d = [float(x) for x in np.ravel(distortion)]
    if len(d) not in (4, 5, 8):
        raise ValueError("a distortion has 4, 5 or 8 coefficients")
    return d + [0.0] * (8 - len(d))


@dataclass(frozen=True)
class CameraModel:
    """Checked parameters of one camera; they enter plans as literals."""

    intrinsics: np.ndarray
    image_shape: tuple[int, int] | None = None
    distortion: tuple[float, ...] | None = None
    rectification: np.ndarray | None = None
    projection_matrix: np.ndarray | None = None

    def __post_init__(self):
        checked(self.intrinsics)
        coefficients(self.distortion)
        if self.image_shape is not None and (len(self.image_shape) < 2 or min(self.image_shape[:2]) <= 0):
            raise ValueError("an image shape is (rows, columns), both above 0")
        if self.rectification is not None and np.shape(self.rectification) != (3, 3):
            raise ValueError("a rectification is 3x3")
        if self.projection_matrix is not None and np.shape(self.projection_matrix) != (3, 4):
            raise ValueError("a projection matrix is 3x4")


def camera_model(fx=None, fy=None, cx=None, cy=None, intrinsics=None, image_shape=None, distortion=None, rectification=None, projection_matrix=None) -> CameraModel:
    if intrinsics is None:
        if None in (fx, fy, cx, cy):
            raise ValueError("fx, fy, cx and cy or intrinsics are needed")
        intrinsics = camera_matrix(fx, fy, cx, cy)
    shape = None if image_shape is None else tuple(int(x) for x in image_shape[:2])
    return CameraModel(checked(intrinsics), shape, None if distortion is None else tuple(map(float, np.ravel(distortion))), rectification, projection_matrix)


def intrinsics_of(fx, fy, cx, cy, matrix, camera: CameraModel | None = None) -> np.ndarray:
    if camera is not None:
        return camera.intrinsics
    if matrix is not None:
        return checked(matrix)
    if None in (fx, fy, cx, cy):
        raise ValueError("fx, fy, cx and cy or a camera matrix are needed")
    return camera_matrix(fx, fy, cx, cy)


def pixels_to_normalized_points(pixels, camera_matrix) -> v.Vector:
    k, (px, py) = checked(camera_matrix), v.vector(pixels, 2)
    return [(px - float(k[0, 2])) / float(k[0, 0]), (py - float(k[1, 2])) / float(k[1, 1])]


def normalized_points_to_pixels(points, camera_matrix) -> v.Vector:
    k, (x, y) = checked(camera_matrix), v.vector(points, 2)
    return [x * float(k[0, 0]) + float(k[0, 2]), y * float(k[1, 1]) + float(k[1, 2])]


def factors(x: Column, y: Column, distortion) -> tuple[Column, Column, Column]:
    """Radial factor and tangential shifts at a point."""
    k1, k2, p1, p2, k3, k4, k5, k6 = coefficients(distortion)
    r2 = x * x + y * y
    over = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    under = 1 + r2 * (k4 + r2 * (k5 + r2 * k6))
    radial = F.when(under == 0, F.lit(1.0)).otherwise(over / under)
    return radial, 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def distort_normalized_points(points, distortion=None) -> v.Vector:
    x, y = v.vector(points, 2)
    if distortion is None:
        return [x, y]
    radial, dx, dy = factors(x, y, distortion)
    return [x * radial + dx, y * radial + dy]


def undistort_normalized_points(points, distortion=None, iterations: int = 5) -> v.Vector:
    """Fixed-point inverse of the distortion, each step an aggregate over an array of the steps so that the expression stays small."""
    x0, y0 = v.vector(points, 2)
    if distortion is None:
        return [x0, y0]

    def step(at: Column, _: Column) -> Column:
        radial, dx, dy = factors(at["x"], at["y"], distortion)
        return F.struct(F.try_divide(x0 - dx, radial).alias("x"), F.try_divide(y0 - dy, radial).alias("y"))

    done = F.reduce(F.array_repeat(F.lit(1), iterations), F.struct(x0.alias("x"), y0.alias("y")), step)
    return [done["x"], done["y"]]


def distort_pixels(pixels, camera_matrix, distortion=None) -> v.Vector:
    return normalized_points_to_pixels(distort_normalized_points(pixels_to_normalized_points(pixels, camera_matrix), distortion), camera_matrix)


def undistort_pixels(pixels, camera_matrix, distortion=None, iterations: int = 5) -> v.Vector:
    return normalized_points_to_pixels(undistort_normalized_points(pixels_to_normalized_points(pixels, camera_matrix), distortion, iterations), camera_matrix)


def backproject_pixels(pixels, depth, camera_matrix, distortion=None) -> v.Vector:
    """Camera coordinates of pixels at a depth."""
    x, y = undistort_normalized_points(pixels_to_normalized_points(pixels, camera_matrix), distortion)
    z = v.col(depth)
    return [x * z, y * z, z]


def project_camera_points(points, camera: CameraModel | None = None, fx=None, fy=None, cx=None, cy=None, camera_matrix=None, distortion=None, image_shape=None, transform=None) -> Column:
    """Struct (u, v, depth, valid) of points; u and v are NaN where the point cannot be seen.

    Valid are points with finite coordinates in front of the camera and, with an image
    shape (rows, columns), in [0, columns - 1] x [0, rows - 1].
    """
    k = intrinsics_of(fx, fy, cx, cy, camera_matrix, camera)
    if camera is not None:
        distortion = camera.distortion if distortion is None else distortion
        image_shape = camera.image_shape if image_shape is None else image_shape
    p = v.vector(points, 3) if isinstance(points, (list, tuple)) else v.unpack(points, 3)
    if transform is not None:
        t = v.transform4(transform)
        p = [v.dot(row[:3], p) + row[3] for row in t]
    front = v.is_finite(*p) & (p[2] > 0)
    z = F.when(front, p[2])
    u, w = normalized_points_to_pixels(distort_normalized_points([p[0] / z, p[1] / z], distortion), k)
    valid = front
    if image_shape is not None:
        valid = valid & v.between(u, 0, image_shape[1] - 1) & v.between(w, 0, image_shape[0] - 1)
    valid = F.coalesce(valid, F.lit(False))
    nan = F.lit(float("nan"))
    return F.struct(F.when(valid, u).otherwise(nan).alias("u"), F.when(valid, w).otherwise(nan).alias("v"), p[2].alias("depth"), valid.alias("valid"))


def project_points_to_image(points, fx=None, fy=None, cx=None, cy=None, image_shape=None, transform=None, camera_matrix=None, distortion=None) -> Column:
    return project_camera_points(points, None, fx, fy, cx, cy, camera_matrix, distortion, image_shape, transform)
