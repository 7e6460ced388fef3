"""Quaternions in the order x, y, z, w, as column expressions.

Arguments are lists of columns, array columns or their names; results are vectors whose
``array`` is one expression, so results can be arguments again without growing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratawave.functions import vectors as v

#: Standard gravity in a frame whose z axis points up.
GRAVITY = (0.0, 0.0, -9.80665)


def out(array: Column, n: int) -> v.Vector:
    return v.unpack(array, n)


def unit(a: Column) -> Column:
    """A quaternion array over its norm; null if an element is."""

    def divide(s: Column) -> Column:
        n = F.when(s["n"] == 0, F.raise_error(F.lit("a quaternion of norm 0 cannot be normalised")).cast("double")).otherwise(s["n"])
        return F.transform(s["a"], lambda x: x / n)

    return v.let(a, lambda q: F.struct(F.slice(q, 1, 4).alias("a"), v.norm(v.unpack(q, 4)).alias("n")), divide)


def normalize_quaternion(quaternion) -> v.Vector:
    """Unit quaternion; a zero norm is an error when the row is computed, null gives null."""
    return out(unit(v.packed(quaternion, 4)), 4)


def product(a: Column, b: Column) -> Column:
    (ax, ay, az, aw), (bx, by, bz, bw) = v.unpack(a, 4), v.unpack(b, 4)
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def pair(a, b, **more) -> Column:
    return F.struct(v.packed(a).alias("a"), v.packed(b).alias("b"), *(v.col(x).alias(n) for n, x in more.items()))


def multiply(a, b) -> v.Vector:
    return out(v.let(pair(a, b), lambda s: product(s["a"], s["b"])), 4)


def conjugate(q) -> v.Vector:
    return out(v.let(v.packed(q, 4), lambda a: F.array(*(-x for x in v.unpack(a, 3)), F.get(a, F.lit(3)))), 4)


def slerp(q0, q1, fraction) -> v.Vector:
    """Shortest-path spherical interpolation; nearly equal orientations (dot above 0.9995) interpolate linearly."""

    def measured(s: Column) -> Column:
        d = v.dot(v.unpack(s["a"], 4), v.unpack(s["b"], 4))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["t"].alias("t"), d.alias("d"), F.acos(F.least(F.abs(d), F.lit(1.0))).alias("angle"))

    def weighed(s: Column) -> Column:
        near, t, angle = F.abs(s["d"]) > 0.9995, s["t"], s["angle"]
        wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
        wb = F.when(s["d"] < 0, -1.0).otherwise(1.0) * F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), wa.alias("wa"), wb.alias("wb"))

    ready = F.struct(unit(v.packed(q0, 4)).alias("a"), unit(v.packed(q1, 4)).alias("b"), v.col(fraction).alias("t"))
    mixed = v.let(ready, measured, weighed, lambda s: F.zip_with(s["a"], s["b"], lambda x, y: x * s["wa"] + y * s["wb"]))
    return out(unit(mixed), 4)


def euler_to_quaternion(roll, pitch=None, yaw=None, degrees: bool = False) -> v.Vector:
    """From roll, pitch, yaw (applied in the order x, y, z about fixed axes), or one vector of the three."""
    angles = v.packed(roll, 3) if pitch is None and yaw is None else F.array(*(v.col(x) for x in (roll, pitch, yaw)))

    def parts(a: Column) -> Column:
        half = [(F.radians(x) if degrees else x) / 2 for x in v.unpack(a, 3)]
        return F.array(*(f(x) for f in (F.cos, F.sin) for x in half))

    def made(c: Column) -> Column:
        cr, cp, cy, sr, sp, sy = v.unpack(c, 6)
        return F.array(sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy)

    return out(v.let(angles, parts, made), 4)


def quaternion_to_euler(quaternion, degrees: bool = False) -> v.Vector:
    """Roll, pitch, yaw; the pitch is clipped to a quarter turn."""

    def angles(a: Column) -> Column:
        x, y, z, w = v.unpack(a, 4)
        made = [
            F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)),
            F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))),
            F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
        ]
        return F.array(*(F.degrees(m) if degrees else m for m in made))

    return out(v.let(unit(v.packed(quaternion, 4)), angles), 3)


def rotation(a: Column) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion array."""
    x, y, z, w = v.unpack(a, 4)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_to_rotation_matrix(quaternion) -> list[v.Vector]:
    """Three rows of the matrix."""
    flat = v.let(unit(v.packed(quaternion, 4)), lambda a: F.array(*(x for row in rotation(a) for x in row)))
    nine = v.unpack(flat, 9)
    return [v.Vector(nine[3 * i : 3 * i + 3]) for i in range(3)]


def rotation_matrix_to_quaternion(m) -> v.Vector:
    """Quaternion of a rotation matrix (3 x 3 columns or numbers), by the largest of its four components."""
    rows = m if isinstance(m, list) else v.matrix(m, 3, 3)

    def measured(a: Column) -> Column:
        r = v.unpack(a, 9)
        d = [r[0], r[4], r[8]]
        squares = [1 + d[0] - d[1] - d[2], 1 - d[0] + d[1] - d[2], 1 - d[0] - d[1] + d[2], 1 + d[0] + d[1] + d[2]]
        off = [r[1] + r[3], r[2] + r[6], r[5] + r[7], r[7] - r[5], r[2] - r[6], r[3] - r[1]]  # xy, xz, yz, xw, yw, zw
        return F.struct(F.array(*squares).alias("s"), F.array(*off).alias("o"), F.greatest(*squares).alias("most"))

    def chosen(q: Column) -> Column:
        s, o, root = v.unpack(q["s"], 4), v.unpack(q["o"], 6), F.sqrt(q["most"])
        place = {(0, 1): 0, (0, 2): 1, (1, 2): 2, (0, 3): 3, (1, 3): 4, (2, 3): 5}
        made = None
        for k in range(4):
            value = F.array(*(root / 2 if i == k else o[place[min(i, k), max(i, k)]] / (2 * root) for i in range(4)))
            test = s[k] == q["most"]
            made = F.when(test, value) if made is None else made.when(test, value)
        return made

    flat = F.array(*(v.col(x) for row in rows for x in row))
    return out(unit(v.let(flat, measured, chosen)), 4)


def turn(s: Column, inverse: bool) -> Column:
    m = rotation(s["b"])
    return F.array(*v.times(v.transposed(m) if inverse else m, v.unpack(s["a"], 3)))


def rotate_vectors_by_quaternion(vectors, quaternion, inverse: bool = False) -> v.Vector:
    ready = F.struct(v.packed(vectors, 3).alias("a"), unit(v.packed(quaternion, 4)).alias("b"))
    return out(v.let(ready, lambda s: turn(s, inverse)), 3)


def compensate_gravity(linear_acceleration, orientation, gravity=GRAVITY, orientation_maps_body_to_world: bool = True) -> v.Vector:
    """Acceleration plus gravity as the body sees it."""
    g = rotate_vectors_by_quaternion([float(x) for x in gravity], orientation, inverse=orientation_maps_body_to_world)
    return out(F.zip_with(v.packed(linear_acceleration, 3), v.packed(g), lambda a, b: a + b), 3)


def compensate_imu_gravity(imu, gravity=GRAVITY, orientation_maps_body_to_world: bool = True) -> Column:
    """The same on a flat IMU array of 24: orientation in 0 to 3, linear acceleration in 16 to 18."""
    data = v.col(imu)
    moved = compensate_gravity(F.slice(data, 17, 3), F.slice(data, 1, 4), gravity, orientation_maps_body_to_world)
    return F.concat(F.slice(data, 1, 16), v.packed(moved), F.slice(data, 20, 5))


def angular_velocity(q0, q1, dt) -> v.Vector:
    """Rate in the body frame that turns the first orientation into the second within ``dt``; infinite (NaN about axes at rest) where that is 0."""

    def measured(s: Column) -> Column:
        x, y, z, w = v.unpack(s["q"], 4)
        return F.struct(s["q"].alias("q"), s["dt"].alias("dt"), F.sqrt(x * x + y * y + z * z).alias("s"), w.alias("w"))

    def rate(s: Column) -> Column:
        sign = F.when(s["w"] < 0, -1.0).otherwise(1.0)
        k = F.when(s["dt"] == 0, sign * float("inf")).otherwise(F.when(s["s"] > 1e-12, 2 * F.atan2(s["s"], F.abs(s["w"])) / s["s"]).otherwise(2.0) * sign / s["dt"])
        return F.transform(F.slice(s["q"], 1, 3), lambda x: x * k)

    between = unit(v.packed(multiply(conjugate(q0), q1)))
    return out(v.let(F.struct(between.alias("q"), v.col(dt).alias("dt")), measured, rate), 3)
