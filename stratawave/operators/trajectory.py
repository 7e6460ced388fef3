"""Trajectories: one row for each sample, with position, orientation, rates and covariance diagonals as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.functions import geodesy
from stratawave.functions import quaternion as q
from stratawave.functions import vectors as v
from stratawave.operators.align import around, grid, lerp
from stratawave.operators.order import BLOCK, bordered, same, with_neighbours
from stratawave.operators.windows import ieee_divide, neighbour_gradient, smooth_timeseries
from stratawave.session import changes, cut, whole_groups, whole_tables

STATES = ("position", "orientation", "linear_velocity", "angular_velocity", "linear_acceleration")
COVARIANCES = tuple(f"{s}_covariance" for s in STATES)


def nan3() -> Column:
    return F.array_repeat(F.lit(float("nan")), 3)


def identity() -> Column:
    return F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))


def trajectory(df: DataFrame, fields: Mapping[str, Column], source: str, keep: Sequence[str] = ()) -> DataFrame:
    """Common form: key columns, seq, ts, the five states, their covariances, pose (7), trajectory (13) and source.

    States that are not given are NaN, the orientation identity; orientations are normalised.
    """
    given = {s: fields.get(s, identity() if s == "orientation" else nan3()) for s in STATES} | {c: fields.get(c, nan3()) for c in COVARIANCES}
    given["orientation"] = v.packed(q.normalize_quaternion(given["orientation"]))
    heads = [c for c in ("topic", "source_uri", "seq", "ts") if c in df.columns]
    out = df.select(*heads, *(x.alias(n) for n, x in given.items()), *(c for c in keep if c in df.columns), F.lit(source).alias("source"))
    return with_pose(out)


def with_pose(df: DataFrame) -> DataFrame:
    return df.withColumns({"pose": F.concat("position", "orientation"), "trajectory": F.concat("position", "orientation", "linear_velocity", "angular_velocity")})


def imu_to_trajectory(imu: DataFrame, data: str = "data", position: str | None = None, linear_velocity: str | None = None) -> DataFrame:
    """IMU rows of 24 elements: orientation, rates and acceleration with their covariances; position and velocity only if given."""
    d = F.col(data)
    fields = {
        "orientation": F.slice(d, 1, 4), "orientation_covariance": F.slice(d, 5, 3), "angular_velocity": F.slice(d, 9, 3),
        "angular_velocity_covariance": F.slice(d, 13, 3), "linear_acceleration": F.slice(d, 17, 3), "linear_acceleration_covariance": F.slice(d, 21, 3),
    }
    fields |= {n: F.col(c) for n, c in (("position", position), ("linear_velocity", linear_velocity)) if c}
    return trajectory(imu, fields, "imu")


def odometry_to_trajectory(odometry: DataFrame, data: str = "data") -> DataFrame:
    """Odometry rows of 32 elements."""
    d = F.col(data)
    names = ("position", "orientation", "linear_velocity", "angular_velocity")
    fields = {n: F.slice(d, 8 * i + 1, 4 if n == "orientation" else 3) for i, n in enumerate(names)} | {f"{n}_covariance": F.slice(d, 8 * i + 5, 3) for i, n in enumerate(names)}
    return trajectory(odometry, fields, "odometry")


def first_fix(df: DataFrame, data: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(data, "seq").alias("reference_fix"))


def navsat_to_local(df: DataFrame, data: str = "data", ref_lat=None, ref_lon=None, ref_alt=None, frame: str = "enu", by: Sequence[str] = ("topic",)) -> DataFrame:
    """Adds local (ENU or NED) and reference (lat, lon, alt): the first fix of the key where no reference is given."""
    down = geodesy.local(frame)
    by = list(by)
    a, b = df.alias("a"), first_fix(df, data, by).alias("b")
    joined = a.join(b, same("a", "b", by)).select(*(F.col(f"a.`{c}`") for c in df.columns), "b.reference_fix")
    first = v.unpack("reference_fix", 3)
    reference = [F.lit(float(x)) if x is not None else first[i] for i, x in enumerate((ref_lat, ref_lon, ref_alt))]
    enu = geodesy.navsat_to_enu(*v.unpack(data, 3), *reference)
    return joined.withColumns({"local": F.array(*(geodesy.enu_to_ned(enu) if down else enu)), "reference": F.array(*reference)}).drop("reference_fix")


def navsat_to_trajectory(navsat: DataFrame, data: str = "data", ref_lat=None, ref_lon=None, ref_alt=None, compute_velocity: bool = True, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Fixes as a trajectory in ENU about the reference; velocity is the derivative of position, NaN at repeated times."""
    local = navsat_to_local(navsat, data, ref_lat, ref_lon, ref_alt, "enu", by).withColumnRenamed(data, "navsat")
    fields = {"position": F.col("local")}
    if compute_velocity:
        near = with_neighbours(local, by, "seq", ["ts", "local"])
        level = F.coalesce((F.col("ts") == F.col("prev_ts")) | (F.col("ts") == F.col("next_ts")), F.lit(False))
        velocity = F.transform(neighbour_gradient("local"), lambda x: F.when(level | x.isNull(), float("nan")).otherwise(x))
        local = near.select(*local.columns, F.when(F.size("local") > 0, velocity).otherwise(nan3()).alias("velocity"))
        fields["linear_velocity"] = F.col("velocity")
    return trajectory(local, fields, "navsat", ("navsat", "reference", "status"))


def sensor_to_trajectory(df: DataFrame, kind: str, **more) -> DataFrame:
    made = {"imu": imu_to_trajectory, "odometry": odometry_to_trajectory, "odom": odometry_to_trajectory, "navsat": navsat_to_trajectory, "gps": navsat_to_trajectory}
    if kind.lower() not in made:
        raise ValueError(f"unknown kind of sensor: {kind}")
    return made[kind.lower()](df, **more)


def strict(near: DataFrame) -> Column:
    """ts, or an error where it does not increase."""
    wrong = F.coalesce(F.col("prev_ts") >= F.col("ts"), F.lit(False))
    return F.when(wrong, F.raise_error(F.lit("timestamps must strictly increase")).cast("double")).otherwise(F.col("ts"))


def interpolate_timeseries(df: DataFrame, times: DataFrame, values: Sequence[str], by: Sequence[str] = ("topic",)) -> DataFrame:
    """Linear values of array columns at the times (*by, ts, seq); end values repeat outside."""
    found = around(times.select(*by, "ts", "seq"), df.select(*by, "ts", "seq", *values), by)
    b, a = F.col("before"), F.col("after")
    share = (F.col("ts") - b["ts"]) / (a["ts"] - b["ts"])
    return found.select(*by, "ts", "seq", *(blend(b, a, n, share).alias(n) for n in values))


def blend(b: Column, a: Column, name: str, share: Column) -> Column:
    exact = a["ts"] == F.col("ts")
    if name == "orientation":
        mixed = v.packed(q.slerp(b[name], a[name], share))
    else:
        mixed = lerp(b[name], a[name], share)
    return F.when(a.isNull(), b[name]).when(exact | b.isNull(), a[name]).otherwise(mixed)


def interpolate_quaternions(df: DataFrame, times: DataFrame, orientation: str = "orientation", by: Sequence[str] = ("topic",)) -> DataFrame:
    """Orientations at the times by slerp, the end ones repeated outside."""
    return interpolate_timeseries(df.withColumnRenamed(orientation, "orientation"), times, ["orientation"], by).withColumnRenamed("orientation", orientation)


def interpolate_trajectory(df: DataFrame, times: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """All states and covariances at the times, with pose and trajectory made anew."""
    fields = [f for f in (*STATES, *COVARIANCES, "navsat") if f in df.columns]
    out = interpolate_timeseries(df, times, fields, by)
    return with_pose(out) if {"position", "orientation", "linear_velocity", "angular_velocity"} <= set(fields) else out


def resample_trajectory(df: DataFrame, period: float | None = None, times: DataFrame | None = None, start=None, end=None, by: Sequence[str] = ("topic",)) -> DataFrame:
    """At a period, or at given times; one of both."""
    if (period is None) == (times is None):
        raise ValueError("give either a period or times")
    at = grid(df, period, start, end, by).select(*by, "ts", "seq") if times is None else times
    return interpolate_trajectory(df, at, by)


def resample_imu(imu: DataFrame, period=None, times=None, start=None, end=None, by: Sequence[str] = ("topic",), **more) -> DataFrame:
    return resample_trajectory(imu_to_trajectory(imu, **more), period, times, start, end, by)


def resample_odometry(odometry: DataFrame, period=None, times=None, start=None, end=None, by: Sequence[str] = ("topic",), **more) -> DataFrame:
    return resample_trajectory(odometry_to_trajectory(odometry, **more), period, times, start, end, by)


def resample_navsat(navsat: DataFrame, period=None, times=None, start=None, end=None, by: Sequence[str] = ("topic",), **more) -> DataFrame:
    """Resampled fixes; navsat is made from the resampled position."""
    t = navsat_to_trajectory(navsat, by=by, **more)
    reference = t.groupBy(*by).agg(F.first("reference").alias("reference"))
    a, b = resample_trajectory(t, period, times, start, end, by).drop("navsat").alias("a"), reference.alias("b")
    fix = geodesy.enu_to_navsat(F.col("a.position"), *v.unpack("b.reference", 3))
    return a.join(b, same("a", "b", list(by))).select("a.*", F.array(*fix).alias("navsat"), "b.reference")


def smooth_trajectory(df: DataFrame, window_size: int = 3, fields: Sequence[str] | None = None, smooth_orientation: bool = True, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Moving averages of the fields; orientations are brought to the sign of their neighbours, averaged and normalised.

    A quaternion and its negative are one orientation. The sign of each is made to agree
    with the row before along the whole trajectory, by the parity of the sign changes so
    far, which is a running sum.
    """
    from stratawave.operators.order import running_sum

    fields = [f for f in (fields or [s for s in STATES if s != "orientation"]) if f in df.columns and f != "orientation"]
    out = df
    for f in fields:
        out = smooth_timeseries(out, f, window_size, by).withColumn(f, F.col("smoothed")).drop("smoothed")
    if smooth_orientation and "orientation" in df.columns:
        near = with_neighbours(out, by, "seq", ["orientation"], ahead=False)
        flips = F.when(v.dot(v.unpack("orientation", 4), v.unpack("prev_orientation", 4)) < 0, 1).otherwise(0)
        signed = running_sum(near, by, "seq", {"flips": flips})
        sign = F.when(F.col("flips") % 2 == 1, -1.0).otherwise(1.0)
        turned = signed.withColumn("orientation", F.transform("orientation", lambda x: x * sign)).select(*out.columns)
        mean = smooth_timeseries(turned, "orientation", window_size, by)
        out = mean.withColumn("orientation", v.packed(q.normalize_quaternion("smoothed"))).drop("smoothed")
    return with_pose(out) if {"position", "orientation", "linear_velocity", "angular_velocity"} <= set(out.columns) else out


def frame_is_body(frame: str) -> bool:
    if frame.lower() not in ("body", "world"):
        raise ValueError("an angular velocity is in the body or the world frame")
    return frame.lower() == "body"


def angular_velocity_from_quaternions(df: DataFrame, orientation: str = "orientation", angular_velocity_frame: str = "body", by: Sequence[str] = ("topic",), increasing: bool = True) -> DataFrame:
    """Adds omega: inside, the mean of the rates of the steps before and behind a row; zero for a single row.

    Times that don't increase along seq are an error. With ``increasing`` false they are
    taken as they are: a step back in time turns the rate's sign, a step of no time has an
    infinite rate.
    """
    body = frame_is_body(angular_velocity_frame)
    near = with_neighbours(df, by, "seq", ["ts", orientation])
    return (near.withColumn("ts", strict(near)) if increasing else near).select(*df.columns, turn_rate(orientation, body).alias("omega"))


def turn_rate(orientation: str, body: bool) -> Column:
    """The mean of the rates of both steps, where :func:`with_neighbours` has added ts and orientation."""

    def rate(a, b, dt) -> Column:
        w = q.angular_velocity(a, b, dt)
        return v.packed(w if body else q.rotate_vectors_by_quaternion(w, a))

    here = F.col(orientation)
    back = rate(F.col(f"prev_{orientation}"), here, F.col("ts") - F.col("prev_ts"))
    ahead = rate(here, F.col(f"next_{orientation}"), F.col("next_ts") - F.col("ts"))
    zero = F.array_repeat(F.lit(0.0), 3)
    mean = F.zip_with(back, ahead, lambda x, y: (x + y) / 2)
    return F.when(F.col("prev_ts").isNull() & F.col("next_ts").isNull(), zero).when(F.col("prev_ts").isNull(), ahead).when(F.col("next_ts").isNull(), back).otherwise(mean)


def differentiate_trajectory(df: DataFrame, angular_velocity_frame: str = "body", by: Sequence[str] = ("topic",), increasing: bool = True) -> DataFrame:
    """Velocities from position and orientation, acceleration from velocity.

    Times that don't increase along seq are an error, or with ``increasing`` false taken as
    they are, as :func:`angular_velocity_from_quaternions` does; a step of no time then has
    infinite or undefined (NaN) derivatives.
    """
    body = frame_is_body(angular_velocity_frame)
    divide = F.try_divide if increasing else ieee_divide
    near = with_neighbours(df, by, "seq", ["ts", "orientation", "position"])
    if increasing:
        near = near.withColumn("ts", strict(near))
    rates = {"angular_velocity": turn_rate("orientation", body), "linear_velocity": F.when(F.size("position") > 0, neighbour_gradient("position", divide))}
    moved = cut(near.select(*(c for c in df.columns if c not in rates), *(x.alias(c) for c, x in rates.items())))
    near = with_neighbours(moved, by, "seq", ["ts", "linear_velocity"])
    acceleration = F.when(F.size("linear_velocity") > 0, neighbour_gradient("linear_velocity", divide))
    return with_pose(near.withColumn("linear_acceleration", acceleration).select(*dict.fromkeys([*df.columns, *rates, "linear_acceleration"])))


def hamilton(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of quaternions, unit length again."""
    ax, ay, az, aw = a.T
    bx, by, bz, bw = b.T
    out = np.column_stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz])
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def rotated(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of vectors turned by rows of unit quaternions."""
    t = 2 * np.cross(q[:, :3], x)
    return x + q[:, 3:] * t + np.cross(q[:, :3], t)


def prefix_products(steps: np.ndarray, starts: np.ndarray, body: bool) -> np.ndarray:
    """Products of the steps from the start of each row's group up to it, in log2(rows) passes over all rows."""
    out, reach = steps.copy(), np.arange(len(steps)) - starts
    k = 1
    while len(reach) and k <= reach.max():
        at = np.flatnonzero(reach >= k)
        out[at] = hamilton(out[at - k], out[at]) if body else hamilton(out[at], out[at - k])
        k *= 2
    return out


def vectors_of(column: pa.ChunkedArray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column as a matrix, and whether a row is null; absent elements are NaN."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    null = a.is_null().to_numpy(zero_copy_only=False)
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(a) and (sizes == n).all():
        return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(float), null
    rows = [([float("nan") if y is None else y for y in x[:n]] + [float("nan")] * n)[:n] for x in (x or [] for x in a.to_pylist())]
    return np.array(rows, float).reshape(-1, n), null


def listed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def reckoner(keys: list[str], at: str, side: str, rates: str | None, velocity: str | None, body: bool, turn: bool):
    """What a block adds by itself, from the state of the row before it: rotation, way, velocity and acceleration of each row.

    Rows of a partition are sorted by keys, block, side and seq. ``rates`` are integrated to
    rotations and ``velocity``, turned by them with ``turn``, to ways.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, [*keys, at]):
            new = changes(table.select([*keys, at]).to_pandas(), [*keys, at])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            n, ts = len(new), table["ts"].to_numpy().astype(float)
            last = np.append(new[1:], True)
            dt = np.where(new, 0.0, np.diff(ts, prepend=ts[:1]))
            if (dt[~new] <= 0).any():
                raise ValueError("timestamps must strictly increase")
            earlier, later = np.where(new, np.arange(n), np.arange(n) - 1), np.where(last, np.arange(n), np.arange(n) + 1)
            rotation = np.tile([0.0, 0.0, 0.0, 1.0], (n, 1))
            if rates is not None:
                w, null = vectors_of(table[rates])
                step = np.where((new | null | null[earlier] | np.isnan(dt))[:, None], 0.0, 0.5 * (w + w[earlier]) * dt[:, None])
                angle = np.sqrt(np.einsum("ij,ij->i", step, step))
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = np.where(angle > 1e-12, np.sin(angle / 2) / angle, 0.5)
                rotation = prefix_products(np.column_stack([step * share[:, None], np.cos(angle / 2)]), first, body)
            own = table[side].to_numpy() == 0
            out = table.filter(pa.array(own)).append_column("turned", listed(rotation[own]))
            if velocity is not None:
                x, null = vectors_of(table[velocity])
                x = rotated(rotation, x) if turn else x
                part = np.where((new | null | null[earlier] | np.isnan(dt))[:, None], 0.0, 0.5 * (x + x[earlier]) * dt[:, None])
                way = np.cumsum(part, axis=0)
                way -= way[first] - part[first]
                back, ahead = dt[:, None], dt[later][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    inner = (back * back * x[later] + (ahead * ahead - back * back) * x - ahead * ahead * x[earlier]) / (back * ahead * (back + ahead))
                    change = np.where(new[:, None], (x[later] - x) / ahead, np.where(last[:, None], (x - x[earlier]) / back, inner))
                out = out.append_column("way", listed(way[own])).append_column("swift", listed(x[own])).append_column("change", listed(change[own]))
                out = out.append_column("alone", pa.array((new & last)[own]))
            yield from out.drop_columns([side]).combine_chunks().to_batches()

    return run


#: Blocks whose states are broadcast to their rows; more are joined by shuffle.
STATES_BROADCAST = 100_000


def reckoned(df: DataFrame, rates: str | None, velocity: str | None, body: bool, turn: bool, by: list[str], block: int) -> DataFrame:
    """Rows with what their block adds by itself, and the state that it starts from: before (rotation) and base (way).

    Products of rotations cannot be reordered but can be grouped: blocks are multiplied on
    their own, the blocks before a block in a table of one row for each block. Rows move
    once, with the row before and the row behind their block, and are written once.
    """
    used = ["ts", *(c for c in (rates, velocity) if c)]
    rows, at, side = bordered(df, by, "seq", used, block)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = "".join(f"`{k}` {types[k]}, " for k in by)
    added = "turned array<double>" + (", way array<double>, swift array<double>, change array<double>, alone boolean" if velocity else "")
    schema = ", ".join(f"`{c}` {types[c]}" for c in df.columns) + f", `{at}` long, {added}"
    names = [*df.columns, at, side]
    inner = cut(rows.select(names).repartition(*by, at).sortWithinPartitions(*by, at, side, "seq").mapInArrow(reckoner(by, at, side, rates, velocity, body, turn), schema))
    total = inner.groupBy(*by, at).agg(F.max_by(F.struct("turned", *(["way"] if velocity else [])), "seq").alias("total")).select(*by, at, "total.*")
    total = total if velocity else total.withColumn("way", F.array_repeat(F.lit(0.0), 3))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, by):
            starts, before, base = changes(group, by) if by else np.arange(len(group)) == 0, [], []
            for start, turned, way in zip(starts, group["turned"], group["way"]):
                if start:
                    q, x = np.array([[0.0, 0.0, 0.0, 1.0]]), np.zeros((1, 3))
                before.append(q[0])
                base.append(x[0])
                x = x + (rotated(q, np.array([way])) if turn else np.array([way]))
                q = hamilton(q, np.array([turned])) if body else hamilton(np.array([turned]), q)
            yield group[[*by, at]].assign(before=before, base=base)

    line = total.repartition(*by) if by else total.coalesce(1)  # one row for each block of 65536 rows
    states = cut(line.sortWithinPartitions(*by, at).mapInPandas(across, f"{keys}`{at}` long, before array<double>, base array<double>"))
    r, s = inner.alias("r"), states.alias("s")
    joined = r.join(F.broadcast(s) if states.count() <= STATES_BROADCAST else s, same("r", "s", [*by, at]))
    return joined.select("r.*", "s.before", "s.base").drop(at)


def first_state(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Values of the first row of each key."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*(x.alias(n) for n, x in values.items())), "seq").alias("first_row")).select(*by, "first_row.*")


def integrate_orientations(df: DataFrame, angular_velocity: str = "angular_velocity", initial_orientation=(0.0, 0.0, 0.0, 1.0), angular_velocity_frame: str = "body", by: Sequence[str] = ("topic",), block: int = BLOCK) -> DataFrame:
    """Adds integrated: orientations from rates, each step by the mean of its two rates; a step with a null rate turns nothing.

    ``initial_orientation`` is four numbers or the name of a column whose first row counts.
    """
    body, by = frame_is_body(angular_velocity_frame), list(by)
    inner = reckoned(df, angular_velocity, None, body, False, by, block)
    given = F.col(initial_orientation) if isinstance(initial_orientation, str) else F.array(*(F.lit(float(x)) for x in initial_orientation))
    r, i = inner.alias("r"), first_state(df, by, initial=given).alias("i")
    whole = orientation_of(F.col("i.initial"), body)
    return r.join(i, same("r", "i", by)).select(*(F.col(f"r.`{c}`") for c in df.columns), whole.alias("integrated"))


def orientation_of(initial: Column, body: bool) -> Column:
    start = q.normalize_quaternion(initial)
    own = q.multiply("before", "turned") if body else q.multiply("turned", "before")
    return v.packed(q.normalize_quaternion(q.multiply(start, own) if body else q.multiply(own, start)))


def dead_reckon_trajectory(df: DataFrame, initial_position: Sequence[float] | None = None, initial_orientation=None, body_frame_velocity: bool = False, angular_velocity_frame: str = "body", by: Sequence[str] = ("topic",), block: int = BLOCK) -> DataFrame:
    """Orientation from rates, then position from velocities, turned to the world if they are the body's.

    The first row's position starts the way, or the origin where it is not finite. Rates of
    the body's frame are integrated together with the velocities, in one pass over the
    blocks; rates of the world's frame before them.
    """
    by, body = list(by), frame_is_body(angular_velocity_frame)
    initial = initial_orientation if initial_orientation is not None else "orientation"
    if not body:
        turned = integrate_orientations(df, "angular_velocity", initial, angular_velocity_frame, by, block).withColumn("orientation", F.col("integrated")).drop("integrated")
        df = cut(turned.withColumn("linear_velocity", v.packed(q.rotate_vectors_by_quaternion("linear_velocity", "orientation"))) if body_frame_velocity else turned)
        initial, rates, turn = "orientation", None, False
    else:
        rates, turn = "angular_velocity", body_frame_velocity
    inner = reckoned(df, rates, "linear_velocity", body, turn, by, block)
    given = F.col(initial) if isinstance(initial, str) else F.array(*(F.lit(float(x)) for x in initial))
    start = F.array(*(F.lit(float(x)) for x in initial_position)) if initial_position is not None else F.when(F.forall("position", lambda x: v.is_finite(x)), F.col("position")).otherwise(F.array_repeat(F.lit(0.0), 3))
    r, i = inner.alias("r"), first_state(df, by, initial=given, start=start).alias("i")
    joined = r.join(i, same("r", "i", by)).select("r.*", "i.initial", "i.start")
    # the state before a block turns what the block adds
    frame = v.packed(q.multiply(q.normalize_quaternion("initial"), "before"))
    whole = lambda c: v.packed(q.rotate_vectors_by_quaternion(c, "frame")) if turn else F.col(c)
    base = v.packed(q.rotate_vectors_by_quaternion("base", q.normalize_quaternion("initial"))) if turn else F.col("base")
    placed = joined.withColumn("frame", frame).select(
        *(c for c in df.columns if c not in ("position", "orientation", "linear_velocity", "linear_acceleration", "pose", "trajectory")),
        (orientation_of(F.col("initial"), True) if rates else F.col("orientation")).alias("orientation"), whole("swift").alias("linear_velocity"),
        F.zip_with("start", F.zip_with(base, whole("way"), lambda x, y: x + y), lambda x, y: x + y).alias("position"),
        F.when(F.col("alone"), F.array_repeat(F.lit(None).cast("double"), 3)).otherwise(whole("change")).alias("linear_acceleration"),
    )
    return with_pose(placed)


integrate_trajectory = dead_reckon_trajectory


def propagate_trajectory_covariance(df: DataFrame, process_noise: Mapping[str, float | Sequence[float]] | float | None = None, fill_missing: bool = True, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Covariances plus the time since the first row times the noise; missing ones count as 0 where there is noise."""
    by = list(by)
    first = df.groupBy(*by).agg(F.min_by("ts", "seq").alias("first_ts"))
    a, b = df.alias("a"), first.alias("b")
    out = a.join(b, same("a", "b", by)).select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("a.ts") - F.col("b.first_ts")).alias("elapsed"))
    for state, name in zip(STATES, COVARIANCES):
        if name not in df.columns:
            continue
        noise = process_noise.get(state, process_noise.get(name, 0.0)) if isinstance(process_noise, Mapping) else process_noise or 0.0
        noise = [float(noise)] * 3 if isinstance(noise, (int, float)) else [float(x) for x in noise]
        fill = fill_missing and any(noise)
        out = out.withColumn(name, F.array(*((F.when(v.is_finite(x), x).otherwise(0.0) if fill else x) + F.col("elapsed") * n for x, n in zip(v.unpack(name, 3), noise))))
    return out.drop("elapsed")


def trajectory_quality_mask(df: DataFrame, required_fields: Sequence[str] | str = ("position", "orientation"), covariance_limits: Mapping[str, float | Sequence[float]] | None = None, status_key: str = "status", valid_statuses=None) -> Column:
    """True for rows with finite required fields, covariances within limits and an allowed status; a missing field makes all false."""
    required = [required_fields] if isinstance(required_fields, str) else list(required_fields)
    out = F.lit(True)
    for f in required:
        if f not in df.columns:
            return F.lit(False)
        out = out & F.coalesce(F.forall(f, lambda x: v.is_finite(x)), F.lit(False))
        if f == "orientation":
            out = out & (v.norm(v.unpack(f, 4)) > 0)
    for f, limit in (covariance_limits or {}).items():
        name = f if f.endswith("_covariance") else f"{f}_covariance"
        if name not in df.columns:
            return F.lit(False)
        limits = [float(limit)] * 3 if isinstance(limit, (int, float)) else [float(x) for x in limit]
        for x, most in zip(v.unpack(name, 3), limits):
            out = out & v.is_finite(x) & (x <= most)
    if valid_statuses is not None:
        if status_key not in df.columns:
            return F.lit(False)
        allowed = list(valid_statuses) if isinstance(valid_statuses, (set, list, tuple)) else [valid_statuses]
        out = out & F.col(status_key).isin(*allowed)
    return F.coalesce(out, F.lit(False))


def add_trajectory_quality_mask(df: DataFrame, mask_key: str = "quality_mask", **more) -> DataFrame:
    return df.withColumn(mask_key, trajectory_quality_mask(df, **more))


def mask_trajectory(df: DataFrame, mask: Column, drop: bool = False, invalid_value: float = float("nan"), mask_key: str = "quality_mask") -> DataFrame:
    """Rows where the mask holds, or all rows with the array fields of the others set to ``invalid_value``; ts stays."""
    marked = df.withColumn(mask_key, F.coalesce(mask, F.lit(False)))
    if drop:
        return marked.filter(mask_key)
    arrays = [f.name for f in df.schema if f.dataType.simpleString() == "array<double>"]
    return marked.withColumns({a: F.when(F.col(mask_key), F.col(a)).otherwise(F.transform(a, lambda _: F.lit(float(invalid_value)))) for a in arrays})


def correct_imu_bias(imu: DataFrame, data: str = "data", angular_velocity_bias=None, linear_acceleration_bias=None, angular_velocity_expected=0.0, linear_acceleration_expected=0.0, first: int = 0, last: int | None = None, by: Sequence[str] = ("topic",)) -> DataFrame:
    """IMU rows less the biases of rates and acceleration, which come from the rows ``first`` <= seq < ``last`` unless given."""
    from stratawave.operators.summary import estimate_bias

    by = list(by)
    sample = imu.filter((F.col("seq") >= first) & (F.col("seq") < last)) if last is not None else imu.filter(F.col("seq") >= first)
    places = [*range(8, 11), *range(16, 19)]
    spread = lambda e: [float(e)] * 3 if isinstance(e, (int, float)) else [float(x) for x in e]
    found = estimate_bias(sample, [F.get(F.col(data), F.lit(i)) for i in places], [*spread(angular_velocity_expected), *spread(linear_acceleration_expected)], None, by)
    a, b = imu.alias("a"), found.alias("b")
    joined = a.join(b, same("a", "b", by), "left")
    given = [None] * 3 if angular_velocity_bias is None else spread(angular_velocity_bias)
    given += [None] * 3 if linear_acceleration_bias is None else spread(linear_acceleration_bias)
    biases = [F.lit(g) if g is not None else F.coalesce(F.col(f"b.bias_{i}"), F.raise_error(F.lit("no sample rows to estimate a bias from")).cast("double")) for i, g in enumerate(given)]
    d = F.col(f"a.`{data}`")
    corrected = F.array(*(F.get(d, F.lit(i)) - biases[places.index(i)] if i in places else F.get(d, F.lit(i)) for i in range(24)))
    return joined.select(*(corrected.alias(data) if c == data else F.col(f"a.`{c}`") for c in imu.columns), F.array(*biases).alias("bias"))


def to_tum_trajectory(df: DataFrame) -> DataFrame:
    """ts, x, y, z, qx, qy, qz, qw; orientations that are not finite or of norm 0 are identity."""
    o = v.unpack("orientation", 4)
    good = v.is_finite(*o)
    n = v.norm(o)
    unit = [F.when(good & (n > 0), x / n).otherwise(F.lit(1.0 if i == 3 else 0.0)) for i, x in enumerate(o)]
    return df.select(*(c for c in ("topic", "seq") if c in df.columns), "ts", *(x.alias(c) for x, c in zip(v.unpack("position", 3), "xyz")), *(x.alias(c) for x, c in zip(unit, ("qx", "qy", "qz", "qw"))))


def write_tum_trajectory(df: DataFrame, path: str) -> None:
    """Text rows with nine decimals, in the order of ts, as a folder of part files (sorted by range, so parts are in order as well)."""
    rows = to_tum_trajectory(df)
    line = F.format_string(" ".join(["%.9f"] * 8), "ts", "x", "y", "z", "qx", "qy", "qz", "qw")
    rows.orderBy("ts").select(line.alias("value")).write.mode("errorifexists").text(path)


def read_tum_trajectory(spark, path: str) -> DataFrame:
    """ts, position, orientation and pose of text rows with eight numbers; comments and empty rows are skipped, others are an error."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("p"))
    number = lambda i: F.when(F.size("p") == 8, F.get("p", F.lit(i)).cast("double")).otherwise(F.raise_error(F.lit("a row has 8 numbers")).cast("double"))
    return rows.select(number(0).alias("ts"), F.array(*map(number, range(1, 4))).alias("position"), F.array(*map(number, range(4, 8))).alias("orientation")).withColumn("pose", F.concat("position", "orientation"))


def write_kitti_trajectory(df: DataFrame, path: str) -> None:
    """Text rows of the 3x4 matrix of each pose, row by row, in the order of ts."""
    tum = to_tum_trajectory(df)
    r = q.quaternion_to_rotation_matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")])
    numbers = [x for row, c in zip(r, "xyz") for x in [*row, F.col(c)]]
    tum.orderBy("ts").select(F.format_string(" ".join(["%.9f"] * 12), *numbers).alias("value")).write.mode("errorifexists").text(path)
