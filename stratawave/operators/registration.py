"""Registration of pairs of clouds; pairs are spread over tasks, each cloud being one sensor message."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawave.functions.transforms import as_matrix
from stratawave.operators import kernels
from stratawave.operators.order import same
from stratawave.operators.points import XYZ, iter_loop_closure_candidates

FIELDS = "transform array<double>, fitness double, inlier_rmse double, correspondence_count long, iterations int, converged boolean"


def coordinates(frame: pd.DataFrame) -> np.ndarray:
    p = frame.sort_values("pid")[list(XYZ)].to_numpy(float) if len(frame) else np.zeros((0, 3))
    return p[np.isfinite(p).all(axis=1)]


def paired(source: DataFrame, target: DataFrame, by: Sequence[str], run) -> DataFrame:
    """run(source points, target points) -> result dict, for each key of ``by``."""
    by = list(by)
    if not by:
        source, target, by = source.withColumn("pair", F.lit(0)), target.withColumn("pair", F.lit(0)), ["pair"]
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", " + FIELDS
    source, target = (df.select(*(F.col(c).alias(c) for c in (*by, "pid", *XYZ))) for df in (source, target))  # columns of their own, also where both come from one table

    def each(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        r = run(coordinates(a), coordinates(b))
        rmse = r["inlier_rmse"] if np.isfinite(r["inlier_rmse"]) else None
        return pd.DataFrame([dict(zip(by, key)) | r | {"transform": list(np.ravel(r["transform"])), "inlier_rmse": rmse}])

    return source.groupBy(*by).cogroup(target.groupBy(*by)).applyInPandas(each, schema)


def point_to_point_icp(source: DataFrame, target: DataFrame, initial_transform=None, max_iterations: int = 20, max_correspondence_distance: float | None = None, relative_rmse_tolerance: float = 1e-6, relative_fitness_tolerance: float = 1e-6, min_correspondences: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(keys, transform of 16, fitness, inlier_rmse, correspondence_count, iterations, converged) for each pair of clouds."""
    start = None if initial_transform is None else as_matrix(initial_transform)
    return paired(source, target, by, lambda a, b: kernels.icp(a, b, start, "point_to_point", max_iterations, max_correspondence_distance, relative_rmse_tolerance, relative_fitness_tolerance, min_correspondences))


def point_to_plane_icp(source: DataFrame, target: DataFrame, initial_transform=None, max_iterations: int = 20, max_correspondence_distance: float | None = None, relative_rmse_tolerance: float = 1e-6, min_correspondences: int = 6, normal_k: int = 8, by: Sequence[str] = ()) -> DataFrame:
    start = None if initial_transform is None else as_matrix(initial_transform)
    return paired(source, target, by, lambda a, b: kernels.icp(a, b, start, "point_to_plane", max_iterations, max_correspondence_distance, relative_rmse_tolerance, least=min_correspondences, normal_k=normal_k))


def multi_scale_icp(source: DataFrame, target: DataFrame, voxel_sizes: Sequence[float] = (1.0, 0.5, 0.25), method: str = "point_to_point", initial_transform=None, max_iterations: int = 20, max_correspondence_distances: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Coarse to fine: each level registers voxel means, by default within twice the voxel; the metrics are those of the full clouds."""
    if not voxel_sizes or min(voxel_sizes) <= 0:
        raise ValueError("voxel sizes are above 0")
    limits = list(max_correspondence_distances) if max_correspondence_distances is not None else [2 * s for s in voxel_sizes]
    if len(limits) != len(voxel_sizes):
        raise ValueError("one distance for each voxel size is needed")
    start = None if initial_transform is None else as_matrix(initial_transform)

    def run(a: np.ndarray, b: np.ndarray) -> dict:
        at, steps, converged = start, 0, False
        for size, limit in zip(voxel_sizes, limits):
            level = kernels.icp(kernels.voxel_means(a, size), kernels.voxel_means(b, size), at, method, max_iterations, limit)
            at, steps, converged = level["transform"], steps + level["iterations"], level["converged"]
        return kernels.icp(a, b, at, method, 0, limits[-1]) | {"iterations": steps, "converged": converged}

    return paired(source, target, by, run)


def odometry_seeded_icp(source: DataFrame, target: DataFrame, odometry_transform=None, source_pose=None, target_pose=None, method: str = "point_to_point", by: Sequence[str] = (), **more) -> DataFrame:
    """ICP from a start given by odometry: a transform, or the poses (7) of both clouds in one frame."""
    if odometry_transform is None:
        if source_pose is None or target_pose is None:
            raise ValueError("a transform or both poses are needed")
        odometry_transform = np.linalg.inv(pose_matrix(target_pose)) @ pose_matrix(source_pose)
    run = {"point_to_point": point_to_point_icp, "point_to_plane": point_to_plane_icp}[method]
    return run(source, target, odometry_transform, by=by, **more)


def pose_matrix(pose: Sequence[float]) -> np.ndarray:
    p = np.asarray(pose, float)
    x, y, z, w = p[3:7] / np.linalg.norm(p[3:7])
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = p[:3]
    return out


def verify_loop_closures(clouds: DataFrame, poses: DataFrame, candidates: DataFrame | None = None, radius: float | None = None, min_separation: int = 30, max_candidates_per_pose: int = 1, method: str = "point_to_point", voxel_size: float | None = None, max_correspondence_distance: float | None = None, min_fitness: float = 0.3, max_inlier_rmse: float | None = None, return_all: bool = False) -> DataFrame:
    """Candidates (topic, source_index, target_index) registered from their poses, with accepted; only accepted ones unless ``return_all``.

    ``clouds`` has topic, seq, pid, x, y, z; ``poses`` topic, seq, pose (7) and position.
    Each candidate is one group of its two clouds.
    """
    if candidates is None:
        if radius is None:
            raise ValueError("candidates or a radius are needed")
        candidates = iter_loop_closure_candidates(poses, radius, min_separation, max_candidates_per_pose)
    c, p, t = candidates.alias("c"), poses.alias("p"), poses.alias("t")
    named = c.join(p, same("c", "p", ["topic"]) & (F.col("c.source_index") == F.col("p.seq"))).join(t, same("c", "t", ["topic"]) & (F.col("c.target_index") == F.col("t.seq")))
    named = named.select("c.topic", "c.source_index", "c.target_index", F.col("p.pose").alias("source_pose"), F.col("t.pose").alias("target_pose"))
    keys = ["topic", "source_index", "target_index"]
    n, k = named.alias("n"), clouds.alias("k")

    def side(index: str, poses_too: bool) -> DataFrame:
        joined = n.join(k, same("n", "k", ["topic"]) & (F.col(f"n.{index}") == F.col("k.seq")))
        extra = ["n.source_pose", "n.target_pose"] if poses_too else []
        return joined.select(*(F.col(f"n.{x}").alias(x) for x in keys), F.col("k.pid").alias("pid"), *(F.col(f"k.{x}").alias(x) for x in XYZ), *(F.col(x).alias(x[2:]) for x in extra))

    def each(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*keys, "transform", "fitness", "inlier_rmse", "correspondence_count", "iterations", "converged"])
        start = np.linalg.inv(pose_matrix(a["target_pose"].iloc[0])) @ pose_matrix(a["source_pose"].iloc[0])
        s, d = coordinates(a), coordinates(b)
        if voxel_size:
            s, d = kernels.voxel_means(s, voxel_size), kernels.voxel_means(d, voxel_size)
        r = kernels.icp(s, d, start, method, limit=max_correspondence_distance)
        rmse = r["inlier_rmse"] if np.isfinite(r["inlier_rmse"]) else None
        return pd.DataFrame([dict(zip(keys, key)) | r | {"transform": list(np.ravel(r["transform"])), "inlier_rmse": rmse}])

    schema = f"topic string, source_index long, target_index long, {FIELDS}"
    done = side("source_index", True).groupBy(*keys).cogroup(side("target_index", False).groupBy(*keys)).applyInPandas(each, schema)
    good = F.col("fitness") >= min_fitness
    if max_inlier_rmse is not None:
        good = good & (F.col("inlier_rmse") <= max_inlier_rmse)
    out = done.withColumn("accepted", F.coalesce(good, F.lit(False)))
    return out if return_all else out.filter("accepted")
