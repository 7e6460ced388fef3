import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.operators import kernels, points, registration

SCHEMA = "cloud string, pid int, x double, y double, z double"


def cloud(spark, xyz, name="c"):
    return spark.createDataFrame([(name, i, *map(float, p)) for i, p in enumerate(xyz)], SCHEMA)


FIVE = [(0, 0, 0), (0.1, 0, 0), (5, 5, 5), (5.1, 5, 5), (20, 0, 0)]
LINE = [(float(i), 0, 0) for i in range(5)]


def labels(df):
    return [r.label for r in df.orderBy("pid").collect()]


def test_small_examples(spark):
    c = cloud(spark, FIVE)
    assert labels(points.cluster_dbscan(c, 0.5, 2)) == [0, 0, 1, 1, -1]
    assert labels(points.connected_components(c, 0.5, 2)) == [0, 0, 1, 1, -1] and labels(points.connected_components(c, 0.5)) == [0, 0, 1, 1, 2]
    assert points.voxel_downsample(c.filter("pid < 4"), 0.5).count() == 2
    far = points.farthest_point_downsample(cloud(spark, LINE), 3)
    assert [r.pid for r in far.orderBy("rank").collect()] == [0, 4, 2]
    d = {r.pid: list(r.distances) for r in points.nearest_neighbor_distances(cloud(spark, LINE), 2).collect()}
    assert d[0] == [1, 2] and d[2] == [1, 1]
    assert sorted(r.pid for r in points.uniform_downsample(c, 2, 1).collect()) == [1, 3]
    chosen = sorted(r.pid for r in points.random_downsample(c, count=3, seed=5).collect())
    assert chosen == sorted(np.random.default_rng(5).choice(5, 3, replace=False).tolist()) and points.random_downsample(c, ratio=0.5, seed=1).count() == 3


@pytest.mark.parametrize("seed", [0, 1])
def test_searches_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(0, 1, (120, 3)) ** 3, rng.normal(0, 3, (40, 3))
    p[5], p[6] = p[4], p[4]
    p[9, 0] = np.nan
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
    d = np.where(np.isnan(d), np.inf, d)
    a, b = cloud(spark, p), cloud(spark, q)
    order = np.lexsort((np.broadcast_to(np.arange(120), d.shape), d), axis=1)[:, :5]
    got = points.knn_search(a, b, 5).collect()
    assert sorted((r.qid, r["rank"], r.pid) for r in got) == sorted((i, k, int(j)) for i in range(40) for k, j in enumerate(order[i]))
    near = {r.qid: list(r.neighbors) for r in points.radius_search(a, b, 1.5).collect()}
    assert near == {i: np.flatnonzero(d[i] <= 1.5).tolist() for i in range(40)}
    at, dist = kernels.nearest(p, q)
    np.testing.assert_allclose(dist, d.min(axis=1))
    assert all(d[i, at[i]] == d[i].min() for i in range(40))
    at, _ = kernels.nearest(p, q, 1.0)
    assert [x >= 0 for x in at] == (d.min(axis=1) <= 1.0).tolist()
    same = points.radius_search(a, a.filter("pid = 4"), 0).first()
    assert list(same.neighbors) == [4, 5, 6]


def test_keys_fewer_points_and_empty(spark):
    two = cloud(spark, LINE[:2], "a").unionByName(cloud(spark, LINE, "b"))
    got = points.knn_search(two, two, 3, ["cloud"]).groupBy("cloud", "qid").count().collect()
    assert {(r.cloud, r["count"]) for r in got} == {("a", 2), ("b", 3)}
    none = two.limit(0)
    assert points.knn_search(none, none).count() == 0 and points.radius_search(none, none, 1.0).count() == 0 and points.cluster_dbscan(none, 1.0, 2).count() == 0 and points.voxel_downsample(none, 1.0).count() == 0
    assert points.statistical_outlier_filter(cloud(spark, LINE[:1])).count() == 1
    for bad in (lambda: points.knn_search(two, two, 0), lambda: points.radius_search(two, two, -1), lambda: points.cluster_dbscan(two, 0, 1), lambda: points.voxel_downsample(two, 0), lambda: points.random_downsample(two)):
        with pytest.raises(ValueError):
            bad()


def test_dbscan_against_a_scan(spark):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.normal(c, 0.35, (25, 3)) for c in ((0, 0, 0), (1.6, 0, 0), (5, 5, 5))] + [rng.uniform(-3, 8, (15, 3))])
    p = rng.permutation(p)
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= 0.5**2
    core, label, n = near.sum(axis=1) >= 5, np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += np.flatnonzero(near[j]).tolist() if core[j] else []
            n += 1
    assert labels(points.cluster_dbscan(cloud(spark, p), 0.5, 5)) == label.tolist()


def test_shape_and_filters(spark):
    rng = np.random.default_rng(5)
    flat = np.column_stack([rng.uniform(0, 1, (60, 2)), rng.normal(0, 0.001, 60)])
    c = cloud(spark, flat)
    n = points.estimate_normals(c, 8, (0.5, 0.5, -9)).collect()
    assert np.mean([r.normal[2] < -0.95 for r in n]) > 0.9
    s = points.curvature_descriptors(c, 8).agg(F.avg("planarity").alias("p"), F.avg("curvature").alias("c")).first()
    assert s.p > 0.3 and s.c < 0.05
    cov = {r.pid: np.reshape(r.covariance, (3, 3)) for r in points.local_covariances(c, 6).collect()}
    d = ((flat[0] - flat) ** 2).sum(axis=1)
    np.testing.assert_allclose(cov[0], np.cov(flat[np.argsort(d)[:6]].T), atol=1e-12)
    out = cloud(spark, np.vstack([flat, [[9, 9, 9]]]))
    assert points.statistical_outlier_filter(out, 5).filter("pid = 60").count() == 0 and points.radius_outlier_filter(out, 0.5, 1).filter("pid = 60").count() == 0
    assert points.valid_point_cloud_points(cloud(spark, [(0, 0, 0), (1, math.nan, 0), (1, 1, 1)])).count() == 1


def test_planes_and_ground(spark):
    rng = np.random.default_rng(6)
    ground = np.column_stack([rng.uniform(-5, 5, (200, 2)), rng.normal(0, 0.01, 200)])
    c = cloud(spark, np.vstack([ground, rng.uniform(1, 3, (60, 3))]))
    marked, plane = points.segment_ground(c, 0.05)
    assert marked.filter("is_ground").count() >= 195 and plane["plane"][2] > 0.99
    wall = c.select("cloud", "pid", F.col("z").alias("x"), "y", F.col("x").alias("z"))
    assert points.segment_ground(wall, 0.05)[0].filter("is_ground").count() == 0
    assert points.segment_plane(c.limit(2), 0.1)["plane"] is None


def turned(p, a=0.2, shift=(0.1, -0.05, 0.02)):
    m = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    return p @ m.T + np.array(shift), m


def test_registration(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(-1, 1, (150, 3))
    t, m = turned(p)
    a, b = cloud(spark, p), cloud(spark, t)
    for run in (registration.point_to_point_icp, registration.point_to_plane_icp):
        r = run(a, b, max_iterations=40).first()
        np.testing.assert_allclose(np.reshape(r.transform, (4, 4))[:3, :3], m, atol=1e-3)
        assert r.fitness == 1.0 and r.inlier_rmse < 1e-3 and r.correspondence_count == 150
    both = registration.multi_scale_icp(a.unionByName(cloud(spark, p, "d")), b.unionByName(cloud(spark, t, "d")), (0.5, 0.25), by=["cloud"]).collect()
    assert {r.cloud for r in both} == {"c", "d"} and all(r.fitness > 0.9 for r in both)
    seeded = registration.odometry_seeded_icp(a, b, source_pose=(0.1, -0.05, 0.02, 0, 0, math.sin(0.1), math.cos(0.1)), target_pose=(0, 0, 0, 0, 0, 0, 1)).first()
    assert seeded.inlier_rmse < 1e-6
    lonely = registration.point_to_point_icp(a, cloud(spark, p + 99), max_correspondence_distance=0.5).first()
    assert lonely.fitness == 0 and lonely.inlier_rmse is None and not lonely.converged


def test_loop_closures(spark):
    rng = np.random.default_rng(8)
    ring = [(math.cos(i / 10), math.sin(i / 10), 0.0) for i in range(75)]
    poses = spark.createDataFrame([("t", i, [*p], [*p, 0.0, 0.0, 0.0, 1.0]) for i, p in enumerate(ring)], "topic string, seq long, position array<double>, pose array<double>")
    got = {(r.source_index, r.target_index) for r in points.find_loop_closure_candidates(poses, 0.06, 30).collect()}
    want = set()
    for i in range(75):
        near = sorted((math.dist(ring[i], ring[j]), j) for j in range(0, i - 29) if math.dist(ring[i], ring[j]) <= 0.06)
        want |= {(i, near[0][1])} if near else set()
    assert got == want and got
    world = rng.uniform(-2, 2, (80, 3))
    clouds = spark.createDataFrame([("t", i, k, *map(float, w - np.array(ring[i]))) for i in (0, 63, 64) for k, w in enumerate(world)], "topic string, seq long, pid int, x double, y double, z double")
    ok = registration.verify_loop_closures(clouds, poses, radius=0.06, max_correspondence_distance=0.3).collect()
    assert {(r.source_index, r.target_index) for r in ok} <= got and all(r.accepted for r in ok)


def test_metric_scales(spark):
    rng = np.random.default_rng(9)
    p = rng.normal(0, 1, (50, 3))
    r = points.calibrate_point_cloud_metric_scale(cloud(spark, p), cloud(spark, p * 2.5 + [1, 2, 3])).first()
    assert r.scale == pytest.approx(2.5) and r.offset == pytest.approx([1, 2, 3]) and r.rmse == pytest.approx(0, abs=1e-6) and r.correspondence_count == 50
    near = points.calibrate_point_cloud_metric_scale(cloud(spark, p), cloud(spark, p[::-1] * 1.001), "nearest", False, 0.1).first()
    assert near.scale == pytest.approx(1.001)
    back = points.apply_point_cloud_metric_scale(cloud(spark, [(1, 1, 1)]), 2.0, [1, 2, 3]).first()
    assert (back.x, back.y, back.z) == (3, 4, 5)
    depth = spark.createDataFrame([(0, c, float(c + 1)) for c in range(5)], "row int, col int, z double")
    d = points.calibrate_depth_metric_scale(depth, depth.withColumn("z", F.col("z") * 3 + 0.5)).first()
    assert (d.scale, d.offset, d.correspondence_count) == (pytest.approx(3), pytest.approx(0.5), 5)
    got = points.calibrate_depth_anything_point_cloud(cloud(spark, [(1, 1, -2), (1, 1, 2), (1, 1, -9)]), 1.5, 0.0).collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1.5, 1.5, -3.0)]


def nearest(cloud_points, queries, k):
    d = np.linalg.norm(queries[:, None] - cloud_points[None], axis=2)
    order = np.lexsort((np.broadcast_to(np.arange(len(cloud_points)), d.shape), d), axis=1)[:, :k]
    return {(i, r): int(j) for i, row in enumerate(order) for r, j in enumerate(row)}


def test_neighbours_follow_local_density(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n, k = 1500, 4
    dense, wide = rng.normal(0, 1e-4, (n, 3)) + 0.5, rng.uniform(-1e5, 1e5, (n, 3))
    both = np.vstack([dense, wide])
    frame = lambda a, name: [(name, i, *map(float, x)) for i, x in enumerate(a)]
    df = spark.createDataFrame(frame(dense, "dense") + frame(wide, "wide") + frame(both, "both"), "topic string, pid long, x double, y double, z double")
    met, real = [], points.nearest_first
    monkeypatch.setattr(points, "nearest_first", lambda pairs, by, k: met.append(pairs.count()) or real(pairs, by, k))
    found = points.knn_search(df, df, k, by=["topic"])
    for name, cloud in (("dense", dense), ("wide", wide), ("both", both)):
        assert {(r.qid, r.rank): r.pid for r in found.filter(F.col("topic") == name).collect()} == nearest(cloud, cloud, k)
    assert sum(met) < 100 * k * 4 * n  # all pairs are 1.35e7


def test_neighbours_of_odd_clouds(spark):
    rng = np.random.default_rng(12)
    same = np.vstack([np.full((200, 3), 7.0), [[8, 7, 7]], rng.normal(0, 1, (50, 3))])
    line = np.column_stack([np.arange(300.0), np.zeros(300), np.zeros(300)])
    far = np.vstack([rng.uniform(-1e3, 1e3, (20, 3)), [[1e12, 0, 0], [0, -1e300, 0], [7, 7, 7]], same[-3:]])
    for cloud in (same, line, same[:1], same[:3]):
        df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(cloud)], "pid long, x double, y double, z double")
        asked = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(far)], df.schema)
        got = {(r.qid, r.rank): r.pid for r in points.knn_search(df, asked, 3).collect()}
        want = nearest(cloud, far, 3)
        told = {q for q, _ in want if not np.isinf(np.linalg.norm(far[q]))}
        assert {x: y for x, y in got.items() if x[0] in told} == {x: y for x, y in want.items() if x[0] in told} and len(got) == len(want)
    assert points.knn_search(df.limit(0), df, 2).count() == 0 and points.knn_search(df, df.limit(0), 2).count() == 0
