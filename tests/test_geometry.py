import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.functions import boxes, camera, geodesy, masks, sensors, transforms
from stratawave.functions import quaternion as q
from stratawave.functions import vectors as v
from stratawave.operators import trajectory as tr


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def lits(x):
    return [F.lit(float(e)) for e in x]


def matrix_of(x, y, z, w):
    n = math.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + 2 * w * k + 2 * k @ k


def test_quaternions(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        a, b, p = rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 3)
        m = q.quaternion_to_rotation_matrix(lits(a))
        r = one(spark, F.array(*(x for row in m for x in row)), v.packed(q.rotate_vectors_by_quaternion(lits(p), lits(a), True)), v.packed(q.multiply(lits(a), lits(b))), v.packed(q.rotation_matrix_to_quaternion(m)), v.packed(q.euler_to_quaternion(v.packed(q.quaternion_to_euler(lits(a))))), v.packed(q.slerp(lits(a), lits(b), 0.25)))
        np.testing.assert_allclose(np.reshape(r.c0, (3, 3)), matrix_of(*a), atol=1e-12)
        np.testing.assert_allclose(r.c1, matrix_of(*a).T @ p, atol=1e-12)
        np.testing.assert_allclose(matrix_of(*r.c2), matrix_of(*a) @ matrix_of(*b), atol=1e-12)
        np.testing.assert_allclose(matrix_of(*r.c3), matrix_of(*a), atol=1e-9)
        np.testing.assert_allclose(matrix_of(*r.c4), matrix_of(*a), atol=1e-9)
        np.testing.assert_allclose(matrix_of(*r.c5), transforms.slerp_matrix(transforms.as_matrix(matrix_of(*a)), transforms.as_matrix(matrix_of(*b)), 0.25)[:3, :3], atol=1e-9)
    half = one(spark, v.packed(q.slerp(lits((0, 0, 0, 1)), lits((0, 0, 1, 0)), 0.5))).c0
    assert abs(half[2]) == pytest.approx(math.sqrt(0.5))
    with pytest.raises(Exception, match="norm 0"):
        one(spark, v.packed(q.normalize_quaternion(lits((0, 0, 0, 0)))))
    assert one(spark, v.packed(q.compensate_gravity(lits((0, 0, 9.80665)), lits((0, 0, 0, 1))))).c0 == pytest.approx([0, 0, 0])
    w = one(spark, v.packed(q.angular_velocity(lits((0, 0, 0, 1)), lits((0, 0, math.sin(0.25), math.cos(0.25))), 2.0))).c0
    assert w == pytest.approx([0, 0, 0.25])


def test_transforms_and_frames(spark):
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = matrix_of(0, 0, 1, 1), (1, 2, 3)
    r = one(spark, transforms.apply_transform(F.array(*lits((1, 0, 0, 7))), t), transforms.transform_poses(F.array(*lits((1, 0, 0, 0, 0, 0, 1))), t), transforms.pose_to_matrix(F.array(*lits((1, 2, 3, 0, 0, 1, 1)))), transforms.transform_odometry(F.array(*lits(np.arange(1.0, 33))), t))
    assert r.c0 == pytest.approx([1, 3, 3, 7]) and r.c1[:3] == pytest.approx([1, 3, 3])
    np.testing.assert_allclose(matrix_of(*r.c1[3:]), t[:3, :3], atol=1e-12)
    np.testing.assert_allclose(np.reshape(r.c2, (4, 4)), t, atol=1e-12)
    odom = np.reshape(r.c3, (8, 4))
    np.testing.assert_allclose(odom[4, :3], t[:3, :3] @ [17, 18, 19], atol=1e-12)
    np.testing.assert_allclose(odom[1, :3], t[:3, :3] ** 2 @ [5, 6, 7], atol=1e-12)
    g = transforms.FrameGraph().add_transform("a", "b", t).add_transform("b", "c", [np.eye(4), t], [0.0, 2.0])
    np.testing.assert_allclose(g.lookup_transform("a", "c", 2.0), t @ t, atol=1e-12)
    np.testing.assert_allclose(g.lookup_transform("c", "a", 0.0), np.linalg.inv(t), atol=1e-12)
    assert g.lookup_transform("b", "c", 1.0)[:3, 3] == pytest.approx([0.5, 1, 1.5])
    for error, call in ((KeyError, lambda: g.lookup_transform("a", "z")), (ValueError, lambda: g.lookup_transform("b", "c", 3.0)), (ValueError, lambda: g.lookup_transform("b", "c")), (ValueError, lambda: g.add_transform("a", "a", t)), (ValueError, lambda: g.add_transform("a", "b", [t, t], [1.0, 1.0]))):
        with pytest.raises(error):
            call()


def test_geodesy_and_masks(spark):
    enu = geodesy.navsat_to_enu(*lits((37.001, -122.002, 15.0)), 37.0, -122.0, 10.0)
    r = one(spark, F.array(*enu), F.array(*geodesy.enu_to_navsat(enu, 37.0, -122.0, 10.0)), F.array(*geodesy.ned_to_enu(geodesy.enu_to_ned(enu))))
    assert r.c0 == pytest.approx([-0.002 * math.pi / 180 * 6378137 * math.cos(math.radians(37)), 0.001 * math.pi / 180 * 6378137, 5.0])
    assert r.c1 == pytest.approx([37.001, -122.002, 15.0]) and r.c2 == r.c0
    df = spark.createDataFrame([(1, [1.0, 179.0, 0.0]), (2, [1.0, -179.0, 0.0]), (3, [float("nan"), 179.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0])], "i int, p array<double>")
    ids = lambda d: sorted(x.i for x in d.collect())
    assert ids(masks.crop_geographic_bounds(df, "p", 0, 170, 2, -170)) == [1, 2]
    assert ids(masks.crop_bounds(df, "p", (0, -1), (2, 1))) == [5] and ids(masks.crop_bounds(df, "p", (0.5,), None)) == [1, 2, 5]
    assert ids(masks.crop_oriented_bounds(df, "p", (1, 0, 0), (1, 1, 1))) == [5]
    for bad in (lambda: geodesy.geographic_bounds_mask("p", 2, 0, 1, 1), lambda: geodesy.geographic_bounds_mask("p", 0, 2, 1, 1, wrap_longitude=False), lambda: masks.oriented_bounds_mask("p", (0, 0, 0), (-1, 1, 1))):
        with pytest.raises(ValueError):
            bad()


def test_cameras(spark):
    k = camera.camera_matrix(100, 120, 32, 24)
    d = (0.1, -0.05, 0.001, 0.002, 0.01, 0.02, 0.03, 0.04)
    back = camera.undistort_pixels(camera.distort_pixels(lits((40, 30)), k, d), k, d, 20)
    p = camera.backproject_pixels(lits((40, 30)), 2.0, k)
    seen = camera.project_points_to_image(F.array(*p), camera_matrix=k, image_shape=(48, 64))
    behind = camera.project_points_to_image(F.array(*lits((0, 0, -1))), camera_matrix=k)
    r = one(spark, F.array(*back), seen, behind, camera.project_camera_points(F.array(*lits((0.3, 0, 1))), camera.camera_model(100, 120, 32, 24, image_shape=(48, 60))))
    assert r.c0 == pytest.approx([40, 30], abs=1e-6) and (r.c1.u, r.c1.v, r.c1.depth, r.c1.valid) == pytest.approx((40, 30, 2, True))
    assert math.isnan(r.c2.u) and not r.c2.valid and not r.c3.valid
    np.testing.assert_allclose(camera.crop_camera_matrix(camera.scale_camera_matrix(k, 0.5), 2, 3), [[50, 0, 13], [0, 60, 10], [0, 0, 1]])
    for bad in (lambda: camera.camera_matrix(0, 1, 0, 0), lambda: camera.coefficients((1, 2, 3)), lambda: camera.camera_model(1, 1, 0, 0, image_shape=(0, 4)), lambda: camera.camera_model()):
        with pytest.raises(ValueError):
            bad()


def test_sensor_layouts(spark):
    v3 = lambda a: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(a, "xyz")))
    v4 = F.struct(*(F.lit(x).alias(n) for x, n in zip((0.0, 0.0, 0.0, 1.0), "xyzw")))
    nine, many = F.array(*lits(range(9))), F.array(*lits(range(36)))
    imu = F.struct(v4.alias("orientation"), nine.alias("orientation_covariance"), v3((1, 2, 3)).alias("angular_velocity"), nine.alias("angular_velocity_covariance"), v3((4, 5, 6)).alias("linear_acceleration"), nine.alias("linear_acceleration_covariance"))
    pose = F.struct(v3((1, 2, 3)).alias("position"), v4.alias("orientation"))
    odom = F.struct(F.struct(pose.alias("pose"), many.alias("covariance")).alias("pose"), F.struct(F.struct(v3((7, 8, 9)).alias("linear"), v3((1, 1, 1)).alias("angular")).alias("twist"), many.alias("covariance")).alias("twist"))
    r = one(spark, sensors.imu_array(imu), sensors.odometry_array(odom), sensors.pose_array(pose), sensors.pad_points(F.array(*lits((1, 2, 3))), 3, 2))
    assert np.reshape(r.c0, (6, 4)).tolist() == [[0, 0, 0, 1], [0, 4, 8, 0], [1, 2, 3, 0], [0, 4, 8, 0], [4, 5, 6, 0], [0, 4, 8, 0]]
    assert np.reshape(r.c1, (8, 4))[[0, 1, 3, 4, 7]].tolist() == [[1, 2, 3, 0], [0, 7, 14, 0], [21, 28, 35, 0], [7, 8, 9, 0], [21, 28, 35, 0]]
    assert r.c2 == [1, 2, 3, 0, 0, 0, 1] and r.c3 == [1, 2, 3, 0, 0, 0]
    values, shape = sensors.image_values(bytes(range(16)), "mono16", 2, 3, 8, True)
    assert shape == [2, 3] and values.tolist() == [1, 515, 1029, 2057, 2571, 3085]
    for bad in (lambda: sensors.image_values(b"123", "rgb8", 1, 1, 2), lambda: sensors.image_values(b"12", "rgb8", 1, 1)):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03"), "rgb8", 1, 1, None, False)], "d binary, e string, h int, w int, s int, b boolean")
    got = df.select(sensors.image_array(*(F.col(c) for c in df.columns)).alias("i")).first().i
    assert got.data == [1, 2, 3] and got.shape == [1, 1, 3] and got.dtype == "uint8"


def test_boxes(spark):
    b = lits((10, 20, 29, 49))
    r = one(spark, boxes.area(b), F.array(*boxes.to_sizes(b)), F.array(*boxes.transpose(b, 100, 100)), F.array(*boxes.clip(b, 25, 40)), F.array(*boxes.crop(b, (5, 5, 20, 30))), F.array(*boxes.to_corners(boxes.to_sizes(b), "xywh")))
    assert r.c0 == 600 and r.c1 == [10, 20, 20, 30] and r.c2 == [70, 20, 89, 49] and r.c3 == [10, 20, 24, 39] and r.c4 == [5, 15, 15, 25] and r.c5 == [10, 20, 29, 49]


TRAJ = "topic string, seq long, ts double, position array<double>, orientation array<double>, linear_velocity array<double>, angular_velocity array<double>"


def path(spark, ts, pos, ori=None, vel=None, omega=None, name="t"):
    n = len(ts)
    ori = [(0, 0, 0, 1)] * n if ori is None else ori
    rows = [(name, i, float(ts[i]), list(map(float, pos[i])), list(map(float, ori[i])), list(map(float, (vel if vel is not None else pos)[i])), list(map(float, (omega if omega is not None else np.zeros((n, 3)))[i]))) for i in range(n)]
    return spark.createDataFrame(rows, TRAJ)


def rows(df):
    return df.orderBy("topic", "seq").collect()


def yaw(a):
    return (0, 0, math.sin(a / 2), math.cos(a / 2))


def test_motion(spark):
    t = tr.differentiate_trajectory(path(spark, [0, 1, 2], [[0, 0, 0], [1, 0, 0], [4, 0, 0]], [yaw(0), yaw(0.5), yaw(1)]))
    got = rows(t)
    assert [r.linear_velocity[0] for r in got] == pytest.approx([1, 2, 3]) and [r.angular_velocity[2] for r in got] == pytest.approx([0.5] * 3)
    walk = tr.dead_reckon_trajectory(path(spark, [0, 1, 2], np.zeros((3, 3)), vel=[[1, 0, 0]] * 3))
    assert [r.position[0] for r in rows(walk)] == pytest.approx([0, 1, 2]) and len(rows(walk)[0].trajectory) == 13
    with pytest.raises(Exception, match="increase"):
        rows(tr.integrate_orientations(path(spark, [0, 1, 1], np.zeros((3, 3)))))


def test_rates_over_times_that_go_back(spark):
    poses = path(spark, [0, 2, 1, 1, 5], np.zeros((5, 3)), [yaw(0.5 * i) for i in range(5)])
    got = [r.omega[2] for r in rows(tr.angular_velocity_from_quaternions(poses, increasing=False))]
    assert got == pytest.approx([0.25, -0.125, math.inf, math.inf, 0.125])
    with pytest.raises(Exception, match="increase"):
        rows(tr.angular_velocity_from_quaternions(poses))


def test_derivatives_over_times_that_go_back(spark):
    x = np.array([0.0, 1, 4, 2, 5, 3])
    ts = np.array([0.0, 2, 5, 1, 3, 4])
    back = path(spark, ts, np.column_stack([x, -x, 0 * x]), [yaw(0.5 * i) for i in range(6)])
    got = rows(tr.differentiate_trajectory(back, increasing=False))
    speed = np.gradient(x, ts)
    assert [r.linear_velocity[0] for r in got] == pytest.approx(speed) and [r.linear_velocity[1] for r in got] == pytest.approx(-speed)
    assert [r.linear_acceleration[0] for r in got] == pytest.approx(np.gradient(speed, ts)) and got[2].angular_velocity[2] == pytest.approx((0.5 / 3 - 0.5 / 4) / 2)
    level = rows(tr.differentiate_trajectory(path(spark, [0, 1, 1], [[0] * 3, [1] * 3, [3] * 3]), increasing=False))
    assert [r.linear_velocity[0] for r in level] == [1, math.inf, math.inf]
    with pytest.raises(Exception, match="increase"):
        rows(tr.differentiate_trajectory(back))


def test_orientation_products_over_blocks(spark):
    rng = np.random.default_rng(3)
    n = 40
    ts, omega = np.cumsum(rng.uniform(0.05, 0.2, n)), rng.normal(0, 2, (n, 3))
    df = path(spark, ts, np.zeros((n, 3)), omega=omega).unionByName(path(spark, ts, np.zeros((n, 3)), omega=-omega, name="u"))
    for frame in ("body", "world"):
        now, want = np.eye(3), [np.eye(3)]
        for i in range(1, n):
            w = (omega[i - 1] + omega[i]) / 2 * (ts[i] - ts[i - 1])
            a = np.linalg.norm(w)
            turn = matrix_of(*(w / a * math.sin(a / 2)), math.cos(a / 2))
            now = now @ turn if frame == "body" else turn @ now
            want.append(now)
        for block in (7, 65536):
            got = [r for r in rows(tr.integrate_orientations(df, angular_velocity_frame=frame, block=block)) if r.topic == "t"]
            np.testing.assert_allclose([matrix_of(*r.integrated) for r in got], want, atol=1e-9)


@pytest.mark.parametrize("frame", ["body", "world"])
@pytest.mark.parametrize("turned", [True, False])
def test_reckoning_over_blocks(spark, frame, turned):
    rng = np.random.default_rng(5)
    n = 30
    ts, omega, vel = np.cumsum(rng.uniform(0.05, 0.2, n)), rng.normal(0, 2, (n, 3)), rng.normal(0, 1, (n, 3))
    df = path(spark, ts, np.full((n, 3), 2.0), [yaw(0.3)] * n, vel, omega).unionByName(path(spark, [4.0], [[7, 8, 9]], name="alone"))
    df = df.withColumn("extra", F.col("seq") * 2)
    now = matrix_of(*yaw(0.3))
    turns = [now]
    for i in range(1, n):
        w = (omega[i - 1] + omega[i]) / 2 * (ts[i] - ts[i - 1])
        a = np.linalg.norm(w)
        turn = matrix_of(*(w / a * math.sin(a / 2)), math.cos(a / 2))
        now = now @ turn if frame == "body" else turn @ now
        turns.append(now)
    world = np.array([m @ x for m, x in zip(turns, vel)]) if turned else vel
    way = 2.0 + np.vstack([np.zeros(3), np.cumsum((world[1:] + world[:-1]) / 2 * np.diff(ts)[:, None], axis=0)])
    for block in (4, 65536):
        got = rows(tr.dead_reckon_trajectory(df, body_frame_velocity=turned, angular_velocity_frame=frame, block=block))
        alone, got = got[0], got[1:]
        assert alone.position == [7, 8, 9] and alone.linear_acceleration == [None] * 3 and [r.extra for r in got] == list(range(0, 2 * n, 2))
        np.testing.assert_allclose([matrix_of(*r.orientation) for r in got], turns, atol=1e-9)
        np.testing.assert_allclose([r.position for r in got], way, atol=1e-9)
        np.testing.assert_allclose([r.linear_acceleration for r in got], np.gradient(world, ts, axis=0), atol=1e-8)
    assert tr.dead_reckon_trajectory(df.limit(0)).count() == 0


def test_interpolation_and_smoothing(spark):
    df = path(spark, [0, 1], [[0, 0, 10], [10, 20, 20]], [(0, 0, 0, 1), (0, 0, 1, 0)])
    times = spark.createDataFrame([("t", 0.5, 0), ("t", -1.0, 1), ("t", 9.0, 2)], "topic string, ts double, seq long")
    mid, low, high = rows(tr.interpolate_trajectory(df, times))
    assert mid.position == [5, 10, 15] and abs(mid.orientation[2]) == pytest.approx(math.sqrt(0.5)) and low.position == [0, 0, 10] and high.position == [10, 20, 20]
    assert len(rows(tr.resample_trajectory(df, period=0.25))) == 5
    flips = path(spark, range(4), np.zeros((4, 3)), [yaw(0.1), tuple(-x for x in yaw(0.1)), yaw(0.1), tuple(-x for x in yaw(0.1))])
    for r in rows(tr.smooth_trajectory(flips, 3)):
        np.testing.assert_allclose(matrix_of(*r.orientation), matrix_of(*yaw(0.1)), atol=1e-9)
    with pytest.raises(ValueError):
        tr.resample_trajectory(df)


def test_sensors_to_trajectories(spark):
    data = lambda n: [float(x) for x in np.r_[0, 0, 0, 1, np.arange(4, n)]]
    imu = spark.createDataFrame([("t", 0, 0.0, data(24)), ("t", 1, 1.0, data(24))], "topic string, seq long, ts double, data array<double>")
    r = rows(tr.imu_to_trajectory(imu))[0]
    assert r.angular_velocity == [8, 9, 10] and r.linear_acceleration == [16, 17, 18] and math.isnan(r.position[0]) and r.source == "imu"
    odom = spark.createDataFrame([("t", 0, 0.0, [float(x) for x in np.r_[np.arange(8), 0, 0, 0, 1, np.arange(12, 32)]])], imu.schema)
    r = rows(tr.sensor_to_trajectory(odom, "odometry"))[0]
    assert r.position == [0, 1, 2] and r.linear_velocity == [16, 17, 18] and r.angular_velocity_covariance == [28, 29, 30]
    nav = spark.createDataFrame([("t", i, float(i), [50 + i * 1e-5, 8.0, 100.0]) for i in range(3)] + [("t", 3, 2.0, [50.1, 8.0, 100.0])], imu.schema)
    got = rows(tr.navsat_to_trajectory(nav))
    assert got[1].position[1] == pytest.approx(1e-5 * math.pi / 180 * 6378137) and got[1].linear_velocity[1] == pytest.approx(got[1].position[1]) and math.isnan(got[2].linear_velocity[0])
    assert rows(tr.resample_navsat(nav.filter("seq < 3"), period=1.0))[1].navsat == pytest.approx([50.00001, 8.0, 100.0])
    fixed = rows(tr.correct_imu_bias(imu))[0]
    assert fixed.data[8:11] == [0, 0, 0] and fixed.data[16:19] == [0, 0, 0] and fixed.bias == [8, 9, 10, 16, 17, 18]
    assert rows(tr.correct_imu_bias(imu, angular_velocity_bias=1.0, linear_acceleration_bias=[1, 2, 3]))[0].data[16:19] == [15, 15, 15]


def test_quality_and_covariance(spark):
    df = path(spark, range(3), [[0, 0, 0], [math.nan, 0, 0], [1, 1, 1]]).withColumn("status", F.when(F.col("seq") == 2, -1).otherwise(0)).withColumn("position_covariance", F.array(*lits((1, 1, math.nan))))
    marked = tr.add_trajectory_quality_mask(df, valid_statuses=[0, 1])
    assert [r.quality_mask for r in rows(marked)] == [True, False, False]
    assert not any(r.quality_mask for r in rows(tr.add_trajectory_quality_mask(df, required_fields=["gone"])))
    assert not any(r.quality_mask for r in rows(tr.add_trajectory_quality_mask(df, covariance_limits={"position": 5})))
    masked = rows(tr.mask_trajectory(df, F.col("seq") != 2))
    assert math.isnan(masked[2].position[0]) and masked[2].ts == 2.0 and len(rows(tr.mask_trajectory(df, F.col("seq") != 2, drop=True))) == 2
    assert [r.position_covariance for r in rows(tr.propagate_trajectory_covariance(df, 2.0))][2] == [5, 5, 4]


def test_text_files(spark, tmp_path):
    df = path(spark, [0, 1], [[1, 2, 3], [4, 5, 6]], [(0, 0, 2, 0), (math.nan, 0, 0, 1)])
    tr.write_tum_trajectory(df, str(tmp_path / "tum"))
    back = tr.read_tum_trajectory(spark, str(tmp_path / "tum")).orderBy("ts").collect()
    assert back[0].pose == [1, 2, 3, 0, 0, 1, 0] and back[1].orientation == [0, 0, 0, 1]
    tr.write_kitti_trajectory(df, str(tmp_path / "kitti"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "kitti")).collect())
    assert [len(x.split()) for x in lines] == [12, 12] and float(lines[1].split()[3]) in (1.0, 4.0)
