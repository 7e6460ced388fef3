import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.operators import image, kernels, raster

CELLS = "raster string, row int, col int, z double"


def cells(spark, grid, name="r"):
    return spark.createDataFrame([(name, r, c, float(z)) for r, row in enumerate(grid) for c, z in enumerate(row)], CELLS)


def grid(df, column="z", name=None):
    rows = [r for r in df.collect() if name is None or r.raster == name]
    out = np.full((max(r.row for r in rows) + 1, max(r.col for r in rows) + 1), math.nan)
    for r in rows:
        out[r.row, r.col] = math.nan if r[column] is None else r[column]
    return out


RAMP = [[0, 1, 2]] * 3


def test_slopes(spark):
    s = raster.slope_aspect(cells(spark, RAMP))
    np.testing.assert_allclose(grid(s, "slope"), math.atan(1))
    np.testing.assert_allclose(grid(s, "aspect"), -math.pi / 2)
    rng = np.random.default_rng(1)
    z = rng.normal(0, 5, (6, 7))
    g = raster.terrain_gradients(cells(spark, z), 2.0)
    dy, dx = np.gradient(z, 2.0)
    np.testing.assert_allclose(grid(g, "dz_dx"), dx)
    np.testing.assert_allclose(grid(g, "dz_dy"), dy)
    n = raster.terrain_normals(cells(spark, z), 2.0).filter("row = 2 AND col = 3").first().normal
    np.testing.assert_allclose(n, np.array([-dx[2, 3], -dy[2, 3], 1]) / math.sqrt(dx[2, 3] ** 2 + dy[2, 3] ** 2 + 1))
    assert (grid(raster.hillshade(cells(spark, z)), "shade") >= 0).all()


@pytest.mark.parametrize("w", [1, 2, 3, 4])
def test_windows_with_repeated_edges(spark, w):
    rng = np.random.default_rng(w)
    z = rng.normal(1000, 5, (5, 4))
    z[1, 2] = np.nan
    pad = np.pad(z, ((w // 2, w - 1 - w // 2),) * 2, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(pad, (w, w))
    m = raster.local_moments(cells(spark, z), w)
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(grid(m, "std"), np.nanstd(view, axis=(2, 3)), atol=1e-9)
        np.testing.assert_allclose(grid(m, "mean"), np.nanmean(view, axis=(2, 3)))
    t = raster.traversability_map(cells(spark, z), max_roughness=10.0, roughness_window=w)
    assert grid(t, "score")[1, 2] == 0


def test_sampling(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, (4, 5))
    q = spark.createDataFrame([("r", 0, 1.5, 2.25), ("r", 1, -3.0, 9.0), ("r", 2, 3.0, 4.0), ("r", 3, None, 1.0), ("x", 4, 1.0, 1.0)], "raster string, i int, at_row double, at_col double")
    got = {r.i: r.sample for r in raster.sample_grid(cells(spark, z), q).collect()}
    want = 0.5 * (0.75 * z[1, 2] + 0.25 * z[1, 3]) + 0.5 * (0.75 * z[2, 2] + 0.25 * z[2, 3])
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(z[0, 4]) and got[2] == pytest.approx(z[3, 4]) and math.isnan(got[3]) and math.isnan(got[4])
    near = {r.i: r.sample for r in raster.sample_grid(cells(spark, z), q, bilinear=False).collect()}
    assert near[0] == pytest.approx(z[2, 2])  # 1.5 rounds to even
    half = grid(raster.resample_raster(cells(spark, RAMP), (3, 5)))
    np.testing.assert_allclose(half, [[0, 0.5, 1, 1.5, 2]] * 3)
    moved = grid(raster.reproject_raster(cells(spark, RAMP), (0, 0, 2, 2), (3, 3), (1, 0, 3, 2), fill_value=-1))
    np.testing.assert_allclose(moved, [[1, 2, -1]] * 3)
    flipped = grid(raster.reproject_raster(cells(spark, RAMP), (0, 0, 2, 2), (3, 3), transform=[[-1, 0, 2], [0, 1, 0], [0, 0, 1]]))
    np.testing.assert_allclose(flipped, [[2, 1, 0]] * 3)
    at = spark.createDataFrame([("r", 1.0, 0.5)], "raster string, x double, y double")
    assert raster.sample_elevation(cells(spark, RAMP), at, resolution=0.5).first().sample == pytest.approx(2)


def test_patches_mosaics_meshes(spark):
    p = raster.terrain_patch(cells(spark, RAMP), (0.0, 0.0), 3, fill_value=-9)
    np.testing.assert_allclose(grid(p), [[-9, -9, -9], [-9, 0, 1], [-9, 0, 1]])
    assert (p.first().x0, p.first().y0) == (-1, -1)
    tiles = cells(spark, [[1, 1], [1, 1]], "N02W002").unionByName(cells(spark, [[2, 2], [2, 2]], "N02W001")).unionByName(cells(spark, [[3, 3], [3, 3]], "N01W002"))
    np.testing.assert_allclose(grid(raster.mosaic_dem_tiles(tiles, -1)), [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, -1, -1], [3, 3, -1, -1]])
    for bad in (cells(spark, RAMP, "N01W001").unionByName(cells(spark, [[1]], "N01W002")), cells(spark, [[1]], "N01W001").unionByName(cells(spark, [[1]], "N80E100")), cells(spark, RAMP).limit(0)):
        with pytest.raises(ValueError):
            raster.mosaic_dem_tiles(bad)
    hole = [[1, math.nan], [2, 3]]
    assert raster.dem_to_point_cloud(cells(spark, hole)).count() == 3
    vertices, faces = raster.dem_to_mesh(cells(spark, hole))
    assert vertices.count() == 0 and faces.count() == 0
    vertices, faces = raster.dem_to_mesh(cells(spark, [[1, 2, math.nan], [3, 4, 5]]))
    assert vertices.count() == 4 and sorted((f.a, f.b, f.c) for f in faces.collect()) == [(0, 1, 2), (1, 3, 2)]
    assert grid(raster.crop_raster(cells(spark, RAMP), 1, 9, 1, 2)).tolist() == [[1], [1]]


def test_cache(spark, tmp_path):
    raster.write_dem_cache(cells(spark, RAMP, "a").unionByName(cells(spark, RAMP, "b/c")), str(tmp_path / "dem"))
    back = raster.read_dem_cache(spark, str(tmp_path / "dem"), "b/c")
    np.testing.assert_allclose(grid(back), RAMP)


FRAME = "topic string, seq long, ts double, dtype string, shape array<int>, data array<double>"


def frames(spark, images, dtype="float64"):
    return spark.createDataFrame([("t", i, float(i), dtype, list(im.shape), [float(x) for x in im.ravel()]) for i, im in enumerate(images)], FRAME)


def arrays(df, column="data"):
    return [np.reshape(r[column], r["shape"]) for r in df.orderBy("seq").collect()]


def test_pointwise(spark):
    rng = np.random.default_rng(3)
    gray, rgb = rng.uniform(0, 10, (4, 5)), rng.uniform(0, 1, (3, 2, 3))
    g = frames(spark, [gray, gray * 2])
    np.testing.assert_allclose(arrays(image.normalize_image(g))[0], (gray - gray.min()) / (gray.max() - gray.min()), atol=1e-6)
    np.testing.assert_allclose(arrays(image.normalize_images(g))[0], (gray - gray.min()) / (2 * gray.max() - gray.min()), atol=1e-6)
    assert not np.any(arrays(image.normalize_image(frames(spark, [np.ones((2, 2))])))[0])
    c = frames(spark, [rgb])
    np.testing.assert_allclose(arrays(image.rgb_to_gray(c))[0], rgb @ [0.299, 0.587, 0.114])
    np.testing.assert_allclose(arrays(image.convert_color(c, "rgb_to_bgr"))[0], rgb[..., ::-1])
    np.testing.assert_allclose(arrays(image.convert_color(c, "bgr_to_gray"))[0], rgb[..., ::-1] @ [0.299, 0.587, 0.114])
    rgba = image.convert_color(c, "rgb_to_rgba")
    np.testing.assert_allclose(arrays(rgba)[0], np.dstack([rgb, np.ones((3, 2))]))
    np.testing.assert_allclose(arrays(image.convert_color(rgba, "rgba_to_rgb"))[0], rgb)
    np.testing.assert_allclose(arrays(image.convert_color(g, "gray_to_rgb"))[0], np.dstack([gray] * 3))
    with pytest.raises(Exception, match="channels"):
        image.rgb_to_gray(g).collect()
    bytes_ = arrays(image.convert_image_dtype(frames(spark, [np.array([[0.0, 0.5, 2.0]])]), "uint8", "float64"))[0]
    assert bytes_.tolist() == [[0, 128, 255]]
    assert arrays(image.convert_image_dtype(frames(spark, [np.array([[255.0]])], "uint8"), "uint16", "uint8"))[0].tolist() == [[65535]]
    masked = g.select(image.threshold_image(5.0).alias("t"), image.image_mask(2, 4).alias("m"), "data").first()
    assert masked.t == [float(x >= 5) for x in gray.ravel()] and masked.m == [bool(2 <= x <= 4) for x in gray.ravel()]


def test_neighbourhoods_and_sizes(spark):
    rng = np.random.default_rng(4)
    im = rng.normal(0, 1, (7, 6))
    f = frames(spark, [im])
    near = np.lib.stride_tricks.sliding_window_view(np.pad(im, 1, mode="edge"), (3, 3))
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8
    out = image.image_gradients(f).first()
    np.testing.assert_allclose(np.reshape(out.dx, im.shape), (near * k).sum(axis=(2, 3)), atol=1e-12)
    np.testing.assert_allclose(np.reshape(out.dy, im.shape), (near * k.T).sum(axis=(2, 3)), atol=1e-12)
    np.testing.assert_allclose(arrays(image.local_std(f), "std")[0], near.std(axis=(2, 3)), atol=1e-12)
    mask = (im > 0).astype(float)
    zeros = np.lib.stride_tricks.sliding_window_view(np.pad(mask, 1), (3, 3))
    m = frames(spark, [mask])
    assert (arrays(image.dilate_mask(m))[0] == zeros.max(axis=(2, 3))).all() and (arrays(image.erode_mask(m))[0] == zeros.min(axis=(2, 3))).all()
    opened = arrays(image.open_mask(m))[0]
    assert (opened <= mask).all() and arrays(image.close_mask(m))[0].shape == mask.shape
    assert arrays(image.resize_nearest(f, (3, 3)))[0].tolist() == im[[0, 3, 6]][:, [0, 2, 5]].tolist()
    assert arrays(image.pad_image(f, ((1, 0), (0, 2)), 9))[0].shape == (8, 8) and arrays(image.crop_image(f, 1, 3, 2, 9))[0].tolist() == im[1:3, 2:9].tolist()
    levels = {r.level: list(r.shape) for r in image.image_pyramid(f, 3).collect()}
    assert levels == {0: [7, 6], 1: [4, 3], 2: [2, 2]}


def test_motion(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (32, 32))
    stack = [np.roll(base, (i, -2 * i), (0, 1)) for i in range(4)]
    assert kernels.image_shift(stack[0], stack[1]) == (1, -2) and kernels.image_shift(stack[0], stack[3], 6) == (3, -6)
    f = frames(spark, stack)
    flows = image.frame_to_frame_optical_flow(f).orderBy("seq").collect()
    assert len(flows) == 3 and flows[0].flow[:2] == [1, -2]
    for incremental in (True, False):
        aligned = image.align_images(f, incremental=incremental).orderBy("seq").collect()
        assert [list(r["shift"]) for r in aligned] == [[0, 0], [1, -2], [2, -4], [3, -6]]
        np.testing.assert_allclose(np.reshape(aligned[3].data, (32, 32))[:29, 6:][:-3, :-6], base[:29, 6:][:-3, :-6])
    w = image.motion_compensated_rolling_windows(f, 3, min_periods=2).orderBy("seq").collect()
    assert [len(r.frames) for r in w] == [2, 3, 3] and [list(s) for s in w[1].shifts] == [[-2, 4], [-1, 2], [0, 0]]
    assert kernels.translate(np.arange(4.0).reshape(2, 2), (1, 0), 9).tolist() == [[9, 9], [0, 1]]
    filtered = image.fft_filter(f).first()
    assert len(filtered.data) == 1024


def test_depth(spark):
    depth = np.full((4, 5), 2.0)
    depth[0, 0] = np.nan
    f = frames(spark, [depth])
    p = image.depth_to_points(f, 10.0, 10.0, 2.0, 1.5)
    assert p.count() == 19
    r = p.filter("row = 2 AND col = 4").first()
    assert (r.x, r.y, r.z) == pytest.approx((0.4, 0.1, 2.0))
    n = image.depth_to_normals(f, 10.0, 10.0, 2.0, 1.5).filter("row = 2 AND col = 2").first()
    assert (n.nx, n.ny, n.nz) == pytest.approx((0, 0, -1))
    assert math.isnan(image.depth_to_normals(f, 10.0, 10.0, 2.0, 1.5).filter("row = 0").first().nx)
    back = image.points_to_depth_image(p.withColumn("pid", F.col("row") * 5 + F.col("col")), (4, 5), 10.0, 10.0, 2.0, 1.5)
    got = {(r.row, r.col): (r.z, r.pid) for r in back.collect()}
    assert got[0, 0] == (0.0, -1) and got[3, 4] == (2.0, 19)
    moved = spark.createDataFrame([("t", 0, [float(x) for x in (1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])], "topic string, seq long, transform array<double>")
    fused = image.fuse_rgbd_frames(f, frames(spark, [np.arange(20.0).reshape(4, 5)]), 10.0, 10.0, 2.0, 1.5, transforms=moved).filter("row = 2 AND col = 4").first()
    assert fused.x == pytest.approx(5.4) and fused.attrs == [14.0]


def test_sampling_images(spark):
    im = cells(spark, np.arange(12.0).reshape(3, 4), "i")
    q = spark.createDataFrame([("i", 1.5, 1.0), ("i", 4.0, 1.0), ("i", math.nan, 0.0)], "raster string, u double, v double")
    got = image.sample_image_at_pixels(im, q, fill_value=-1.0).collect()
    assert [(r["sample"], r.inside) for r in sorted(got, key=lambda r: (math.isnan(r.u), r.u))] == [(5.5, True), (-1.0, False), (-1.0, False)]
    same = image.rectify_image(im, (3, 4), [[10, 0, 1.5], [0, 10, 1], [0, 0, 1]])
    np.testing.assert_allclose(grid(same), np.arange(12.0).reshape(3, 4), atol=1e-9)
    pts = spark.createDataFrame([("i", 0, 0.0, 0.0, 1.0)], "raster string, pid int, x double, y double, z double")
    assert image.colorize_points(pts, im, fx=10.0, fy=10.0, cx=2.0, cy=1.0).first().color == 6.0
    assert image.project_dem_to_image(cells(spark, [[1.0]]), 10.0, 10.0, 2.0, 1.0).first().valid
