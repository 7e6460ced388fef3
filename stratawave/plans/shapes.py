"""Queries over the further operators on geometry, cameras, clouds, rasters and images."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from stratawave.functions import boxes, camera, masks, transforms
from stratawave.functions import vectors as v
from stratawave.operators import beacons, image, ml, points, raster, registration
from stratawave.operators import order as o
from stratawave.plans.families import named, union
from stratawave.plans.sensor import DEM, E4, IMG, KNN, ROTATION, UNIT, WINDOWED, S, cloud, dem, pictures, plane, query, r6, vecs
from stratawave.session import cut, removed, shared_dir

e = lambda c, i: F.get(c, F.lit(i))

# ---- transforms and cameras

MIDDLE = math.radians(15)


@query(f"""WITH {UNIT} SELECT vec_id, round(-b, 6) AS vx, round(a, 6) AS vy, round({math.cos(MIDDLE)} * a - {math.sin(MIDDLE)} * b + 1, 6) AS tx, round({math.sin(MIDDLE)} * a + {math.cos(MIDDLE)} * b, 6) AS ty,
  round(a * {math.cos(MIDDLE)} + b * {math.sin(MIDDLE)}, 6) AS bx, round(x * {S} - y * {S}, 6) AS qx FROM q""")
def frame_vectors(spark, sf_dir):
    """Vectors turned by a frame graph, with an edge that changes over time, looked up between its ends and against its direction."""
    turn = lambda a, x: [[math.cos(a), -math.sin(a), 0, x], [math.sin(a), math.cos(a), 0, 0], [0, 0, 1, 0]]
    g = transforms.FrameGraph().add_transform("lidar", "base", ROTATION).add_transform("base", "map", [turn(0, 0), turn(math.radians(30), 2), turn(0, 9)], timestamps=[0.0, 10.0, 20.0])
    abc = F.slice("e", 5, 3)
    still = g.transform_vectors(abc, "lidar", "base")
    moved = g.transform_points(abc, "base", "map", 5.0)
    back = g.transform_vectors(abc, "map", "base", 5.0)
    poses = g.transform_poses(F.concat(abc, F.slice("e", 1, 4)), "lidar", "base")
    return vecs(spark, sf_dir).select("vec_id", r6(e(still, 0)).alias("vx"), r6(e(still, 1)).alias("vy"), r6(e(moved, 0)).alias("tx"), r6(e(moved, 1)).alias("ty"), r6(e(back, 0)).alias("bx"), r6(e(poses, 3)).alias("qx"))


@query(f"""WITH d AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings), n AS (SELECT *, sqrt(d[9] * d[9] + d[10] * d[10] + d[11] * d[11] + d[12] * d[12]) AS n FROM d)
SELECT vec_id, round(0.5 - d[2], 6) AS px, round(d[1] - 0.25, 6) AS py, round(d[6], 6) AS cx, round(-d[18], 6) AS vx, round({S} * (d[9] - d[10]) / n, 6) AS qx, round(d[30], 6) AS wx FROM n""")
def transform_odometry(spark, sf_dir):
    t = transforms.transform_odometry(F.slice("e", 1, 32), ROTATION)
    return vecs(spark, sf_dir).select("vec_id", t.alias("t")).select("vec_id", *(r6(e("t", i)).alias(n) for i, n in ((0, "px"), (1, "py"), (4, "cx"), (16, "vx"), (8, "qx"), (28, "wx"))))


@query(f"""WITH {E4}, p AS (SELECT vec_id, x, y, x * x + y * y AS r2, z + 1 AS d FROM emb), k AS (SELECT *, 1 + 0.1 * r2 - 0.05 * r2 * r2 AS k FROM p)
SELECT vec_id, round(50 * (x * k + 0.002 * x * y + 0.002 * (r2 + 2 * x * x)) + 6, 5) AS u, round(60 * (y * k + 0.001 * (r2 + 2 * y * y) + 0.004 * x * y) + 4, 5) AS v, round(x, 5) AS x, round(y, 5) AS y FROM k""")
def camera_pixels(spark, sf_dir):
    """Pixels of a scaled and cropped camera, distorted and brought back."""
    m = camera.crop_camera_matrix(camera.scale_camera_matrix(camera.camera_matrix(100.0, 120.0, 32.0, 24.0), 0.5), 8.0, 10.0)
    model = camera.camera_model(intrinsics=m, distortion=(0.1, -0.05, 0.001, 0.002), image_shape=(48, 64))
    straight = camera.normalized_points_to_pixels(v.unpack("e", 2), model.intrinsics)
    bent = camera.distort_pixels(straight, model.intrinsics, model.distortion)
    back = camera.pixels_to_normalized_points(camera.undistort_pixels(bent, model.intrinsics, model.distortion, 25), model.intrinsics)
    return vecs(spark, sf_dir).select("vec_id", r6(bent[0], 5).alias("u"), r6(bent[1], 5).alias("v"), r6(back[0], 5).alias("x"), r6(back[1], 5).alias("y"))


#: Sampling the raster as an image: columns along u, rows along v.
SPOTS = f"{DEM}, q AS (SELECT vec_id, (x + 0.2) * 80 AS u, (y + 0.2) * 60 AS v FROM emb), k AS (SELECT *, CAST(floor(v) AS INT) AS r0, CAST(floor(u) AS INT) AS c0, u >= 0 AND u <= cc AND v >= 0 AND v <= rr AS inside FROM q, h), m AS (SELECT *, least(r0 + 1, rr) AS r1, least(c0 + 1, cc) AS c1, v - r0 AS fr, u - c0 AS fc FROM k WHERE inside)"
BLEND = "(1 - fr) * ((1 - fc) * a.z + fc * b.z) + fr * ((1 - fc) * c2.z + fc * d.z)"
CORNERS = "JOIN dem a ON a.row = r0 AND a.col = c0 JOIN dem b ON b.row = r0 AND b.col = c1 JOIN dem c2 ON c2.row = r1 AND c2.col = c0 JOIN dem d ON d.row = r1 AND d.col = c1"


@query(f"WITH {E4}, {SPOTS}, s AS (SELECT vec_id, round({BLEND}, 4) AS z FROM m {CORNERS}) SELECT w.way, k.vec_id, coalesce(s.z, -1.0) AS z FROM k LEFT JOIN s USING (vec_id), (SELECT unnest(['pixels', 'points', 'colors']) AS way) w")
def sampled_image(spark, sf_dir):
    """An image sampled at pixels, at projected points, and as colours of points."""
    cells = dem(spark, sf_dir)
    p = vecs(spark, sf_dir).select(F.lit("part").alias("raster"), "vec_id", ((e("e", 0) + 0.2) * 80).alias("x"), ((e("e", 1) + 0.2) * 60).alias("y"), F.lit(2.0).alias("z"))
    at = image.sample_image_at_pixels(cells, p.drop("z"), "x", "y", fill_value=-1.0)
    k = {"fx": 2.0, "fy": 2.0, "cx": 0.0, "cy": 0.0}
    seen = image.sample_image_at_points(cells, p, **k, fill_value=-1.0)
    colored = image.colorize_points(p, cells, **k, fill_value=-1.0)
    return union([named("pixels", at, "vec_id", r6("sample", 4).alias("z")), named("points", seen, "vec_id", r6("sample", 4).alias("z")), named("colors", colored, "vec_id", r6("color", 4).alias("z"))])


@query(f"""WITH {DEM}, g AS (SELECT CAST(i // 40 AS INT) AS row, CAST(i % 40 AS INT) AS col, (i % 40 - 5) * 1.25 + 3 AS u, (i // 40 - 2) * 1.25 + 2 AS v FROM range(rows_of) t(i)),
k AS (SELECT g.*, CAST(floor(v) AS INT) AS r0, CAST(floor(u) AS INT) AS c0, rr, cc FROM g, h), m AS (SELECT *, least(r0 + 1, rr) AS r1, least(c0 + 1, cc) AS c1, v - r0 AS fr, u - c0 AS fc FROM k WHERE u >= 0 AND u <= cc AND v >= 0 AND v <= rr)
SELECT g.row, g.col, coalesce(round(x.z, 4), 0.0) AS z FROM g LEFT JOIN (SELECT m.row, m.col, {BLEND} AS z FROM m {CORNERS}) x USING (row, col)""".replace("rows_of", "1200"))
def rectified_raster(spark, sf_dir):
    r = image.rectify_image(dem(spark, sf_dir), (30, 40), [[50, 0, 3], [0, 50, 2], [0, 0, 1]], new_camera_matrix=[[40, 0, 5], [0, 40, 2], [0, 0, 1]])
    return r.select("row", "col", r6("z", 4).alias("z"))


@query("""WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 + 20 AS x0, CAST(embedding[2] AS DOUBLE) * 10 + 20 AS y0, CAST(embedding[3] AS DOUBLE) * 10 + 50 AS x1, CAST(embedding[4] AS DOUBLE) * 10 + 50 AS y1 FROM embeddings)
SELECT vec_id, round(x1 - x0 + 1, 4) AS width, round(least(x1, 39), 4) AS clipped, round(greatest(x0 - 10, 0), 4) AS cropped, round(x0, 4) AS back FROM b""")
def box_conversions(spark, sf_dir):
    b = [e("e", i) * 10 + (20 if i < 2 else 50) for i in range(4)]
    sizes = boxes.to_sizes(b)
    return vecs(spark, sf_dir).select("vec_id", r6(sizes[2], 4).alias("width"), r6(boxes.clip(b, 40, 100)[2], 4).alias("clipped"), r6(boxes.crop(b, (10, 10, 90, 90))[0], 4).alias("cropped"), r6(boxes.to_corners(sizes, "xywh")[0], 4).alias("back"))


@query(f"WITH {E4} SELECT vec_id FROM emb WHERE x > 0 AND y < 0.05")
def selected_mask(spark, sf_dir):
    return masks.select_mask(vecs(spark, sf_dir), (e("e", 0) > 0) & (e("e", 1) < 0.05)).select("vec_id")


@query("""WITH b AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 200 AS x0, CAST(embedding[2] AS DOUBLE) * 200 AS y0, CAST(embedding[3] AS DOUBLE) * 200 + 20 AS x1, CAST(embedding[4] AS DOUBLE) * 200 + 20 AS y1 FROM embeddings),
c AS (SELECT vec_id, label, greatest(0, least(39, x0)) AS x0, greatest(0, least(29, y0)) AS y0, greatest(0, least(39, x1)) AS x1, greatest(0, least(29, y1)) AS y1 FROM b) SELECT vec_id, label, round(x0, 5) AS x0, round(y1, 5) AS y1 FROM c WHERE x1 > x0 AND y1 > y0""")
def clipped_boxes(spark, sf_dir):
    b = vecs(spark, sf_dir).select("vec_id", "label", F.array(*(e("e", i) * 200 + (0 if i < 2 else 20) for i in range(4))).alias("box"))
    return boxes.clip_boxes(b, "box", 40, 30).select("vec_id", "label", r6(e("box", 0), 5).alias("x0"), r6(e("box", 3), 5).alias("y1"))


BELL = f"(exp(-((r - top - 15) * (r - top - 15) + (c - lft - 15) * (c - lft - 15)) / (2 * {beacons.VARIANCE})) - exp(-450 / (2 * {beacons.VARIANCE}))) * (200 - {beacons.DARK}) + {beacons.DARK}"
PLACES = "(VALUES " + ", ".join(f"({r}, {c}, {blink}, {period})" for r, c, blink, period in beacons.BEACONS) + ") AS b(br, bc, blink, period)"
CELLS = "cells AS (SELECT i // 40 AS row, i % 40 AS col, (i // 40) * 16 + 7 + j // 2 AS r, (i % 40) * 16 + 7 + j % 2 AS c FROM range(1280) t(i), range(4) u(j))"


def beacon_sql(frames: str, on: str, top: str, left: str) -> str:
    return f"""WITH {CELLS}, f AS ({frames}), lit AS (SELECT f.seq, {top} AS top, {left} AS lft FROM f, {PLACES} WHERE {on}),
px AS (SELECT f.seq, cells.row, cells.col, coalesce((SELECT max({BELL}) FROM lit WHERE lit.seq = f.seq AND r >= top AND r < top + 30 AND c >= lft AND c < lft + 30), {beacons.DARK}) AS z FROM f, cells)
SELECT seq, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(avg(z), 6) AS z FROM px GROUP BY ALL"""


@query(beacon_sql("SELECT CAST(i AS BIGINT) AS seq FROM range(20) t(i)", "blink = 0 OR floor(f.seq / (blink / 2 * 10)) % 2 = 1", "br * 100 + 241", "bc * 100 + 105 + f.seq * 16"))
def moving_beacons(spark, sf_dir):
    return plane(beacons.create_synth_image_moving(spark, 2.0, noise=0.0))


@query(beacon_sql("SELECT CAST(i AS BIGINT) AS seq FROM range(12) t(i)", "round_even(f.seq % period, 0) = 0", "br * 100 + 241 + f.seq", "bc * 100 + 305"))
def still_beacons(spark, sf_dir):
    poses = spark.range(12).select(F.col("id").alias("seq"), (F.col("id") / 10.0).alias("ts"), (F.col("id") / 10.0 + 0.01).alias("x"))
    return plane(beacons.create_synth_image(poses, noise=0.0))


@query("SELECT vec_id AS seq, 2 AS areas, CAST(4 + vec_id % 3 AS INT) AS first_row FROM embeddings")
def bright_areas(spark, sf_dir):
    """The brightest pixels of two bright areas in each frame."""
    at = lambda i: (F.floor(i / 16), i % 16)

    def value(i):
        r, c = at(i)
        top = 4 + F.col("vec_id") % 3
        return F.when((r >= top) & (r < top + 2) & (c >= 3) & (c < 6), 200.0 - (r - top) - (c - 3)).when((r == 11) & (c >= 9) & (c < 14), 90.0 + c).otherwise(3.0)

    f = vecs(spark, sf_dir).select(F.lit("ir").alias("topic"), F.col("vec_id").alias("seq"), F.array(F.lit(14), F.lit(16)).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(14 * 16 - 1)), value).alias("data"), "vec_id")
    found = beacons.binarization(f, 50.0)
    return found.groupBy("seq").agg(F.count(F.lit(1)).cast("int").alias("areas"), F.min("row").alias("first_row"))


@query(f"WITH {DEM}, p AS (SELECT vec_id AS pid FROM embeddings) SELECT CAST(CASE WHEN col >= 25 THEN row ELSE row END AS INT) AS row, CAST(49 - col AS INT) AS col, z FROM dem")
def merged_tiles(spark, sf_dir):
    """Tiles of a raster, named from the east westwards, in one."""
    d = dem(spark, sf_dir).withColumn("col", 49 - F.col("col"))
    tile = F.floor(F.col("col") / 25).cast("int")
    tiles = d.select(F.concat(F.lit("tile"), tile.cast("string")).alias("raster"), "row", (F.col("col") % 25).alias("col"), "z")
    return raster.mosaic_tiles(tiles, F.lit(0), F.substring("raster", 5, 1).cast("int")).select("row", "col", "z")


# ---- clouds

GREEDY = """WITH RECURSIVE emb AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
f AS (
  SELECT label, vec_id, x, y, z, CAST('Infinity' AS DOUBLE) AS d, first_value(vec_id) OVER w AS pick, first_value(x) OVER w AS px, first_value(y) OVER w AS py, first_value(z) OVER w AS pz, 0 AS rank FROM emb WINDOW w AS (PARTITION BY label ORDER BY vec_id)
  UNION ALL
  SELECT label, vec_id, x, y, z, n, first_value(vec_id) OVER w, first_value(x) OVER w, first_value(y) OVER w, first_value(z) OVER w, rank + 1 FROM (SELECT *, least(d, (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS n FROM f WHERE rank < 19) g WINDOW w AS (PARTITION BY label ORDER BY n DESC, vec_id))
SELECT DISTINCT label, pick AS pid, CAST(rank AS BIGINT) AS rank FROM f"""


@query(GREEDY)
def farthest_points(spark, sf_dir):
    return points.farthest_point_downsample(cloud(spark, sf_dir), 20, by=["label"]).select("label", "pid", "rank")


@query(f"""WITH {KNN}, n AS (SELECT qid, e.x, e.y, e.z FROM k JOIN emb e ON e.vec_id = k.pid WHERE rank < 8), c AS (SELECT qid AS pid, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM n GROUP BY 1)
SELECT pid, round(xx + yy + zz, 8) AS trace, round(sqrt(xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 8) AS size, 1.0::DOUBLE AS unit, 0.0::DOUBLE AS residual, true AS turned, 0.0::DOUBLE AS shapes FROM c""")
def normals_and_shape(spark, sf_dir):
    """Normals and shapes: the sums that the covariance gives, unit normals that turn as asked and are its eigenvectors, shapes that add up."""
    c = cut(cloud(spark, sf_dir))
    shape = points.curvature_descriptors(c, 8)
    normals, covariance = points.estimate_normals(c, 8, (0.0, 0.0, 10.0)), points.local_covariances(c, 8)
    all_of = shape.join(normals, "pid").join(covariance, "pid").join(c, "pid")
    n, m, values = v.unpack("normal", 3), [v.unpack("covariance", 3, 3 * i) for i in range(3)], v.unpack("eigenvalues", 3)
    off = v.subtract(v.times(m, n), v.scale(n, values[2]))
    toward = n[0] * (0 - F.col("x")) + n[1] * (0 - F.col("y")) + n[2] * (10 - F.col("z"))
    shapes = F.abs(F.col("linearity") + F.col("planarity") + F.col("scattering") - 1) + F.abs(F.col("curvature") - values[2] / (values[0] + values[1] + values[2])) + F.abs(F.col("anisotropy") - 1 + F.col("scattering"))
    return all_of.select(
        "pid", r6(values[0] + values[1] + values[2], 8).alias("trace"), r6(F.sqrt(v.dot(values, values)), 8).alias("size"), r6(v.norm(n)).alias("unit"), F.abs(r6(v.norm(off), 8)).alias("residual"), (toward >= 0).alias("turned"), F.abs(r6(shapes)).alias("shapes"),
    )


@query(f"""WITH {E4} SELECT way, vec_id AS pid, vec_id % 5 <> 0 AS inlier FROM emb, (SELECT unnest(['plane', 'ground']) AS way)""")
def ground_plane(spark, sf_dir):
    """Points of a slanted plane among points above it: the plane of most points, and the ground."""
    c = vecs(spark, sf_dir).select(F.col("vec_id").alias("pid"), e("e", 0).alias("x"), e("e", 1).alias("y"), (0.1 * e("e", 0) - 0.05 * e("e", 1) + 3 + F.when(F.col("vec_id") % 5 == 0, 1 + F.abs(e("e", 2))).otherwise(0.0)).alias("z"))
    c = cut(c)
    found = points.segment_plane(c, 1e-6, iterations=60)
    near = c.select(F.lit("plane").alias("way"), "pid", (points.plane_distance(found["plane"]) <= 1e-6).alias("inlier"))
    marked, _ = points.segment_ground(c, 1e-6, iterations=60)
    return near.unionByName(named("ground", marked, "pid", F.col("is_ground").alias("inlier")))


TURN = 0.004
MOVED = [[math.cos(TURN), -math.sin(TURN), 0, 0.002], [math.sin(TURN), math.cos(TURN), 0, -0.001], [0, 0, 1, 0.0015]]


@query(f"""SELECT way, label, round({math.cos(TURN)}::DOUBLE, 4) AS c, round({math.sin(TURN)}::DOUBLE, 4) AS s, 0.002::DOUBLE AS x, -0.001::DOUBLE AS y, 1.0::DOUBLE AS fitness FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(['point', 'plane', 'scales', 'seeded']) AS way)""")
def icp(spark, sf_dir):
    """Clouds of one label registered onto themselves after a known small motion, by four methods."""
    c = cut(cloud(spark, sf_dir))
    t = transforms.apply_transform(F.array("x", "y", "z"), MOVED)
    moved = c.withColumn("t", t).select("label", "pid", *(e("t", i).alias(n) for i, n in enumerate("xyz")))
    runs = {
        "point": registration.point_to_point_icp(c, moved, max_iterations=60, relative_rmse_tolerance=1e-12, relative_fitness_tolerance=0.0, by=["label"]), "plane": registration.point_to_plane_icp(c, moved, max_iterations=60, relative_rmse_tolerance=1e-12, by=["label"]),
        "scales": registration.multi_scale_icp(c, moved, (0.002, 0.001), max_iterations=60, max_correspondence_distances=(1.0, 1.0), by=["label"]), "seeded": registration.odometry_seeded_icp(c, moved, source_pose=[0.002, -0.001, 0.0015, 0, 0, math.sin(TURN / 2), math.cos(TURN / 2)], target_pose=[0, 0, 0, 0, 0, 0, 1], by=["label"]),
    }
    return union([named(k, d, "label", *(r6(e("transform", i), 4).alias(n) for i, n in ((0, "c"), (4, "s"), (3, "x"), (7, "y"))), r6("fitness").alias("fitness")) for k, d in runs.items()])


@query(f"""WITH {E4} SELECT 'scale' AS way, vec_id AS pid, round(2 * x + 1, 6) AS x, round(2 * z + 3, 6) AS z FROM emb UNION ALL SELECT 'depth', vec_id, CASE WHEN x > 0 THEN round(3 * x + 0.5, 6) ELSE round(x, 6) END, 0.0 FROM emb UNION ALL SELECT 'valid', vec_id, round(x, 6), round(z, 6) FROM emb WHERE vec_id % 3 = 0""")
def scaled_clouds(spark, sf_dir):
    c = cloud(spark, sf_dir)
    nan, zero = F.lit(float("nan")), F.lit(0.0)
    dirty = c.select("pid", *(F.when(F.col("pid") % 3 == 1, nan if n == "y" else F.col(n)).when(F.col("pid") % 3 == 2, zero).otherwise(F.col(n)).alias(n) for n in "xyz"))
    return union([
        named("scale", points.apply_point_cloud_metric_scale(c, 2.0, (1.0, 2.0, 3.0)), "pid", r6("x").alias("x"), r6("z").alias("z")), named("depth", c, "pid", r6(points.apply_depth_metric_scale(F.col("x"), 3.0, 0.5)).alias("x"), F.lit(0.0).alias("z")),
        named("valid", points.valid_point_cloud_points(dirty), "pid", r6("x").alias("x"), r6("z").alias("z")),
    ])


@query("""WITH l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'ratio' AS way, label, CAST(ceil(n * 0.25) AS BIGINT) AS n, CAST(ceil(n * 0.25) AS BIGINT) AS different FROM l UNION ALL SELECT 'count', label, least(n, 7), least(n, 7) FROM l""")
def random_choice(spark, sf_dir):
    """Exact numbers of different points chosen at random, the same each time."""
    c = cloud(spark, sf_dir)
    runs = {"ratio": points.random_downsample(c, ratio=0.25, seed=3, by=["label"]), "count": points.random_downsample(c, 7, seed=3, by=["label"])}
    return union([named(k, d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("different")), "label", "n", "different") for k, d in runs.items()])


@query("""WITH l AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq FROM embeddings), p AS (SELECT * FROM l WHERE seq < 6) SELECT label::VARCHAR AS topic, seq AS source_index, seq - 3 AS target_index, true AS accepted, 1.0::DOUBLE AS fitness FROM p WHERE seq >= 3""")
def verified_closures(spark, sf_dir):
    """Each device comes by three places twice and sees the same cloud there."""
    base = cloud(spark, sf_dir)
    clouds = base.select(F.col("label").cast("string").alias("topic"), "pid", "x", "y", "z").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    position = F.array((F.col("seq") % 3) * 10.0, F.lit(0.0), F.lit(0.0))
    poses = clouds.select("topic", "seq").distinct().withColumn("position", position).withColumn("pose", F.concat(position, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))))
    many = base.groupBy("label").count().filter("count >= 6").select(F.col("label").cast("string").alias("topic"))
    found = points.find_loop_closure_candidates(poses.join(many, "topic"), 1.0, 3)
    return registration.verify_loop_closures(clouds, poses, found, return_all=True).select("topic", "source_index", "target_index", "accepted", r6("fitness").alias("fitness"))


# ---- rasters


@query(f"WITH {DEM}, g AS (SELECT CAST(i // 5 AS INT) AS row, CAST(i % 5 AS INT) AS col FROM range(25) t(i)) SELECT g.row, g.col, round(coalesce(z, -1), 6) AS z FROM g LEFT JOIN dem d ON d.row = g.row + 0 AND d.col = g.col + 8")
def terrain_patch_at_fix(spark, sf_dir):
    degree = math.degrees(1 / 6378137.0)
    return raster.terrain_patch_at_navsat(dem(spark, sf_dir), [50 + 2 * degree, 8 + 10 * degree / math.cos(math.radians(50))], 50.0, 8.0, size=5, fill_value=-1.0).select("row", "col", r6("z").alias("z"))


@query(f"WITH {DEM} SELECT 'a' AS raster, row, col, z FROM dem UNION ALL SELECT 'b', row, col, z + 1 FROM dem")
def dem_cache(spark, sf_dir):
    base = f"{shared_dir(spark)}/dem-{uuid.uuid4().hex}"
    d = dem(spark, sf_dir)
    raster.write_dem_cache(d.withColumn("raster", F.lit("a")).unionByName(d.withColumn("raster", F.lit("b")).withColumn("z", F.col("z") + 1)), base)
    found = cut(raster.read_dem_cache(spark, base, "a").unionByName(raster.read_dem_cache(spark, base, "b")).select("raster", "row", "col", "z"))
    removed(spark, base)
    return found


@query(f"WITH {IMG} SELECT seq, row, 7 - col AS col, round(z * 2 + 5, 6) AS z FROM px")
def augment_patch(spark, sf_dir):
    return plane(ml.augment_dem_patch(pictures(spark, sf_dir), flip_horizontal=True, z_scale=2.0, z_offset=5.0))


# ---- images


@query(f"""WITH {IMG}, l AS (SELECT px.*, label FROM px JOIN embeddings ON vec_id = seq), ends AS (SELECT label, min(z) AS lo, max(z) AS hi FROM l GROUP BY 1), g AS (SELECT CAST(i // 4 AS INT) AS row, CAST(i % 4 AS INT) AS col FROM range(16) t(i)), s AS (SELECT DISTINCT seq FROM px), f AS (SELECT seq, CAST(i // 9 AS INT) AS row, CAST(i % 9 AS INT) AS col FROM s, range(72) t(i))
SELECT 'normalize' AS way, seq, row, col, round(CAST(CAST((z - lo) / (hi - lo) AS FLOAT) AS DOUBLE), 5) AS z FROM l JOIN ends USING (label) UNION ALL SELECT 'crop', seq, row - 1, col - 2, round(z, 5) FROM px WHERE row BETWEEN 1 AND 5 AND col BETWEEN 2 AND 4
UNION ALL SELECT 'resize', seq, g.row, g.col, round(z, 5) FROM g JOIN px ON px.row = CAST(round_even(g.row * 7 / 3.0, 0) AS INT) AND px.col = CAST(round_even(g.col * 7 / 3.0, 0) AS INT) UNION ALL SELECT 'pad', f.seq, f.row, f.col, coalesce(round(z, 5), 9.0) FROM f LEFT JOIN px ON px.seq = f.seq AND px.row = f.row AND px.col = f.col - 1""")
def image_stacks(spark, sf_dir):
    """The same for stacks of images."""
    p = cut(pictures(spark, sf_dir))
    runs = {"normalize": image.normalize_images(p), "crop": image.crop_images(p, 1, 6, 2, 5), "resize": image.resize_images_nearest(p, (4, 4)), "pad": image.pad_images(p, ((0, 0), (1, 0)), 9.0)}
    return union([plane(d, digits=5).select(F.lit(k).alias("way"), "seq", "row", "col", "z") for k, d in runs.items()])


def morphed(cell: str, outside: str, first: str, second: str) -> str:
    """SQL of two passes over 3 x 3 neighbourhoods; what lies outside the image counts as ``outside`` says."""
    near = lambda t, rest: f"SELECT d.seq, d.row, d.col, coalesce(y.m, {rest}) AS m FROM {t} d CROSS JOIN k a CROSS JOIN k b LEFT JOIN {t} y ON y.seq = d.seq AND y.row = d.row + a.k AND y.col = d.col + b.k"
    one, other = outside.split(",")
    return f"WITH {IMG}, k AS (SELECT unnest(range(-1, 2)) AS k), b0 AS (SELECT seq, row, col, {cell} AS m FROM px), b1 AS (SELECT seq, row, col, {first}(m) AS m FROM ({near('b0', one)}) GROUP BY 1, 2, 3), b2 AS (SELECT seq, row, col, {second}(m) AS m FROM ({near('b1', other)}) GROUP BY 1, 2, 3) SELECT seq, row, col, CASE WHEN m THEN 1.0::DOUBLE ELSE 0.0 END AS z FROM b2"


@query(morphed("z > -0.05", "false,false", "bool_and", "bool_or"))
def opened_mask(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x > -0.05).cast("double")))
    return plane(image.open_mask(p))


@query(morphed("z > 0.05", "false,false", "bool_or", "bool_and"))
def closed_mask(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x > 0.05).cast("double")))
    return plane(image.close_mask(p))


@query(f"WITH {WINDOWED} SELECT seq, row, col, round(avg(z), 6) AS z FROM near GROUP BY 1, 2, 3")
def local_mean(spark, sf_dir):
    return plane(image.local_mean(pictures(spark, sf_dir)), "mean")


@query(f"WITH {IMG}, f AS (SELECT seq, row, 7 - col AS col, z FROM px), c AS (SELECT seq, row, col, (col - 3.5) * (z + 1) / 10 AS x, z FROM px) SELECT way, seq, row, col, round(x, 6) AS x, round(z, 6) AS color FROM c, (SELECT unnest(['points', 'frames']) AS way)")
def colored_points(spark, sf_dir):
    """Depth and image frames to coloured points, one frame and many."""
    p = cut(pictures(spark, sf_dir))
    deep = p.withColumn("data", F.transform("data", lambda x: x + 1))
    runs = {"points": image.rgbd_to_points(deep, p, 10.0, 12.0, 3.5, 3.5), "frames": image.iter_rgbd_frame_points(deep, p, 10.0, 12.0, 3.5, 3.5)}
    return union([named(k, d, "seq", "row", "col", r6("x").alias("x"), r6(e("attrs", 0)).alias("color")) for k, d in runs.items()])


def wandering(spark, sf_dir):
    """Frames of 12 x 16 with one bright 4 x 4 patch of each embedding's values, which moves by one row and two columns from frame to frame, four frames a topic."""
    pic = pictures(spark, sf_dir).select(F.col("seq").cast("string").alias("topic"), F.transform(F.slice("data", 1, 16), lambda x: x + 2).alias("patch"))
    frames = pic.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    cell = lambda i: (F.floor(i / 16) - 2 - F.col("seq"), i % 16 - 1 - 2 * F.col("seq"))

    def value(i):
        r, c = cell(i)
        return F.when((r >= 0) & (r < 4) & (c >= 0) & (c < 4), F.get("patch", (r * 4 + c).cast("int"))).otherwise(0.0)

    return frames.select("topic", "seq", F.col("seq").cast("double").alias("ts"), F.array(F.lit(12), F.lit(16)).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(191)), value).alias("data"))


STEPS = "f AS (SELECT vec_id::VARCHAR AS topic, CAST(i AS BIGINT) AS seq FROM embeddings, range(4) t(i))"


@query(f"WITH {STEPS} SELECT 'shift' AS way, topic, seq, 1 AS dy, 2 AS dx FROM f WHERE seq > 0 UNION ALL SELECT 'flow', topic, seq, 1, 2 FROM f WHERE seq > 0 UNION ALL SELECT 'each', topic, seq, 1, 2 FROM f WHERE seq > 0 UNION ALL SELECT 'align', topic, seq, CAST(seq AS INT), CAST(2 * seq AS INT) FROM f UNION ALL SELECT 'first', topic, seq, CAST(seq AS INT), CAST(2 * seq AS INT) FROM f UNION ALL SELECT 'one', topic, seq, 1, 2 FROM f WHERE seq > 0")
def frame_shifts(spark, sf_dir):
    """How a patch moves from frame to frame, by every operator that tells it."""
    w = cut(wandering(spark, sf_dir))
    pairs = cut(image.with_previous_frame(w))
    shift = lambda k, d: named(k, d, "topic", "seq", e("shift", 0).alias("dy"), e("shift", 1).alias("dx"))
    flow = lambda k, d: named(k, d, "topic", "seq", e("flow", 0).cast("int").alias("dy"), e("flow", 1).cast("int").alias("dx"))
    return union([
        shift("shift", image.estimate_image_shift(pairs)), flow("flow", image.frame_optical_flow(pairs)), flow("each", image.iter_frame_optical_flow(w)),
        shift("align", image.iter_aligned_images(w)), shift("first", image.align_images(w, incremental=False)), shift("one", image.align_image(pairs)),
    ])


@query(f"WITH {STEPS}, s AS (SELECT vec_id::VARCHAR AS topic, round(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) + 2)), 4) AS total FROM embeddings) SELECT topic, seq, CAST(least(seq + 1, 3) AS INT) AS frames, round(total, 4) AS total FROM f JOIN s USING (topic)")
def compensated_windows(spark, sf_dir):
    """Windows of frames moved onto their newest: the patch keeps all its values."""
    w = image.iter_motion_compensated_windows(wandering(spark, sf_dir), 3)
    return w.select("topic", "seq", F.size("frames").alias("frames"), r6(F.aggregate(e("frames", 0), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"WITH {STEPS}, s AS (SELECT vec_id::VARCHAR AS topic, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) + 2) AS p FROM embeddings) SELECT topic, seq, round(p[1], 6) AS corner, round(p[16], 6) AS last FROM f JOIN s USING (topic)")
def aligned_frames(spark, sf_dir):
    """Frames moved onto the first of their topic: the patch stays where it was."""
    a = image.align_images(wandering(spark, sf_dir))
    return a.select("topic", "seq", r6(e("data", 2 * 16 + 1)).alias("corner"), r6(e("data", 5 * 16 + 4)).alias("last"))


@query(f"WITH {STEPS} SELECT topic, seq, CAST(12 * 16 * 3 AS DOUBLE) AS total, 2.0::DOUBLE AS right FROM f WHERE seq > 0")
def optical_flow(spark, sf_dir):
    """The field of shifts between frames, one for each pixel, in blocks."""
    f = image.frame_to_frame_optical_flow(wandering(spark, sf_dir), block_size=(12, 16))
    return f.select("topic", "seq", F.aggregate("flow", F.lit(0.0), lambda s, x: s + x).alias("total"), e("flow", 101).alias("right"))


@query("SELECT vec_id::VARCHAR AS topic, round(CAST(embedding[1] AS DOUBLE) * cos(2 * pi() * 2 * 9 / 10), 6) AS newest, round(CAST(embedding[16] AS DOUBLE) * cos(2 * pi() * 2 * 9 / 10), 6) AS last FROM embeddings")
def filtered_over_time(spark, sf_dir):
    """Frames that swing twice in ten frames about a level: the band keeps the swing and drops the level."""
    pic = pictures(spark, sf_dir).select(F.col("seq").cast("string").alias("topic"), F.slice("data", 1, 16).alias("p"))
    f = pic.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    f = f.select("topic", "seq", F.array(F.lit(4), F.lit(4)).alias("shape"), F.transform("p", lambda x: x * F.cos(F.col("seq") * (2 * math.pi * 2 / 10)) + 3).alias("data"))
    return image.fft_filter(f).select("topic", r6(e("data", 0)).alias("newest"), r6(e("data", 15)).alias("last"))


@query(f"""WITH {IMG}, c AS (SELECT seq, row, col, (col - 3.5) * (z + 1) / 10 AS x, (row - 3.5) * (z + 1) / 12 AS y, z + 1 AS z FROM px),
n AS (SELECT *, lead(x) OVER r - lag(x) OVER r AS ax, lead(y) OVER r - lag(y) OVER r AS ay, lead(z) OVER r - lag(z) OVER r AS az, lead(x) OVER d - lag(x) OVER d AS bx, lead(y) OVER d - lag(y) OVER d AS bby, lead(z) OVER d - lag(z) OVER d AS bz FROM c WINDOW r AS (PARTITION BY seq, row ORDER BY col), d AS (PARTITION BY seq, col ORDER BY row)),
k AS (SELECT *, ay * bz - az * bby AS nx, az * bx - ax * bz AS ny, ax * bby - ay * bx AS nz FROM n WHERE ax IS NOT NULL AND bx IS NOT NULL), u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) * CASE WHEN nx * x + ny * y + nz * z > 0 THEN -1 ELSE 1 END AS s FROM k)
SELECT seq, row, col, round(nx / s, 5) AS nx, round(ny / s, 5) AS ny, round(nz / s, 5) AS nz FROM u""")
def depth_normals(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("data", F.transform("data", lambda x: x + 1))
    n = image.depth_to_normals(p, 10.0, 12.0, 3.5, 3.5).filter(~F.isnan("nz"))
    return n.select("seq", "row", "col", *(r6(c, 5).alias(c) for c in ("nx", "ny", "nz")))

