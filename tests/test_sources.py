import base64
import json
import shutil
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave import cli
from stratawave.operators import summary
from stratawave.plans import recordings as r
from stratawave.sources import containers, export, messages, png, sources
from stratawave.sources.store import DataBuffer, Store, last_rows
from stratawave.streaming import source as stream


def cdr(*parts):
    """Parts are (format, value) or texts, aligned as in CDR."""
    out = b""
    for p in parts:
        kind, value = ("I", len(p.encode()) + 1) if isinstance(p, str) else p
        if kind == "bytes":
            out += value
            continue
        size = struct.calcsize(kind)
        out += b"\0" * (-len(out) % size) + struct.pack("<" + kind, value)
        if isinstance(p, str):
            out += p.encode() + b"\0"
    return b"\0\1\0\0" + out


HEADER = (("i", 5), ("I", 500_000_000), "map")


def pose(x=1.0):
    return cdr(*HEADER, *(("d", v) for v in (x, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)))


def cloud(points, padding=0):
    packed = b"".join(struct.pack("<fff", *p) + b"\0" * 4 for p in points)
    fields = [x for i, n in enumerate("xyz") for x in (n, ("I", 4 * i), ("B", 7), ("I", 1))]
    return cdr(*HEADER, ("I", 1), ("I", len(points)), ("I", 3), *fields, ("B", 0), ("I", 16), ("I", 16 * len(points) + padding), ("I", len(packed)), ("bytes", packed), ("B", 1))


def test_decoders():
    m = messages.decode_supported_cdr_message(pose(), "geometry_msgs/msg/PoseStamped")
    assert m["data"].tolist() == [1, 2, 3, 0, 0, 0, 1] and m["timestamp"] == 5.5 and m["frame_id"] == "map"
    c = messages.decode_supported_cdr_message(cloud([(1, 2, 3), (4, 5, 6)]), "sensor_msgs/msg/PointCloud2")
    assert c["shape"] == [2, 3] and c["data"].tolist() == [1, 2, 3, 4, 5, 6]
    texts = ("src", "topic", "mesh", "frame")
    d = cdr(*HEADER, ("I", 2), *texts, *(("I", v) for v in (10, 20, 30, 40)), ("d", 1.5), ("d", 0.25), "eq", "u", "m", "cal", "{}")
    k = messages.decode_supported_cdr_message(d, "calibration_msgs/msg/DepthAnythingCalibration")
    assert k["data"].tolist() == [1.5, 0.25, 10, 20, 30, 40] and k["extra"]["equation"] == "eq" and len(k["extra"]) == 16
    assert messages.decode_supported_cdr_message(b"\0\1\0\0", "std_msgs/msg/String") is None
    with pytest.raises((ValueError, struct.error)):
        messages.decode_supported_cdr_message(pose()[:20], "geometry_msgs/msg/PoseStamped")
    fix = json.dumps({"op": "publish", "msg": {"header": {"stamp": {"sec": 3, "nanosec": 500000000}, "frame_id": "gps"}, "latitude": 1.0, "longitude": 2.0}}).encode()
    f = messages.decode_supported_cdr_message(fix, "sensor_msgs/msg/NavSatFix")
    assert f["data"].tolist() == [1, 2, 0] and f["timestamp"] == 3.5 and f["frame_id"] == "gps"
    p = messages.decode_rosbridge_json_message(b'{"pose": {}}', "geometry_msgs/msg/PoseStamped")
    assert p["data"].tolist() == [0, 0, 0, 0, 0, 0, 1]
    body = {"height": 1, "width": 1, "point_step": 12, "row_step": 12, "fields": [{"name": n, "offset": 4 * i, "datatype": 7} for i, n in enumerate("xyz")], "data": base64.b64encode(struct.pack("<fff", 7, 8, 9)).decode()}
    assert messages.decode_rosbridge_json_message(json.dumps(body).encode(), "sensor_msgs/msg/PointCloud2")["data"].tolist() == [7, 8, 9]
    assert messages.decode_rosbridge_json_message(b"{nonsense}", "sensor_msgs/msg/NavSatFix") is None
    with pytest.raises(ValueError):
        messages.pointcloud_xyz(b"", [{"name": "x", "offset": 0, "datatype": 7}], 1, 1, 12, 12, False)
    padded = b"".join(struct.pack("<fff", r, r, r) + b"\xff" * 4 for r in (1, 2))
    rows = [{"name": n, "offset": 4 * i, "datatype": 7} for i, n in enumerate("xyz")]
    assert messages.pointcloud_xyz(padded, rows, 2, 1, 12, 16, False).tolist() == [[1, 1, 1], [2, 2, 2]]


def recording(folder, names=("a_0.db3",), listed=True):
    folder.mkdir()
    at = 0
    for name in names:
        db = sqlite3.connect(folder / name)
        db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/pose", "geometry_msgs/msg/PoseStamped"), (2, "/other", "std_msgs/msg/String")])
        for i in range(5):
            db.execute("INSERT INTO messages VALUES (?, 1, ?, ?)", (i + 1, (10 + at) * 10**9, pose(float(at)) if i != 3 else b"broken"))
            at += 1
        db.execute("INSERT INTO messages VALUES (9, 2, 1, ?)", (b"x",))
        db.commit()
        db.close()
    if listed:
        (folder / "metadata.yaml").write_text("files:\n" + "".join(f"  - {n}\n" for n in (*names, "gone.db3")))
    return str(folder)


def test_recordings(spark, tmp_path):
    path = recording(tmp_path / "bag", ("a_1.db3", "a_0.db3"))
    df = sources.data_source(spark, path)
    got = [(r.seq, r.data[0]) for r in df.orderBy("seq").collect()]
    assert got == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 4.0), (4, 5.0), (5, 6.0), (6, 7.0), (7, 9.0)]
    assert sources.read_recording(spark, path, rows_per_partition=2).count() == 8
    meta = sources.recording_metadata(path)
    assert dict(zip(meta["topic"], meta["count"])) == {"/pose": 10, "/other": 2}
    (tmp_path / "bag" / "alone.bag").write_bytes((tmp_path / "bag" / "a_0.db3").read_bytes())
    assert sources.data_source(spark, str(tmp_path / "bag" / "alone.bag")).count() == 4
    for bad, error in (("none.png", FileNotFoundError), ("x.bag", FileNotFoundError), ("nothing", FileNotFoundError), ("DEM", ValueError)):
        with pytest.raises(error):
            sources.data_source(spark, str(tmp_path / bad) if bad != "DEM" else bad)


@pytest.mark.parametrize("compression", ["", "zstd", "lz4"])
@pytest.mark.parametrize("encoding", ["cdr", "ros1"])
def test_mcap(spark, tmp_path, compression, encoding):
    e = np.arange(64) / 64
    rows = [(f"/t{k}", r.KINDS[k], (10 + i) * 10**9, r.encoded(k, 10 + i + 0.5, e + i, encoding == "ros1")) for i in range(6) for k in range(8)]
    path = str(tmp_path / "a.mcap")
    r.write_mcap(path, rows, compression, 5, encoding)
    check_recording(spark, path, e)
    assert len(containers.parts(path, 100)) == 10
    whole = open(path, "rb").read()
    (tmp_path / "cut.mcap").write_bytes(whole[: len(whole) // 2])
    assert 0 < sources.read_recording(spark, str(tmp_path / "cut.mcap")).count() < 42


@pytest.mark.parametrize("compression", ["none", "bz2"])
def test_bags(spark, tmp_path, compression):
    e = np.arange(64) / 64
    rows = [(f"/t{k}", r.KINDS[k], (10 + i) * 10**9, r.encoded(k, 10 + i + 0.5, e + i, True)) for i in range(6) for k in range(8)]
    path = str(tmp_path / "a.bag")
    r.write_bag(path, rows, compression, 5)
    check_recording(spark, path, e)
    whole = open(path, "rb").read()
    (tmp_path / "cut.bag").write_bytes(whole[: len(whole) // 2])
    assert 0 < sources.read_recording(spark, str(tmp_path / "cut.bag")).count() < 42
    loose = b"#ROSBAG V2.0\n" + r.bag_part(r.bag_head(op=b"\7", conn=b"\0\0\0\0", topic=b"/p"), r.bag_head(type=b"geometry_msgs/Pose")[4:])
    loose += b"".join(r.bag_part(r.bag_head(op=b"\2", conn=b"\0\0\0\0", time=struct.pack("<II", i, 0)), r.encoded(5, 0, e, True)) for i in range(7))
    (tmp_path / "loose.bag").write_bytes(loose)
    assert [x.ts for x in sources.read_recording(spark, str(tmp_path / "loose.bag"), 3).orderBy("seq").collect()] == list(range(7)) and len(containers.parts(str(tmp_path / "loose.bag"), 3)) == 3


def check_recording(spark, path, e):
    df = sources.data_source(spark, path)
    got = {(x.topic, x.seq): x for x in df.collect()}
    assert len(got) == 42 and {x.ts for x in got.values() if x.topic != "/t5"} == {10.5 + i for i in range(6)} and got["/t5", 2].ts == 12.0
    assert got["/t2", 1].data == [1, 1 + 1 / 64, 1 + 2 / 64] and got["/t6", 0].shape == [21, 3] and got["/t0", 0].frame_id == "base"
    assert np.allclose(np.reshape(got["/t1", 0].data, (8, 4))[:, 0], e[::4][:8]) and got["/t1", 0].extra == {"child_frame_id": "wheels"}
    assert got["/t3", 0].dtype == "uint8" and got["/t3", 0].shape == [8, 8] and got["/t3", 0].data == np.floor((e + 1) * 100).tolist()
    assert [(x.topic, x["count"]) for x in sources.undecoded(spark, path).collect()] == [("/t7", 6)]
    meta = sources.recording_metadata(path)
    assert set(meta["count"]) == {6} and len(meta) == 8 and set(meta["start_time"]) == {10.0}


def test_json_of_sensors():
    imu = messages.decode_supported_cdr_message(b'{"angular_velocity": {"x": 2}, "linear_acceleration": {"z": 9}}', "sensor_msgs/msg/Imu")
    assert imu["shape"] == [6, 4] and imu["data"].reshape(6, 4)[[0, 2, 4]].tolist() == [[0, 0, 0, 1], [2, 0, 0, 0], [0, 0, 9, 0]]
    odom = messages.decode_supported_cdr_message(b'{"pose": {"pose": {"position": {"x": 1}}}, "twist": {"twist": {"linear": {"y": 3}}}, "child_frame_id": "b"}', "nav_msgs/msg/Odometry")
    assert odom["data"].reshape(8, 4)[[0, 2, 4]].tolist() == [[1, 0, 0, 0], [0, 0, 0, 1], [0, 3, 0, 0]] and odom["extra"]["child_frame_id"] == "b"
    image = json.dumps({"encoding": "mono8", "height": 1, "width": 2, "step": 2, "data": base64.b64encode(b"ab").decode()}).encode()
    assert messages.decode_supported_cdr_message(image, "sensor_msgs/msg/Image")["data"].tolist() == [97, 98]


def test_images_and_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {f"f_{i}.png": rng.integers(0, 255, (4, 5) if i % 2 else (4, 5, 3)) for i in (1, 2, 10)}
    for name, im in pictures.items():
        (tmp_path / name).write_bytes(png.encode_png(im))
    got = sources.data_source(spark, str(tmp_path / "*.png"), 0.5).orderBy("seq").collect()
    assert [(r.name, r.ts) for r in got] == [("f_1.png", 0.0), ("f_2.png", 0.5), ("f_10.png", 1.0)]
    assert all(np.array_equal(np.reshape(r.data, r["shape"]), pictures[r.name] if pictures[r.name].ndim == 2 else pictures[r.name][:, :, ::-1]) for r in got)
    assert png.decode_pnm(b"P5\n# c\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]
    with pytest.raises(ValueError):
        png.decode_image(b"no image at all")
    (tmp_path / "N01W002.hgt").write_bytes(np.arange(9, dtype=">i2").tobytes())
    (tmp_path / "N05W002.hgt").write_bytes(np.arange(9, dtype=">i2").tobytes())
    tiles = sources.data_source(spark, "DEM", bounds=((1, 3), (1, 3)), cache_dir=str(tmp_path)).collect()
    assert [(r.name, list(r["shape"]), r.data[8]) for r in tiles] == [("N01W002", [3, 3], 8.0)]
    with pytest.raises(ValueError):
        sources.decode_hgt(b"123")


def test_images_that_the_jvm_decodes(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(6, 4, 1)  # RGB
    for x in range(6):
        for y in range(4):
            image.setRGB(x, y, (200 << 16) | (100 << 8) | 30)
    for kind in ("jpg", "bmp"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / f"a +%41 10.{kind}")))
    (tmp_path / "a 2.png").write_bytes(png.encode_png(np.full((4, 6, 3), [200, 100, 30])))
    got = sources.read_images(spark, str(tmp_path / "a *")).orderBy("seq").collect()
    assert [r.name for r in got] == ["a +%41 10.bmp", "a +%41 10.jpg", "a 2.png"]
    for r in got:
        assert r["shape"] == [4, 6, 3] and r.dtype == "uint8" and np.abs(np.reshape(r.data, (4, 6, 3)) - [30, 100, 200]).max() <= 4
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    with pytest.raises(Exception, match="no image"):
        sources.data_source(spark, str(tmp_path / "bad.jpg")).collect()


@pytest.mark.parametrize("filter_kind", range(5))
def test_png_filters(filter_kind):
    import zlib

    rng = np.random.default_rng(filter_kind)
    im = rng.integers(0, 256, (6, 7, 3)).astype(int)
    flat, lines = im.reshape(6, 21), []
    for r in range(6):
        up = flat[r - 1] if r else np.zeros(21, int)
        left, corner = np.r_[np.zeros(3, int), flat[r][:-3]], np.r_[np.zeros(3, int), up[:-3]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines.append(bytes([filter_kind]) + bytes(((flat[r] - [0 * up, left, up, (left + up) // 2, paeth][filter_kind]) % 256).astype(np.uint8)))
    plain = png.encode_png(im)
    at = plain.index(b"IDAT") - 4
    body = zlib.compress(b"".join(lines))
    raw = plain[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", 0) + plain[plain.index(b"IEND") - 4 :]
    assert np.array_equal(png.decode_png(raw), im)


KINDS = [{"name": f"/{k}", "kind": k, "rate": 4.0, "points": 50, "shape": (4, 6)} for k in ("imu", "odometry", "pointcloud", "navsat", "image", "scalar")]


def test_synthetic(spark):
    a, b = (sources.synthetic(spark, KINDS, duration=2.0, seed=3) for _ in range(2))
    key = lambda df: sorted((r.topic, r.seq, tuple(r.data)) for r in df.collect())
    assert key(a) == key(b) and key(a) != key(sources.synthetic(spark, KINDS, duration=2.0, seed=4))
    counts = {r.topic: r["count"] for r in a.groupBy("topic").count().collect()}
    assert set(counts.values()) == {9} and len(counts) == 6
    assert a.filter(F.size("data") != F.aggregate("shape", F.lit(1), lambda s, x: s * x)).count() == 0
    for bad in (lambda: sources.synthetic(spark, duration=0), lambda: sources.synthetic(spark, [{"name": "x", "kind": "odd", "rate": 1}])):
        with pytest.raises(ValueError):
            bad()


def test_stitched_scans_meet_the_landmarks(spark):
    topics = [{"name": "/odom", "kind": "odometry", "rate": 50.0}, {"name": "/points", "kind": "pointcloud", "rate": 5.0, "points": 120}]
    world = cli.flagship(sources.synthetic(spark, topics, seed=2)).toPandas()[["x", "y", "z"]].to_numpy()
    places = sources.landmarks(10.0, 2)
    d = np.sqrt(((world[:, None] - places[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(world) > 1000 and np.median(d) < 0.1


def store_rows(spark, n=5, start=0):
    return spark.createDataFrame([("sensor/a b", 100 + 0.1 * i, f"f{i}", "map", [float(i), 2.0 * i]) for i in range(start, n)], "topic string, ts double, name string, frame_id string, data array<double>")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.manifest().count() == 0
    store.append(store_rows(spark))
    m = store.manifest().first()
    assert (m.topic, m["count"], m.closed, m.name, m.frame_id, list(m["shape"])) == ("sensor/a b", 5, False, "f4", "map", [2])
    t = store.topic("sensor/a b")
    assert [round(r.ts, 1) for r in t.time_range(100.05, 100.35).df.orderBy("seq").collect()] == [100.1, 100.2, 100.3]
    assert t.last_seconds(0.15).df.count() == 2 and t.slice(2, 5).df.count() == 3 and t.spatial_bounds((1.5, 0), (9, 9)).df.count() == 3
    again = store_rows(spark, 8).withColumn("seq", F.regexp_extract("name", r"(\d+)", 1).cast("long"))
    store.append(again, closed=True)  # the first five are stored already
    assert store.messages().count() == 8 and store.manifest().first().closed and store.manifest().first()["count"] == 8
    store.append(store_rows(spark, 2))
    assert sorted(r.seq for r in store.messages().collect()) == list(range(10))
    with pytest.raises(Exception, match="shape"):
        store.append(spark.createDataFrame([("sensor/a b", 1.0, [1.0])], "topic string, ts double, data array<double>"))
    with pytest.raises(ValueError):
        store.dataset(["no"])
    report = store.compact()
    assert report.agg(F.sum("rows")).first()[0] == 10 and store.messages().count() == 10
    store.overwrite("sensor/a b", store.messages().filter("seq < 4"))
    assert store.messages().count() == 4 and store.manifest().first()["count"] == 4


def test_buffers(spark, tmp_path):
    two = spark.createDataFrame([("cam", 10.0 + 0.1 * i, [1.0]) for i in range(3)] + [("imu", 10.05 + 0.1 * i, [2.0]) for i in range(2)], "topic string, ts double, data array<double>")
    ring = DataBuffer(two, buffer_depth=2, axis="cam")
    assert last_rows(ring.source, 2).count() == 4
    sizes = [df.groupBy("topic").count().orderBy("topic").collect() for df, _ in ring.get_data()]
    assert [[(r.topic, r["count"]) for r in s] for s in sizes] == [[("cam", 1)], [("cam", 2), ("imu", 1)], [("cam", 2), ("imu", 2)]]
    assert ring.get_size() == 2 and [round(r.ts, 1) for r in ring.get_index_range("cam", -1).collect()] == [10.2]
    assert ring.get_time_range("cam", 10.15, 11).count() == 1 and ring.get_last_seconds("cam", 0.05).count() == 1 and len(ring.topic_view("imu")) == 2
    with DataBuffer(two, data_uri=str(tmp_path / "b"), use_db=True) as stored:
        stored.load_data_db()
        assert stored.dataset().df.count() == 5 and stored.topic("imu").df.count() == 2
    for bad in (lambda: DataBuffer(two, 0), lambda: DataBuffer(two, backend="odd"), lambda: DataBuffer(two, use_db=True)):
        with pytest.raises(ValueError):
            bad()


def test_exports(spark, tmp_path):
    df = sources.synthetic(spark, [{"name": "/p", "kind": "pointcloud", "rate": 2.0, "points": 20}], duration=1.0)
    path = export.save_topic_npz(df, "/p", str(tmp_path / "t.npz"))
    back = export.load_topic_npz(spark, path)
    assert sorted(map(str, back.select("topic", "seq", "ts", "name", "data").collect())) == sorted(map(str, df.select("topic", "seq", "ts", "name", "data").collect()))
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(50)], "pid int, x double, y double, z double")
    assert export.write_html(points, str(tmp_path / "c.html"), limit=10) <= 10 and "canvas" in (tmp_path / "c.html").read_text()
    assert export.from_open3d_point_cloud(spark, type("C", (), {"points": np.zeros((3, 3))})).count() == 3


def test_cli(spark, tmp_path):
    path = recording(tmp_path / "bag")
    assert cli.run(["topics", path], spark) == ["/pose"]
    assert "n=4" in cli.run(["info", path], spark)[0]
    cli.run(["export", path, "/pose", str(tmp_path / "o.npz"), "--limit", "2"], spark)
    assert np.load(tmp_path / "o.npz")["data"].shape == (2, 7)
    assert cli.run(["ingest", path, str(tmp_path / "store")], spark) == ["/pose 4"]
    assert any("points written" in line for line in cli.run(["demo", str(tmp_path)], spark))


def streamed(spark, folder):
    return spark.readStream.schema("topic string, seq long, ts double, name string, frame_id string, source_uri string, dtype string, shape array<int>, data array<double>").option("maxFilesPerTrigger", 1).parquet(str(folder))


def batches(spark, folder, n=3, per=4, topics=("a", "b")):
    from stratawave.schema import MESSAGE

    for i in range(n):
        rows = [(t, i * per + k, float(i * per + k), f"{t}{i * per + k}", None, None, "float64", [1], [float(i * per + k)]) for t in topics for k in range(per)]
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(str(folder))


def test_streams_equal_batches_and_resume(spark, tmp_path):
    batches(spark, tmp_path / "in")
    pipe = stream.source_pipeline(streamed(spark, tmp_path / "in"))
    chosen = pipe.select_topics("a").filter(F.get("data", F.lit(0)) != 2).index_range(1, 9, 2)
    chosen.to_buffer(str(tmp_path / "out"), str(tmp_path / "cp"))
    stored = Store(spark, str(tmp_path / "out"))
    got = sorted(r.name for r in stored.messages().collect())
    assert [(r.topic, r["count"], r.closed) for r in stored.manifest().collect()] == [("a", 4, True)]
    batch = stream.source_pipeline(spark.read.parquet(str(tmp_path / "in"))).select_topics("a").filter(F.get("data", F.lit(0)) != 2).index_range(1, 9, 2)
    assert got == sorted(r.name for r in batch.df.collect()) and len(got) == 4
    seen = []
    whole = stream.source_pipeline(streamed(spark, tmp_path / "in"))
    whole.to_buffer(str(tmp_path / "all"), str(tmp_path / "cp2"), progress=seen.append)
    assert seen[-1].processed == 24 and seen[-1].done
    batches(spark, tmp_path / "in", 1)
    stream.source_pipeline(streamed(spark, tmp_path / "in")).to_buffer(str(tmp_path / "all"), str(tmp_path / "cp2"))
    whole = Store(spark, str(tmp_path / "all"))
    assert whole.messages().count() == 32 and whole.messages().select("topic", "seq").distinct().count() == 32 and {r["count"] for r in whole.manifest().collect()} == {16}
    # a batch that is added again, whole or after a break, adds nothing
    broken = Store(spark, str(tmp_path / "broken"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    broken.append_batch(rows, "x-0")
    n = broken.messages().count()
    broken.append_batch(rows, "x-0")
    assert broken.messages().count() == n
    shutil.rmtree(tmp_path / "broken" / "manifest")
    broken.append_batch(rows, "x-0")
    assert broken.messages().count() == n
    broken.append_batch(rows, "x-1")
    assert broken.messages().count() == 2 * n and broken.messages().select("topic", "seq").distinct().count() == 2 * n
    with pytest.raises(Exception, match="shape"):
        broken.append_batch(rows.withColumn("shape", F.array(F.lit(9))), "x-2")


def test_stream_positions_over_pieces_of_a_batch(spark, tmp_path):
    rows = [("a", 0, 100.0 - i, str(i), [1], [float(i)]) for i in range(100)]
    spark.createDataFrame(rows, "topic string, seq long, ts double, name string, shape array<int>, data array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for a, b, c, want in ((0, 5, 1, [1, 2, 3, 4, 5]), (95, None, 2, [96, 98, 100])):
            pipe = stream.source_pipeline(streamed(spark, tmp_path / "in")).index_range(a, b, c)
            pipe.to_parquet(str(tmp_path / f"out{a}"), str(tmp_path / f"cp{a}"), partition=False)
            assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / f"out{a}")).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_reading_again_from_where_it_broke_off(spark, tmp_path):
    batches(spark, tmp_path / "in")
    pipe = stream.source_pipeline(spark.read.parquet(str(tmp_path / "in")))
    kept, token, seen = {}, stream.CancellationToken(), []
    got = []
    with pytest.raises(stream.PipelineCancelled):
        for r in pipe.iter_messages(token, seen.append, kept, 2):
            got.append(r.name)
            if len(got) == 9:
                token.cancel()
    got += [r.name for r in pipe.iter_messages(checkpoint=kept)]
    assert sorted(got) == sorted(f"{t}{i}" for t in "ab" for i in range(12)) and [p.processed for p in seen] == [2, 4, 6, 8] and kept["processed"] == 24
    done = []
    assert list(pipe.iter_messages(None, done.append, kept)) == [] and done[-1].done and done[-1].processed == 24


def test_cancel(spark, tmp_path):
    batches(spark, tmp_path / "in")
    token = stream.CancellationToken()
    token.cancel()
    with pytest.raises(stream.PipelineCancelled):
        stream.source_pipeline(streamed(spark, tmp_path / "in")).to_buffer(str(tmp_path / "out"), str(tmp_path / "cp"), token=token, available_now=False)
    stream.source_pipeline(streamed(spark, tmp_path / "in")).to_buffer(str(tmp_path / "out"), str(tmp_path / "cp"))
    assert Store(spark, str(tmp_path / "out")).messages().count() == 24
    assert stream.is_cancelled(lambda: True) and not stream.is_cancelled(None)


def test_rolling_state_and_pairs(spark, tmp_path):
    batches(spark, tmp_path / "in")
    q = stream.source_pipeline(streamed(spark, tmp_path / "in")).latest(3).writeStream.format("memory").queryName("latest_rows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.topic: [x.name for x in r.rows] for r in spark.table("latest_rows").collect()}
    assert set(last) == {"a", "b"}
    q = stream.source_pipeline(streamed(spark, tmp_path / "in")).nearest_topic_pairs("a", "b", 0.5, "1 second").writeStream.format("memory").queryName("pair_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    pairs = {r.reference_name: r.target_name for r in spark.table("pair_rows").collect()}
    assert pairs and all(k[1:] == x[1:] for k, x in pairs.items())
    batch = stream.source_pipeline(spark.read.parquet(str(tmp_path / "in"))).nearest_topic_pairs("a", "b", 0.5)
    assert batch.count() == 12
    got = spark.createDataFrame([([{"ts": 1.0}, {"ts": 3.0}],)], "w array<struct<ts: double>>").select(stream.nearest_buffered(F.col("w"), F.lit(2.0))["ts"].alias("t")).first().t
    assert got == 1.0
    assert summary.describe_dataset(spark.read.parquet(str(tmp_path / "in"))).count() == 2


def test_natural_order_of_long_numbers(spark):
    from stratawave.sources.sources import natural_key

    names = ["f2.png", "f10.png", "f" + "9" * 21 + ".png", "f1" + "0" * 21 + ".png", "f1" + "0" * 20 + "1.png"]
    got = [r.name for r in spark.createDataFrame([(n,) for n in names], "name string").orderBy(natural_key(F.col("name"))).collect()]
    assert got == sorted(names, key=lambda n: int(n[1:-4]))
