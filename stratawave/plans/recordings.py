"""Queries over recordings, image files and elevation tiles.

The test tables hold no files, so each query writes its own from the whole ``embeddings``
table, by tasks, into the shared folder, and reads them back through the sources.
"""

from __future__ import annotations

import math
import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.plans.sensor import query, r6
from stratawave.session import cut, removed, shared_dir, table
from stratawave.sources import sources
from stratawave.sources.png import encode_png

#: Kinds of messages, told by vec_id modulo their number; the last one has no decoder.
KINDS = ("sensor_msgs/msg/Imu", "nav_msgs/msg/Odometry", "sensor_msgs/msg/NavSatFix", "sensor_msgs/msg/Image", "geometry_msgs/msg/PoseStamped", "geometry_msgs/msg/Pose", "sensor_msgs/msg/PointCloud2", "std_msgs/msg/String")
#: Rows of one written file; every so many rows one payload is cut off.
FILE_ROWS, BROKEN = 4000, 53


class Writer:
    """Bytes of a message: aligned behind a header of four bytes, or packed as bags have it."""

    def __init__(self, packed: bool):
        self.packed, self.out = packed, bytearray() if packed else bytearray(b"\0\1\0\0")

    def put(self, kind: str, *values) -> "Writer":
        size = struct.calcsize(kind)
        if not self.packed:
            self.out += b"\0" * (-(len(self.out) - 4) % size)
        self.out += struct.pack(f"<{len(values)}{kind}", *values)
        return self

    def text(self, value: str) -> "Writer":
        raw = value.encode() + (b"" if self.packed else b"\0")
        self.put("I", len(raw)).out.extend(raw)
        return self

    def header(self, ts: float, frame: str) -> "Writer":
        if self.packed:
            self.put("I", 0)
        whole = math.floor(ts)
        return self.put("I", whole, round((ts - whole) * 1e9)).text(frame)


def covariance(size: int, *diagonals) -> list[float]:
    out = np.zeros((size, size))
    np.fill_diagonal(out, np.concatenate(diagonals))
    return out.ravel().tolist()


def encoded(kind: int, ts: float, e: np.ndarray, packed: bool) -> bytes:
    """A message of a kind whose values are those of an embedding."""
    w, x = Writer(packed), e.tolist()
    if kind == 5:
        return bytes(w.put("d", *x[:7]).out)
    w.header(ts, "base")
    if kind == 0:
        for values, spread in ((x[:4], x[4:7]), (x[8:11], x[12:15]), (x[16:19], x[20:23])):
            w.put("d", *values, *covariance(3, spread))
    elif kind == 1:
        w.text("wheels").put("d", *x[:3], *x[8:12], *covariance(6, x[4:7], x[12:15]), *x[16:19], *x[24:27], *covariance(6, x[20:23], x[28:31]))
    elif kind == 2:
        w.put("b", 0).put("H", 1).put("d", *x[:3], *covariance(3, [0.0] * 3)).put("B", 0)
    elif kind == 3:
        pixels = np.floor((e + 1) * 100).clip(0, 255).astype(np.uint8).reshape(8, 8)
        padded = np.hstack([pixels, np.zeros((8, 2), np.uint8)]).tobytes()
        w.put("I", 8, 8).text("mono8").put("B", 0).put("I", 10, len(padded)).out.extend(padded)
    elif kind == 4:
        w.put("d", *x[:7])
    elif kind == 6:
        points = e[:63].astype("<f4").tobytes()
        w.put("I", 1, 21, 3)
        for i, name in enumerate("xyz"):
            w.text(name).put("I", 4 * i).put("B", 7).put("I", 1)
        w.put("B", 0).put("I", 12, 252, len(points)).out.extend(points)
    else:
        w.text("text")
    return bytes(w.out)


def write_sqlite(path: str, rows: list[tuple]) -> None:
    topics = sorted({(t, k) for t, k, _, _ in rows})
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(i, *t) for i, t in enumerate(topics)])
        db.executemany("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", [(topics.index((t, k)), nanos, raw) for t, k, nanos, raw in rows])
    db.close()


def mcap_record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


def short(value: str) -> bytes:
    return struct.pack("<I", len(value)) + value.encode()


def write_mcap(path: str, rows: list[tuple], compression: str = "zstd", chunk_rows: int = 500, encoding: str = "cdr") -> None:
    """A file of chunks, of which only the first names the channels."""
    import pyarrow as pa
    import zstandard

    topics = sorted({(t, k) for t, k, _, _ in rows})
    known = b"".join(mcap_record(3, struct.pack("<H", i + 1) + short(k) + short("ros2msg") + struct.pack("<I", 0)) + mcap_record(4, struct.pack("<HH", i, i + 1) + short(t) + short(encoding) + struct.pack("<I", 0)) for i, (t, k) in enumerate(topics))
    with open(path, "wb") as f:
        f.write(b"\x89MCAP0\r\n" + mcap_record(1, short("") + short("")))
        for a in range(0, max(len(rows), 1), chunk_rows):
            data = known if a == 0 else b""
            data += b"".join(mcap_record(5, struct.pack("<HIQQ", topics.index((t, k)), n, nanos, nanos) + raw) for n, (t, k, nanos, raw) in enumerate(rows[a : a + chunk_rows]))
            packed = {"zstd": lambda d: zstandard.ZstdCompressor().compress(d), "lz4": lambda d: pa.compress(d, codec="lz4", asbytes=True), "": lambda d: d}[compression](data)
            f.write(mcap_record(6, struct.pack("<QQQI", 0, 0, len(data), 0) + short(compression) + struct.pack("<Q", len(packed)) + packed))
        f.write(mcap_record(15, struct.pack("<I", 0)) + mcap_record(2, b"\0" * 20) + b"\x89MCAP0\r\n")


def bag_head(**fields: bytes) -> bytes:
    out = b"".join(struct.pack("<I", len(k) + 1 + len(x)) + k.encode() + b"=" + x for k, x in fields.items())
    return struct.pack("<I", len(out)) + out


def bag_part(head: bytes, body: bytes) -> bytes:
    return head + struct.pack("<I", len(body)) + body


def write_bag(path: str, rows: list[tuple], compression: str = "bz2", chunk_rows: int = 500) -> None:
    import bz2

    topics = sorted({(t, k.replace("/msg/", "/")) for t, k, _, _ in rows})
    number = {t: struct.pack("<I", i) for i, t in enumerate(topics)}
    connections = b"".join(bag_part(bag_head(op=b"\7", conn=n, topic=t.encode()), bag_head(topic=t.encode(), type=k.encode(), md5sum=b"0", message_definition=b"")[4:]) for (t, k), n in number.items())
    with open(path, "wb") as f:
        f.write(b"#ROSBAG V2.0\n" + bag_part(bag_head(op=b"\3"), b" " * 64))
        for a in range(0, max(len(rows), 1), chunk_rows):
            data = connections if a == 0 else b""
            for t, k, nanos, raw in rows[a : a + chunk_rows]:
                data += bag_part(bag_head(op=b"\2", conn=number[t, k.replace("/msg/", "/")], time=struct.pack("<II", *divmod(nanos, 10**9))), raw)
            f.write(bag_part(bag_head(op=b"\5", compression=compression.encode(), size=struct.pack("<I", len(data))), bz2.compress(data) if compression == "bz2" else data))
        f.write(connections)


def local(uri: str) -> str:
    """The path of a shared folder as files are opened; recordings are read from mounted folders."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return uri
    if scheme != "file":
        raise ValueError("recordings are read from a mounted folder")
    return "/" + rest.lstrip("/")


def written(spark: SparkSession, sf_dir: str, write, group) -> str:
    """A new shared folder into which ``write(folder, number, frame)`` has put files, one group of vec_id, embedding and label each."""
    folder = local(f"{shared_dir(spark)}/files-{uuid.uuid4().hex}")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).withColumn("part", group)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        write(folder, key[0], frame.sort_values("vec_id"))
        return pd.DataFrame({"part": [key[0]]})

    e.groupBy("part").applyInPandas(run, "part long").write.format("noop").mode("overwrite").save()
    return folder


def write_recordings(folder: str, number: int, frame: pd.DataFrame) -> None:
    packed = number % 3 == 2
    rows = []
    for i, label, e in zip(frame["vec_id"], frame["label"], frame["embedding"]):
        kind = int(i) % len(KINDS)
        raw = encoded(kind, i + 0.25, np.asarray(e, float), packed)
        rows.append((f"/{label}/{kind}", KINDS[kind], int(i * 1e9) + 250_000_000, raw[:9] if i % BROKEN == 0 else raw))
    suffix, write = ((".db3", write_sqlite), (".mcap", write_mcap), (".bag", write_bag))[number % 3]
    write(f"{folder}/.{number}{suffix}", rows)
    os.replace(f"{folder}/.{number}{suffix}", f"{folder}/{number}{suffix}")


def parts_of_files() -> F.Column:
    """Files of FILE_ROWS rows at most, in three formats."""
    return F.floor(F.col("vec_id") / FILE_ROWS) * 3 + F.pmod(F.col("vec_id"), F.lit(3))


ROWS = f"rows AS (SELECT vec_id, label, CAST(vec_id % {len(KINDS)} AS INT) AS kind, vec_id % 3 AS packing, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(f"""WITH {ROWS}, values AS (
  SELECT vec_id, label, kind, ['Imu', 'Odometry', 'NavSatFix', 'Image', 'PoseStamped', 'Pose', 'PointCloud2'][kind + 1] AS name,
    CASE kind WHEN 0 THEN list_concat(e[1:7], [0.0], e[9:11], [0.0], e[13:15], [0.0], e[17:19], [0.0], e[21:23], [0.0]) WHEN 1 THEN list_concat(e[1:3], [0.0], e[5:7], [0.0], e[9:15], [0.0], e[17:19], [0.0], e[21:23], [0.0], e[25:27], [0.0], e[29:31], [0.0])
      WHEN 2 THEN e[1:3] WHEN 3 THEN list_transform(e, lambda x: floor((x + 1) * 100)) WHEN 6 THEN e[1:63] ELSE e[1:7] END AS d
  FROM rows WHERE kind < 7 AND vec_id % {BROKEN} <> 0)
SELECT CAST(vec_id AS BIGINT) AS vec_id, '/' || label || '/' || kind AS topic, row_number() OVER (PARTITION BY label, kind ORDER BY vec_id) - 1 AS place, name, CAST(len(d) AS BIGINT) AS n, round(list_sum(d), 6) AS total, round(d[len(d)], 6) AS last FROM values""")
def recorded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of seven kinds in three formats, as they are read back."""
    from stratawave.operators.order import positions

    folder = written(spark, sf_dir, write_recordings, parts_of_files())
    m = sources.data_source(spark, folder)
    placed = positions(m.select("topic", F.round(F.col("ts") - 0.25).cast("long").alias("vec_id"), "name", "data"), ["topic"], ["vec_id"], "place")
    found = cut(placed.select("vec_id", "topic", "place", "name", F.size("data").cast("long").alias("n"), r6(F.aggregate("data", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.element_at("data", -1)).alias("last")))
    removed(spark, folder)
    return found


@query(f"""WITH {ROWS} SELECT '/' || label || '/' || kind AS topic, count(*) AS count FROM rows WHERE kind = 7 OR vec_id % {BROKEN} = 0 GROUP BY 1""")
def recorded_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that no decoder could read, counted."""
    folder = written(spark, sf_dir, write_recordings, parts_of_files())
    found = cut(sources.undecoded(spark, folder).groupBy("topic").agg(F.sum("count").alias("count")))
    removed(spark, folder)
    return found


@query(f"""WITH {ROWS} SELECT '/' || label || '/' || kind AS topic, count(*) AS count, min(vec_id) + 0.25::DOUBLE AS start_time, max(vec_id) + 0.25::DOUBLE AS end_time FROM rows GROUP BY 1""")
def recorded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the recordings, from the files themselves."""
    folder = written(spark, sf_dir, write_recordings, parts_of_files())
    found = sources.recording_metadata(folder).groupby("topic", as_index=False).agg({"count": "sum", "start_time": "min", "end_time": "max"})
    removed(spark, folder)
    return spark.createDataFrame(found, "topic string, count long, start_time double, end_time double")  # one row for each topic


def write_pictures(folder: str, number: int, frame: pd.DataFrame) -> None:
    for i, e in zip(frame["vec_id"], frame["embedding"]):
        with open(f"{folder}/frame_{i}.png", "wb") as f:
            f.write(encode_png(np.floor((np.asarray(e) + 1) * 100).clip(0, 255).astype(np.uint8).reshape(8, 8)))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS seq, 'frame_' || vec_id || '.png' AS name, 'uint8' AS dtype, list_sum(list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 100))) AS total FROM embeddings")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files in the natural order of their names."""
    folder = written(spark, sf_dir, write_pictures, F.floor(F.col("vec_id") / FILE_ROWS))
    m = sources.data_source(spark, f"{folder}/*.png")
    found = cut(m.select("seq", "name", "dtype", F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total")))
    removed(spark, folder)
    return found


def write_bitmaps(folder: str, number: int, frame: pd.DataFrame) -> None:
    """Bitmaps of 24 bits, rows from below, in the order blue, green, red."""
    for i, e in zip(frame["vec_id"], frame["embedding"]):
        v = np.floor((np.asarray(e, float) + 1) * 100).clip(0, 255).astype(np.uint8).reshape(8, 8)
        body = np.dstack([v, v // 2, np.full_like(v, 7)])[::-1].tobytes()
        with open(f"{folder}/b{i}.bmp", "wb") as f:
            f.write(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 100)) AS v FROM embeddings) SELECT row_number() OVER (ORDER BY vec_id) - 1 AS seq, 'b' || vec_id || '.bmp' AS name, v[1] AS blue, floor(v[2] / 2) AS green, 7.0::DOUBLE AS red, list_sum(v) + list_sum(list_transform(v, lambda x: floor(x / 2))) + 448 AS total FROM v")
def bitmap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files that the JVM decodes."""
    folder = written(spark, sf_dir, write_bitmaps, F.floor(F.col("vec_id") / FILE_ROWS))
    m = sources.data_source(spark, f"{folder}/*.bmp")
    value = lambda i: F.get("data", F.lit(i))
    found = cut(m.select("seq", "name", value(0).alias("blue"), value(4).alias("green"), value(5).alias("red"), F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total")))
    removed(spark, folder)
    return found


def write_tiles(folder: str, number: int, frame: pd.DataFrame) -> None:
    for i, e in zip(frame["vec_id"], frame["embedding"]):
        with open(f"{folder}/N{i // 1000:02d}W{i % 1000:03d}.hgt", "wb") as f:
            f.write(np.floor(np.asarray(e) * 1000).astype(">i2").tobytes())


@query("WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000)) AS z FROM embeddings) SELECT format('N{:02d}W{:03d}', vec_id // 1000, vec_id % 1000) AS name, list_sum(z) AS total, z[9] AS second_row FROM t WHERE vec_id % 1000 >= 100")
def elevation_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation tiles within bounds, from files."""
    folder = written(spark, sf_dir, write_tiles, F.floor(F.col("vec_id") / FILE_ROWS))
    most = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    m = sources.data_source(spark, "DEM", bounds=((0, most // 1000 + 1), (100, 1000)), cache_dir=folder)
    found = cut(m.select("name", F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"), F.get("data", F.lit(8)).alias("second_row")))
    removed(spark, folder)
    return found


@query("""WITH t AS (SELECT CAST(i AS BIGINT) AS seq, i / 20.0 AS ts, i / 20.0 * 2 * pi() / 10 AS a FROM range(201) r(i))
SELECT '/odom' AS topic, seq, ts::DOUBLE AS ts, 'odometry_' || seq AS name, round(7 * cos(a), 6) AS x, round(7 * sin(a), 6) AS y FROM t
UNION ALL SELECT '/level', seq, ts::DOUBLE, 'scalar_' || seq, round(sin(a), 6), NULL FROM t""")
def synthetic_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drive around a circle."""
    topics = [{"name": "/odom", "kind": "odometry", "rate": 20.0}, {"name": "/level", "kind": "scalar", "rate": 20.0}]
    m = sources.synthetic(spark, topics, duration=10.0, radius=7.0)
    return m.select("topic", "seq", "ts", "name", r6(F.get("data", F.lit(0))).alias("x"), r6(F.get("data", F.lit(1))).alias("y"))
