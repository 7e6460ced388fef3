"""Recordings, images, elevation tiles and synthetic drives as DataFrames in the message model."""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratawave.functions import geodesy
from stratawave.schema import normalize_messages
from stratawave.session import cut, importable
from stratawave.sources import containers
from stratawave.sources.messages import decode_supported_cdr_message
from stratawave.sources.png import decode_image

RECORDED = "topic string, chunk int, row long, ts double, name string, frame_id string, source_uri string, dtype string, shape array<int>, data array<double>, extra map<string,string>, error string"
#: Image files decoded here in any depth, and those that the JVM's own readers decode, of 8 bits.
OWN_IMAGES, JVM_IMAGES = (".png", ".pgm", ".ppm"), (".jpg", ".jpeg", ".bmp", ".gif")
IMAGES, RECORDINGS = OWN_IMAGES + JVM_IMAGES, (".db3", ".mcap", ".bag")


def is_rosbag2_dir(path: str) -> bool:
    """True for a folder with metadata.yaml or any file of a recording."""
    p = Path(path)
    return p.is_dir() and ((p / "metadata.yaml").exists() or any(f.suffix in RECORDINGS for f in p.iterdir()))


def chunk_paths(path: str) -> list[str]:
    """The recording's files in order: those that metadata.yaml lists and that exist, else all of the folder.

    A single file that a metadata.yaml beside it does not list is that file alone.
    """
    p = Path(path)
    folder = p if p.is_dir() else p.parent
    meta, listed = folder / "metadata.yaml", []
    if meta.exists():
        for line in meta.read_text(errors="replace").splitlines():
            if m := re.fullmatch(r"\s*-\s*(['\"]?)(.+?\.(?:db3|mcap))\1\s*", line):
                listed.append(str(folder / m[2].replace("''", "'")))
        listed = [f for f in listed if os.path.exists(f)]
    if p.is_file():
        return listed if str(p) in listed else [str(p)]
    return listed or sorted(str(f) for f in p.iterdir() if f.suffix in RECORDINGS)


class Chunk(InputPartition):
    def __init__(self, path: str, chunk: int, first: int, last: int):
        self.path, self.chunk, self.first, self.last = path, chunk, first, last


class RecordingReader(DataSourceReader):
    """One partition for each part of a file, so that a large file is read by many tasks."""

    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("rowsPerPartition", 100_000))

    def partitions(self) -> list[Chunk]:
        return [Chunk(path, i, a, b) for i, path in enumerate(chunk_paths(self.path)) for a, b in containers.parts(path, self.per)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for number, nanos, topic, kind, raw, cursor in containers.read(partition.path, partition.first, partition.last):
            try:
                m, wrong = decode_supported_cdr_message(raw, kind, cursor), "no decoder for this type"
            except (ValueError, struct.error, KeyError, IndexError, TypeError) as e:
                m, wrong = None, f"{type(e).__name__}: {e}"
            at = (partition.chunk, number)
            if m is None:  # a payload that can't be decoded does not spoil the recording, and is told
                yield topic, *at, nanos * 1e-9, kind, None, partition.path, None, None, None, None, wrong
            else:
                yield topic, *at, m["timestamp"] or nanos * 1e-9, m["name"], m["frame_id"], partition.path, m["dtype"], m["shape"], m["data"].tolist(), m["extra"], None


class Recording(DataSource):
    """``spark.read.format("stratawave_recording").load(path)``: a recording's file or folder; rows that can't be decoded have an ``error``."""

    @classmethod
    def name(cls) -> str:
        return "stratawave_recording"

    def schema(self) -> str:
        return RECORDED

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def recorded(spark: SparkSession, path: str, rows_per_partition: int) -> DataFrame:
    importable(spark)
    spark.dataSource.register(Recording)
    return spark.read.format("stratawave_recording").option("rowsPerPartition", str(rows_per_partition)).load(path)


def read_recording(spark: SparkSession, path: str, rows_per_partition: int = 100_000) -> DataFrame:
    """Messages of a recording with seq by (chunk, time, row) in each topic; those that can't be decoded are counted by :func:`undecoded`."""
    from stratawave.operators.order import positions

    raw = recorded(spark, path, rows_per_partition).filter("error IS NULL")
    placed = positions(raw, ["topic"], ["chunk", "ts", "row"], "seq")
    return placed.select("topic", "seq", "ts", "name", "frame_id", "source_uri", "dtype", "shape", "data", "extra")


def undecoded(spark: SparkSession, path: str, rows_per_partition: int = 100_000) -> DataFrame:
    """Messages of a recording that :func:`read_recording` leaves out: topic, type, error, count."""
    wrong = recorded(spark, path, rows_per_partition).filter("error IS NOT NULL")
    return wrong.groupBy("topic", F.col("name").alias("type"), "error").agg(F.count(F.lit(1)).alias("count"))


def recording_metadata(path: str) -> pd.DataFrame:
    """Topic, type, count, first and last time of a recording, counted inside the files, summed over chunks."""
    found = [row for file in chunk_paths(path) for row in containers.listing(file)]
    frame = pd.DataFrame(found, columns=["topic", "type", "count", "start_time", "end_time"])
    return frame.groupby(["topic", "type"], as_index=False).agg({"count": "sum", "start_time": "min", "end_time": "max"})


def natural_key(name: F.Column) -> F.Column:
    """A text that sorts names by the numbers in them: every run of digits, without leading zeros, comes behind its length."""
    split = F.split(F.regexp_replace(name, r"(\d+)", "\x01$1\x01"), "\x01")
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(split, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)), "")


def read_images(spark: SparkSession, pattern: str, period: float = 0.1) -> DataFrame:
    """Image files as messages of topic ``images``, in the natural order of their names, ``period`` seconds apart; a file that is no image is an error.

    Colours come in the order blue, green, red (and alpha).
    """
    from stratawave.operators.order import positions

    importable(spark)
    suffixes = lambda kinds: F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*kinds)
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    named = files.select("path").withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("sort_key", natural_key(F.col("name")))
    ordered = cut(positions(named.withColumn("topic", F.lit("images")), ["topic"], ["sort_key", "name"], "seq"))
    heads = ["topic", "seq", (F.col("seq") * period).alias("ts"), "name", F.lit(None).cast("string").alias("frame_id"), F.col("path").alias("source_uri")]
    schema = "topic string, seq long, ts double, name string, frame_id string, source_uri string, dtype string, shape array<int>, data array<double>"

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(ordered, "path").select(*heads, *(c for c in rows.columns if c != "path"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [decode_image(bytes(c)) for c in batch["content"]]
            images = [im[:, :, [2, 1, 0, 3][: im.shape[2]]] if im.ndim == 3 and im.shape[2] >= 3 else im for im in images]
            yield batch.drop(columns="content").assign(dtype=[im.dtype.name for im in images], shape=[list(im.shape) for im in images], data=[im.ravel().astype(float) for im in images])

    def jvm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=["content", "height", "width", "channels"])
            shapes = [[int(h), int(w)] + ([int(c)] if c > 1 else []) for h, w, c in zip(batch["height"], batch["width"], batch["channels"])]
            yield out.assign(dtype="uint8", shape=shapes, data=[np.frombuffer(bytes(c), np.uint8).astype(float) for c in batch["content"]])

    out = placed(files.filter(~suffixes(JVM_IMAGES))).mapInPandas(own, schema)
    if not ordered.filter(suffixes(JVM_IMAGES)).take(1):
        return out
    # the reader of images names its files as encoded addresses
    address = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    decoded = spark.read.format("image").load(pattern).select("image.*").withColumn("path", F.regexp_replace(address, "^file:/+", "file:/"))
    wrong = F.raise_error(F.concat(F.lit("no image: "), F.col("origin"))).cast("binary")
    content = F.when(F.col("height") < 0, wrong).otherwise(F.col("data"))
    return out.unionByName(placed(decoded.filter(suffixes(JVM_IMAGES)).select("path", content.alias("content"), "height", "width", F.col("nChannels").alias("channels"))).mapInPandas(jvm, schema))


def decode_hgt(raw: bytes) -> np.ndarray:
    """A square grid of big-endian 16-bit elevations."""
    side = int(round(np.sqrt(len(raw) / 2)))
    if side * side * 2 != len(raw):
        raise ValueError("not a square tile of 16-bit elevations")
    return np.frombuffer(raw, ">i2").reshape(side, side)


def read_hgt(spark: SparkSession, folder: str, bounds: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """Elevation tiles of a folder as messages of topic ``images`` at time 0, one for each tile; ``bounds`` are half-open degrees ((north, north), (west, west)) as in the tiles' names. Nothing is downloaded."""
    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(folder).withColumn("name", F.regexp_extract("path", r"([^/]+)\.hgt$", 1))
    if bounds is not None:
        names = [f"N{n:02d}W{w:03d}" for n in range(bounds[0][0], bounds[0][-1]) for w in range(bounds[1][0], bounds[1][-1])]
        files = files.filter(F.col("name").isin(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tiles = [decode_hgt(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"topic": "images", "ts": 0.0, "name": batch["name"], "source_uri": batch["path"], "dtype": "int16", "shape": [list(t.shape) for t in tiles], "data": [t.ravel().astype(float) for t in tiles]})

    decoded = files.select("path", "name", "content").mapInPandas(run, "topic string, ts double, name string, source_uri string, dtype string, shape array<int>, data array<double>")
    return normalize_messages(decoded)


#: A drive of odometry, IMU and scans.
DEFAULT_TOPICS = ({"name": "/imu", "kind": "imu", "rate": 50.0}, {"name": "/odom", "kind": "odometry", "rate": 20.0}, {"name": "/points", "kind": "pointcloud", "rate": 5.0})
KINDS = {"imu": "imu_link", "odometry": "odom", "pointcloud": "lidar", "navsat": "gps", "image": "camera", "scalar": None}


def synthetic(spark: SparkSession, topics: Sequence[dict] | None = None, duration: float = 5.0, radius: float = 10.0, seed: int = 0) -> DataFrame:
    """A device that drives once around a circle and observes fixed landmarks; equal arguments give equal messages.

    A topic has name, kind (imu, odometry, pointcloud, navsat, image, scalar) and rate, and
    may have points (of a scan), max_range and shape (of an image). A topic has
    floor(duration · rate) + 1 messages, named kind_number. All kinds but scans and images
    are expressions over a range; each scan's noise comes from the seed and its own
    number, so scans are made in parallel.
    """
    importable(spark)
    topics = [dict(t) for t in (DEFAULT_TOPICS if topics is None else topics)]
    if duration <= 0 or radius <= 0:
        raise ValueError("duration and radius are above 0")
    out = None
    for t in topics:
        kind = t.setdefault("kind", "scalar")
        if kind not in KINDS or t.get("rate", 0) <= 0 or "name" not in t:
            raise ValueError("a topic has a name, a known kind and a rate above 0")
        df = synthetic_topic(spark, t, kind, duration, radius, seed)
        out = df if out is None else out.unionByName(df)
    return out


def synthetic_topic(spark: SparkSession, topic: dict, kind: str, duration: float, radius: float, seed: int) -> DataFrame:
    count = int(np.floor(duration * topic["rate"])) + 1
    turn = 2 * np.pi / duration
    seq, ts = F.col("id"), F.col("id") / float(topic["rate"])
    angle = ts * turn
    x, y = radius * F.cos(angle), radius * F.sin(angle)
    half = (angle + np.pi / 2) / 2
    attitude = [F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)]
    row = lambda *values: [*(F.lit(float(k)) if not isinstance(k, F.Column) else k for k in values), *[F.lit(0.0)] * (4 - len(values))]
    tight, loose, speed = row(1e-6, 1e-6, 1e-6), row(1e-4, 1e-4, 1e-4), radius * turn
    shape = {"imu": [6, 4], "odometry": [8, 4], "navsat": [3], "scalar": [1], "image": list(topic.get("shape", (32, 48))), "pointcloud": [int(topic.get("points", 120)), 3]}[kind]
    base = spark.range(count).select(
        F.lit(topic["name"]).alias("topic"), seq.alias("seq"), ts.alias("ts"), F.concat(F.lit(f"{kind}_"), seq.cast("string")).alias("name"), F.lit(KINDS[kind]).cast("string").alias("frame_id"),
        F.lit(f"synthetic://seed={seed}").alias("source_uri"), F.lit("float64").alias("dtype"), F.array(*map(F.lit, shape)).alias("shape"), "id",
    )
    if kind in ("pointcloud", "image"):
        return base.drop("id").mapInPandas(drawn(topic, kind, shape, duration, radius, seed), "topic string, seq long, ts double, name string, frame_id string, source_uri string, dtype string, shape array<int>, data array<double>")
    data = {
        "imu": [*attitude, *tight, *row(0, 0, turn), *tight, *row(0, speed * turn, 9.81), *loose],
        "odometry": [*row(x, y, 0), *loose, *attitude, *tight, *row(speed), *loose, *row(0, 0, turn), *tight],
        "navsat": geodesy.enu_to_navsat([x, y, F.lit(0.0)], 37.0, -122.0, 10.0),
        "scalar": [F.sin(angle)],
    }[kind]
    return base.withColumn("data", F.array(*data)).drop("id")


def landmarks(radius: float, seed: int) -> np.ndarray:
    """Fixed places that every scan observes."""
    rng = np.random.default_rng([seed, 1])
    return np.column_stack([rng.uniform(-1.5 * radius, 1.5 * radius, (160, 2)), rng.uniform(0, 2, 160)])


def drawn(topic: dict, kind: str, shape: list[int], duration: float, radius: float, seed: int):
    places, turn = landmarks(radius, seed), 2 * np.pi / duration
    far = float(topic.get("max_range", 2 * radius))

    def scan(seq: int, ts: float) -> np.ndarray:
        angle = turn * ts
        yaw = angle + np.pi / 2
        off = places - np.array([radius * np.cos(angle), radius * np.sin(angle), 0.0])
        own = np.column_stack([off[:, 0] * np.cos(yaw) + off[:, 1] * np.sin(yaw), off[:, 1] * np.cos(yaw) - off[:, 0] * np.sin(yaw), off[:, 2]])
        seen = own[np.hypot(own[:, 0], own[:, 1]) <= far][: shape[0]]
        out = np.zeros(shape)
        out[: len(seen)] = seen + np.random.default_rng([seed, 2, seq]).normal(0, 0.01, seen.shape)
        return out

    def picture(ts: float) -> np.ndarray:
        out = np.linspace(0, 1, shape[0])[:, None] * np.linspace(0, 1, shape[1])
        out[:, int(ts / duration * (shape[1] - 1))] = 2.0
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[(scan(int(s), t) if kind == "pointcloud" else picture(t)).ravel() for s, t in zip(batch["seq"], batch["ts"])])

    return run


def data_source(spark: SparkSession, data_path: str, period: float = 0.1, bounds=None, cache_dir: str | None = None) -> DataFrame:
    """Messages of any supported source, told by its path: a recording's folder or file (sqlite, MCAP or bag, whatever its suffix), image files, ``DEM``, or stored topics in Parquet."""
    if data_path == "DEM":
        if cache_dir is None:
            raise ValueError("elevation tiles are read from cache_dir")
        return read_hgt(spark, cache_dir, bounds)
    p = Path(data_path)
    if is_rosbag2_dir(data_path):
        return read_recording(spark, data_path)
    if p.is_file() and containers.kind_of(data_path):
        return read_recording(spark, data_path)
    if p.suffix.lower() in IMAGES or any(data_path.lower().endswith(s) for s in IMAGES):
        if not glob.glob(data_path):
            raise FileNotFoundError(data_path)
        return read_images(spark, data_path, period)
    if p.is_dir() and any(p.rglob("*.parquet")):
        return normalize_messages(spark.read.parquet(data_path))
    if not p.exists():
        raise FileNotFoundError(data_path)
    raise ValueError(f"unknown kind of source: {data_path}")
