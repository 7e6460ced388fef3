"""Stores of messages: Parquet partitioned by topic with a manifest, or the last rows in memory."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawave.operators.order import positions, same
from stratawave.operators.topic import Dataset, Topic
from stratawave.schema import BOUNDS, MESSAGE, normalize_messages, spatial_bounds_for_data, topic_metadata
from stratawave.session import cut

MANIFEST = "topic string, count long, closed boolean, name string, frame_id string, shape array<int>, dtype string, written_at timestamp, batch string"


class Store:
    """Messages below ``path``: data/topic=.../*.parquet and a manifest of append-only revisions.

    Topics are percent-encoded by Spark in the partition's name, so no two topics collide.
    Rows carry the bounding box of their payload, rows of a file are sorted by time, and
    files are compressed with zstd: time, topic and box filters prune row groups.
    """

    def __init__(self, spark: SparkSession, path: str, row_group_bytes: int = 32 << 20):
        self.spark, self.path, self.row_group_bytes = spark, path.rstrip("/"), row_group_bytes

    def exists(self, part: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        """The newest revision of each topic."""
        if not self.exists("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        newest = F.max_by(F.struct(*[c for c in rows.columns if c != "topic"]), F.struct("written_at", "count"))
        return rows.groupBy("topic").agg(newest.alias("m")).select("topic", "m.*")

    def append(self, messages: DataFrame, closed: bool | None = None) -> None:
        """Add messages behind those stored; seq goes on from the count of the manifest.

        Rows are a continuation unless they carry a seq below the stored count, which is
        skipped: writing a source again after a break stores each of its rows once. A
        payload whose shape differs from the topic's first is an error.
        """
        df = normalize_messages(messages)
        known = self.manifest().select("topic", F.col("count").alias("stored"), F.col("shape").alias("own_shape"))
        if "seq" not in messages.columns:
            a, b = df.alias("a"), known.alias("b")
            df = a.join(b, same("a", "b", ["topic"]), "left").select(*((F.col("a.seq") + F.coalesce("b.stored", F.lit(0))).alias("seq") if c == "seq" else F.col(f"a.`{c}`") for c in df.columns))
        a, b = df.alias("a"), known.alias("b")
        fresh = a.join(b, same("a", "b", ["topic"]), "left").filter(F.col("a.seq") >= F.coalesce("b.stored", F.lit(0))).select(*(F.col(f"a.`{c}`") for c in df.columns))
        self.write(fresh, known, None)
        self.write_manifest(closed)

    def write(self, rows: DataFrame, known: DataFrame, batch: str | None) -> None:
        """Rows in the model to files by topic, with their boxes; a payload whose shape differs from its topic's is an error."""
        a, b = rows.alias("a"), known.select("topic", "own_shape").alias("b")
        wrong = F.raise_error(F.lit("a payload's shape differs from its topic's")).cast("array<int>")
        shape = F.when(F.col("b.own_shape").isNotNull() & (F.col("b.own_shape") != F.col("a.shape")), wrong).otherwise(F.col("a.shape"))
        held = a.join(b, same("a", "b", ["topic"]), "left").select(*(shape.alias("shape") if c == "shape" else F.col(f"a.`{c}`") for c in rows.columns if c != "batch"))
        boxed = held.withColumn("box", spatial_bounds_for_data()).select(*held.columns, *(F.col(f"box.{c}") for c in BOUNDS), F.lit(batch).cast("string").alias("batch"))
        (
            boxed.repartition("topic", F.floor(F.col("seq") / 1_000_000)).sortWithinPartitions("topic", "ts", "seq")
            .write.mode("append").option("compression", "zstd").option("parquet.block.size", str(self.row_group_bytes)).partitionBy("topic").parquet(f"{self.path}/data")
        )

    def append_batch(self, messages: DataFrame, batch: str) -> None:
        """Add one batch of a stream, named so that adding it again after a break adds nothing twice.

        Rows come behind those stored, in the order of (ts, name). A batch is complete once
        the manifest names it; rows of a batch that broke off are found by its name.
        """
        manifest = self.manifest()
        if manifest.filter(F.col("batch") == batch).take(1):
            return
        known = manifest.select("topic", F.col("count").alias("stored"), F.col("shape").alias("own_shape"), F.col("frame_id").alias("own_frame"))
        model = normalize_messages(cut(messages.drop("seq"))).drop(*(c for c in messages.columns if c not in MESSAGE.names))
        a, b = model.alias("a"), known.alias("b")
        placed = a.join(b, same("a", "b", ["topic"]), "left").select(*((F.col("a.seq") + F.coalesce("b.stored", F.lit(0))).alias("seq") if c == "seq" else F.col(f"a.`{c}`") for c in model.columns))
        rows = cut(placed)
        fresh = rows
        if self.exists("data"):
            written = self.stored().filter(F.col("batch") == batch).select("topic", "seq")
            r, w = rows.alias("r"), written.alias("w")
            fresh = r.join(w, same("r", "w", ["topic", "seq"]), "left_anti")
        self.write(fresh, known, batch)
        new, k = topic_metadata(rows).join(rows.groupBy("topic").agg(F.max_by("name", "seq").alias("name")), "topic").alias("n"), known.alias("k")
        frame = F.when(F.col("k.topic").isNull() | F.col("k.own_frame").eqNullSafe(F.col("n.frame_id")), F.col("n.frame_id"))
        out = new.join(k, same("n", "k", ["topic"]), "left").select(
            "n.topic", (F.col("n.count") + F.coalesce("k.stored", F.lit(0))).alias("count"), F.lit(False).alias("closed"), "n.name", frame.alias("frame_id"),
            F.coalesce("k.own_shape", "n.shape").alias("shape"), "n.dtype", F.current_timestamp().alias("written_at"), F.lit(batch).alias("batch"),
        )
        out.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # one row for each topic

    def write_manifest(self, closed: bool | None = None, topics: Sequence[str] | None = None) -> None:
        """A new revision for each topic, counted from the stored rows."""
        if not self.exists("data"):
            return
        data = self.messages()
        last = data.groupBy("topic").agg(F.max_by("name", "seq").alias("name"))
        before = self.manifest().select("topic", F.col("closed").alias("was"))
        m, l, b = topic_metadata(data).alias("m"), last.alias("l"), before.alias("b")
        joined = m.join(l, same("m", "l", ["topic"])).join(b, same("m", "b", ["topic"]), "left")
        flag = F.lit(closed) if closed is not None else F.coalesce("b.was", F.lit(False))
        out = joined.select("m.topic", "m.count", flag.alias("closed"), "l.name", "m.frame_id", "m.shape", "m.dtype", F.current_timestamp().alias("written_at"), F.lit(None).cast("string").alias("batch"))
        if topics is not None:
            out = out.filter(F.col("topic").isin(*topics))
        out.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # one row for each topic

    def messages(self) -> DataFrame:
        return self.stored().drop("batch")

    def stored(self) -> DataFrame:
        if not self.exists("data"):
            raise FileNotFoundError(f"{self.path}/data")
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data").withColumn("topic", F.col("topic").cast("string"))

    def topic(self, name: str) -> Topic:
        return Topic(self.messages().filter(F.col("topic") == name), [name])

    def dataset(self, topics: Sequence[str] | None = None) -> Dataset:
        if topics is not None:
            known = {r.topic for r in self.manifest().select("topic").collect()}
            if missing := [t for t in topics if t not in known]:
                raise ValueError(f"unknown topics: {missing}")
            return Dataset(self.messages().filter(F.col("topic").isin(*topics)), topics)
        return Dataset(self.messages())

    def overwrite(self, name: str, changed: DataFrame) -> None:
        """Replace a topic's rows; files are immutable, so its partition is written anew beside and swapped in."""
        out = f"{self.path}/staging-{uuid.uuid4().hex}"
        changed.drop("topic").write.parquet(out)
        rows = self.spark.read.parquet(out).withColumn("topic", F.lit(name))
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.write.mode("overwrite").partitionBy("topic").parquet(f"{self.path}/data")
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(out)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.write_manifest(topics=[name])

    def compact(self, target_bytes: int = 256 << 20) -> DataFrame:
        """Few large files for each topic, by copying encoded blocks; the report of the consolidation.

        A file that can't be copied is an error, and the store stays as it was; so it does
        where the new folder can't be put in place. What is no topic's folder moves along.
        """
        from stratawave.operators.consolidate import consolidate

        out, fs_path = f"{self.path}/data-{uuid.uuid4().hex}", self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        report = consolidate(self.spark, f"{self.path}/data", out, target_bytes, by_folder=True)
        if refused := report.filter("refused IS NOT NULL").first():
            fs.delete(fs_path(out), True)
            raise ValueError(f"{refused.file} can't be copied: {refused.refused}")
        if not fs.exists(fs_path(out)):
            return report
        for status in fs.listStatus(fs_path(f"{self.path}/data")):
            name = status.getPath().getName()
            if not name.startswith("topic=") and not name.endswith(".parquet") and not name.startswith(("_", ".")):
                fs.rename(status.getPath(), fs_path(f"{out}/{name}"))
        old = fs_path(f"{self.path}/old-{uuid.uuid4().hex}")
        if not fs.rename(fs_path(f"{self.path}/data"), old):
            raise OSError(f"{self.path}/data can't be moved aside")
        if not fs.rename(fs_path(out), fs_path(f"{self.path}/data")):
            fs.rename(old, fs_path(f"{self.path}/data"))
            raise OSError(f"{out} can't be put in place")
        fs.delete(old, True)
        return report


def last_rows(messages: DataFrame, depth: int) -> DataFrame:
    """The newest ``depth`` rows of each topic, as a ring buffer would hold them."""
    if depth < 1:
        raise ValueError("a depth is at least 1")
    newest = Window.partitionBy("topic").orderBy(F.col("seq").desc())
    return messages.withColumn("from_end", F.row_number().over(newest)).filter(F.col("from_end") <= depth).drop("from_end")


class DataBuffer:
    """Messages of a source, held as the last rows of each topic or in a store.

    ``backend`` is memory or parquet (also arrow, tiledb: both mean the Parquet store here).
    ``axis`` is the topic that paces reading with :meth:`roll_buffer`.
    """

    def __init__(self, messages: DataFrame, buffer_depth: int = 1, data_uri: str | None = None, topics: Sequence[str] | None = None, axis: str = "", use_db: bool = False, backend: str | None = None):
        if buffer_depth < 1:
            raise ValueError("a depth is at least 1")
        self.backend = backend or ("parquet" if use_db else "memory")
        if self.backend not in ("memory", "parquet", "arrow", "tiledb"):
            raise ValueError(f"unknown backend {self.backend}")
        if self.backend != "memory" and not data_uri:
            raise ValueError("a store needs data_uri")
        df = messages if {"topic", "seq", "ts", "data", "shape"} <= set(messages.columns) else normalize_messages(messages)
        self.source = df if topics is None else df.filter(F.col("topic").isin(*topics))
        self.depth, self.axis = buffer_depth, axis
        self.store = Store(df.sparkSession, data_uri) if self.backend != "memory" else None
        self.rolled: int | None = None

    def __enter__(self) -> "DataBuffer":
        return self

    def __exit__(self, kind, *_) -> None:
        self.close(kind is None)

    def load_data_db(self) -> None:
        """Store all messages and close every topic."""
        if self.store is None:
            raise ValueError("a memory buffer has no store")
        self.store.append(self.source, closed=True)

    def close(self, closed: bool | None = None) -> None:
        if self.store is not None:
            self.store.write_manifest(closed)

    def reset(self) -> None:
        self.rolled = None

    def roll_buffer(self, axis: str | None = None) -> DataFrame:
        """Take in one more message of the axis topic and all others up to its time; the buffer's rows then."""
        self.rolled = (self.rolled or 0) + 1 if self.rolled is not None else 1
        edge = self.source.filter((F.col("topic") == (axis or self.axis)) & (F.col("seq") == self.rolled - 1)).agg(F.max("ts").alias("edge"))
        seen = self.source.crossJoin(F.broadcast(edge)).filter(F.col("ts") <= F.col("edge")).drop("edge")
        return last_rows(seen, self.depth)

    def get_data(self, axis: str | None = None) -> Iterator[tuple[DataFrame, int]]:
        """Snapshots of the buffer, one for each message of the axis topic."""
        self.reset()
        for i in range(self.source.filter(F.col("topic") == (axis or self.axis)).count()):
            yield self.roll_buffer(axis), i

    def rows(self) -> DataFrame:
        return self.store.messages() if self.store is not None else last_rows(self.source, self.depth)

    def get_size(self, axis: str | None = None) -> int:
        return self.topic(axis or self.axis).df.count()

    def topic(self, axis: str) -> Topic:
        return Topic(self.rows().filter(F.col("topic") == axis), [axis])

    query_topic = topic

    def dataset(self, topics: Sequence[str] | None = None) -> Dataset:
        return self.store.dataset(topics) if self.store is not None else Dataset(self.rows() if topics is None else self.rows().filter(F.col("topic").isin(*topics)), topics)

    query = dataset

    def get_time_range(self, axis: str, start: float, end: float) -> DataFrame:
        return self.topic(axis).time_range(start, end).df

    def get_index_range(self, axis: str, start=None, stop=None, step=None) -> DataFrame:
        """Python's slice over the rows held, in their order."""
        rows = positions(self.topic(axis).df, ["topic"], ["seq"], "held_at")
        n = rows.agg((F.max("held_at") + 1).alias("n")).first().n or 0
        if step is not None and step < 1:
            raise ValueError("a step is at least 1")
        a, b, c = slice(start, stop, step).indices(n)
        return rows.filter((F.col("held_at") >= a) & (F.col("held_at") < b) & ((F.col("held_at") - a) % c == 0)).drop("held_at")

    def chosen(self, key) -> DataFrame:
        """Rows of the axis topic: by position (a number, a slice, a list of numbers), or those less than ``key`` seconds (a float) older than the last."""
        if isinstance(key, float):
            held = self.topic(self.axis).df
            last = held.agg(F.max_by("ts", "seq").alias("last_ts"))
            return held.crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("last_ts") - key).drop("last_ts")  # last is one row
        if isinstance(key, slice):
            return self.get_index_range(self.axis, key.start, key.stop, key.step)
        if isinstance(key, int):
            return self.get_index_range(self.axis, key, key + 1 if key != -1 else None)
        rows = positions(self.topic(self.axis).df, ["topic"], ["seq"], "held_at")
        n = rows.agg((F.max("held_at") + 1).alias("n")).first().n or 0
        return rows.filter(F.col("held_at").isin([int(k) + n if k < 0 else int(k) for k in key])).drop("held_at")

    __getitem__ = chosen

    def __setitem__(self, key, value) -> None:
        """A new payload (numbers or a column) for the rows that ``key`` chooses; a store's topic is written anew."""
        data = value if isinstance(value, Column) else F.array(*(F.lit(float(x)) for x in value))
        marked = self.chosen(key).select("topic", "seq", F.lit(True).alias("is_chosen"))
        rows = self.store.topic(self.axis).df if self.store is not None else self.source
        a, b = rows.alias("a"), marked.alias("b")
        joined = a.join(b, same("a", "b", ["topic", "seq"]), "left").select("a.*", "b.is_chosen")
        changed = joined.withColumn("data", F.when(F.col("is_chosen"), data).otherwise(F.col("data"))).drop("is_chosen")
        if self.store is not None:
            box = spatial_bounds_for_data()
            self.store.overwrite(self.axis, changed.withColumn("box", box).select(*(F.col(f"box.{c}").alias(c) if c in BOUNDS else F.col(c) for c in changed.columns)))
        else:
            self.source = cut(changed)

    def get_last_seconds(self, axis: str, seconds: float) -> DataFrame:
        return self.topic(axis).last_seconds(seconds).df

    def topic_view(self, axis: str, columns: Sequence[str] | None = None):
        return self.topic(axis).collect(columns=columns).get(axis)

    def map_topic(self, axis: str, fn) -> DataFrame:
        return self.topic(axis).map(fn).df

    def filter_topic(self, axis: str, predicate) -> DataFrame:
        return self.topic(axis).filter(predicate).df

    def reduce_topic(self, axis: str, fn, initial=None) -> DataFrame:
        return self.topic(axis).reduce(fn, initial)

    def window_topic(self, axis: str, size=None, seconds=None) -> DataFrame:
        return self.topic(axis).window(size, seconds)

    def iter_topic_chunks(self, axis: str, chunk_size: int) -> Iterator[list]:
        return self.topic(axis).iter_chunks(chunk_size)
