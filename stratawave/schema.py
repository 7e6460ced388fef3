"""The message model and its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratawave.functions import vectors as v

MESSAGE = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.DoubleType()),
    T.StructField("name", T.StringType()), T.StructField("frame_id", T.StringType()), T.StructField("source_uri", T.StringType()),
    T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType())),
])
POINT = "topic string, seq long, ts double, pid int, x double, y double, z double, attrs array<double>"
CELL = "raster string, row int, col int, z double"
PIXEL = "topic string, seq long, row int, col int, chan array<double>"
BOUNDS = ("spatial_valid", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


def normalize_messages(df: DataFrame) -> DataFrame:
    """Rows in the message model: a name defaults to ``id`` and then to the topic, a time may be called ``ts`` or ``timestamp``.

    ``topic``, ``data`` and a time are required columns; frame_id, source_uri, dtype and
    shape are null where absent; seq is numbered by time where it is absent. Other columns
    are kept behind the model's.
    """
    have = set(df.columns)
    for c in ("topic", "data"):
        if c not in have:
            raise ValueError(f"a message needs {c}")
    if not have & {"ts", "timestamp"}:
        raise ValueError("a message needs ts or timestamp")
    time = F.col("ts" if "ts" in have else "timestamp").cast("double")
    names = [F.col(c).cast("string") for c in ("name", "id") if c in have] + [F.col("topic")]
    flat = F.col("data").cast("array<double>") if isinstance(df.schema["data"].dataType, T.ArrayType) else F.array(F.col("data").cast("double"))
    out = df.select(
        F.col("topic").cast("string").alias("topic"), (F.col("seq").cast("long") if "seq" in have else F.lit(None).cast("long")).alias("seq"), time.alias("ts"), F.coalesce(*names).alias("name"),
        (F.col("frame_id") if "frame_id" in have else F.lit(None).cast("string")).alias("frame_id"), (F.col("source_uri") if "source_uri" in have else F.lit(None).cast("string")).alias("source_uri"),
        (F.col("dtype") if "dtype" in have else F.lit("float64")).alias("dtype"), (F.col("shape") if "shape" in have else F.array(F.size(flat))).alias("shape"), flat.alias("data"),
        *(c for c in df.columns if c not in {"topic", "seq", "ts", "timestamp", "name", "id", "frame_id", "source_uri", "dtype", "shape", "data"}),
    )
    if "seq" not in have:
        from stratawave.operators.order import positions

        out = positions(out.drop("seq"), ["topic"], ["ts", "name"], "seq")
        out = out.select(*[f.name for f in MESSAGE], *(c for c in out.columns if c not in MESSAGE.names))
    return out


def spatial_bounds_for_data(data: Column | str = "data", shape: Column | str = "shape") -> Column:
    """Struct (spatial_valid, min_x .. max_z) over the finite rows of a payload of at most two dimensions.

    The last axis gives up to three coordinates. Absent coordinates are null. Invalid for
    empty payloads, for more than two dimensions, and without a finite row.
    """

    def rows_of(m: Column) -> Column:
        d, s = m["d"], m["s"]
        width = F.get(s, F.size(s) - 1)
        used = F.least(width, F.lit(3))
        rows = F.when((F.size(s) >= 1) & (F.size(s) <= 2) & (F.size(d) > 0) & (width > 0), (F.size(d) / width).cast("int")).otherwise(0)
        # one pass over the payload: the finite rows, each cut to its coordinates
        points = F.when(rows > 0, F.filter(F.transform(F.sequence(F.lit(1), rows), lambda i: F.slice(d, (i - 1) * width + 1, used)), lambda p: F.forall(p, lambda x: v.is_finite(x))))
        return F.struct(points.alias("points"), used.alias("used"))

    def edges(m: Column) -> Column:
        valid = F.coalesce(F.size(m["points"]) > 0, F.lit(False))
        edge = lambda i, pick: F.when(valid & (m["used"] > i), pick(F.transform(m["points"], lambda p: F.get(p, F.lit(i)))))
        return F.struct(valid.alias("spatial_valid"), *(edge(i, pick).alias(f"{name}_{axis}") for name, pick in (("min", F.array_min), ("max", F.array_max)) for i, axis in enumerate("xyz")))

    return v.let(F.struct(v.col(data).alias("d"), v.col(shape).alias("s")), rows_of, edges)


def topic_frames(df: DataFrame) -> DataFrame:
    """(topic, topic_frame): the frame of a topic while all its rows that name one agree, else null."""
    low, high = F.min("frame_id"), F.max("frame_id")
    return df.groupBy("topic").agg(F.when(low == high, low).alias("topic_frame"))


def topic_metadata(df: DataFrame) -> DataFrame:
    """One row for each topic: source_uri, frame_id (null if mixed), dtype, shape, count, start_time and end_time (of the first and last row)."""
    return df.groupBy("topic").agg(
        F.min_by("source_uri", "seq").alias("source_uri"), F.when(F.min("frame_id") == F.max("frame_id"), F.min("frame_id")).alias("frame_id"),
        F.min_by("dtype", "seq").alias("dtype"), F.min_by("shape", "seq").alias("shape"), F.count(F.lit(1)).alias("count"),
        F.min_by("ts", "seq").alias("start_time"), F.max_by("ts", "seq").alias("end_time"),
    )
