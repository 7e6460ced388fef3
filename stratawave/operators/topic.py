"""Lazy queries over one topic or many, as builders around DataFrames in the message model."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.functions import vectors as v
from stratawave.operators import align, summary, windows
from stratawave.operators.order import positions, same
from stratawave.schema import BOUNDS, topic_frames, topic_metadata

#: Bytes that a collect may bring to the driver.
COLLECT_BYTES = 512 << 20


def arity(fn: Callable) -> int:
    """How many of (data, ts, name) a callable takes; decided from its signature, once, on the driver."""
    try:
        kinds = inspect.signature(fn).parameters.values()
    except (TypeError, ValueError):
        return 1
    if any(p.kind is p.VAR_POSITIONAL for p in kinds):
        return 3
    return max(1, min(3, sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in kinds)))


def between_times(start: float, end: float, inclusive: bool = True) -> Column:
    if start > end:
        raise ValueError("a range ends before it starts")
    ts = F.col("ts")
    return v.is_finite(ts) & ((ts >= start) & (ts <= end) if inclusive else (ts > start) & (ts < end))


def points_of(data: Column, shape: Column, columns: Sequence[int]) -> Column:
    """The chosen columns of the rows of a payload, as arrays; none where a column is missing."""

    def chosen(m: Column) -> Column:
        rows = F.when(m["w"] > max(columns), (F.size(m["d"]) / m["w"]).cast("int")).otherwise(0)
        picked = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.array(*(F.get(m["d"], (i * m["w"] + c).cast("int")) for c in columns)))
        return F.when(rows > 0, picked).otherwise(F.array().cast("array<array<double>>"))

    return v.let(F.struct(data.alias("d"), F.coalesce(F.get(shape, F.size(shape) - 1), F.lit(0)).alias("w")), chosen)


def touches(data: Column, shape: Column, columns: Sequence[int], low: Sequence[float], high: Sequence[float]) -> Column:
    """True if any row of the payload lies in the closed box."""

    def inside(p: Column) -> Column:
        out = F.lit(True)
        for i in range(len(columns)):
            out = out & v.between(F.get(p, F.lit(i)), float(low[i]), float(high[i]))
        return out

    return F.exists(points_of(data, shape, columns), inside)


def pandas_frame(df: DataFrame) -> pd.DataFrame:
    """The rows on the driver; numbers, text and arrays of numbers come from Arrow at once, without Spark's conversion of each value."""
    plain = all(re.fullmatch(r"(array<)?(tinyint|smallint|int|bigint|float|double)>?|string|boolean", kind) for _, kind in df.dtypes)
    return df.toArrow().to_pandas(split_blocks=True) if plain else df.toPandas()


class Dataset:
    """A lazy query over messages of any number of topics.

    Every method gives a new query; nothing runs before a result is asked for. Filters on
    columns reach the scan. Python callables run over Arrow batches and are barriers.
    """

    def __init__(self, df: DataFrame, topics: Sequence[str] | None = None):
        self.df, self.topics = df, list(topics) if topics is not None else None

    def with_df(self, df: DataFrame) -> "Dataset":
        return type(self)(df, self.topics)

    def select_topics(self, *topics: str) -> "Dataset":
        """Only these topics, in this order where order matters; an unknown one is an error if the topics are known."""
        if self.topics is not None and (missing := [t for t in topics if t not in self.topics]):
            raise ValueError(f"unknown topics: {missing}")
        return type(self)(self.df.filter(F.col("topic").isin(*topics)), topics)

    def time_range(self, start: float, end: float, inclusive: bool = True) -> "Dataset":
        return self.with_df(self.df.filter(between_times(start, end, inclusive)))

    def index_range(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> "Dataset":
        """Positions among the rows that earlier steps left, for each topic; not negative."""
        start, step = start or 0, 1 if step is None else step
        if start < 0 or (stop is not None and stop < 0) or step < 1:
            raise ValueError("a range has start >= 0, stop >= 0 and step >= 1")
        placed = positions(self.df, ["topic"], ["seq"], "position_among")
        at = F.col("position_among")
        keep = (at >= start) & ((at - start) % step == 0)
        if stop is not None:
            keep = keep & (at < stop)
        return self.with_df(placed.filter(keep).drop("position_among"))

    def frame_id(self, *frames: str) -> "Dataset":
        """Rows of these frames; a row without a frame has that of its topic while the topic has only one."""
        a, b = self.df.alias("a"), topic_frames(self.df).alias("b")
        joined = a.join(b, same("a", "b", ["topic"]))
        return self.with_df(joined.filter(F.coalesce("a.frame_id", "b.topic_frame").isin(*frames)).select("a.*"))

    def spatial_bounds(self, min_bound: Sequence[float], max_bound: Sequence[float], columns: Sequence[int] | None = None) -> "Dataset":
        """Messages of which any point lies in the closed box.

        Stored bounding boxes prune first, where they are valid and on the axes asked for,
        and are pushed to the scan; the exact test follows on what is left.
        """
        columns = list(columns) if columns is not None else list(range(len(min_bound)))
        if len(min_bound) != len(columns) or len(max_bound) != len(columns):
            raise ValueError("bounds and columns differ in length")
        df = self.df
        if set(BOUNDS) <= set(df.columns):
            overlap = F.lit(True)
            for c, low, high in zip(columns, min_bound, max_bound):
                if c < 3:
                    overlap = overlap & (F.col(f"max_{'xyz'[c]}") >= float(low)) & (F.col(f"min_{'xyz'[c]}") <= float(high))
            df = df.filter(~F.coalesce("spatial_valid", F.lit(False)) | overlap)
        return self.with_df(df.filter(touches(F.col("data"), F.col("shape"), columns, min_bound, max_bound)))

    def geographic_bounds(self, min_lat: float, min_lon: float, max_lat: float, max_lon: float, columns: Sequence[int] = (0, 1)) -> "Dataset":
        """Messages with a coordinate in the closed box, which must not cross the date line."""
        if min_lat > max_lat or min_lon > max_lon:
            raise ValueError("a box ends before it starts")
        return self.with_df(self.df.filter(touches(F.col("data"), F.col("shape"), columns, (min_lat, min_lon), (max_lat, max_lon))))

    geo_bounds = geographic_bounds

    def map(self, fn: Callable | Column, schema: str = "array<double>") -> "Dataset":
        """New payloads: from a column expression, or from a callable fn(data[, ts[, name]]) over rows, run in Arrow batches.

        A callable's result is flattened and its shape kept. An exception it raises fails the query.
        """
        if isinstance(fn, Column):
            changed = self.df.withColumn("data", fn)
            return self.with_df(changed.withColumn("shape", F.array(F.size("data"))) if "shape" in self.df.columns else changed)
        n, names = arity(fn), self.df.columns
        have_shape = "shape" in names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out, shapes = [], []
                for row in batch.itertuples(index=False):
                    data = np.asarray(row.data, float)
                    if have_shape and row.shape is not None and int(np.prod(row.shape)) == data.size:
                        data = data.reshape([int(x) for x in row.shape])
                    value = np.asarray(fn(*(data, row.ts, row.name)[:n]), float)
                    out.append(value.ravel())
                    shapes.append(list(value.shape))
                batch = batch.copy()
                batch["data"] = out
                if have_shape:
                    batch["shape"] = shapes
                yield batch

        return self.with_df(self.df.mapInPandas(run, self.df.schema))

    def filter(self, predicate: Callable | Column) -> "Dataset":
        """Rows for which a column expression, or a callable of (data[, ts[, name]]), is true."""
        if isinstance(predicate, Column):
            return self.with_df(self.df.filter(predicate))
        n, have_shape = arity(predicate), "shape" in self.df.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for row in batch.itertuples(index=False):
                    data = np.asarray(row.data, float)
                    if have_shape and row.shape is not None and int(np.prod(row.shape)) == data.size:
                        data = data.reshape([int(x) for x in row.shape])
                    keep.append(bool(predicate(*(data, row.ts, row.name)[:n])))
                yield batch[np.array(keep, bool)]

        return self.with_df(self.df.mapInPandas(run, self.df.schema))

    def reduce(self, fn: Callable[[Column, Column], Column] | str, initial: Column | None = None) -> DataFrame:
        """One row (topic, result): an ordered left fold of the payloads, or one of sum, min, max by element.

        The named folds are plain aggregates and combine before the shuffle. A fold given
        as fn(accumulated, data) over columns is ordered by seq, so a topic's payloads
        meet in one array; it is for topics that fit a task.
        """
        if isinstance(fn, str):
            pick = {"sum": F.sum, "min": F.min, "max": F.max}[fn]
            each = self.df.select("topic", F.posexplode("data").alias("i", "x")).groupBy("topic", "i").agg(pick("x").alias("x"))
            return each.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("result"))
        listed = self.df.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda s: s["data"]).alias("all"))
        start = initial if initial is not None else F.get("all", F.lit(0))
        rest = F.col("all") if initial is not None else F.slice("all", 2, F.size("all"))
        return listed.select("topic", F.reduce(rest, start, fn).alias("result"))

    def window(self, size: int | None = None, seconds: float | None = None) -> DataFrame:
        return windows.window_topic(self.df, size, seconds)

    def align(self, other: "Dataset", mode: str = "nearest", **more) -> DataFrame:
        return align.align_topic(self.df, other.df, mode, **more)

    def describe(self) -> DataFrame:
        return summary.describe_dataset(self.df)

    def metadata(self) -> DataFrame:
        return topic_metadata(self.df)

    def ordered(self) -> DataFrame:
        if self.topics is None:
            return self.df.orderBy("topic", "seq")
        rank = F.array_position(F.array(*map(F.lit, self.topics)), F.col("topic"))
        return self.df.orderBy(rank, "seq")

    def iter_rows(self) -> Iterator:
        """Rows topic by topic in order, a partition at a time on the driver."""
        yield from self.ordered().toLocalIterator(prefetchPartitions=True)

    def iter_chunks(self, chunk_size: int = 1024) -> Iterator[list]:
        """Lists of exactly ``chunk_size`` rows, the last of each topic shorter."""
        if chunk_size < 1:
            raise ValueError("a chunk has at least one row")
        held: list = []
        for row in self.iter_rows():
            if held and (len(held) == chunk_size or held[-1].topic != row.topic):
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def collect(self, max_rows: int | None = None, max_bytes: int = COLLECT_BYTES, allow_large: bool = False, columns: Sequence[str] | None = None) -> dict[str, pd.DataFrame]:
        """One pandas frame for each topic, of all columns or those named; more than ``max_rows`` or ``max_bytes`` is a MemoryError, found before anything is brought over."""
        if not allow_large:
            size = self.df.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.greatest(F.size("data"), F.lit(0)) + 16).alias("bytes")).first()
            if max_rows is not None and size.n > max_rows:
                raise MemoryError(f"{size.n} rows are more than {max_rows}")
            if (size["bytes"] or 0) > max_bytes:
                raise MemoryError(f"{size['bytes']} bytes are more than {max_bytes}")
        rows = self.ordered()
        frame = pandas_frame(rows if columns is None else rows.select("topic", *(c for c in columns if c != "topic")))
        one = len(frame) > 0 and (frame["topic"] == frame["topic"].iloc[0]).all()  # no second copy of a single topic
        parts = [(frame["topic"].iloc[0], frame)] if one else [(t, g.reset_index(drop=True)) for t, g in frame.groupby("topic", sort=False)]
        return {t: g if columns is None else g[list(columns)] for t, g in parts}


class Topic(Dataset):
    """A lazy query over one topic."""

    def last_seconds(self, seconds: float) -> "Topic":
        """Rows not older than ``seconds`` before the last row by seq."""
        last = self.df.agg(F.max_by("ts", "seq").alias("last_ts"))
        return self.with_df(self.df.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last_ts") - seconds).drop("last_ts"))

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> "Topic":
        """Python's slice over the stored rows, negative ends included; seq is the position in the store."""
        if step is not None and step < 1:
            raise ValueError("a step is at least 1")
        n = self.df.agg((F.max("seq") + 1).alias("n")).first().n or 0
        a, b, c = slice(start, stop, step).indices(n)
        return self.with_df(self.df.filter((F.col("seq") >= a) & (F.col("seq") < b) & ((F.col("seq") - a) % c == 0)))


def topic_view(df: DataFrame, topic: str) -> pd.DataFrame:
    """One topic's rows on the driver, in order, with the limits of collect."""
    return Topic(df.filter(F.col("topic") == topic)).collect().get(topic, pd.DataFrame(columns=df.columns))


class TopicArrays:
    """One topic on the driver as arrays: ids, ts, data (stacked where all payloads have one shape, else a list) and metadata."""

    def __init__(self, frame: pd.DataFrame, metadata: dict | None = None):
        self.ids, self.ts, payloads = topic_parts(frame)
        self.data = np.stack(payloads) if payloads and len({p.shape for p in payloads}) == 1 else payloads
        only = lambda c: next(iter(frame[c].dropna().unique()), None) if c in frame and frame[c].nunique() == 1 else None
        self.metadata = {"topic": only("topic"), "source_uri": only("source_uri"), "frame_id": only("frame_id"), "count": len(frame)} | (metadata or {})

    def __len__(self) -> int:
        return len(self.ts)

    def as_dict(self, include_metadata: bool = True) -> dict:
        return {"ts": self.ts, "data": self.data, "id": self.ids, "name": self.ids} | ({k: x for k, x in self.metadata.items() if x is not None} if include_metadata else {})


def topic_arrays(df: DataFrame, topic: str) -> TopicArrays:
    """One topic as arrays, with the limits of collect."""
    return TopicArrays(topic_view(df, topic))


def topic_parts(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """Names, times and payloads of a collected topic."""
    if not isinstance(frame, pd.DataFrame):
        raise TypeError("a collected topic is needed")
    return frame["name"].to_numpy(), frame["ts"].to_numpy(float), [np.asarray(d, float).reshape([int(x) for x in s]) if s is not None else np.asarray(d, float) for d, s in zip(frame["data"], frame["shape"])]


def topic_pipeline(df: DataFrame, topic: str | None = None) -> Topic:
    return Topic(df if topic is None else df.filter(F.col("topic") == topic), None if topic is None else [topic])


def dataset_query(df: DataFrame, topics: Sequence[str] | None = None) -> Dataset:
    return Dataset(df if topics is None else df.filter(F.col("topic").isin(*topics)), topics)


def select_indices(df: DataFrame, start=None, stop=None, step=None) -> DataFrame:
    return Topic(df).slice(start, stop, step).df


def select_time_range(df: DataFrame, start: float, end: float, inclusive: bool = True) -> DataFrame:
    return df.filter(between_times(start, end, inclusive))


def map_topic(df: DataFrame, fn) -> DataFrame:
    return Topic(df).map(fn).df


def filter_topic(df: DataFrame, predicate) -> DataFrame:
    return Topic(df).filter(predicate).df


def reduce_topic(df: DataFrame, fn, initial=None) -> DataFrame:
    return Topic(df).reduce(fn, initial)


def iter_chunks(df: DataFrame, chunk_size: int) -> Iterator[list]:
    return Topic(df).iter_chunks(chunk_size)
