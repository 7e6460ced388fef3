"""Summaries of topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.functions import vectors as v
from stratawave.operators.order import with_neighbours


def describe_dataset(df: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """One row for each topic: count, start_time, end_time, duration, rate_hz, dt_mean, dt_std, dt_min, dt_max, dtype, shape, frame_id, nan_fraction, min, max, mean.

    Start and end are the times of the first and last row by seq. duration and the steps
    need two rows, else they are null; the rate is null without a positive duration.
    dt_std divides by the number of steps. nan_fraction is over all elements; min, max
    and mean over the finite ones. Steps come from neighbours by seq across blocks, and
    all aggregates combine before the shuffle.
    """
    near = with_neighbours(df, by, "seq", ["ts"], ahead=False)
    step = F.col("ts") - F.col("prev_ts")
    good = F.filter("data", lambda x: v.is_finite(x))
    total = F.aggregate(good, F.lit(0.0), lambda s, x: s + x)
    nans = F.size(F.filter("data", lambda x: x.isNull() | F.isnan(x)))
    size = F.greatest(F.size("data"), F.lit(0))
    extra = [F.min_by(c, "seq").alias(c) for c in ("dtype", "shape") if c in df.columns]
    frame = [F.when(F.min("frame_id") == F.max("frame_id"), F.min("frame_id")).alias("frame_id")] if "frame_id" in df.columns else []
    out = near.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min_by("ts", "seq").alias("start_time"), F.max_by("ts", "seq").alias("end_time"),
        F.avg(step).alias("dt_mean"), F.stddev_pop(step).alias("dt_std"), F.min(step).alias("dt_min"), F.max(step).alias("dt_max"),
        *extra, *frame, (F.sum(nans) / F.nullif(F.sum(size), F.lit(0).cast("long"))).alias("nan_fraction"),
        F.min(F.array_min(good)).alias("min"), F.max(F.array_max(good)).alias("max"), (F.sum(total) / F.nullif(F.sum(F.size(good)), F.lit(0).cast("long"))).alias("mean"),
    )
    duration = F.when(F.col("count") >= 2, F.col("end_time") - F.col("start_time"))
    rate = F.when(duration > 0, (F.col("count") - 1) / duration)
    columns = [*by, "count", "start_time", "end_time", duration.alias("duration"), rate.alias("rate_hz")]
    return out.select(*columns, *(c for c in out.columns if c not in (*by, "count", "start_time", "end_time")))


def describe_topic(df: DataFrame, topic: str | None = None) -> DataFrame:
    """The summary of one topic."""
    return describe_dataset(df if topic is None else df.filter(F.col("topic") == topic))


def format_describe(summaries: DataFrame) -> DataFrame:
    """One line of text for each summary."""
    number = lambda c, f: F.coalesce(F.format_string(f, c), F.lit("-"))
    line = F.concat_ws(
        "  ", F.col("topic"), F.format_string("n=%d", "count"), F.concat(F.lit("duration="), number("duration", "%.3fs")), F.concat(F.lit("rate="), number("rate_hz", "%.2fHz")),
        F.concat(F.lit("dt="), number("dt_mean", "%.4f"), F.lit("±"), number("dt_std", "%.4f")), F.concat(F.lit("nan="), number("nan_fraction", "%.3f")),
    )
    return summaries.select("topic", line.alias("line"))


def bias(value: Column, expected: float = 0.0, mask: Column | None = None) -> Column:
    """Aggregate: the mean of value - expected over rows where the mask holds and the value is finite."""
    keep = v.is_finite(value) if mask is None else v.is_finite(value) & mask
    return F.avg(F.when(keep, value - expected))


def estimate_bias(df: DataFrame, values: Sequence[Column | str], expected: float | Sequence[float] = 0.0, mask: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row for each key with bias_0, bias_1, ... of the values; null where no value counts."""
    wanted = [float(expected)] * len(values) if isinstance(expected, (int, float)) else list(expected)
    return df.groupBy(*by).agg(*(bias(v.col(x), e, mask).alias(f"bias_{i}") for i, (x, e) in enumerate(zip(values, wanted, strict=True))))


def correct_bias(df: DataFrame, values: dict[str, Column], expected: float = 0.0, mask: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds each named value less its bias; one row of biases for each key joins back."""
    names = list(values)
    found = estimate_bias(df, [values[n] for n in names], expected, mask, by)
    joined = df.join(found, list(by)) if by else df.crossJoin(F.broadcast(found))  # one row without keys
    return joined.withColumns({n: values[n] - F.coalesce(F.col(f"bias_{i}"), F.lit(0.0)) for i, n in enumerate(names)}).drop(*(f"bias_{i}" for i in range(len(names))))
