"""Trailing windows, smoothing, derivatives and integrals along a topic."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.functions import vectors as v
from stratawave.operators.align import rolling_window_join
from stratawave.operators.order import BLOCK, free, running_sum, same, with_neighbours
from stratawave.session import changes, whole_tables


def window_topic(df: DataFrame, size: int | None = None, seconds: float | None = None, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Adds window: the rows (ts, seq, name, data) up to and with this one, at most ``size`` and not older than ``seconds``.

    Rows at the same time but behind this one are left out. With a ``size`` the window holds
    the last such rows by seq, in whatever order times come; by ``seconds`` alone rows meet
    by buckets of time, and rows before this one with later times are left out.
    """
    if size is None and seconds is None:
        raise ValueError("size or seconds is needed")
    fields = [c for c in ("ts", "seq", "name", "data") if c in df.columns]
    packed = F.struct(*fields)
    if size is not None and size < 1:
        raise ValueError("a size is at least 1")
    if seconds is None:
        return rows_before(df, by, packed, size)
    if seconds < 0:
        raise ValueError("windows are not negative")
    if size is not None:
        return recent_rows_before(df, by, fields, size, seconds)
    # the order of rows bounds the window: rows behind this one at the same time are dropped
    joined = rolling_window_join(df, df.select(*by, *fields), lookback=seconds, by=by)
    return joined.withColumn("window", F.filter("window", lambda x: x["seq"] <= F.col("seq"))).drop("count", "valid")


def last_reaching(ts: np.ndarray, rows: np.ndarray, least: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each of ``rows`` the last ``size`` places from its start up to it whose ts is at least ``least``, the latest first; -1 where there are fewer.

    Highest values over 1, 2, 4 ... places behind one another let a search leap over all
    that is too low, so it takes log2(len(ts)) vectorised steps.
    """
    highest = [ts]
    while (1 << len(highest)) <= len(ts):
        w, last = 1 << (len(highest) - 1), highest[-1]
        highest.append(np.concatenate([np.maximum.accumulate(last[:w]), np.maximum(last[w:], last[:-w])]))
    out = np.full((len(rows), size), -1, np.int64)
    place, open_ = rows.astype(np.int64), np.arange(len(rows))
    for k in range(size):
        low = np.flatnonzero(ts[place] < least[open_])
        if len(low):
            p, t = place[low], least[open_[low]]
            for level in range(len(highest) - 1, -1, -1):
                p = np.where((p >= 0) & (highest[level][p] < t), p - (1 << level), p)
            place[low] = p
        found = place >= starts[open_]
        place, open_ = place[found], open_[found]
        out[open_, k] = place
        more = place > starts[open_]
        place, open_ = place[more] - 1, open_[more]
        if not len(open_):
            break
    return out


def block_columns(t: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """ts of the rows of a table of whole groups, -inf where it isn't finite, and the place at which each row's group starts."""
    ts = t["ts"].cast(pa.float64()).to_numpy()
    ts = np.where(np.isfinite(ts), ts, -np.inf)
    fresh = changes(t.select(list(keys)).to_pandas(), keys)
    return ts, np.maximum.accumulate(np.where(fresh, np.arange(len(ts)), 0))


def recent_rows_before(df: DataFrame, by: Sequence[str], fields: Sequence[str], size: int, seconds: float, block: int = BLOCK) -> DataFrame:
    """Windows of the last ``size`` rows up to each row that aren't older than ``seconds``, over blocks of seq.

    A row that finds fewer in its block may have some in earlier ones. Of a block, only rows
    with fewer than ``size`` later ones at their time or above can be found from behind it:
    where times rise, its last ``size`` rows. A pass over seq and ts alone finds these and
    the span of times that each block still asks for; what a block needs then joins it.
    Times that fall all along make many such rows, and one task looks through those of a key.
    """
    by = list(by)
    at, own = free(df, "block_at"), free(df, "is_own")
    keys = [*by, at]
    blocked = df.withColumn(at, F.floor(F.col("seq") / block))
    narrow = blocked.select(*keys, F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tables(batches, keys):
            ts, starts = block_columns(t, keys)
            live = np.flatnonzero(ts > -np.inf)
            least = ts[live] - seconds
            short = last_reaching(ts, live, least, starts[live], size)[:, -1] < 0
            asked = pd.DataFrame({"start": starts[live], "least": np.where(short, least, np.nan)}).groupby("start")["least"].agg(["min", "max"])
            # from the end: rows behind a row are before it
            n = len(ts)
            ends = np.append(starts[1:] != starts[:-1], True)
            last = np.minimum.accumulate(np.where(ends, np.arange(n), n)[::-1])[::-1]
            seen = last_reaching(ts[::-1], n - 1 - live, ts[live], n - 1 - last[live], size + 1)[:, -1] < 0
            kept = live[seen]
            for start in range(0, len(kept), 100_000):
                part = kept[start : start + 100_000]
                of = asked.loc[starts[part]]
                yield from t.take(pa.array(part)).append_column("low", pa.array(of["min"].to_numpy())).append_column("high", pa.array(of["max"].to_numpy())).to_batches()

    found = narrow.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(edges, f"{kinds}, low double, high double")
    everywhere = Window.partitionBy(*by)
    split = found.withColumn("first_at", F.min(at).over(everywhere)).withColumn("last_at", F.max(at).over(everywhere)).filter("first_at < last_at").drop("first_at", "last_at")

    def carried(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([at, "seq"])
        out, seq, ts = [], np.zeros(0, np.int64), np.zeros(0)
        for number, rows in group.groupby(at, sort=True):
            low, high = rows["low"].iloc[0], rows["high"].iloc[0]
            if len(seq) and not np.isnan(low):
                reach = np.flatnonzero(ts >= high)
                from_ = reach[-size] if len(reach) >= size else 0
                chosen = from_ + np.flatnonzero(ts[from_:] >= low)
                if len(chosen):
                    out.append(pd.DataFrame({k: [rows[k].iloc[0]] * len(chosen) for k in by} | {"seq": seq[chosen], at: number}))
            seq, ts = np.concatenate([seq, rows["seq"].to_numpy()]), np.concatenate([ts, rows["ts"].to_numpy()])
            n = len(ts)
            kept = last_reaching(ts[::-1], n - 1 - np.arange(n), ts, np.zeros(n, np.int64), size + 1)[:, -1] < 0
            seq, ts = seq[kept], ts[kept]
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64" if c in ("seq", at) else object) for c in [*by, "seq", at]})

    named = {f.name: f.dataType.simpleString() for f in narrow.schema}
    needed = split.groupBy(*by).applyInPandas(carried, ", ".join(f"`{c}` {named[c]}" for c in [*by, "seq", at]))
    a, b = df.alias("a"), needed.alias("b")
    border = a.join(b, same("a", "b", [*by, "seq"])).select(*(F.col(f"a.`{c}`") for c in df.columns), F.col(f"b.`{at}`").alias(at), F.lit(False).alias(own))
    window = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in fields)
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tables(batches, keys):
            ts, starts = block_columns(t, keys)
            mine = np.flatnonzero(t[own].to_numpy(zero_copy_only=False))
            columns = [t[c].combine_chunks() for c in fields]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            packed, out = pa.StructArray.from_arrays(columns, fields), t.select(df_columns)
            step = max(1, (1 << 18) // size)
            for start in range(0, len(mine), step):
                part = mine[start : start + step]
                least = np.where(ts[part] > -np.inf, ts[part] - seconds, np.inf)
                places = last_reaching(ts, part, least, starts[part], size)[:, ::-1]
                held = places >= 0
                offsets = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), packed.take(pa.array(places[held])))
                yield from out.take(pa.array(part)).append_column("window", made).to_batches()

    df_columns = list(df.columns)
    rows = blocked.withColumn(own, F.lit(True)).unionByName(border)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(windows, f"{shown}, window array<struct<{window}>>")


def rows_before(df: DataFrame, by: Sequence[str], packed: Column, size: int, block: int = BLOCK) -> DataFrame:
    """Frames of rows over blocks of seq; each block gets the ``size - 1`` rows before it as well."""
    by, at, own = list(by), free(df, "block_at"), free(df, "is_own")
    width = max(block, size)
    home = F.floor(F.col("seq") / width)
    spread = df.withColumn(at, F.explode(F.array(home, home + 1))).withColumn(own, home == F.col(at))
    order = Window.partitionBy(*by, at).orderBy(F.col("seq").desc())
    # of the block before only the last rows are needed
    near = spread.withColumn("from_end", F.row_number().over(Window.partitionBy(*by, at, own).orderBy(F.col("seq").desc()))).filter(F.col(own) | (F.col("from_end") < size))
    del order
    frame = Window.partitionBy(*by, at).orderBy("seq").rowsBetween(-(size - 1), 0)
    return near.withColumn("window", F.collect_list(packed).over(frame)).filter(own).select(*df.columns, "window")


def iter_ml_windows(df: DataFrame, size: int | None = None, seconds: float | None = None, topics: Sequence[str] | None = None) -> DataFrame:
    """Windows of every topic, or of those named."""
    chosen = df if topics is None else df.filter(F.col("topic").isin(*topics))
    return window_topic(chosen, size, seconds)


def smooth_timeseries(df: DataFrame, value: str = "data", window_size: int = 3, by: Sequence[str] = ("topic",), order: str = "seq") -> DataFrame:
    """Centred moving average of an array column; beyond the ends the end value repeats, non-finite elements are skipped.

    The window has size // 2 elements before a row and the rest behind it.
    """
    if window_size < 1:
        raise ValueError("a window has at least one row")
    before = window_size // 2
    after = window_size - 1 - before
    by = list(by)
    block = max(BLOCK, window_size)
    at, own, near = free(df, "block_at"), free(df, "is_own"), free(df, "near")
    home = F.floor(F.col(order) / block)
    spread = df.withColumn(at, F.explode(F.array(home - 1, home, home + 1))).withColumn(own, home == F.col(at))
    halo = (F.pmod(F.col(order), F.lit(block)) < window_size) | (F.pmod(F.col(order), F.lit(block)) >= block - window_size)
    spread = spread.filter(F.col(own) | halo)
    line = Window.partitionBy(*by, at).orderBy(order)
    ends = df.groupBy(*by).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.min(order).alias("first_at"), F.max(order).alias("last_at"))
    frame = spread.withColumn(near, F.collect_list(F.col(value)).over(line.rowsBetween(-before, after))).withColumn("behind", F.count(F.lit(1)).over(line.rowsBetween(-before, -1))).withColumn("ahead", F.count(F.lit(1)).over(line.rowsBetween(1, after)) if after else F.lit(0))
    a, b = frame.filter(own).alias("a"), ends.alias("b")
    joined = a.join(b, same("a", "b", by))
    padded = F.concat(F.array_repeat("b.first_value", F.lit(before) - F.col("a.behind").cast("int")), F.col(f"a.{near}"), F.array_repeat("b.last_value", F.lit(after) - F.col("a.ahead").cast("int")))

    def means(m: Column) -> Column:
        def mean(i: Column) -> Column:
            values = F.filter(F.transform(m["near"], lambda w: F.get(w, i)), lambda x: v.is_finite(x))
            total = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda t, x: F.struct((t["s"] + x).alias("s"), (t["n"] + 1).alias("n")))
            return v.let(total, lambda t: F.when(t["n"] > 0, t["s"] / t["n"]).otherwise(F.lit(float("nan"))))

        return F.when(F.size(m["own"]) > 0, F.transform(F.sequence(F.lit(0), F.size(m["own"]) - 1), mean)).otherwise(m["own"])

    smoothed = v.let(F.struct(padded.alias("near"), F.col(f"a.`{value}`").alias("own")), means)
    return joined.select(*(F.col(f"a.`{c}`") for c in df.columns), smoothed.alias("smoothed"))


def ieee_divide(x: Column, by: Column) -> Column:
    """x / by, with infinities and NaN where ``by`` is 0."""
    infinite = F.when(F.atan2(F.lit(0.0), by) > 0, float("-inf")).otherwise(float("inf"))  # by the sign of zero
    return F.when(by == 0, x * infinite).otherwise(x / by)


def gradient(before: Column, here: Column, after: Column, back: Column, ahead: Column, divide=F.try_divide) -> Column:
    """Second-order derivative for uneven steps; one-sided where a neighbour is missing; null for a single row and, unless ``divide`` has it otherwise, where times repeat."""
    inner = divide(back * back * after + (ahead * ahead - back * back) * here - ahead * ahead * before, back * ahead * (back + ahead))
    return F.when(before.isNull(), divide(after - here, ahead)).when(after.isNull(), divide(here - before, back)).otherwise(inner)


def neighbour_gradient(value: str, divide=F.try_divide) -> Column:
    """The gradient of each element of an array column by ts, where :func:`with_neighbours` has added both."""
    back, ahead = F.col("ts") - F.col("prev_ts"), F.col("next_ts") - F.col("ts")
    p, n = F.col(f"prev_{value}"), F.col(f"next_{value}")
    return F.transform(F.sequence(F.lit(0), F.size(value) - 1), lambda i: gradient(F.get(p, i), F.get(F.col(value), i), F.get(n, i), back, ahead, divide))


def differentiate_timeseries(df: DataFrame, value: str = "data", by: Sequence[str] = ("topic",), order: str = "seq") -> DataFrame:
    """Adds derivative: of each element by ts, as np.gradient has it for uneven steps."""
    near = with_neighbours(df, by, order, ["ts", value])
    return near.select(*df.columns, F.when(F.size(value) > 0, neighbour_gradient(value)).alias("derivative"))


def integrate_timeseries(df: DataFrame, value: str = "data", elements: int = 1, initial: Sequence[float] | float = 0.0, by: Sequence[str] = ("topic",), order: str = "seq") -> DataFrame:
    """Adds integral: the trapezoid sum of each of ``elements`` elements over ts, from ``initial``."""
    start = [float(initial)] * elements if isinstance(initial, (int, float)) else [float(x) for x in initial]
    near = with_neighbours(df, by, order, ["ts", value], ahead=False)
    step = F.col("ts") - F.col("prev_ts")
    terms = {f"sum_{i}": F.coalesce(0.5 * (F.get(F.col(value), F.lit(i)) + F.get(F.col(f"prev_{value}"), F.lit(i))) * step, F.lit(0.0)) for i in range(elements)}
    summed = running_sum(near, by, order, terms)
    return summed.select(*df.columns, F.array(*(F.col(f"sum_{i}") + start[i] for i in range(elements))).alias("integral"))


def trajectory_speed(df: DataFrame, position: str = "position", by: Sequence[str] = ("topic",), order: str = "seq") -> DataFrame:
    """Adds speed: the norm of the change of position over that of ts, both between the neighbours of a row; equal times are an error."""
    near = with_neighbours(df, by, order, ["ts", position])
    a, b = F.coalesce(F.col(f"prev_{position}"), F.col(position)), F.coalesce(F.col(f"next_{position}"), F.col(position))
    step = F.coalesce("next_ts", "ts") - F.coalesce("prev_ts", "ts")
    way = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, x: s + x))
    speed = F.when((step == 0) & F.coalesce("prev_ts", "next_ts").isNotNull(), F.raise_error(F.lit("timestamps repeat")).cast("double")).otherwise(way / F.nullif(step, F.lit(0.0)))
    return near.select(*df.columns, speed.alias("speed"))
