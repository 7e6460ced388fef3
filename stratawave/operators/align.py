"""Alignment of topics in time: exact, nearest, bounded, rolling and resampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.functions import vectors as v
from stratawave.operators.order import free, positions, same

#: Seconds of one block of time; blocks, not keys, are what one task sees.
BLOCK_SECONDS = 3600.0


def around(reference: DataFrame, target: DataFrame, by: Sequence[str] = (), block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Each reference row with the target before it and the target at or after it, as structs ``before`` and ``after``.

    ``before`` is the last target (by ts, seq) with a smaller ts, ``after`` the first one
    with an equal or larger ts; the structs hold all target columns but ``by``. Both sides
    have ts and seq. Times are cut into blocks. Within a block two windows find the
    neighbours; where a block has none on one side, the nearest block that has targets
    hands its edge over, in a table of one row for each block. Rows with a null or NaN ts
    on the target side are no targets; on the reference side they have no neighbours.
    """
    by = list(by)
    fields = [c for c in target.columns if c not in by]
    packed = F.struct(*(F.col(c) for c in fields))
    block = F.floor(F.col("ts") / block_seconds)
    targets = target.filter(v.is_finite("ts")).select(*by, block.alias("block"), F.col("ts").alias("at"), F.lit(1).alias("side"), F.col("seq").alias("place"), packed.alias("hit"), F.lit(None).cast(reference.select(F.struct(*reference.columns)).schema[0].dataType).alias("row"))
    asked = reference.select(*by, block.alias("block"), F.col("ts").alias("at"), F.lit(0).alias("side"), F.col("seq").alias("place"), F.lit(None).cast(targets.schema["hit"].dataType).alias("hit"), F.struct(*reference.columns).alias("row"))
    edges = targets.groupBy(*by, "block").agg(F.max_by("hit", F.struct("at", "place")).alias("last"), F.min_by("hit", F.struct("at", "place")).alias("first"))
    all_blocks = edges.unionByName(asked.select(*by, "block").distinct().withColumns({"last": F.lit(None).cast(targets.schema["hit"].dataType), "first": F.lit(None).cast(targets.schema["hit"].dataType)}))
    merged = all_blocks.groupBy(*by, "block").agg(F.first("last", ignorenulls=True).alias("last"), F.first("first", ignorenulls=True).alias("first"))
    line = Window.partitionBy(*by)
    carried = merged.select(
        *by, "block",
        F.last("last", ignorenulls=True).over(line.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry_before"),
        F.last("first", ignorenulls=True).over(line.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("carry_after"),
    )
    own = Window.partitionBy(*by, "block")
    seen = (
        targets.unionByName(asked)
        .withColumn("before", F.last("hit", ignorenulls=True).over(own.orderBy("at", "side", "place").rowsBetween(Window.unboundedPreceding, -1)))
        # the other way round is a growing frame as well; a frame that starts behind the row would be quadratic
        .withColumn("after", F.last("hit", ignorenulls=True).over(own.orderBy(F.col("at").desc(), F.col("side").desc(), F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)))
        .filter("side = 0")
    )
    a, b = seen.alias("a"), carried.alias("b")
    timed = v.is_finite("a.at")
    return a.join(b, same("a", "b", [*by, "block"]), "left").select(
        *(F.col(f"a.row.`{c}`").alias(c) for c in reference.columns),
        F.when(timed, F.coalesce("a.before", "b.carry_before")).alias("before"), F.when(timed, F.coalesce("a.after", "b.carry_after")).alias("after"),
    )


def aligned(found: DataFrame, reference: DataFrame, hit: Column, valid: Column, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Reference columns with target_ts, target_index (-1 without a target), valid, and the target's other columns."""
    valid = F.coalesce(valid, F.lit(False))
    names = {f: f if f not in reference.columns else f"target_{f}" for f in fields if f not in ("ts", "seq")}
    return found.select(
        *reference.columns, F.when(valid, hit["ts"]).alias("target_ts"), F.when(valid, hit["seq"]).otherwise(F.lit(-1).cast("long")).alias("target_index"),
        valid.alias("valid"), *(F.when(valid, hit[f]).alias(n) for f, n in names.items()),
    )


def align_nearest(reference: DataFrame, target: DataFrame, tolerance: float | None = None, by: Sequence[str] = (), ties: str = "later", block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Each reference row with the nearest target in time, of the same ``by``.

    Of two equally near targets the later is taken, or the earlier with ``ties`` =
    "earlier" (the rule of streams). Of targets at the same time the last is taken before
    the reference, the first at or after it. Beyond ``tolerance``, or without a target,
    valid is false, target_index -1 and the rest null. Every reference row comes once.
    """
    if tolerance is not None and tolerance < 0:
        raise ValueError("a tolerance is not negative")
    fields = [c for c in target.columns if c not in by]
    found = around(reference, target, by, block_seconds)
    back, ahead = F.col("ts") - F.col("before.ts"), F.col("after.ts") - F.col("ts")
    wins = ahead <= back if ties == "later" else ahead < back
    hit = F.when(F.col("before").isNull() | (F.col("after").isNotNull() & wins), F.col("after")).otherwise(F.col("before"))
    found = found.withColumn("hit", hit)
    valid = F.col("hit").isNotNull()
    if tolerance is not None:
        valid = valid & (F.abs(F.col("hit.ts") - F.col("ts")) <= tolerance)
    return aligned(found, reference, F.col("hit"), valid, by, fields)


def align_bounded(reference: DataFrame, target: DataFrame, tolerance: float, by: Sequence[str] = (), **more) -> DataFrame:
    if tolerance is None:
        raise ValueError("a tolerance is needed")
    return align_nearest(reference, target, tolerance, by, **more)


def align_backward(reference: DataFrame, target: DataFrame, by: Sequence[str] = (), inclusive: bool = True, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Each reference row with the latest target seen so far; a target at the same time counts if ``inclusive``."""
    fields = [c for c in target.columns if c not in by]
    found = around(reference, target, by, block_seconds)
    level = F.col("after.ts") == F.col("ts")
    hit = F.when(level & F.lit(inclusive), F.col("after")).otherwise(F.col("before"))
    found = found.withColumn("hit", hit)
    return aligned(found, reference, F.col("hit"), F.col("hit").isNotNull(), by, fields)


def align_exact(reference: DataFrame, target: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left join on equal times; of several targets at one time the first (by seq) is taken."""
    fields = [c for c in target.columns if c not in by]
    first = target.filter(v.is_finite("ts")).groupBy(*by, "ts").agg(F.min_by(F.struct(*fields), "seq").alias("hit"))
    a, b = reference.alias("a"), first.alias("b")
    found = a.join(b, same("a", "b", by) & (F.col("a.ts") == F.col("b.ts")), "left").select(*(F.col(f"a.`{c}`") for c in reference.columns), "b.hit")
    return aligned(found, reference, F.col("hit"), F.col("hit").isNotNull(), by, fields)


def nearest_time_index(target: DataFrame, query_time: float, tolerance: float | None = None) -> int:
    """seq of the target nearest to one time, by the rule of :func:`align_nearest`; -1 without one. Two scalar aggregates, nothing is collected but one row."""
    side = F.when(F.col("ts") >= query_time, 0).otherwise(1)
    rank = F.struct(F.abs(F.col("ts") - query_time), side, F.when(F.col("ts") >= query_time, F.col("seq")).otherwise(-F.col("seq")))
    row = target.filter(v.is_finite("ts")).agg(F.min_by(F.struct("ts", "seq"), rank).alias("hit")).first()
    if row is None or row.hit is None or (tolerance is not None and abs(row.hit.ts - query_time) > tolerance):
        return -1
    return row.hit.seq


def rolling_window_join(reference: DataFrame, target: DataFrame, seconds: float | None = None, size: int | None = None, lookback: float | None = None, lookahead: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Each reference row with the targets in [ts - lookback, ts + lookahead], the newest ``size`` of them, in the order of ts and seq.

    Adds window (array of structs of the target's columns), count and valid (count > 0).
    Without ``seconds`` or ``lookback`` the window reaches back to the ``size`` newest
    targets. Times are joined by buckets as wide as the window, so each pair of rows meets
    once and no cross join arises; by size alone, targets are joined by their position.
    """
    lookback = seconds if lookback is None else lookback
    if lookback is None and size is None:
        raise ValueError("seconds, lookback or size is needed")
    if (lookback is not None and lookback < 0) or lookahead < 0 or (size is not None and size < 1):
        raise ValueError("windows are not negative")
    fields = [c for c in target.columns if c not in by]
    identity = free(reference, "row_identity")
    numbered = reference.withColumn(identity, F.struct(*(c for c in ("topic", "seq", "ts") if c in reference.columns)))
    timed = target.filter(v.is_finite("ts")).select(*by, F.struct(F.col("ts").alias("at"), F.col("seq").alias("place"), *fields).alias("hit"))
    t, r = timed.alias("t"), numbered.filter(v.is_finite("ts")).select(*by, identity, F.col("ts").alias("at")).distinct().alias("r")
    if lookback is None:
        placed = positions(target.filter(v.is_finite("ts")), by, ["ts", "seq"], free(target, "place"))
        place = placed.columns[-1]
        ahead = around(numbered.withColumn("ts", F.col("ts") + lookahead).select(*by, identity, "ts", F.lit(0).alias("seq")), placed.select(*by, "ts", F.col(place).alias("seq")), by)
        # targets at the very end of the window belong to it: count them by position
        upto = F.coalesce(F.col("before.seq") + 1, F.lit(0))
        at_end = placed.groupBy(*by, "ts").agg(F.max(place).alias("last"))
        a, b = ahead.withColumn("upto", upto).alias("a"), at_end.alias("b")
        ranges = a.join(b, same("a", "b", by) & (F.col("a.ts") == F.col("b.ts")), "left").select(*(F.col(f"a.`{c}`") for c in by), f"a.{identity}", F.coalesce(F.col("b.last") + 1, F.col("a.upto")).alias("upto"))
        wanted = ranges.filter("upto > 0").withColumn("index", F.explode(F.sequence(F.greatest(F.lit(0), F.col("upto") - size), F.col("upto") - 1))).alias("w")
        p = placed.select(*by, F.col(place).alias("index"), F.struct(F.col("ts").alias("at"), F.col("seq").alias("place"), *fields).alias("hit")).alias("p")
        pairs = wanted.join(p, same("w", "p", by) & (F.col("w.index") == F.col("p.index"))).select(f"w.{identity}", "p.hit")
    else:
        width = max(lookback + lookahead, 1e-6)
        t = timed.withColumn("bucket", F.floor(F.col("hit.at") / width)).alias("t")
        r = r.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - lookback) / width), F.floor((F.col("at") + lookahead) / width)))).alias("r")
        near = same("r", "t", by) & (F.col("r.bucket") == F.col("t.bucket")) & (F.col("t.hit.at") >= F.col("r.at") - lookback) & (F.col("t.hit.at") <= F.col("r.at") + lookahead)
        pairs = r.join(t, near).select(f"r.{identity}", "t.hit")
    windows = pairs.groupBy(identity).agg(F.array_sort(F.collect_list("hit")).alias("window"))
    if size is not None:
        windows = windows.withColumn("window", F.slice("window", F.greatest(F.lit(1), F.size("window") - size + 1), size))
    windows = windows.withColumn("window", F.transform("window", lambda x: F.struct(*(x[f].alias(f) for f in fields))))
    a, b = numbered.alias("a"), windows.alias("b")
    joined = a.join(b, F.col(f"a.{identity}") == F.col(f"b.{identity}"), "left")
    empty = F.array().cast(windows.schema["window"].dataType)
    return joined.select(*(F.col(f"a.`{c}`") for c in reference.columns), F.coalesce("b.window", empty).alias("window"), F.coalesce(F.size("b.window"), F.lit(0)).alias("count"), F.coalesce(F.size("b.window") > 0, F.lit(False)).alias("valid"))


def lerp(before: Column, after: Column, fraction: Column) -> Column:
    return F.zip_with(before, after, lambda a, b: a + (b - a) * fraction)


def grid(df: DataFrame, period: float, start: float | None, end: float | None, by: Sequence[str]) -> DataFrame:
    """Regular times of each key: start + i · period up to the end, with a slack of 1e-12 periods."""
    if period is None or period <= 0:
        raise ValueError("a period is above 0")
    ends = df.groupBy(*by).agg(F.min_by("ts", "seq").alias("first"), F.max_by("ts", "seq").alias("last"))
    a = F.lit(float(start)) if start is not None else F.col("first")
    b = F.lit(float(end)) if end is not None else F.col("last")
    n = (F.floor((b - a) / period + 1e-12)).cast("long")
    return ends.filter(F.col("first").isNotNull() & (n >= 0)).select(*by, "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("seq"), a.alias("begin")).select(*by, (F.col("begin") + F.col("seq") * period).alias("ts"), "seq", "first", "last")


def resample_topic(df: DataFrame, rate_hz: float | None = None, period: float | None = None, start: float | None = None, end: float | None = None, method: str = "linear", tolerance: float | None = None, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Rows at a fixed rate: (*by, ts, seq, data, valid).

    ``linear`` interpolates between the neighbours and repeats the end values outside the
    readings, where valid is false; ``nearest`` takes the nearest reading, valid within
    ``tolerance``. The default start and end are the times of the first and last row.
    """
    if (rate_hz is None) == (period is None):
        raise ValueError("give either rate_hz or period")
    period = 1.0 / rate_hz if period is None else period
    by = list(by)
    times = grid(df, period, start, end, by)
    target = df.select(*by, "ts", "seq", "data")
    if method == "nearest":
        return align_nearest(times.select(*by, "ts", "seq"), target, tolerance, by).select(*by, "ts", "seq", "data", "valid")
    if method != "linear":
        raise ValueError("the method is linear or nearest")
    return interpolate(times, target, by)


def interpolate(times: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Linear values of ``target`` at the times (*by, ts, seq), repeated beyond the ends, where valid is false."""
    found = around(times.select(*by, "ts", "seq"), target, by)
    b, a = F.col("before"), F.col("after")
    exact = a["ts"] == F.col("ts")
    value = F.when(a.isNull(), b["data"]).when(exact | b.isNull(), a["data"]).otherwise(lerp(b["data"], a["data"], (F.col("ts") - b["ts"]) / (a["ts"] - b["ts"])))
    valid = F.coalesce(exact, F.lit(False)) | (a.isNotNull() & b.isNotNull())
    return found.select(*by, "ts", "seq", value.alias("data"), valid.alias("valid"))


def align_topic(reference: DataFrame, target: DataFrame, mode: str = "nearest", tolerance: float | None = None, by: Sequence[str] = (), rate_hz=None, period=None, start=None, end=None, interpolation: str = "linear", seconds=None, size=None, lookback=None, lookahead: float = 0.0) -> DataFrame:
    """Dispatcher over the modes exact, nearest, bounded, fixed_rate and rolling_window."""
    mode = mode.lower().replace("-", "_")
    if mode == "exact":
        return align_exact(reference, target, by)
    if mode == "nearest":
        return align_nearest(reference, target, tolerance, by)
    if mode in ("bounded", "tolerance"):
        return align_bounded(reference, target, tolerance, by)
    if mode in ("fixed_rate", "resample"):
        return resample_topic(target, rate_hz, period, start, end, interpolation, tolerance, by or ("topic",))
    if mode in ("rolling_window", "rolling", "window"):
        return rolling_window_join(reference, target, seconds, size, lookback, lookahead, by)
    raise ValueError(f"unknown mode {mode}")


def nearest_topic_pairs(messages: DataFrame, reference_topic: str, target_topic: str, tolerance: float | None = None) -> DataFrame:
    """Pairs of two topics of one stream: each reference message with its nearest target, the earlier on a tie; misses are left out."""
    reference, target = messages.filter(F.col("topic") == reference_topic), messages.filter(F.col("topic") == target_topic)
    return align_nearest(reference, target, tolerance, ties="earlier").filter("valid")
