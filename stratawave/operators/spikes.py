"""Implausible readings: two-sided robust control charts, run lengths and physical limits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawave.session import changes, cut, usable, whole_groups

#: Readings of one block and of the overlap at its borders; they bound what a task holds.
BLOCK, HALO = 4096, 64
#: Weight of a new reading; clip, in scales; limit of a normal deviation, in scales.
WEIGHT, CLIP, LIMIT = 0.25, 2.5, 6.0
#: Deviations on one side after which the chart takes a new level; equal readings that count as stuck; share of repeats of a source that repeats by nature.
RELEVEL, STUCK, REPEATS = 6, 8, 0.08
#: Bins of the histogram of deviations: each is wider than the one before by this factor.
STEP = 1.02

OUT = "kind int, msg_id long, topic string, element int, deviation double, scale double, run int, bin int, n long, repeats long"


def chart(x: np.ndarray, sizes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Signed deviation of each reading from the chart of the readings before it, row by row.

    ``x`` holds one series in each row, padded behind ``sizes``. The chart starts at the
    median of the first seven readings. Deviations beyond CLIP scales enter the mean and
    the scale clipped; after RELEVEL of them in a row on the same side the chart moves to
    the median of those readings, since a lasting change is a new level and no excursion.
    """
    rows, length = x.shape
    out = np.zeros((rows, length))
    head = np.where(np.arange(min(7, length)) < sizes[:, None], x[:, :7], np.nan)
    mean, spread = np.nanmedian(head, axis=1), scale.copy()
    run, side = np.zeros(rows, int), np.zeros(rows)
    for t in range(length):
        deviation = np.where(t < sizes, x[:, t] - mean, 0.0)
        out[:, t] = deviation
        bound = CLIP * spread
        beyond = np.abs(deviation) > bound
        sign = np.sign(deviation)
        run = np.where(beyond, np.where(sign == side, run + 1, 1), 0)
        side = np.where(beyond, sign, 0.0)
        clipped = np.clip(deviation, -bound, bound)
        mean = mean + WEIGHT * clipped
        # the mean absolute value of a clipped normal deviation is 0.79 scales
        spread = np.clip(spread + 0.05 * (np.abs(clipped) * 1.26 - spread), 0.5 * scale, 2 * scale)
        moved = run >= RELEVEL
        if moved.any():
            mean[moved] = np.median(x[moved, t - RELEVEL + 1 : t + 1], axis=1)
            run[moved] = 0
    return out


def own_scale(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Robust spread of each row: of its successive differences, with the finest step seen as the floor."""
    d = np.where(np.arange(1, x.shape[1]) < sizes[:, None], np.abs(np.diff(x, axis=1)), np.nan)
    single = sizes < 2
    d = np.where(single[:, None], 0.0, d) if d.shape[1] else np.zeros((len(x), 1))
    spread = 1.4826 * np.nanmedian(d, axis=1) / math.sqrt(2)
    step = np.min(np.where(d > 0, d, np.inf), axis=1)
    return np.maximum(np.maximum(spread, np.where(np.isfinite(step), step, 0) / 2), 1e-12 * np.abs(x[:, 0]) + 1e-300)


def run_lengths(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the run of equal neighbours that each value is part of; runs end where a series ends."""
    new = starts.copy()
    new[1:] |= v[1:] != v[:-1]
    ids = np.cumsum(new) - 1
    return np.bincount(ids)[ids]


def examine(group: pd.DataFrame, size: int, limit: float = LIMIT) -> Iterator[pd.DataFrame]:
    """Candidates (kind 0) and histograms by topic and element (kind 1) of some whole blocks."""
    # a record stored repeatedly is one reading
    group = group[changes(group, ["source_uri", "topic", "block", "seq", "msg_id", "timestamp"])].reset_index(drop=True)
    lengths = group["data"].map(len).to_numpy()
    for element in range(int(lengths.max(initial=0))):
        part = group[lengths > element].reset_index(drop=True)
        v = np.array([d[element] for d in part["data"]], float)
        new = changes(part, ["source_uri", "topic", "block"])
        series = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(v)))
        place = np.arange(len(v)) - begins[series]
        deviation, scale = np.zeros(len(v)), np.zeros(len(v))
        order = np.argsort(sizes, kind="stable")  # series of like length together, so that padding stays small
        for some in np.array_split(order, max(1, len(order) // 256)):
            if not len(some):
                continue
            n, length = sizes[some], int(sizes[some].max())
            index = np.minimum(begins[some][:, None] + np.arange(length), begins[some][:, None] + n[:, None] - 1)
            x = v[index]
            own = own_scale(x, n)
            ahead = chart(x, n, own)
            turned = x[np.arange(len(some))[:, None], np.maximum(n[:, None] - 1 - np.arange(length), 0)]
            back = chart(turned, n, own)
            at = np.flatnonzero(np.isin(series, some))
            where = np.empty(len(sizes), int)
            where[some] = np.arange(len(some))
            r, c = where[series[at]], place[at]
            f, b = ahead[r, c], back[r, sizes[series[at]] - 1 - c]
            # off the level before and off the level after, on the same side: an excursion
            deviation[at] = np.where(f * b > 0, np.minimum(np.abs(f), np.abs(b)), 0.0)
            scale[at] = own[r]
        runs = run_lengths(v, new)
        core = np.asarray(part["seq"].to_numpy(float) // size == part["block"].to_numpy(float)) | part["seq"].isna().to_numpy()
        keep = core & ((deviation > 0.5 * limit * scale) | (runs >= STUCK))
        if keep.any():
            yield pd.DataFrame({"kind": 0, "msg_id": part["msg_id"][keep], "topic": part["topic"][keep], "element": element, "deviation": deviation[keep], "scale": scale[keep], "run": runs[keep], "bin": 0, "n": 1, "repeats": 0})
        with np.errstate(divide="ignore"):
            bins = np.where(deviation > 0, np.floor(np.log(deviation) / math.log(STEP)), -(10**6))
        same = np.zeros(len(v), bool)
        same[1:] = ~new[1:] & (v[1:] == v[:-1]) & (runs[1:] < STUCK)
        counted = pd.DataFrame({"topic": part["topic"][core], "bin": bins[core].astype(int), "repeats": same[core].astype(int), "n": 1})
        counted = counted.groupby(["topic", "bin"], dropna=False, as_index=False).agg(n=("n", "sum"), repeats=("repeats", "sum"))
        yield pd.DataFrame({"kind": 1, "msg_id": None, "topic": counted["topic"], "element": element, "deviation": None, "scale": None, "run": 0, "bin": counted["bin"], "n": counted["n"], "repeats": counted["repeats"]})


def examined(size: int, limit: float = LIMIT):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["source_uri", "topic", "block"]):
            yield from examine(group, size, limit)

    return run


def flag_implausible(message: DataFrame, spec: DataFrame, limit: float = LIMIT, block_size: int = BLOCK) -> DataFrame:
    """Flag the elements of usable messages that their source would not normally produce.

    ``message`` has msg_id, source_uri, topic, seq, timestamp and data; ``spec`` has one
    pair range_lo, range_hi for each topic (null: no limit) and is a reference table of
    fixed size. Readings of one (source_uri, topic) are charted in the order of seq, the
    device's own count, which also places readings with an unset or impossible timestamp.

    Result: msg_id, topic, element, reason, once for each reason: ``excursion`` (off the
    charts of the readings before and after, by more than ``limit`` spreads of the topic
    and half as many of the series), ``stuck`` (in a run of at least STUCK equal readings,
    in a topic whose other readings repeat in less than REPEATS of all cases) and
    ``range``. Lasting changes of level move the charts and are not flagged. Records
    stored repeatedly are one reading. Null, empty and non-finite payloads are not
    examined. Messages of topics without ``spec`` are charted but have no range; those
    of the null topic or source form series of their own.

    Series are cut into blocks of ``block_size`` readings, HALO more at each side, so that a hot
    series spreads over tasks; readings without seq are charted among themselves in the
    order of their time, hour by hour. The charts run once over the data and leave candidates and
    mergeable histograms of the deviations by topic, from which the spreads come.
    """
    block = F.floor(F.col("seq") / block_size)
    counted = F.array_distinct(F.array(block, *(F.greatest(F.lit(0), F.floor((F.col("seq") + d) / block_size)) for d in (-HALO, HALO))))
    hours = -1 - F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1e12), F.col("timestamp"))) / 3600)  # readings without a count
    blocks = F.when(F.col("seq").isNull(), F.array(hours)).otherwise(counted)
    sorted_blocks = (
        usable(message)
        .select("source_uri", "topic", F.explode(blocks).alias("block"), "seq", "msg_id", "timestamp", "data")
        .repartition("source_uri", "topic", "block")
        .sortWithinPartitions("source_uri", "topic", "block", "seq", "timestamp", "msg_id")
    )
    seen = cut(sorted_blocks.mapInPandas(examined(block_size, limit), OUT))
    histogram = seen.filter("kind = 1").groupBy("topic", "element", "bin").agg(F.sum("n").alias("n"), F.sum("repeats").alias("repeats"))
    spread = topic_spread(histogram)
    found = (
        seen.filter("kind = 0").alias("a")
        .join(spread.alias("b"), F.expr("a.topic <=> b.topic AND a.element = b.element"), "left")
        .select(
            "a.msg_id", "a.topic", "a.element",
            F.explode(F.array_compact(F.array(
                F.when((F.col("deviation") > limit * F.col("spread")) & (F.col("deviation") > 0.5 * limit * F.col("scale")), "excursion"),
                F.when((F.col("run") >= STUCK) & (F.col("repeating") < REPEATS), "stuck"),
            ))).alias("reason"),
        )
    )
    limits = F.broadcast(spec.select("topic", "range_lo", "range_hi").dropDuplicates(["topic"]))
    outside = (
        usable(message).join(limits, "topic")
        .filter(F.exists("data", lambda x: (x < F.col("range_lo")) | (x > F.col("range_hi"))))
        .select("msg_id", "topic", F.posexplode("data").alias("element", "x"), "range_lo", "range_hi")
        .filter((F.col("x") < F.col("range_lo")) | (F.col("x") > F.col("range_hi")))
        .select("msg_id", "topic", "element", F.lit("range").alias("reason"))
    )
    return found.unionByName(outside).distinct()


def topic_spread(histogram: DataFrame) -> DataFrame:
    """Spread and share of repeats of each topic and element, from the histogram of its deviations.

    The spread is the largest of what the quantiles 0.8 and 0.9 of the two-sided deviations
    would be for normal noise, so that a topic of coarse resolution, half of whose
    deviations are 0, has a spread as well.
    """
    from pyspark.sql import Window

    group = Window.partitionBy("topic", "element")
    cumulative = histogram.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "whole": F.sum("n").over(group), "again": F.sum("repeats").over(group)})
    value = F.when(F.col("bin") > -(10**6), F.pow(F.lit(STEP), F.col("bin") + 1.0)).otherwise(0.0)
    return (
        cumulative.groupBy("topic", "element")
        .agg(
            F.min(F.when(F.col("upto") >= F.col("whole") * 0.8, value)).alias("q80"),
            F.min(F.when(F.col("upto") >= F.col("whole") * 0.9, value)).alias("q90"),
            F.max(F.col("again") / F.col("whole")).alias("repeating"),
        )
        .select("topic", "element", F.greatest(F.col("q80") / 0.84, F.col("q90") / 1.28).alias("spread"), "repeating")
    )
