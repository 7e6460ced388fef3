"""Stops and trips from noisy location pings, by movability windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.session import changes, finite, whole_groups

#: Pings of one block and of the overlap at its borders.
BLOCK, HALO = 4096, 512
#: Seconds that a stop lasts at least, and what the gaps between pings may hide of them.
STOP_SECONDS, SLACK = 180.0, 20.0
#: Half a movability window, in seconds; pings it has at least on each side.
HALF_WINDOW, LEAST_PINGS = 75.0, 3
#: Net displacement over path length below which a window does not move; its extent in noise spreads.
MOVABILITY, EXTENT = 0.45, 3.5
#: Metres of noise assumed at least; least radius of a place and bound of the extent of a window, in metres; fastest plausible speed in m/s.
LEAST_NOISE, LEAST_RADIUS, LEAST_EXTENT, FASTEST = 3.0, 18.0, 30.0, 70.0
EARTH = 6378137.0

OUT = "source_uri string, topic string, nav_id long, seq long, timestamp double, east double, north double, good boolean, stopped boolean, run long"


def plane(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of the median position; longitudes across the date line are joined."""
    if not len(lat):
        return lat, lon
    turned = (lon - lon[0] + 180.0) % 360.0 - 180.0
    return np.radians(turned - np.median(turned)) * EARTH * np.cos(np.radians(np.median(lat))), np.radians(lat - np.median(lat)) * EARTH


def plausible(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False for stray fixes: far from the median of their neighbours, for what those neighbours spread and the speed allows."""
    n, good = len(t), np.ones(len(t), bool)
    for _ in range(2):
        index = np.flatnonzero(good)
        if len(index) < 5:
            return good
        m = len(index)
        around = np.clip(np.arange(m)[:, None] + np.array([-3, -2, -1, 1, 2, 3]), 0, m - 1)
        px, py, pt = x[index], y[index], t[index]
        nx, ny = px[around], py[around]
        mx, my = np.median(nx, axis=1), np.median(ny, axis=1)
        off = np.hypot(px - mx, py - my)
        reach = np.median(np.hypot(nx - mx[:, None], ny - my[:, None]), axis=1)
        before, after = np.maximum(np.arange(m) - 1, 0), np.minimum(np.arange(m) + 1, m - 1)
        # a stray fix makes a detour: the way over it is far longer than the way between its neighbours
        way = np.hypot(px - px[before], py - py[before]) + np.hypot(px[after] - px, py[after] - py)
        straight = np.hypot(px[after] - px[before], py[after] - py[before])
        speed = np.minimum(np.hypot(px - px[before], py - py[before]) / np.maximum(pt - pt[before], 1), np.hypot(px[after] - px, py[after] - py) / np.maximum(pt[after] - pt, 1))
        bad = (off > 60 + 6 * reach) | ((way > straight + 120) & (way > 3 * straight + 60)) | (speed > FASTEST)
        good[index[bad]] = False
    return good


def movability(t: np.ndarray, x: np.ndarray, y: np.ndarray, noise: float) -> np.ndarray:
    """True where the window around a ping has a low ratio of net displacement to path and a bounded extent."""
    n = len(t)
    first = np.minimum(np.searchsorted(t, t - HALF_WINDOW, "left"), np.maximum(np.arange(n) - LEAST_PINGS, 0))
    last = np.maximum(np.searchsorted(t, t + HALF_WINDOW, "right") - 1, np.minimum(np.arange(n) + LEAST_PINGS, n - 1))
    path = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    cx, cy, cxx, cyy = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, y, x * x, y * y))
    k = last - first + 1
    # displacement of the mean of the window's later part from that of its earlier part, so that one ping's noise counts little
    middle = (first + last + 1) // 2
    early, late = np.maximum(middle - first, 1), np.maximum(last + 1 - middle, 1)
    dx = (cx[last + 1] - cx[middle]) / late - (cx[middle] - cx[first]) / early
    dy = (cy[last + 1] - cy[middle]) / late - (cy[middle] - cy[first]) / early
    net = 2 * np.hypot(dx, dy)
    length = path[last] - path[first]
    variance = (cxx[last + 1] - cxx[first]) / k - ((cx[last + 1] - cx[first]) / k) ** 2 + (cyy[last + 1] - cyy[first]) / k - ((cy[last + 1] - cy[first]) / k) ** 2
    extent = np.sqrt(np.maximum(variance, 0))
    return (net < MOVABILITY * np.maximum(length, 1e-9)) & (extent < np.maximum(EXTENT * noise, LEAST_EXTENT)) & (k > 2)


def noise_of(x: np.ndarray, y: np.ndarray) -> float:
    """Spread of a position along one axis: from second differences, which steady motion leaves at zero."""
    if len(x) < 5:
        return LEAST_NOISE
    second = np.concatenate([np.diff(x, 2), np.diff(y, 2)])
    return max(LEAST_NOISE, float(np.quantile(np.abs(second), 0.3)) / 0.3853 / np.sqrt(6))


def stops(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each stop among plausible pings in the order of time."""
    n = len(t)
    if n < 2:
        return []
    noise = noise_of(x, y)
    radius = max(LEAST_RADIUS, 2.6 * noise)
    still = movability(t, x, y, noise)
    found: list[list[int]] = []
    # a silence with the device at the same place on both sides is standing as well
    quiet = np.flatnonzero((np.diff(t) >= HALF_WINDOW) & (np.hypot(np.diff(x), np.diff(y)) < 1.5 * radius))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], still.astype(int), [0]])))
    seeds = [(a, b - 1) for a, b in zip(edges[::2], edges[1::2])] + [(i, i + 1) for i in quiet]
    for a, b in sorted(seeds):
        if found and a <= found[-1][1] + 1:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    grown = [settle(t, x, y, a, b, radius) for a, b in found]
    merged: list[list[int]] = []
    for a, b in sorted(g for g in grown if g):
        if merged:
            p, q = merged[-1]
            near = np.hypot(np.median(x[a : b + 1]) - np.median(x[p : q + 1]), np.median(y[a : b + 1]) - np.median(y[p : q + 1])) < radius
            between = slice(q + 1, a)
            # back at the place so soon, the device never left it: those fixes drifted
            inside = np.all(np.hypot(x[between] - np.median(x[p : q + 1]), y[between] - np.median(y[p : q + 1])) < 6 * radius)
            if a <= q or (near and inside and a - q <= 6 and t[a] - t[q] < 2 * HALF_WINDOW):
                merged[-1][1] = max(q, b)
                continue
        merged.append([a, b])
    trimmed = [trim(x, y, a, b, noise) for a, b in merged]
    return [(a, b) for a, b in trimmed if lasting(t, x, y, a, b) >= STOP_SECONDS]


def trim(x: np.ndarray, y: np.ndarray, a: int, b: int, noise: float) -> tuple[int, int]:
    """Leave out up to two pings at an end that lie on the way in or out: off the place, in the direction of the ping beyond."""
    cx, cy = np.median(x[a : b + 1]), np.median(y[a : b + 1])

    def passing(i: int, beyond: int) -> bool:
        ux, uy, vx, vy = x[i] - cx, y[i] - cy, x[beyond] - cx, y[beyond] - cy
        own, far = np.hypot(ux, uy), np.hypot(vx, vy)
        return own > 1.5 * noise and far > own and ux * vx + uy * vy > 0.5 * own * far

    if b - a >= 4:
        for _ in range(2):
            if a and passing(a, a - 1):
                a += 1
            if b + 1 < len(x) and passing(b, b + 1):
                b -= 1
    return a, b


def settle(t: np.ndarray, x: np.ndarray, y: np.ndarray, a: int, b: int, radius: float) -> tuple[int, int] | None:
    """The stop around a seed: the stretch near its place, with single pings of noise inside."""
    for _ in range(4):
        cx, cy = np.median(x[a : b + 1]), np.median(y[a : b + 1])
        near = np.hypot(x - cx, y - cy) < radius
        core = np.flatnonzero(near[a : b + 1])
        if not len(core):
            return None
        p, q = a + int(core[0]), a + int(core[-1])
        while p > 0 and (near[p - 1] or (p > 1 and near[p - 2] and np.hypot(x[p - 1] - cx, y[p - 1] - cy) < 2 * radius)):
            p -= 1
        while q < len(t) - 1 and (near[q + 1] or (q < len(t) - 2 and near[q + 2] and np.hypot(x[q + 1] - cx, y[q + 1] - cy) < 2 * radius)):
            q += 1
        if (p, q) == (a, b):
            break
        a, b = p, q
    return a, b


def lasting(t: np.ndarray, x: np.ndarray, y: np.ndarray, a: int, b: int) -> float:
    """Seconds of a stop, with half of the ordinary gaps at its ends."""
    before = min(t[a] - t[a - 1], SLACK) / 2 if a else 0.0
    after = min(t[b + 1] - t[b], SLACK) / 2 if b + 1 < len(t) else 0.0
    return t[b] - t[a] + before + after


def label(group: pd.DataFrame) -> pd.DataFrame:
    """Mark the pings of one block of a drive: good (a plausible position), stopped, run (numbers stops and trips)."""
    t = group["timestamp"].to_numpy(float)
    lat, lon = group["lat"].to_numpy(float), group["lon"].to_numpy(float)
    there = np.isfinite(lat) & np.isfinite(lon) & (np.abs(lat) <= 90) & (np.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    x, y = np.full(len(t), np.nan), np.full(len(t), np.nan)
    x[there], y[there] = plane(lat[there], lon[there])
    index = np.flatnonzero(there)
    index = index[plausible(t[index], x[index], y[index])]
    good, stopped = np.zeros(len(t), bool), np.zeros(len(t), bool)
    good[index] = True
    for a, b in stops(t[index], x[index], y[index]):
        stopped[index[a] : index[b] + 1] = True  # pings between are in the stop whatever they report
    run = np.cumsum(np.concatenate([[0], stopped[1:] != stopped[:-1]])) if len(t) else np.zeros(0, int)
    return pd.DataFrame({"source_uri": group["source_uri"], "topic": group["topic"], "nav_id": group["nav_id"], "seq": group["seq"], "timestamp": t, "east": x, "north": y, "good": good, "stopped": stopped, "run": run, "block": group["block"]})


def labelled(size: int):
    keys = ["source_uri", "topic", "block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in whole_groups(batches, keys):
            chunk = chunk[changes(chunk, [*keys, "seq", "timestamp", "nav_id"])].reset_index(drop=True)
            starts = np.append(np.flatnonzero(changes(chunk, keys)), len(chunk))
            for a, b in zip(starts[:-1], starts[1:]):
                out = label(chunk.iloc[a:b].reset_index(drop=True))
                core = (out["seq"] // size == out["block"]) | out["seq"].isna()
                yield out.loc[core, [c.split()[0] for c in OUT.split(", ")]]

    return run


def days() -> Column:
    """The block of a ping without seq: its day, below the blocks of counted pings."""
    return -1 - F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1e12), F.col("timestamp"))) / 86400)


def mark_stops(navsensor: DataFrame, block_size: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Each timed ping once, with what it is part of: stopped is true within a stop.

    ``navsensor`` has source_uri, topic, nav_id, seq, timestamp and data (lat, lon, ...).
    Pings without a finite timestamp are left out; repeated rows (same nav_id) become one.
    Pings with a missing, impossible or stray position carry good = false and are judged
    by the pings around them; status is not used, since it is not dependable. A drive
    whose positions are all missing has no stop.

    Pings of a drive are taken in the order of seq, the device's own count. Drives are cut
    into blocks of ``block_size`` pings that see ``halo`` more on each side, so no task holds an
    unbounded drive, and the labels of a stop that crosses a border agree on both sides.
    Pings without seq are taken among themselves in the order of their time, day by day.
    """
    counted = F.array_distinct(F.array(*(F.greatest(F.lit(0), F.floor((F.col("seq") + d) / block_size)) for d in (-halo, 0, halo))))
    blocks = F.when(F.col("seq").isNull(), F.array(days())).otherwise(counted)
    return (
        navsensor.filter(finite(F.col("timestamp")))
        .select("source_uri", "topic", F.explode(blocks).alias("block"), "seq", "timestamp", "nav_id", F.get("data", F.lit(0)).alias("lat"), F.get("data", F.lit(1)).alias("lon"))
        .repartition("source_uri", "topic", "block")
        .sortWithinPartitions("source_uri", "topic", "block", "seq", "timestamp", "nav_id")
        .mapInPandas(labelled(block_size), OUT)
    )


def stops_and_trips(navsensor: DataFrame, block_size: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Stops and trips of each drive: source_uri, topic, kind, start_time, end_time, duration, distance, pings.

    A trip runs from the last ping of the stop before to the first of the stop after; its
    distance is the path over plausible positions, a stop's distance is 0. Runs of equal
    kind that meet at a block's border are one. A drive without a stop is one trip.
    """
    marked = mark_stops(navsensor, block_size, halo)
    block = F.when(F.col("seq").isNull(), days()).otherwise(F.floor(F.col("seq") / block_size))
    inside = Window.partitionBy("source_uri", "topic", "block", "run").orderBy("seq", "timestamp", "nav_id")
    spot = F.when(F.col("good"), F.struct("east", "north"))
    before = F.last(spot, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("good") & before.isNotNull() & ~F.col("stopped"), F.hypot(F.col("east") - before["east"], F.col("north") - before["north"])).otherwise(0.0)
    runs = (
        marked.withColumn("block", block).withColumn("step", step)
        .groupBy("source_uri", "topic", "block", "run", "stopped")
        .agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.sum("step").alias("distance"), F.count(F.lit(1)).alias("pings"))
    )
    drive = Window.partitionBy("source_uri", "topic").orderBy("block", "run")
    new = (F.lag("stopped").over(drive).eqNullSafe(F.col("stopped"))).cast("int")
    islands = runs.withColumn("island", F.sum(1 - new).over(drive.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("source_uri", "topic", "island", "stopped").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("distance").alias("distance"), F.sum("pings").alias("pings")
    )
    order = Window.partitionBy("source_uri", "topic").orderBy("island")
    return (
        joined.withColumns({
            "start_time": F.when(~F.col("stopped"), F.coalesce(F.lag("end_time").over(order), F.col("start_time"))).otherwise(F.col("start_time")),
            "end_time": F.when(~F.col("stopped"), F.coalesce(F.lead("start_time").over(order), F.col("end_time"))).otherwise(F.col("end_time")),
        })
        .select(
            "source_uri", "topic", F.when(F.col("stopped"), "stop").otherwise("trip").alias("kind"), "start_time", "end_time",
            (F.col("end_time") - F.col("start_time")).alias("duration"), "distance", "pings",
        )
    )
