"""Synthetic infrared frames: beacons that blink on a noisy dark ground."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.functions import vectors as v

#: Level and noise of the dark ground, level of a beacon's middle, and the variance of its shape in pixels.
DARK, NOISE, BRIGHT, VARIANCE = 15.5375, 2.143087613521848, 200.0, 41.72827445376682
#: The large frame, the frame it is reduced to, the side of a beacon's patch, pixels of one metre, the middle's row, the middle's column with a still and a moving camera.
LARGE, SMALL, SIDE, SCALE, ROW, STILL_COLUMN, MOVING_COLUMN = (512, 640), (32, 40), 30, 100, 256, 320, 120
#: Place (row, column, in metres) of the beacons, seconds of their blinking with a moving camera (0: always on), and the multiple of tenths of seconds they are on at with a still camera.
BEACONS = ((1, 1, 0.2, 5), (1, -1, 0.4, 4), (-1, -1, 1.0, 5), (-1, 1, 0.2, 4), (1, 0, 0.0, 1), (0, -1, 0.0, 1), (-1, 0, 0.0, 1), (0, 1, 0.0, 1))
#: Frames a second, and columns the moving camera passes from one frame to the next.
RATE, STEP = 10, 16


def make_beacon(row: Column, column: Column) -> Column:
    """Value of a beacon's patch at a place counted from its first row and column: a bell over the dark ground."""
    half = SIDE // 2
    square = (row - half) * (row - half) + (column - half) * (column - half)
    least = math.exp(-2 * half * half / (2 * VARIANCE))
    return (F.exp(-square / (2 * VARIANCE)) - least) * (BRIGHT - DARK) + DARK


def make_background(*place: Column, noise: float = NOISE, seed: int = 0) -> Column:
    """Value of the dark ground: a normal deviate from hashes of the place, so the same place has the same value each time."""
    if not noise:
        return F.lit(DARK)
    return DARK + noise * v.deviate(seed, *place)


def frames_of(frames: DataFrame, lit: list[Column], rows: list[Column], columns: list[Column], noise: float, seed: int) -> DataFrame:
    """Small frames of ``frames`` (seq, ts): each pixel is the mean of the four pixels about its middle in the large frame."""
    height, width = LARGE[0] // SMALL[0], LARGE[1] // SMALL[1]

    def value(i: Column) -> Column:
        total = F.lit(0.0)
        for dr in (0, 1):
            for dc in (0, 1):
                r, c = F.floor(i / SMALL[1]) * height + height // 2 - 1 + dr, i % SMALL[1] * width + width // 2 - 1 + dc
                pixel = make_background(F.col("seq"), r, c, noise=noise, seed=seed)
                for on, top, left in zip(lit, rows, columns):
                    inside = on & (r >= top) & (r < top + SIDE) & (c >= left) & (c < left + SIDE)
                    pixel = F.when(inside, make_beacon(r - top, c - left)).otherwise(pixel)
                total = total + pixel
        return total / 4

    cells = F.sequence(F.lit(0), F.lit(SMALL[0] * SMALL[1] - 1))
    return frames.select(
        F.lit("images").alias("topic"), "seq", "ts", F.lit("synth_ir").alias("name"), F.lit(None).cast("string").alias("frame_id"), F.lit(f"synthetic://seed={seed}").alias("source_uri"), F.lit("float64").alias("dtype"),
        F.array(*map(F.lit, SMALL)).alias("shape"), F.transform(cells, value).alias("data"),
    )


def create_synth_image(poses: DataFrame, noise: float = NOISE, seed: int = 0) -> DataFrame:
    """A frame for each pose (seq, ts, x): beacons move by ten rows a metre of x and are on at multiples of their period."""
    shift = (F.col("x") * 10).cast("int")
    at = lambda m, middle: int(m * SCALE + middle - SIDE / 2)
    lit = [F.rint((F.col("ts") * 10) % period) == 0 for *_, period in BEACONS]
    return frames_of(poses, lit, [at(r, ROW) + shift for r, *_ in BEACONS], [F.lit(at(c, STILL_COLUMN)) for _, c, *_ in BEACONS], noise, seed)


def create_synth_image_moving(spark: SparkSession, seconds: float = 5.0, noise: float = NOISE, seed: int = 0) -> DataFrame:
    """Frames of a camera that passes the beacons, which blink with their own periods and leave the frame at its edge."""
    frames = spark.range(math.ceil(seconds * RATE)).select(F.col("id").alias("seq"), (F.col("id") / float(RATE)).alias("ts"))
    lit = [F.lit(True) if not period else F.floor(F.col("seq") / (period / 2 * RATE)) % 2 == 1 for *_, period, _ in BEACONS]
    columns = [F.lit(int(c * SCALE + MOVING_COLUMN - SIDE / 2)) + F.col("seq") * STEP for _, c, *_ in BEACONS]
    return frames_of(frames, lit, [F.lit(int(r * SCALE + ROW - SIDE / 2)) for r, *_ in BEACONS], columns, noise, seed)


def binarization(frames: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(topic, seq, row, col, value): the brightest pixel of every connected bright area of each frame, the first of equals.

    Areas of pixels above the threshold hang together over edges and corners; their mask is threshold_image.
    """
    import numpy as np
    import pandas as pd

    from stratawave.operators.image import array_of

    def areas(im: np.ndarray) -> list[tuple[int, int, float]]:
        bright = im > threshold
        label = np.where(bright, np.arange(im.size).reshape(im.shape), -1)
        while True:  # the smallest number of an area spreads over it
            wide = np.pad(np.where(bright, label, im.size), 1, constant_values=im.size)
            least = np.min([wide[a : a + im.shape[0], b : b + im.shape[1]] for a in range(3) for b in range(3)], axis=0)
            new = np.where(bright, least, -1)
            if (new == label).all():
                break
            label = new
        out = []
        for k in np.unique(label[bright]):
            places = np.flatnonzero(label.ravel() == k)
            best = int(places[np.argmax(im.ravel()[places])])
            out.append((*divmod(best, im.shape[1]), float(im.ravel()[best])))
        return out

    def run(batches):
        for batch in batches:
            rows = [(t, s, *a) for t, s, d, shape in zip(batch["topic"], batch["seq"], batch["data"], batch["shape"]) for a in areas(array_of(d, shape))]
            yield pd.DataFrame(rows, columns=["topic", "seq", "row", "col", "value"])

    return frames.select("topic", "seq", "data", "shape").mapInPandas(run, "topic string, seq long, row int, col int, value double")
