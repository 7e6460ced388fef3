"""Images and depth maps: one frame is one row (topic, seq, ts, data flat, shape).

Pointwise operators are array expressions in the JVM. Operators on neighbourhoods,
spectra and pairs of frames run NumPy over Arrow batches of whole frames: a frame never
leaves its row, so nothing is shuffled but where frames of a sequence meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.functions import camera as cam
from stratawave.functions import vectors as v
from stratawave.operators import kernels

INTEGERS = {"uint8": (0, 255), "uint16": (0, 65535), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1)}


def array_of(data, shape) -> np.ndarray:
    return np.asarray(data, float).reshape([int(x) for x in shape])


def frames(df: DataFrame, run: Callable[[np.ndarray], np.ndarray | Sequence[np.ndarray]]) -> DataFrame:
    """New payloads: run(frame) over batches; a null payload stays null."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [None if d is None else np.asarray(run(array_of(d, s)), float) for d, s in zip(batch["data"], batch["shape"])]
            yield batch.assign(data=[None if o is None else o.ravel() for o in out], shape=[s if o is None else list(o.shape) for o, s in zip(out, batch["shape"])])

    return df.mapInPandas(each, df.schema)


def split_rows(data: Column, width: Column, rows: Column) -> Column:
    """An array cut into ``rows`` arrays of ``width`` elements; exploding it does not carry the whole along with each row."""
    return v.let(F.struct(data.alias("d"), width.alias("w"), rows.alias("n")), lambda s: F.when(s["n"] > 0, F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.slice(s["d"], i * s["w"] + 1, s["w"]))).otherwise(F.array().cast("array<array<double>>")))


def pixels(df: DataFrame) -> DataFrame:
    """Rows (topic, seq, row, col, chan) of frames, for joins and aggregates over pixels."""
    deep = F.greatest(F.coalesce(F.get("shape", F.lit(2)), F.lit(1)), F.lit(1))
    cols = F.get("shape", F.lit(1))
    each = df.filter(F.size("data") > 0).select("topic", "seq", cols.alias("w"), F.posexplode(split_rows(F.col("data"), deep, F.get("shape", F.lit(0)) * cols)).alias("i", "chan"))
    return each.select("topic", "seq", F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), (F.col("i") % F.col("w")).cast("int").alias("col"), "chan")


def stretched(data: Column, low: Column, high: Column) -> Column:
    """Elements to 0 .. 1 between two values, as 32-bit floats would have them; all 0 without a span."""
    ready = F.struct(data.alias("d"), low.alias("low"), high.alias("high"))
    return v.let(ready, lambda s: F.transform(s["d"], lambda x: F.when(s["high"] == s["low"], 0.0).otherwise((x - s["low"]) / (s["high"] - s["low"])).cast("float").cast("double")))


def normalize_image(df: DataFrame, min_value: float | None = None, max_value: float | None = None) -> DataFrame:
    """Each frame to 0 .. 1 between its own least and largest value or those given; without a span all 0."""
    low = (lambda d: F.lit(float(min_value))) if min_value is not None else F.array_min
    high = (lambda d: F.lit(float(max_value))) if max_value is not None else F.array_max
    return df.withColumn("data", v.let(F.col("data"), lambda d: stretched(d, low(d), high(d))))


def normalize_images(df: DataFrame, min_value: float | None = None, max_value: float | None = None, per_image: bool = False) -> DataFrame:
    """Frames of a topic to 0 .. 1 by the least and largest value of the whole topic, or of each frame."""
    if per_image or (min_value is not None and max_value is not None):
        return normalize_image(df, min_value, max_value)
    ends = df.groupBy("topic").agg(F.min(F.array_min("data")).alias("low"), F.max(F.array_max("data")).alias("high"))
    a, b = df.alias("a"), ends.alias("b")
    low = F.lit(float(min_value)) if min_value is not None else F.col("b.low")
    high = F.lit(float(max_value)) if max_value is not None else F.col("b.high")
    changed = stretched(F.col("a.data"), low, high)
    return a.join(b, F.col("a.topic").eqNullSafe(F.col("b.topic"))).select(*(changed.alias(c) if c == "data" else F.col(f"a.`{c}`") for c in df.columns))


def pad_image(df: DataFrame, pad_width, value: float = 0) -> DataFrame:
    """Constant padding: one width, (rows, columns), or ((top, bottom), (left, right))."""
    p = np.asarray(pad_width)
    widths = [(int(p), int(p))] * 2 if p.ndim == 0 else [(int(x), int(x)) for x in p] if p.ndim == 1 else [tuple(int(y) for y in x) for x in p]
    if min(min(w) for w in widths) < 0:
        raise ValueError("padding is not negative")
    return frames(df, lambda im: np.pad(im, widths + [(0, 0)] * (im.ndim - 2), constant_values=value))


pad_images = pad_image


def nearest_indices(n: int, out: int) -> np.ndarray:
    return np.rint(np.linspace(0, n - 1, out)).astype(int)


def resized(im: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    return im[nearest_indices(im.shape[0], shape[0])][:, nearest_indices(im.shape[1], shape[1])]


def resize_nearest(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    if min(shape) < 1:
        raise ValueError("a shape is at least 1 x 1")
    return frames(df, lambda im: resized(im, shape))


resize_images_nearest = resize_nearest


def resize_images(df: DataFrame, shape: Sequence[int], method: str = "nearest") -> DataFrame:
    if method != "nearest":
        raise ValueError("the method is nearest")
    return resize_nearest(df, shape)


def crop_image(df: DataFrame, row_start: int, row_stop: int, col_start: int, col_stop: int) -> DataFrame:
    return frames(df, lambda im: im[row_start:row_stop, col_start:col_stop])


crop_images = crop_image


def per_pixel(df: DataFrame, channels: int, out: int, make: Callable[[Callable[[int], Column]], list[Column]]) -> DataFrame:
    """New channels from the old of each pixel, which ``make`` gets as a function of the channel; ``out`` 0 drops the channel axis."""

    def changed(d: Column) -> Column:
        n = (F.size(d) / channels).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*make(lambda k: F.get(d, (i * channels + k).cast("int"))))))

    wrong = F.raise_error(F.lit(f"{channels} channels are needed")).cast("array<double>")
    good = F.get("shape", F.size("shape") - 1) == channels if channels > 1 else F.lit(True)
    shape = F.slice("shape", 1, 2) if not out else F.concat(F.slice("shape", 1, 2), F.array(F.lit(out)))
    return df.withColumn("data", F.when(good, v.let(F.col("data"), changed)).otherwise(wrong)).withColumn("shape", shape)


def rgb_to_gray(df: DataFrame) -> DataFrame:
    """Luminance 0.299 R + 0.587 G + 0.114 B."""
    return per_pixel(df, 3, 0, lambda c: [0.299 * c(0) + 0.587 * c(1) + 0.114 * c(2)])


def convert_color(df: DataFrame, mode: str, alpha: float | None = None) -> DataFrame:
    """One of rgb_to_gray, bgr_to_gray, rgb_to_bgr, bgr_to_rgb, rgba_to_rgb, rgb_to_rgba, gray_to_rgb; alpha is 255 for integer images and 1 for others by default."""
    m = mode.lower()
    pick = lambda *ks: (lambda c: [c(k) for k in ks])
    if m == "rgb_to_gray":
        return rgb_to_gray(df)
    if m == "bgr_to_gray":
        return rgb_to_gray(per_pixel(df, 3, 3, pick(2, 1, 0)))
    if m in ("rgb_to_bgr", "bgr_to_rgb"):
        return per_pixel(df, 3, 3, pick(2, 1, 0))
    if m == "rgba_to_rgb":
        return per_pixel(df, 4, 3, pick(0, 1, 2))
    if m == "rgb_to_rgba":
        full = F.lit(float(alpha)) if alpha is not None else F.when(F.col("dtype").contains("int"), 255.0).otherwise(1.0) if "dtype" in df.columns else F.lit(1.0)
        return per_pixel(df, 3, 4, lambda c: [c(0), c(1), c(2), full])
    if m == "gray_to_rgb":
        return per_pixel(df, 1, 3, lambda c: [c(0)] * 3)
    raise ValueError(f"unknown mode {mode}")


def convert_image_dtype(df: DataFrame, dtype: str, source: str, scale: bool = True, clip: bool = True) -> DataFrame:
    """Values of dtype ``source`` on the scale of ``dtype``: integers span their range, floats 0 to 1; integers round half to even."""
    known = {*INTEGERS, "float32", "float64", "bool"}
    if dtype not in known or source not in known:
        raise ValueError("unknown dtype")

    def convert(x: Column) -> Column:
        if not scale:
            return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double") if dtype in INTEGERS else x
        if source == dtype:
            return x
        if dtype not in INTEGERS:
            if source in INTEGERS:
                low, high = INTEGERS[source]
                x = (x - low) / (high - low) if low < 0 else x / high
            return x.cast("float").cast("double") if dtype == "float32" else x
        low, high = INTEGERS[dtype]
        if source in INTEGERS:
            a, b = INTEGERS[source]
            x = (x - a) / (b - a) * (high - low) + low if a < 0 else x / b * high if b != high else x
        else:
            x = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) if clip else x) * high
        x = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)) if clip else x
        return F.rint(x)

    out = df.withColumn("data", F.transform("data", convert))
    return out.withColumn("dtype", F.lit(dtype)) if "dtype" in df.columns else out


def in_range(x: Column, min_value=None, max_value=None, inclusive: bool = True, finite: bool = True) -> Column:
    out = v.is_finite(x) if finite else F.lit(True)
    if min_value is not None:
        out = out & ~F.isnan(x) & ((x >= min_value) if inclusive else (x > min_value))
    if max_value is not None:
        out = out & ~F.isnan(x) & ((x <= max_value) if inclusive else (x < max_value))
    return F.coalesce(out, F.lit(False))


def image_mask(min_value=None, max_value=None, inclusive: bool = True, finite: bool = True, data: str = "data") -> Column:
    """Array of booleans by bounds and finiteness."""
    return F.transform(data, lambda x: in_range(x, min_value, max_value, inclusive, finite))


def apply_image_mask(data: Column | str, mask: Column | str, fill_value: float = 0) -> Column:
    """Payload where the mask, of as many elements, is true; ``fill_value`` elsewhere."""
    return F.zip_with(v.col(data), v.col(mask), lambda x, m: F.when(m, x).otherwise(F.lit(float(fill_value))))


def threshold_image(threshold: float, above: bool = True, inclusive: bool = True, high: float = 1.0, low: float = 0.0, data: str = "data") -> Column:
    """Two values by a threshold; NaN is low."""

    def test(x: Column) -> Column:
        hit = ((x >= threshold) if inclusive else (x > threshold)) if above else ((x <= threshold) if inclusive else (x < threshold))
        return F.when(~F.isnan(x) & hit, float(high)).otherwise(float(low))

    return F.transform(data, test)


def kernel_size(size) -> tuple[int, int]:
    h, w = (size, size) if np.ndim(size) == 0 else size
    if h < 1 or w < 1:
        raise ValueError("a kernel is at least 1 x 1")
    return int(h), int(w)


def neighbourhood(im: np.ndarray, size, mode: str, **more) -> np.ndarray:
    """View of the padded windows of an image: (rows, columns, ..., h, w)."""
    h, w = kernel_size(size)
    pad = [(h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)] + [(0, 0)] * (im.ndim - 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(im, pad, mode=mode, **more), (h, w), axis=(0, 1))


def morph(df: DataFrame, size, iterations: int, pick) -> DataFrame:
    if iterations < 1:
        raise ValueError("there is at least one iteration")

    def run(im: np.ndarray) -> np.ndarray:
        m = im != 0
        for _ in range(iterations):
            m = pick(neighbourhood(m, size, "constant", constant_values=False), axis=(-2, -1))
        return m.astype(float)

    return frames(df, run)


def dilate_mask(df: DataFrame, size=3, iterations: int = 1) -> DataFrame:
    """True where any pixel of the window is; outside counts as false."""
    return morph(df, size, iterations, np.any)


def erode_mask(df: DataFrame, size=3, iterations: int = 1) -> DataFrame:
    """True where all pixels of the window are; outside counts as false."""
    return morph(df, size, iterations, np.all)


def open_mask(df: DataFrame, size=3, iterations: int = 1) -> DataFrame:
    return dilate_mask(erode_mask(df, size, iterations), size, iterations)


def close_mask(df: DataFrame, size=3, iterations: int = 1) -> DataFrame:
    return erode_mask(dilate_mask(df, size, iterations), size, iterations)


def as_planes(df: DataFrame, names: Sequence[str], run: Callable[[np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
    """Adds one array column for each named result of a frame."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` array<double>" for n in names)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [[None] * len(names) if d is None else [np.asarray(o, float).ravel() for o in run(array_of(d, s))] for d, s in zip(batch["data"], batch["shape"])]
            yield batch.assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})

    return df.mapInPandas(each, schema)


def image_gradients(df: DataFrame, method: str = "sobel") -> DataFrame:
    """Adds dy, dx and magnitude: Sobel weights over 8 with repeated edges, or central differences."""
    if method not in ("sobel", "central"):
        raise ValueError("the method is sobel or central")

    def run(im: np.ndarray) -> list[np.ndarray]:
        if method == "central":
            dy, dx = np.gradient(im, axis=(0, 1))
        else:
            smooth, step = np.array([1.0, 2.0, 1.0]) / 8, np.array([-1.0, 0.0, 1.0])
            near = neighbourhood(im, 3, "edge")
            dy, dx = (np.einsum("...ij,i,j->...", near, a, b) for a, b in ((step, smooth), (smooth, step)))
        return [dy, dx, np.hypot(dy, dx)]

    return as_planes(df, ("dy", "dx", "magnitude"), run)


def image_pyramid(df: DataFrame, levels: int, downscale: float = 2.0) -> DataFrame:
    """A row for each frame and level, the frame itself at level 0, each next one smaller by ``downscale``."""
    if levels < 1 or downscale <= 1:
        raise ValueError("levels are at least 1 and downscale above 1")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", level int"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            now = [None if d is None else array_of(d, s) for d, s in zip(batch["data"], batch["shape"])]
            for level in range(levels):
                if level:
                    now = [None if im is None else resized(im, [max(1, int(np.ceil(n / downscale))) for n in im.shape[:2]]) for im in now]
                yield batch.assign(data=[None if im is None else im.ravel() for im in now], shape=[s if im is None else list(im.shape) for im, s in zip(now, batch["shape"])], level=level)

    return df.mapInPandas(each, schema)


def local_statistics(df: DataFrame, size=3, statistics: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Adds the named statistics of edge-padded windows: mean, std (by n), min, max."""
    make = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max}
    if unknown := [s for s in statistics if s not in make]:
        raise ValueError(f"unknown statistics: {unknown}")
    return as_planes(df, list(statistics), lambda im: [make[s](neighbourhood(im, size, "edge"), axis=(-2, -1)) for s in statistics])


def local_mean(df: DataFrame, size=3) -> DataFrame:
    return local_statistics(df, size, ("mean",))


def local_std(df: DataFrame, size=3) -> DataFrame:
    return local_statistics(df, size, ("std",))


def with_previous_frame(df: DataFrame) -> DataFrame:
    """Frames beside the one before them in their topic; the first of a topic is left out."""
    from stratawave.operators.order import with_neighbours

    return with_neighbours(df, ["topic"], "seq", ["data", "shape"], block=1024, ahead=False).filter(F.col("prev_data").isNotNull())


def estimate_image_shift(pairs: DataFrame, reference: str = "prev_data", moving: str = "data", max_shift: int | None = None) -> DataFrame:
    """Adds shift (rows, columns) of the moving frame against the reference, both of the row's shape."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", shift array<int>"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(shift=[list(kernels.image_shift(array_of(a, s), array_of(b, s), max_shift)) for a, b, s in zip(batch[reference], batch[moving], batch["shape"])])

    return pairs.mapInPandas(each, schema)


def frame_optical_flow(pairs: DataFrame, max_shift: int | None = None, block_size: int | Sequence[int] | None = None) -> DataFrame:
    """Adds flow: (rows, columns, 2) shifts (dy, dx) against prev_data, one for the frame or for each block."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", flow array<double>"

    def field(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h, w = a.shape[:2]
        bh, bw = (h, w) if block_size is None else kernel_size(block_size)
        out = np.empty((h, w, 2))
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                part = np.s_[r : r + bh, c : c + bw]
                out[part] = kernels.image_shift(a[part], b[part], max_shift)
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(flow=[field(array_of(a, s), array_of(b, s)).ravel() for a, b, s in zip(batch["prev_data"], batch["data"], batch["shape"])])

    return pairs.mapInPandas(each, schema)


def frame_to_frame_optical_flow(df: DataFrame, max_shift: int | None = None, block_size=None) -> DataFrame:
    """Flow of each frame of a topic against the one before it."""
    return frame_optical_flow(with_previous_frame(df), max_shift, block_size).drop("prev_data", "prev_shape")


iter_frame_optical_flow = frame_to_frame_optical_flow


def translate_image(df: DataFrame, shift: Column | Sequence[int], fill_value: float = 0) -> DataFrame:
    """Frames moved by whole pixels: one shift for all, or a column of (rows, columns)."""
    by = shift if isinstance(shift, Column) else F.array(*(F.lit(int(x)) for x in shift))
    named = df.withColumn("own_shift", by)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[kernels.translate(array_of(d, s), tuple(m), fill_value).ravel() for d, s, m in zip(batch["data"], batch["shape"], batch["own_shift"])])

    return named.mapInPandas(each, named.schema).drop("own_shift")


def align_image(pairs: DataFrame, max_shift: int | None = None, fill_value: float = 0) -> DataFrame:
    """Each frame moved onto its prev_data; shift tells by how much it was off."""
    found = estimate_image_shift(pairs, "prev_data", "data", max_shift)
    return translate_image(found, F.transform("shift", lambda x: -x), fill_value)


def align_images(df: DataFrame, max_shift: int | None = None, fill_value: float = 0, incremental: bool = True) -> DataFrame:
    """Frames moved onto the first of their topic, with shift.

    Incrementally, the shifts between neighbours are estimated in parallel and added up by
    a running sum along the topic; else each frame is compared with the first.
    """
    from stratawave.operators.order import running_sum, same

    if incremental:
        steps = estimate_image_shift(with_previous_frame(df), max_shift=max_shift).select("topic", "seq", "shift")
        a, b = df.alias("a"), steps.alias("b")
        joined = a.join(b, same("a", "b", ["topic", "seq"]), "left").select("a.*", *(F.coalesce(F.get("b.shift", F.lit(i)), F.lit(0)).alias(f"step_{i}") for i in range(2)))
        summed = running_sum(joined, ["topic"], "seq", {"sum_0": F.col("step_0"), "sum_1": F.col("step_1")})
        placed = summed.withColumn("shift", F.array(F.col("sum_0").cast("int"), F.col("sum_1").cast("int"))).select(*df.columns, "shift")
    else:
        first = df.groupBy("topic").agg(F.min_by("data", "seq").alias("prev_data"))
        a, b = df.alias("a"), first.alias("b")
        placed = estimate_image_shift(a.join(b, same("a", "b", ["topic"])).select("a.*", "b.prev_data"), max_shift=max_shift).drop("prev_data")
    return translate_image(placed, F.transform("shift", lambda x: -x), fill_value)


iter_aligned_images = align_images


def motion_compensated_rolling_windows(df: DataFrame, window_size: int, max_shift: int | None = None, fill_value: float = 0, min_periods: int = 1) -> DataFrame:
    """Trailing windows (topic, seq, frames, shape, shifts) of frames moved onto the newest of the window."""
    from stratawave.operators.windows import rows_before

    if not 1 <= min_periods <= window_size:
        raise ValueError("min_periods lies between 1 and the window size")
    windows = rows_before(df, ["topic"], F.struct("seq", "data"), window_size, block=max(1024, window_size)).filter(F.size("window") >= min_periods)
    schema = "topic string, seq long, shape array<int>, frames array<array<double>>, shifts array<array<int>>"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for topic, seq, shape, window in zip(batch["topic"], batch["seq"], batch["shape"], batch["window"]):
                stack = [array_of(w["data"], shape) for w in window]
                shifts = [kernels.image_shift(stack[-1], im, max_shift) for im in stack]
                out.append((topic, seq, shape, [kernels.translate(im, (-s[0], -s[1]), fill_value).ravel() for im, s in zip(stack, shifts)], [list(s) for s in shifts]))
            yield pd.DataFrame(out, columns=["topic", "seq", "shape", "frames", "shifts"])

    return windows.select("topic", "seq", "shape", "window").mapInPandas(each, schema)


iter_motion_compensated_windows = motion_compensated_rolling_windows


def fft_filter(df: DataFrame, low: float = 0.1, high: float = 0.9, last: int = 10) -> DataFrame:
    """(topic, shape, data, dominant): the newest of the last frames of each topic, band-passed over time, and each pixel's dominant frequency bin."""
    newest = df.withColumn("from_end", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("seq").desc()))).filter(F.col("from_end") <= last)

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        stack = np.stack([array_of(d, s) for d, s in zip(frame["data"], frame["shape"])])
        filtered, bins = kernels.band_filter(stack, low, high, last)
        return pd.DataFrame({"topic": [frame["topic"].iloc[0]], "shape": [list(frame["shape"].iloc[-1])], "data": [filtered[-1].ravel()], "dominant": [bins.ravel().astype(float)]})

    return newest.groupBy("topic").applyInPandas(each, "topic string, shape array<int>, data array<double>, dominant array<double>")


def valid_depth_mask(depth: Column, min_depth: float = 0.0, max_depth: float | None = None) -> Column:
    """Finite, above ``min_depth`` and at most ``max_depth``."""
    good = v.is_finite(depth) & (depth > min_depth)
    return F.coalesce(good if max_depth is None else good & (depth <= max_depth), F.lit(False))


def depth_to_point_grid(df: DataFrame, fx=None, fy=None, cx=None, cy=None, scale: float = 1.0, camera_matrix=None) -> DataFrame:
    """Every pixel of depth frames as (topic, seq, row, col, x, y, z); coordinates are NaN where the depth is invalid."""
    k = cam.intrinsics_of(fx, fy, cx, cy, camera_matrix)
    each = pixels(df).withColumn("z", F.get("chan", F.lit(0)) * float(scale))
    good, nan = valid_depth_mask(F.col("z")), F.lit(float("nan"))
    x, y = (F.col("col") - float(k[0, 2])) * F.col("z") / float(k[0, 0]), (F.col("row") - float(k[1, 2])) * F.col("z") / float(k[1, 1])
    return each.select("topic", "seq", "row", "col", *(F.when(good, e).otherwise(nan).alias(n) for e, n in ((x, "x"), (y, "y"), (F.col("z"), "z"))))


def depth_to_points(df: DataFrame, fx=None, fy=None, cx=None, cy=None, scale: float = 1.0, camera_matrix=None) -> DataFrame:
    """The valid pixels of depth frames as points."""
    return depth_to_point_grid(df, fx, fy, cx, cy, scale, camera_matrix).filter(~F.isnan("z"))


def depth_to_normals(df: DataFrame, fx=None, fy=None, cx=None, cy=None, scale: float = 1.0, camera_matrix=None, orient_toward_camera: bool = True) -> DataFrame:
    """(topic, seq, row, col, nx, ny, nz): across central differences of the point grid inside the frame, NaN elsewhere and where a neighbour is invalid."""
    g = depth_to_point_grid(df, fx, fy, cx, cy, scale, camera_matrix)
    p = F.array("x", "y", "z")
    along, down = Window.partitionBy("topic", "seq", "row").orderBy("col"), Window.partitionBy("topic", "seq", "col").orderBy("row")
    near = g.withColumns({"west": F.lag(p).over(along), "east": F.lead(p).over(along)}).withColumns({"north": F.lag(p).over(down), "south": F.lead(p).over(down)})
    apart = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    steps = F.struct(p.alias("p"), apart(F.col("east"), F.col("west")).alias("dx"), apart(F.col("south"), F.col("north")).alias("dy"))

    def crossed(s: Column) -> Column:
        return F.struct(s["p"].alias("p"), F.array(*v.cross(v.unpack(s["dx"], 3), v.unpack(s["dy"], 3))).alias("n"))

    def finished(s: Column) -> Column:
        size, facing = v.norm(v.unpack(s["n"], 3)), -v.dot(v.unpack(s["n"], 3), v.unpack(s["p"], 3))
        good = F.forall(s["p"], lambda x: v.is_finite(x)) & v.is_finite(size) & (size > 0)
        unit = F.transform(s["n"], lambda x: (F.when(facing < 0, -x).otherwise(x) if orient_toward_camera else x) / size)
        return F.when(good, unit).otherwise(F.array_repeat(F.lit(float("nan")), 3))

    normal = v.let(steps, crossed, finished)
    return near.select("topic", "seq", "row", "col", normal.alias("n")).select("topic", "seq", "row", "col", *(F.get("n", F.lit(i)).alias(f"n{c}") for i, c in enumerate("xyz")))


def rgbd_to_points(depth: DataFrame, images: DataFrame, fx=None, fy=None, cx=None, cy=None, scale: float = 1.0, camera_matrix=None) -> DataFrame:
    """Points of depth frames with the channels of the colour frame of the same topic and seq."""
    a, b = depth_to_points(depth, fx, fy, cx, cy, scale, camera_matrix).alias("a"), pixels(images).alias("b")
    on = F.col("a.topic").eqNullSafe(F.col("b.topic")) & (F.col("a.seq") == F.col("b.seq")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.col") == F.col("b.col"))
    return a.join(b, on).select("a.*", F.col("b.chan").alias("attrs"))


def fuse_rgbd_frames(depth: DataFrame, images: DataFrame | None = None, fx=None, fy=None, cx=None, cy=None, scale: float = 1.0, transforms: DataFrame | None = None, camera_matrix=None) -> DataFrame:
    """Points of all frames, moved by the transform (16) of their frame (topic, seq, transform) where given; one long table is the fused cloud."""
    points = depth_to_points(depth, fx, fy, cx, cy, scale, camera_matrix) if images is None else rgbd_to_points(depth, images, fx, fy, cx, cy, scale, camera_matrix)
    if transforms is None:
        return points
    a, b = points.alias("a"), transforms.alias("b")
    t = v.transform4(F.col("b.transform"))
    p = [F.col(f"a.{c}") for c in "xyz"]
    new = {c: v.dot(row[:3], p) + row[3] for c, row in zip("xyz", t)}
    joined = a.join(b, F.col("a.topic").eqNullSafe(F.col("b.topic")) & (F.col("a.seq") == F.col("b.seq")))
    return joined.select(*(new[c].alias(c) if c in new else F.col(f"a.`{c}`") for c in points.columns))


iter_rgbd_frame_points = fuse_rgbd_frames


def points_to_depth_image(points: DataFrame, image_shape: Sequence[int], fx=None, fy=None, cx=None, cy=None, transform=None, camera_matrix=None, fill_value: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(keys, row, col, z, pid): the nearest point of each pixel, pixels rounded half to even; pixels without a point are filled, with pid -1."""
    by = list(by)
    seen = points.withColumn("at", cam.project_camera_points([F.col(c) for c in "xyz"], None, fx, fy, cx, cy, camera_matrix, transform=transform)).filter("at.valid")
    row, col = F.rint("at.v").cast("int"), F.rint("at.u").cast("int")
    hit = seen.select(*by, row.alias("row"), col.alias("col"), F.col("at.depth").alias("z"), "pid").filter((F.col("row") >= 0) & (F.col("row") < image_shape[0]) & (F.col("col") >= 0) & (F.col("col") < image_shape[1]))
    first = hit.groupBy(*by, "row", "col").agg(F.min(F.struct("z", "pid")).alias("first"))
    keys = points.select(*by).distinct() if by else points.sparkSession.range(1).select()
    grid = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(image_shape[0] - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(image_shape[1] - 1))))
    from stratawave.operators.order import same

    a, b = grid.alias("a"), first.alias("b")
    return a.join(b, same("a", "b", [*by, "row", "col"]), "left").select("a.*", F.coalesce("b.first.z", F.lit(float(fill_value))).alias("z"), F.coalesce(F.col("b.first.pid").cast("long"), F.lit(-1).cast("long")).alias("pid"))


def sample_image_at_pixels(image: DataFrame, queries: DataFrame, u: Column | str = "u", w: Column | str = "v", bilinear: bool = True, fill_value: float = float("nan")) -> DataFrame:
    """Adds sample and inside: cells (raster, row, col, z) at pixel coordinates; outside the image ``fill_value``."""
    from stratawave.operators import raster

    a, b = queries.withColumns({"at_col": v.col(u), "at_row": v.col(w)}).alias("a"), raster.sizes(image).alias("b")
    inside = v.between("a.at_col", 0, None) & (F.col("a.at_col") <= F.col("b.cols") - 1) & v.between("a.at_row", 0, None) & (F.col("a.at_row") <= F.col("b.rows") - 1)
    named = a.join(b, F.col("a.raster") == F.col("b.raster"), "left").select("a.*", F.coalesce(inside, F.lit(False)).alias("inside"))
    out = raster.sample_grid(image, named, "at_row", "at_col", bilinear)
    return out.withColumn("sample", F.when(F.col("inside"), F.col("sample")).otherwise(F.lit(float(fill_value)))).drop("at_row", "at_col")


def sample_image_at_points(image: DataFrame, points: DataFrame, fx=None, fy=None, cx=None, cy=None, transform=None, camera_matrix=None, bilinear: bool = True, fill_value: float = float("nan")) -> DataFrame:
    """Samples at the projections of points (raster, pid, x, y, z)."""
    seen = points.withColumn("at", cam.project_camera_points([F.col(c) for c in "xyz"], None, fx, fy, cx, cy, camera_matrix, transform=transform))
    return sample_image_at_pixels(image, seen.select(*points.columns, F.col("at.u").alias("u"), F.col("at.v").alias("v")), "u", "v", bilinear, fill_value)


def colorize_points(points: DataFrame, image: DataFrame, **more) -> DataFrame:
    """Points with the image's value at their projection as color."""
    return sample_image_at_points(image, points, **more).withColumnRenamed("sample", "color").drop("u", "v")


def rectified_place(camera_matrix, distortion=None, rectification=None, new_camera_matrix=None) -> tuple[Column, Column]:
    """Where in the original image a pixel (row, col) of the rectified one comes from: u, v."""
    k, new = cam.checked(camera_matrix), cam.checked(camera_matrix if new_camera_matrix is None else new_camera_matrix)
    r = np.linalg.inv(np.eye(3) if rectification is None else np.asarray(rectification, float))
    x, y = cam.pixels_to_normalized_points([F.col("col").cast("double"), F.col("row").cast("double")], new)
    ray = v.times([[float(e) for e in row] for row in r], [x, y, F.lit(1.0)])
    flat = [F.try_divide(ray[0], ray[2]), F.try_divide(ray[1], ray[2])]
    u, w = cam.normalized_points_to_pixels(cam.distort_normalized_points(flat, distortion), k)
    return u, w


def rectification_map(spark, image_shape: Sequence[int], camera_matrix, distortion=None, rectification=None, new_camera_matrix=None) -> DataFrame:
    """(row, col, u, v): for each pixel of the rectified image the place in the original."""
    from stratawave.operators.raster import dense_grid

    u, w = rectified_place(camera_matrix, distortion, rectification, new_camera_matrix)
    return dense_grid(spark, *(int(s) for s in image_shape[:2])).select("row", "col", u.alias("u"), w.alias("v"))


def rectify_image(image: DataFrame, image_shape: Sequence[int], camera_matrix, distortion=None, rectification=None, new_camera_matrix=None, bilinear: bool = True, fill_value: float = 0) -> DataFrame:
    """Cells of the rectified images."""
    from stratawave.operators.raster import target_cells

    u, w = rectified_place(camera_matrix, distortion, rectification, new_camera_matrix)
    wanted = target_cells(image, image_shape[:2]).select("raster", "row", "col", u.alias("u"), w.alias("v"))
    return sample_image_at_pixels(image, wanted, "u", "v", bilinear, fill_value).select("raster", "row", "col", F.col("sample").alias("z"))


def project_dem_to_image(cells: DataFrame, fx=None, fy=None, cx=None, cy=None, x=None, y=None, resolution: float = 1.0, origin=(0.0, 0.0), image_shape=None, transform=None, camera_matrix=None) -> DataFrame:
    """Cells with u, v, depth and valid of their projection."""
    from stratawave.functions.transforms import dem_grid_to_points

    p = dem_grid_to_points(cells, x, y, resolution, origin)
    at = p.withColumn("at", cam.project_camera_points([F.col(c) for c in "xyz"], None, fx, fy, cx, cy, camera_matrix, image_shape=image_shape, transform=transform))
    return at.select(*cells.columns, "at.u", "at.v", "at.depth", "at.valid")
