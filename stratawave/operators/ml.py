"""Splits, augmentation and collation of training samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.functions import geodesy
from stratawave.functions import vectors as v
from stratawave.operators.order import positions, same


def split_counts(n: Column, fractions: Sequence[float]) -> list[Column]:
    """Sizes of the parts of n units: the whole parts of the shares, and one more for the largest remainders, the first on a tie."""
    total = float(sum(fractions))
    exact = [n * (float(f) / total) for f in fractions]
    whole = [F.floor(e + 1e-9) for e in exact]
    left = n - sum(whole[1:], whole[0])
    # a part is served if fewer than `left` parts have a larger remainder, or an equal one and an earlier place
    rest = [F.round(e - w, 9) for e, w in zip(exact, whole)]
    out = []
    for i, r in enumerate(rest):
        before = sum((((s >= r) if j < i else (s > r)).cast("int") for j, s in enumerate(rest) if j != i), F.lit(0))
        out.append(whole[i] + (before < left).cast("int"))
    return out


def checked(fractions: Sequence[float], names: Sequence[str]) -> None:
    if len(fractions) != len(names) or not fractions or min(fractions) < 0 or sum(fractions) <= 0:
        raise ValueError("one fraction, not negative, for each name, not all 0")


def deterministic_split(df: DataFrame, order: str = "seq", fractions: Sequence[float] = (0.7, 0.15, 0.15), names: Sequence[str] = ("train", "val", "test"), seed: int | None = None, shuffle: bool = False, group: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds split: consecutive parts of the rows of each key in their order; rows of one group stay together.

    Units are rows, or groups in the order of their first row; parts have the sizes of
    largest remainders. ``shuffle`` orders units by a hash with the seed, which is the
    same on any cluster. Units are numbered by a range sort, so no task holds a key.
    """
    checked(fractions, names)
    by = list(by)
    unit = df.withColumn("split_unit", group if group is not None else F.col(order))
    units = unit.groupBy(*by, "split_unit").agg(F.min(order).alias("first_at"))
    units = units.withColumn("rank_by", F.xxhash64(F.lit(0 if seed is None else int(seed)), F.col("split_unit")) if shuffle else F.lit(0).cast("long"))
    placed = positions(units, by, ["rank_by", "first_at"], "unit_at")
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("units"))
    p, s = placed.alias("p"), sizes.alias("s")
    joined = p.join(s, same("p", "s", by)).select("p.*", "s.units")
    counts, upto, name = split_counts(F.col("units"), fractions), F.lit(0), None
    for c, n in zip(counts, names):
        upto = upto + c
        test = F.col("unit_at") < upto
        name = F.when(test, n) if name is None else name.when(test, n)
    labelled = joined.select(*by, "split_unit", name.alias("split"))
    a, b = unit.alias("a"), labelled.alias("b")
    return a.join(b, same("a", "b", [*by, "split_unit"])).select(*(F.col(f"a.`{c}`") for c in df.columns), "b.split")


deterministic_split_indices = deterministic_split


def split_topic(df: DataFrame, by: str = "time", fractions=(0.7, 0.15, 0.15), names=("train", "val", "test"), seed: int | None = None, shuffle: bool = False, geography_columns=(0, 1), geography_cell_size: float = 0.01) -> DataFrame:
    """Adds split to the rows of each topic: by time or index (rows), sequence (name's stem), source, or geography (cells of coordinates)."""
    kinds = {
        "time": None, "index": None, "sequence": F.regexp_replace("name", r"[_\-]?\d+$", ""), "source": F.col("source_uri"),
        "geography": F.concat_ws(":", *(F.floor(F.get("data", F.lit(c)) / float(geography_cell_size)).cast("string") for c in geography_columns)),
    }
    if by not in kinds:
        raise ValueError(f"unknown kind of split: {by}")
    rows = positions(df, ["topic"], ["ts", "seq"], "row_at") if by == "time" else df.withColumn("row_at", F.col("seq"))
    group = kinds[by] if kinds[by] is None else F.coalesce(kinds[by], F.lit(""))
    return deterministic_split(rows, "row_at", fractions, names, seed, shuffle, group, ["topic"]).drop("row_at")


def place_of(df: DataFrame) -> list[Column]:
    """What names a message for its noise."""
    return [F.col(c) for c in ("topic", "seq") if c in df.columns]


def turned(df: DataFrame, flip_horizontal: bool, flip_vertical: bool, rotate_k: int) -> DataFrame:
    """Frames (data by shape) flipped, then turned by quarters against the clock: each element is looked up where it comes from."""
    k = rotate_k % 4
    if not (flip_horizontal or flip_vertical or k):
        return df
    h, w = F.get("shape", F.lit(0)), F.get("shape", F.lit(1))
    channels = F.when(F.size("shape") > 2, F.get("shape", F.lit(2))).otherwise(F.lit(1))
    rows, columns = (w, h) if k % 2 else (h, w)

    def source(i: Column) -> Column:
        cell = F.floor(i / channels)
        r, c = F.floor(cell / columns), cell % columns
        r, c = {0: (r, c), 1: (c, w - 1 - r), 2: (h - 1 - r, w - 1 - c), 3: (h - 1 - c, r)}[k]
        r, c = (h - 1 - r if flip_vertical else r), (w - 1 - c if flip_horizontal else c)
        return ((r * w + c) * channels + i % channels).cast("int")

    moved = F.when(F.size("data") > 0, F.transform(F.sequence(F.lit(0), F.size("data") - 1), lambda i: F.get("data", source(i)))).otherwise(F.col("data"))
    # one after the other: a lambda would see the new shape beside it
    return df.withColumn("data", moved).withColumn("shape", F.concat(F.array(rows, columns), F.slice("shape", 3, F.greatest(F.size("shape") - 2, F.lit(0)))))


def augment_image(df: DataFrame, flip_horizontal: bool = False, flip_vertical: bool = False, rotate_k: int = 0, brightness: float = 0.0, contrast: float = 1.0, noise_std: float = 0.0, seed: int | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """Flips, quarter turns, contrast, brightness, noise and clipping, in this order; integer images (by dtype) stay in their range and round."""
    from stratawave.operators.image import INTEGERS

    out = turned(df, flip_horizontal, flip_vertical, rotate_k)
    if contrast == 1 and not brightness and not noise_std:
        return out
    hold = lambda x, low, high: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))

    def value(x: Column, i: Column) -> Column:
        x = x * float(contrast) + float(brightness)
        x = x + float(noise_std) * v.deviate(seed, *place_of(df), i) if noise_std else x
        x = hold(x, *clip) if clip is not None else x
        if "dtype" in df.columns:
            for name, ends in INTEGERS.items():
                x = F.when(F.col("dtype") == name, F.rint(hold(x, *ends))).otherwise(x)
        return x

    return out.withColumn("data", F.transform("data", value))


def augment_dem_patch(df: DataFrame, flip_horizontal: bool = False, flip_vertical: bool = False, rotate_k: int = 0, z_scale: float = 1.0, z_offset: float = 0.0, noise_std: float = 0.0, seed: int | None = None) -> DataFrame:
    """Flips and quarter turns, then heights scaled, moved and made noisy."""
    noise = lambda i: float(noise_std) * v.deviate(seed, *place_of(df), i) if noise_std else F.lit(0.0)
    return turned(df, flip_horizontal, flip_vertical, rotate_k).withColumn("data", F.transform("data", lambda z, i: z * float(z_scale) + float(z_offset) + noise(i)))


def augment_point_cloud(df: DataFrame, scale: float = 1.0, translation=None, rotation=None, jitter_std: float = 0.0, dropout_ratio: float = 0.0, seed: int | None = None) -> DataFrame:
    """Cloud messages: scale, rotation, translation, jitter and dropout of points, in this order; at least one point stays.

    One affine map does the first three. A point's jitter and whether it stays come from
    hashes of the message and the point's number.
    """
    from stratawave.operators.image import split_rows

    if not 0 <= dropout_ratio < 1:
        raise ValueError("a dropout ratio lies in [0, 1)")
    linear = scale * (np.eye(3) if rotation is None else np.asarray(rotation, float).reshape(3, 3))
    affine = np.column_stack([linear, np.zeros(3) if translation is None else np.asarray(translation, float)])
    width = F.get("shape", F.size("shape") - 1)
    rows = split_rows(F.col("data"), width, F.when(width > 0, (F.size("data") / width).cast("int")).otherwise(0))

    def moved(point: Column, i: Column) -> Column:
        xyz = [F.get(point, F.lit(k)) for k in range(3)]
        new = [v.dot([float(x) for x in row[:3]], xyz) + float(row[3]) for row in affine]
        new = [x + float(jitter_std) * v.deviate(seed, *place_of(df), i, F.lit(k)) for k, x in enumerate(new)] if jitter_std else new
        return F.concat(F.array(*new), F.slice(point, 4, F.greatest(F.size(point) - 3, F.lit(0))))

    out = df.withColumn("points", F.transform(rows, moved))
    if dropout_ratio:
        chance = F.transform(F.col("points"), lambda p, i: F.struct((F.pmod(F.xxhash64(F.lit(0 if seed is None else int(seed)), F.lit("stays"), *place_of(df), i), F.lit(1 << 40)) / float(1 << 40)).alias("u"), i.alias("i")))
        out = out.withColumn("chance", chance).withColumn("best", F.array_max("chance")["i"])
        stays = lambda p, i: (F.get("chance", i)["u"] >= float(dropout_ratio)) | (i == F.col("best"))
        out = out.withColumn("points", F.filter("points", stays)).drop("chance", "best")
    counted = F.concat(F.array(F.size("points")), F.slice("shape", 2, F.greatest(F.size("shape") - 1, F.lit(0))))
    return out.withColumn("data", F.flatten("points")).withColumn("shape", counted).select(*df.columns)


def augment_trajectory(df: DataFrame, translation: Sequence[float] | None = None, position_noise_std: float = 0.0, seed: int | None = None) -> DataFrame:
    """Positions moved and made noisy; pose, trajectory and navsat (about reference) follow."""
    have = set(df.columns)
    shift = np.zeros(3) if translation is None else np.asarray(translation, float)

    def place(x: Column, axis: int) -> Column:
        noise = float(position_noise_std) * v.deviate(seed, *place_of(df), F.lit(axis)) if position_noise_std else F.lit(0.0)
        return x + float(shift[axis]) + noise

    follow = {
        "pose": ({"orientation"}, lambda: F.concat("position", "orientation")), "trajectory": ({"trajectory"}, lambda: F.concat("position", F.slice("trajectory", 4, 10))),
        "navsat": ({"navsat", "reference"}, lambda: F.array(*geodesy.enu_to_navsat("position", *v.unpack("reference", 3)))),
    }
    out = df.withColumn("position", F.array(*(place(x, i) for i, x in enumerate(v.unpack("position", 3)))))
    return out.withColumns({name: made() for name, (needed, made) in follow.items() if needed <= have})


def collate(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), pad_value: float = 0.0) -> DataFrame:
    """Array columns padded to the longest of their batch (the key ``by``): adds <c>_length and <c>_mask.

    The longest length comes from one aggregate and joins back; arrays stay in their rows.
    """
    by = list(by)
    longest = df.groupBy(*by).agg(*(F.max(F.greatest(F.size(c), F.lit(0))).alias(f"{c}_longest") for c in columns))
    a, b = df.alias("a"), longest.alias("b")
    joined = a.join(b, same("a", "b", by)).select("a.*", *(f"b.{c}_longest" for c in columns))
    for c in columns:
        n = F.greatest(F.size(c), F.lit(0))
        gap = F.col(f"{c}_longest") - n
        joined = joined.withColumns({
            f"{c}_length": n, f"{c}_mask": F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), gap)),
            c: F.concat(F.coalesce(c, F.array().cast(df.schema[c].dataType)), F.array_repeat(F.lit(pad_value).cast(df.schema[c].dataType.elementType), gap)),
        })
    return joined.drop(*(f"{c}_longest" for c in columns))


def stack(values: list, pad: bool, pad_value: float) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Values in one array; unequal shapes are padded, with lengths of the first axis and a mask."""
    arrays = [np.asarray(x) for x in values]
    if len({a.shape for a in arrays}) == 1:
        return np.stack(arrays), None, None
    if not pad or len({a.ndim for a in arrays}) != 1:
        raise ValueError("samples differ in shape")
    shape = np.max([a.shape for a in arrays], axis=0)
    out, mask = np.full((len(arrays), *shape), pad_value, np.result_type(*arrays, type(pad_value))), np.zeros((len(arrays), *shape), bool)
    for i, a in enumerate(arrays):
        place = (i, *(slice(0, n) for n in a.shape))
        out[place], mask[place] = a, True
    return out, np.array([a.shape[0] for a in arrays]), mask


def collate_samples(samples: Sequence[Mapping], pad: bool = True, pad_value: float = 0.0) -> dict:
    """A batch of collected samples: stacked arrays by key, with <key>_lengths and <key>_mask where padded; texts and absent values stay lists."""
    samples = list(samples)
    out: dict = {}
    for key in sorted({k for s in samples for k in s}):
        values = [s.get(key) for s in samples]
        if all(isinstance(x, Mapping) for x in values):
            out[key] = collate_samples(values, pad, pad_value)
        elif any(x is None or isinstance(x, (str, bytes)) for x in values):
            out[key] = values
        else:
            out[key], lengths, mask = stack(values, pad, pad_value)
            if lengths is not None:
                out[f"{key}_lengths"], out[f"{key}_mask"] = lengths, mask
    return out


class IteratorDataset:
    """Samples of a query, read a partition at a time, as often as it is iterated."""

    def __init__(self, df: DataFrame, transform=None):
        self.df, self.transform = df, transform or (lambda s: s)

    def __iter__(self) -> Iterator:
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            yield self.transform(row.asDict())


class NumpyDataset:
    """Samples of a small query on the driver."""

    def __init__(self, df: DataFrame, transform=None, max_rows: int = 1_000_000):
        if df.limit(max_rows + 1).count() > max_rows:
            raise MemoryError(f"more than {max_rows} samples")
        self.samples = [(transform or (lambda s: s))(r.asDict()) for r in df.collect()]

    def __len__(self) -> int:
        return len(self.samples)

    def __getitem__(self, i: int):
        return self.samples[i]

    def as_arrays(self, pad: bool = True, pad_value: float = 0.0) -> dict:
        return collate_samples(self.samples, pad, pad_value)


to_iterator_dataset, to_numpy_dataset = IteratorDataset, NumpyDataset


def to_torch_dataset(df: DataFrame, transform=None, iterable: bool = True):
    """The same for torch, where it is installed."""
    import torch.utils.data as data  # optional

    if iterable:
        return type("Samples", (data.IterableDataset,), {"__iter__": lambda self: iter(IteratorDataset(df, transform))})()
    held = NumpyDataset(df, transform)
    return type("Samples", (data.Dataset,), {"__len__": lambda self: len(held), "__getitem__": lambda self, i: held[i]})()
