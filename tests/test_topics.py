import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.operators import align, ml, order, summary, windows
from stratawave.operators.topic import Dataset, Topic, arity, dataset_query, topic_view
from stratawave.schema import normalize_messages, spatial_bounds_for_data, topic_metadata

MODEL = "topic string, seq long, ts double, name string, frame_id string, source_uri string, dtype string, shape array<int>, data array<double>"


def topic(spark, rows, name="t", frame="map"):
    """rows: (ts, data[, frame])"""
    out = [(name, i, float(r[0]), f"n{i}", r[2] if len(r) > 2 else frame, "s", "float64", list(np.shape(r[1])), [float(x) for x in np.ravel(r[1])]) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, MODEL)


def abcd(spark):
    return topic(spark, [(0, [0, 0]), (0.5, [1, 1]), (1, [2, 2]), (1.5, [3, 3])])


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_selection(spark):
    d = Topic(abcd(spark))
    assert seqs(d.time_range(0.25, 1).df) == [1, 2] and seqs(d.time_range(0.5, 1, False).df) == []
    assert seqs(d.index_range(1, 4, 2).df) == [1, 3]
    assert seqs(d.filter(F.get("data", F.lit(0)) > 0).index_range(0, 2).df) == [1, 2]  # counts survivors
    assert seqs(d.slice(-2).df) == [2, 3] and seqs(d.slice(None, None, 3).df) == [0, 3]
    assert seqs(d.last_seconds(0.5).df) == [2, 3]
    for bad in (lambda: d.time_range(1, 0), lambda: d.index_range(-1), lambda: d.index_range(0, 1, 0), lambda: d.slice(0, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_frames(spark):
    mixed = topic(spark, [(0, [0, 0, 0], "map"), (1, [5, 5, 0], "odom"), (2, [2, 2, 0], "map"), (3, [9, 9, 0], None)])
    assert seqs(Dataset(mixed).frame_id("map").df) == [0, 2]
    known = topic(spark, [(0, [0], "map"), (1, [1], None)], "u")
    assert seqs(Dataset(known).frame_id("map").df) == [0, 1] and seqs(Dataset(known).frame_id("odom").df) == []
    assert seqs(Dataset(mixed).spatial_bounds((1, 1, -1), (6, 6, 1)).df) == [1, 2]
    meta = {r.topic: r for r in topic_metadata(mixed.unionByName(known)).collect()}
    assert meta["t"].frame_id is None and meta["u"].frame_id == "map" and meta["t"]["count"] == 4


def test_boxes_prune_and_the_exact_test_decides(spark):
    clouds = topic(spark, [(0, [[0, 0, 0], [9, 9, 0]]), (1, [[5, 5, 0], [8, 8, 0]]), (2, [[np.nan, 5, 0], [np.nan, 5, 0]])])
    boxed = clouds.withColumn("b", spatial_bounds_for_data()).select(*clouds.columns, "b.*")
    got = {r.seq: (r.spatial_valid, r.min_x, r.max_x) for r in boxed.collect()}
    assert got == {0: (True, 0.0, 9.0), 1: (True, 5.0, 8.0), 2: (False, None, None)}
    d = Dataset(boxed).spatial_bounds((4, 4, -1), (6, 6, 1))
    assert seqs(d.df) == [1] and seqs(d.index_range(0, 1).df) == [1]
    plain = Dataset(clouds).spatial_bounds((4, 4), (6, 6), (0, 5))
    assert seqs(plain.df) == []  # a missing column matches nothing


def test_map_filter_reduce_collect(spark):
    d = Topic(abcd(spark), ["t"])
    assert [list(r.data) for r in d.map(lambda x: x * 2).df.orderBy("seq").collect()] == [[0, 0], [2, 2], [4, 4], [6, 6]]
    assert [list(r.shape) for r in d.map(lambda x, ts: np.stack([x, x])).df.limit(1).collect()] == [[2, 2]]
    assert seqs(d.filter(lambda x, ts, name: name in ("n1", "n3")).df) == [1, 3]
    assert list(d.reduce("sum").first().result) == [6.0, 6.0]
    assert list(d.reduce(lambda a, x: F.zip_with(a, x, lambda p, q: p - q)).first().result) == [-6.0, -6.0]
    assert [arity(f) for f in (lambda a: 0, lambda a, b: 0, lambda *a: 0, len)] == [1, 2, 3, 1]
    assert len(d.collect()["t"]) == 4 and len(topic_view(d.df, "t")) == 4 and topic_view(d.df, "x").empty
    with pytest.raises(MemoryError):
        d.collect(max_rows=3)
    with pytest.raises(MemoryError):
        d.collect(max_bytes=10)
    assert [len(c) for c in d.iter_chunks(3)] == [3, 1]
    with pytest.raises(ValueError):
        dataset_query(d.df, ["t"]).select_topics("u")
    with pytest.raises(Exception, match="boom"):
        d.map(lambda x: (_ for _ in ()).throw(TypeError("boom"))).df.collect()


def test_normalize(spark):
    df = spark.createDataFrame([("t", 2.0, [1.0], "b"), ("t", 1.0, [2.0], None)], "topic string, timestamp double, data array<double>, id string")
    assert [(r.seq, r.ts, r.name) for r in normalize_messages(df).orderBy("seq").collect()] == [(0, 1.0, "t"), (1, 2.0, "b")]
    with pytest.raises(ValueError):
        normalize_messages(df.drop("data"))


def pairs(spark):
    ref = spark.createDataFrame([(i, t) for i, t in enumerate([0.0, 0.5, 1.0, 1.5])], "seq long, ts double")
    tgt = spark.createDataFrame([(i, t, [v]) for i, (t, v) in enumerate([(0.0, 10.0), (0.9, 20.0), (1.5, 30.0)])], "seq long, ts double, data array<double>")
    return ref.withColumn("ts", F.col("ts").cast("double")), tgt


def index(df):
    return [r.target_index for r in df.orderBy("seq").collect()]


def test_alignment_modes(spark):
    r, t = pairs(spark)
    assert index(align.align_topic(r, t, "exact")) == [0, -1, -1, 2]
    assert index(align.align_topic(r, t, "nearest")) == [0, 1, 1, 2]
    assert index(align.align_topic(r, t, "bounded", 0.15)) == [0, -1, 1, 2]
    w = align.align_topic(r, t, "rolling_window", seconds=0.6)
    assert [x["count"] for x in w.orderBy("seq").collect()] == [1, 1, 1, 2]
    for bad in (lambda: align.align_topic(r, t, "no"), lambda: align.align_bounded(r, t, None), lambda: align.rolling_window_join(r, t), lambda: align.align_nearest(r, t, -1)):
        with pytest.raises(ValueError):
            bad()
    assert align.nearest_time_index(t, 0.45) == 1 and align.nearest_time_index(t, 0.4) == 0 and align.nearest_time_index(t, 9, 1) == -1


def nearest_reference(times, t):
    at = int(np.searchsorted(times, t, "left"))
    if at == 0:
        return 0
    if at == len(times) or t - times[at - 1] < times[at] - t:
        return at - 1
    return at


@pytest.mark.parametrize("block", [0.5, 3.0, 1e6])
def test_nearest_with_ties_and_repeats_over_blocks(spark, block):
    rng = np.random.default_rng(1)
    tt, rt = np.sort(rng.integers(0, 40, 60) / 4), rng.integers(-8, 60, 80) / 4
    t = spark.createDataFrame([(i, float(x), float(i)) for i, x in enumerate(tt)], "seq long, ts double, v double")
    r = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rt)], "seq long, ts double")
    assert index(align.align_nearest(r, t, block_seconds=block)) == [nearest_reference(tt, x) for x in rt]
    back = [int(np.searchsorted(tt, x, "right")) - 1 for x in rt]
    got = [None if x == -1 else tt[x] for x in index(align.align_backward(r, t, block_seconds=block))]
    assert got == [None if b < 0 else tt[b] for b in back]
    early = index(align.align_nearest(r, t, ties="earlier", block_seconds=block))
    assert all(abs(tt[a] - x) == abs(tt[nearest_reference(tt, x)] - x) and tt[a] <= tt[nearest_reference(tt, x)] for a, x in zip(early, rt))


def test_alignment_dirt_and_empty(spark):
    r, t = pairs(spark)
    dirty = t.unionByName(spark.createDataFrame([(7, None, [1.0]), (8, float("nan"), [1.0])], t.schema))
    missing = r.unionByName(spark.createDataFrame([(9, None), (10, float("nan"))], r.schema))
    assert index(align.align_nearest(missing, dirty)) == [0, 1, 1, 2, -1, -1]
    assert index(align.align_nearest(r, t.limit(0))) == [-1] * 4 and index(align.align_exact(r, t.limit(0))) == [-1] * 4
    assert align.align_nearest(r.limit(0), t).count() == 0
    keyed = align.align_nearest(r.withColumn("k", F.lit("a")), t.withColumn("k", F.lit("b")), by=["k"])
    assert index(keyed) == [-1] * 4


def test_resample(spark):
    df = topic(spark, [(0, [0.0]), (1, [10.0]), (3, [30.0])])
    got = align.resample_topic(df, period=0.5).orderBy("seq").collect()
    assert [r.data[0] for r in got] == pytest.approx([0, 5, 10, 15, 20, 25, 30]) and all(r.valid for r in got)
    wide = align.resample_topic(df, rate_hz=1.0, start=-1.0, end=4.0).orderBy("seq").collect()
    assert [(r.data[0], r.valid) for r in wide] == [(0, False), (0, True), (10, True), (20, True), (30, True), (30, False)]
    near = align.resample_topic(df, period=1.0, method="nearest", tolerance=0.2).orderBy("seq").collect()
    assert [r.valid for r in near] == [True, True, False, True]


def test_windows(spark):
    names = lambda df: [[x.name for x in r.window] for r in df.orderBy("seq").collect()]
    want = [["n0"], ["n0", "n1"], ["n1", "n2"], ["n2", "n3"]]
    assert names(windows.window_topic(abcd(spark), size=2)) == want and names(windows.window_topic(abcd(spark), seconds=0.6)) == want
    tied = topic(spark, [(0, [0]), (0, [1]), (0, [2]), (1, [3])])
    assert names(windows.window_topic(tied, seconds=0.5)) == [["n0"], ["n0", "n1"], ["n0", "n1", "n2"], ["n3"]]
    assert names(windows.rows_before(tied, ["topic"], F.struct("name"), 3, block=2)) == [["n0"], ["n0", "n1"], ["n0", "n1", "n2"], ["n1", "n2", "n3"]]
    assert names(windows.window_topic(tied, size=2, seconds=0.5)) == [["n0"], ["n0", "n1"], ["n1", "n2"], ["n3"]]


def test_collected_columns(spark):
    both = abcd(spark).unionByName(topic(spark, [(0, [7, 7])], "u"))
    got = Dataset(both).collect(columns=["seq", "data"])
    assert list(got) == ["t", "u"] and list(got["t"]) == ["seq", "data"] and list(got["t"]["seq"]) == [0, 1, 2, 3] and list(got["u"]["data"][0]) == [7, 7]


@pytest.mark.parametrize("block", (4, 1000))
def test_bounded_windows_over_times_in_any_order(spark, block):
    rng = np.random.default_rng(5)
    times = {"any": rng.integers(0, 30, 60), "rising": np.cumsum(rng.integers(0, 9, 60)), "falling": 200 - 3 * np.arange(60), "copies": np.tile(np.arange(0, 60, 3), 3), "few": [7], "unset": np.where(rng.random(40) < 0.3, np.nan, rng.integers(0, 20, 40))}
    df = None
    for name, ts in times.items():
        one = topic(spark, [(x, [i]) for i, x in enumerate(ts)], name)
        df = one if df is None else df.unionByName(one)
    for size, seconds in ((1, 5), (3, 6), (8, 0)):
        got = {(r.topic, r.seq): [x.seq for x in r.window] for r in windows.recent_rows_before(df, ["topic"], ["ts", "seq", "name", "data"], size, seconds, block).collect()}
        want = {(name, i): [j for j in range(i + 1) if ts[j] >= ts[i] - seconds][-size:] for name, ts in times.items() for i in range(len(ts))}
        assert got == want


def test_smooth_gradient_integral_speed(spark):
    rng = np.random.default_rng(2)
    ts, x = np.cumsum(rng.uniform(0.1, 1, 40)), rng.normal(0, 1, (40, 2))
    x[7, 0] = np.nan
    df = topic(spark, list(zip(ts, x)))
    padded = np.pad(x, ((2, 1), (0, 0)), mode="edge")
    smooth = [r.smoothed for r in windows.smooth_timeseries(df, "data", 4).orderBy("seq").collect()]
    np.testing.assert_allclose(smooth, [np.nanmean(padded[i : i + 4], axis=0) for i in range(40)])
    x[7, 0] = 0.5
    df = topic(spark, list(zip(ts, x)))
    np.testing.assert_allclose([r.derivative for r in windows.differentiate_timeseries(df).orderBy("seq").collect()], [list(r) for r in np.stack([(np.gradient(x[:, i], ts, edge_order=1)) for i in (0, 1)], 1)])
    np.testing.assert_allclose([r.integral for r in windows.integrate_timeseries(df, "data", 2, [1.0, 2.0]).orderBy("seq").collect()], [1.0, 2.0] + np.vstack([[0, 0], np.cumsum((x[1:] + x[:-1]) / 2 * np.diff(ts)[:, None], axis=0)]))
    want = np.linalg.norm(np.gradient(x, axis=0) / np.gradient(ts)[:, None], axis=1)
    np.testing.assert_allclose([r.speed for r in windows.trajectory_speed(df, "data").orderBy("seq").collect()], want)
    single = windows.differentiate_timeseries(topic(spark, [(0, [1.0])])).first()
    assert single.derivative == [None]


def test_neighbours_and_sums_over_blocks(spark):
    df = spark.createDataFrame([(k, i, float(i * i)) for k in ("a", None) for i in range(23)], "k string, seq long, x double")
    got = order.with_neighbours(df, ["k"], "seq", ["x"], block=5).collect()
    assert all(r.prev_x == (None if r.seq == 0 else (r.seq - 1.0) ** 2) and r.next_x == (None if r.seq == 22 else (r.seq + 1.0) ** 2) for r in got) and len(got) == 46
    summed = order.running_sum(df, ["k"], "seq", {"s": F.col("x")}, block=4).collect()
    assert all(r.s == sum(i * i for i in range(r.seq + 1)) for r in summed)
    placed = order.positions(df.drop("seq"), ["k"], ["x"], "at", 5).collect()
    assert all(r.x == float(r.at) ** 2 for r in placed) and len(placed) == 46
    assert order.positions(df.limit(0), ["k"], ["x"]).count() == 0


def test_describe(spark):
    d = summary.describe_topic(topic(spark, [(0.1 * i, np.ones(3)) for i in range(10)])).first()
    assert d["count"] == 10 and d.rate_hz == pytest.approx(10) and d.mean == 1.0 and d.frame_id == "map" and d.dt_std == pytest.approx(0, abs=1e-9) and d.nan_fraction == 0
    one = summary.describe_topic(topic(spark, [(5.0, [np.nan, 1.0])])).first()
    assert one.duration is None and one.rate_hz is None and one.dt_mean is None and one.nan_fraction == 0.5 and one.mean == 1.0
    line = summary.format_describe(summary.describe_dataset(abcd(spark))).first().line
    assert "n=4" in line and "2.00Hz" in line
    assert summary.describe_dataset(abcd(spark).limit(0)).count() == 0
    fixed = summary.correct_bias(abcd(spark), {"v": F.get("data", F.lit(0))}, 1.0)
    assert [r.v for r in fixed.orderBy("seq").collect()] == [-0.5, 0.5, 1.5, 2.5]


def test_splits(spark):
    parts = lambda df, k="seq": {s: sorted(r[k] for r in df.collect() if r.split == s) for s in ("train", "val", "test")}
    five = spark.range(5).withColumnRenamed("id", "seq")
    assert parts(ml.deterministic_split(five, fractions=(0.4, 0.4, 0.2))) == {"train": [0, 1], "val": [2, 3], "test": [4]}
    grouped = ml.deterministic_split(spark.range(12).withColumnRenamed("id", "seq"), fractions=(0.5, 0.25, 0.25), group=F.col("seq") % 4)
    assert parts(grouped) == {"train": [0, 1, 4, 5, 8, 9], "val": [2, 6, 10], "test": [3, 7, 11]}
    a, b = (ml.deterministic_split(spark.range(100).withColumnRenamed("id", "seq").repartition(n), seed=3, shuffle=True) for n in (1, 7))
    assert parts(a) == parts(b) and len(parts(a)["train"]) == 70
    geo = ml.split_topic(topic(spark, [(0, [0.1, 0.2]), (1, [5.5, 0.1]), (2, [0.9, 0.3]), (3, [9.0, 9.0])]), "geography", (2 / 3, 1 / 3), ("a", "b"), geography_cell_size=1.0)
    assert {r.seq: r.split for r in geo.collect()} == {0: "a", 1: "a", 2: "a", 3: "b"}
    with pytest.raises(ValueError):
        ml.deterministic_split(five, fractions=(1.0,))
    assert ml.deterministic_split(five.limit(0)).count() == 0


def test_collate_and_augment(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [])], "i int, v array<double>")
    got = {r.i: (list(r.v), r.v_length, list(r.v_mask)) for r in ml.collate(df, ["v"], pad_value=-1.0).collect()}
    assert got[1] == ([1.0, -1.0, -1.0], 1, [True, False, False]) and got[3][0] == [-1.0] * 3 and got[2][1] == 3
    b = ml.collate_samples([{"p": np.ones((2, 3)), "n": "a", "m": {"x": 1.0}}, {"p": np.ones((3, 3)), "n": "b", "m": {"x": 2.0}}])
    assert b["p"].shape == (2, 3, 3) and b["p_lengths"].tolist() == [2, 3] and b["n"] == ["a", "b"] and b["m"]["x"].tolist() == [1, 2] and not b["p_mask"][0, 2].any()
    im = topic(spark, [(0, np.arange(6.0).reshape(2, 3))])
    out = ml.augment_image(im, flip_horizontal=True, rotate_k=1, contrast=2.0, brightness=1.0).first()
    np.testing.assert_array_equal(np.reshape(out.data, out.shape), np.rot90(np.arange(6.0).reshape(2, 3)[:, ::-1]) * 2 + 1)
    for k in range(4):
        for channels in ((), (3,)):
            frame = np.arange(2.0 * 3 * (3 if channels else 1)).reshape(2, 3, *channels)
            out = ml.augment_dem_patch(topic(spark, [(0, frame)]), flip_vertical=True, rotate_k=k).first()
            np.testing.assert_array_equal(np.reshape(out.data, out.shape), np.rot90(frame[::-1], k))
    counts = ml.augment_image(topic(spark, [(0, np.array([[250.0, 3.4]]))]).withColumn("dtype", F.lit("uint8")), contrast=2.0, brightness=0.1, clip=(0, 300)).first()
    assert counts.data == [255.0, 7.0]
    noisy = [ml.augment_dem_patch(im, noise_std=1.0, seed=4).first().data for _ in range(2)]
    assert noisy[0] == noisy[1] != im.first().data
    cloud = topic(spark, [(0, np.random.default_rng(0).normal(0, 1, (50, 4)))])
    kept = ml.augment_point_cloud(cloud, 2.0, (1, 0, 0), dropout_ratio=0.5, seed=1).first()
    assert 10 < kept.shape[0] < 40 and kept.shape[1] == 4 and len(kept.data) == 4 * kept.shape[0]
    assert ml.augment_point_cloud(topic(spark, [(0, np.ones((3, 3)))]), dropout_ratio=0.999999).first().shape == [1, 3]
    jittered = np.reshape(ml.augment_point_cloud(topic(spark, [(0, np.zeros((4000, 3)))]), jitter_std=0.5).first().data, (-1, 3))
    assert abs(jittered.std() - 0.5) < 0.02 and abs(jittered.mean()) < 0.02 and len(np.unique(jittered)) == 12000
    samples = ml.NumpyDataset(df.select("i"))
    assert len(samples) == 4 and len(list(ml.IteratorDataset(df))) == 4 and samples.as_arrays()["i"].shape == (4,)
