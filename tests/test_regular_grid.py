import numpy as np
import pytest

from stratawave.operators import regular_grid as rg

MESSAGE = "msg_id long, source_uri string, topic string, timestamp double, data array<double>, slot int"
SPEC = "topic string, period double, shape array<int>, slots string"


def run(spark, messages, stop=100.0, period=10.0, start=0.0, elements=1, **more):
    spec = spark.createDataFrame([("t", period, [1], "x")], SPEC)
    recording = spark.createDataFrame([("s", start, stop, None), ("s", start, stop, "again")], "source_uri string, start_time double, end_time double, device string")
    manifest = spark.createDataFrame([("s", "t"), ("s", "t"), (None, "t"), ("u", "t")], "source_uri string, topic string")
    bounds = rg.series_bounds(manifest, recording, spec)
    out = rg.regular_grid(spark.createDataFrame(messages, MESSAGE), bounds, spec, elements=elements, **more)
    return {r.slot: r for r in out.collect()}


def reference(times, values, at, period, bandwidth):
    u = (np.array(times) - at) / (period * bandwidth)
    w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
    if w.sum() == 0:
        return None, 0.0
    a = np.stack([np.ones_like(u), u], 1)
    fit = np.linalg.lstsq(a * np.sqrt(w)[:, None], np.array(values) * np.sqrt(w), rcond=None)[0] if np.count_nonzero(w) > 1 else [np.average(values, weights=w)]
    return fit[0], w.sum() ** 2 / (w**2).sum()


def test_slots_values_and_marks(spark):
    rng = np.random.default_rng(1)
    times = np.sort(rng.uniform(0, 60, 9))
    messages = [(i, "s", "t", float(t), [float(np.sin(t / 9))], 7) for i, t in enumerate(times)]
    got = run(spark, messages)
    assert sorted(got) == list(range(10))
    for k, row in got.items():
        inside = sum(10 * k <= t < 10 * k + 10 for t in times)
        value, support = reference(times, np.sin(times / 9), 10 * k + 5, 10, rg.BANDWIDTH)
        assert row.readings == inside and row.support == pytest.approx(support)
        assert row.status == ("observed" if inside else "filled" if support >= rg.MIN_SUPPORT else "missing")
        assert row.value == (None if row.status == "missing" else [pytest.approx(value, abs=1e-6)])


def test_dirty_readings_count_for_nothing(spark):
    messages = [
        (1, "s", "t", None, [1.0], 0), (2, "s", "t", 5.0, None, 0), (3, "s", "t", 5.0, [], 0), (4, "s", "t", 5.0, [float("nan")], 0),
        (5, "s", "t", float("nan"), [1.0], 0), (6, "s", "t", 4e9, [1.0], 0), (7, "s", "t", 0.0 - 50, [1.0], 0), (8, None, "t", 5.0, [1.0], 0), (9, "s", None, 5.0, [1.0], 0),
        (10, "s", "t", 25.0, [3.0], 0), (10, "s", "t", 25.0, [3.0], 0), (11, "s", "other", 5.0, [1.0], 0),
    ]
    got = run(spark, messages)
    assert [k for k, r in sorted(got.items()) if r.readings] == [2] and got[2].readings == 1
    assert got[2].support == pytest.approx(1.0) and got[2].value == [3.0]
    assert got[9].status == "missing" and got[9].value is None


def test_empty_tables_and_borders(spark):
    assert all(r.status == "missing" for r in run(spark, []).values())
    got = run(spark, [(1, "s", "t", 0.3, [1.0], 0), (2, "s", "t", 0.6, [1.0], 0)], stop=1.0, period=0.1)
    assert [k for k, r in sorted(got.items()) if r.readings] == [k for k in range(10) if any(k * 0.1 <= t < (k + 1) * 0.1 for t in (0.3, 0.6))]


def test_blocks_do_not_show(spark, monkeypatch):
    rng = np.random.default_rng(2)
    messages = [(i, "s", "t", float(t), [float(t), float(-t)], 0) for i, t in enumerate(rng.uniform(1e9, 1e9 + 3000, 250))]
    whole = run(spark, messages, start=1e9, stop=1e9 + 3000, elements=2)
    monkeypatch.setattr(rg, "BLOCK_SLOTS", 7)
    cut = run(spark, messages, start=1e9, stop=1e9 + 3000, elements=2)
    assert len(whole) == len(cut) == 300
    for k in whole:
        assert whole[k].readings == cut[k].readings and whole[k].status == cut[k].status
        if whole[k].value:
            assert whole[k].value == pytest.approx(cut[k].value, rel=1e-9)


def test_readings_without_id_are_told_apart(spark):
    messages = [(None, "s", "t", 5.0, [1.0], 0), (None, "s", "t", 25.0, [2.0], 0), (None, "s", "t", 25.0, [2.0], 0), (None, "s", "t", 25.0, [4.0], 0), (1, "s", "t", 45.0, [3.0], 0), (1, "s", "t", 45.0, [3.0], 0)]
    got = run(spark, messages)
    assert {k: r.readings for k, r in got.items() if r.readings} == {0: 1, 2: 2, 4: 1}
