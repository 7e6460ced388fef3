import numpy as np

from stratawave.operators import spikes as s

MESSAGE = "msg_id long, source_uri string, topic string, seq long, timestamp double, data array<double>, reason string"
SPEC = "topic string, range_lo double, range_hi double, element int"


def run(spark, rows, spec=(("t", -1000.0, 1000.0, 1),), **more):
    out = s.flag_implausible(spark.createDataFrame(rows, MESSAGE), spark.createDataFrame(list(spec), SPEC), **more)
    return {(r.msg_id, r.element, r.reason) for r in out.collect()}


def series(values, source="s", topic="t", first=0):
    return [(first + i, source, topic, i, 1e9 + 10.0 * i, [float(v)] if np.isscalar(v) else v, "x") for i, v in enumerate(values)]


def test_excursions_levels_runs_and_limits(spark):
    rng = np.random.default_rng(3)
    v = 20 + rng.normal(0, 1, 400)
    v[200:] += 60  # a lasting change
    v[50], v[51], v[300], v[120:123] = 45.0, 44.0, -5000.0, 2.0
    v[340:352] = 80.25  # stuck
    got = run(spark, series(v))
    want = {(50, 0, "excursion"), (51, 0, "excursion"), (300, 0, "excursion"), (300, 0, "range"), *((i, 0, "excursion") for i in (120, 121, 122)), *((i, 0, "stuck") for i in range(340, 352))}
    assert got == want


def test_coarse_topics_repeat_by_nature(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0, 0.4, 500))
    v[100:112] = 0.0
    assert not {x for x in run(spark, series(v)) if x[2] == "stuck"}


def test_second_element_duplicates_and_dirt(spark):
    rng = np.random.default_rng(5)
    rows = series([[float(a), float(b)] for a, b in rng.normal(0, 1, (200, 2))])
    rows[77] = (*rows[77][:5], [rows[77][5][0], 90.0], "x")
    rows += [rows[77]] * 3 + rows[:20]
    rows += [(900, "s", "t", 500, None, [1e9], "x"), (901, "s", "t", 501, 5.0, None, "x"), (902, "s", "t", 502, 5.0, [], "x"), (903, "s", "t", 503, 5.0, [float("inf")], "x")]
    rows += [(904, None, None, None, 7.0, [1.0], "x"), (905, "s", "no spec", 0, 7.0, [1.0], "x"), (906, "z", "t", 0, 7.0, [1e6], "x")]
    assert run(spark, rows) == {(77, 1, "excursion"), (906, 0, "range")}


def test_empty_and_null_limits(spark):
    assert run(spark, []) == set()
    assert run(spark, series([1.0, 2.0, 3.0]), [("t", None, None, 0)]) == set()


def test_blocks_do_not_show(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, 900)
    v[[5, 299, 300, 601, 899]] = 40.0
    v[596:612] = 1.5
    whole = run(spark, series(v))
    assert run(spark, series(v), block_size=300) == whole
    assert {x[0] for x in whole} == {5, 299, 300, 899, *range(596, 612)}


def test_candidates_follow_the_limit():
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, 300)
    v[150] = 2.5
    group = s.pd.DataFrame([(*r[:6], 0) for r in series(v)], columns=["msg_id", "source_uri", "topic", "seq", "timestamp", "data", "block"])
    low, usual = ({int(i) for out in s.examine(group, 4096, limit) if out["kind"].iloc[0] == 0 for i in out["msg_id"]} for limit in (3.0, 6.0))
    assert 150 in low and 150 not in usual and usual < low


def test_a_low_limit_flags_more(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, 300)
    assert run(spark, series(v), limit=2.0) > run(spark, series(v))


def test_readings_without_a_count(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, 900)  # two hours and a half
    v[450] = 60.0
    rows = [(*r[:3], None, *r[4:]) for r in series(v)]
    counted = series(rng.normal(0, 1, 300), first=5000)
    assert run(spark, rows + counted) == {(450, 0, "excursion")}
    assert len({r.n for r in spark.createDataFrame(rows, MESSAGE).selectExpr("floor(timestamp / 3600) AS n").distinct().collect()}) > 2
