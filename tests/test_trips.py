import numpy as np

from stratawave.operators import trips as t

NAV = "source_uri string, topic string, nav_id long, seq long, timestamp double, data array<double>, status int, block int"


def drive(seed, legs, source="d", noise=6.0):
    """legs: (seconds, speed in m/s, silent); returns rows and the truth for each ping."""
    rng = np.random.default_rng(seed)
    now, x, rows, truth = 1e9, 0.0, [], []
    for seconds, speed, silent in legs:
        end = now + seconds
        while now < end:
            step = min(rng.uniform(5, 18), end - now)
            x += speed * step
            now += step
            if not silent:
                e, n = x + rng.normal(0, noise), rng.normal(0, noise)
                rows.append((source, "gps", len(rows) + 1000 * seed, len(rows), float(now), [float(50 + n / 111320), float(8 + e / (111320 * np.cos(np.radians(50)))), 100.0], 1, 0))
                truth.append(speed == 0 and seconds >= 180)
    return rows, truth


LEGS = [(600, 15, False), (400, 0, False), (500, 1.6, False), (90, 0, False), (300, 12, False), (200, 0, False), (1500, 0, True), (300, 0, False), (700, 20, False)]


def marked(spark, rows):
    return {r.nav_id: r for r in t.mark_stops(spark.createDataFrame(rows, NAV)).collect()}


def test_stops_of_noisy_drives(spark):
    rows, truth = [], {}
    for seed in range(1, 9):
        r, tr = drive(seed, LEGS, f"d{seed}")
        rows += r
        truth |= {x[2]: y for x, y in zip(r, tr)}
    got = marked(spark, rows)
    found = {k for k, r in got.items() if r.stopped}
    real = {k for k, v in truth.items() if v}
    assert len(found & real) / len(found) > 0.95 and len(found & real) / len(real) > 0.95


def test_strays_gaps_and_dirt(spark):
    rows, truth = drive(30, [(300, 15, False), (600, 0, False), (300, 15, False)])
    stand = [i for i, x in enumerate(truth) if x]
    lost, stray, gone = stand[5], stand[9], stand[12]
    rows[lost] = (*rows[lost][:5], None, -1, 0)
    rows[stray] = (*rows[stray][:5], [0.0, 0.0, 0.0], 1, 0)
    rows[gone] = (*rows[gone][:5], [51.0, 9.0, 0.0], None, 0)
    rows += [rows[3]] * 2 + [("d", "gps", 5_000_000, 7, None, [50.0, 8.0], 1, 0), ("e", "gps", 6_000_000, 0, 1e9, [], 1, 0), (None, None, 7_000_000, None, 1e9, [50.0, 8.0], 1, 0)]
    got = marked(spark, rows)
    assert 5_000_000 not in got and len(got) == len(truth) + 2
    assert all(got[rows[i][2]].stopped for i in (lost, stray, gone)) and not got[6_000_000].stopped
    assert not got[rows[stray][2]].good


def test_trips(spark):
    rows, _ = drive(12, [(600, 10, False), (600, 0, False), (600, 10, False)], noise=1.0)
    out = sorted(t.stops_and_trips(spark.createDataFrame(rows, NAV)).collect(), key=lambda r: r.start_time)
    assert [r.kind for r in out] == ["trip", "stop", "trip"]
    assert abs(out[1].duration - 600) < 60 and abs(out[0].distance - 6000) < 300 and out[1].distance == 0
    assert out[0].end_time == out[1].start_time and out[2].start_time == out[1].end_time
    assert sum(r.pings for r in out) == len(rows)


def test_blocks_do_not_show_and_empty(spark):
    rows, _ = drive(13, LEGS * 3)
    df = spark.createDataFrame(rows, NAV)
    whole = {r.nav_id for r in t.mark_stops(df).collect() if r.stopped}
    cut = {r.nav_id for r in t.mark_stops(df, 150, 100).collect() if r.stopped}
    assert len(whole ^ cut) <= 4
    assert t.stops_and_trips(df).count() == t.stops_and_trips(df, 150, 100).count()
    assert t.stops_and_trips(spark.createDataFrame([], NAV)).count() == 0


def test_pings_without_a_count(spark):
    rows, truth = drive(41, [(600, 15, False), (900, 0, False), (600, 15, False)])
    rows = [(*r[:3], None, *r[4:]) for r in rows]
    got = marked(spark, rows)
    found, real = {k for k, r in got.items() if r.stopped}, {r[2] for r, y in zip(rows, truth) if y}
    assert len(found & real) / len(found) > 0.95 and len(found & real) / len(real) > 0.95
    kinds = [r.kind for r in t.stops_and_trips(spark.createDataFrame(rows, NAV)).orderBy("start_time").collect()]
    assert kinds == ["trip", "stop", "trip"]
