import math
import random

import pytest

from stratawave.llm import percentiles as p

SCHEMA = "topic string, day int, x double, n long, rows long, part int"


def exact(values, share):
    v = sorted(values)
    return v[max(1, math.ceil(round(share * len(v), 6))) - 1]


def table(spark, rows):
    return spark.createDataFrame([(t, d, x, 1, 2, 3) for t, d, x in rows], SCHEMA)


SHARES = (0.0, 0.1, 0.5, 0.99, 1.0)


def test_exact_percentiles_with_hot_groups_ties_and_dirt(spark):
    rng = random.Random(1)
    rows = [("hot", 1, float(rng.randint(-50, 50))) for _ in range(3000)] + [("rare", 2, 7.5), (None, 1, 1.0), (None, 1, 3.0)]
    rows += [("hot", 1, None), ("hot", 1, float("nan")), ("none", 1, None), ("inf", 1, float("inf")), ("inf", 1, -float("inf")), ("zero", 1, -0.0), ("zero", 1, 0.0)]
    got = {(r.topic, r.share): r for r in p.percentiles(p.frequencies(table(spark, rows), ["topic"], "x"), ["topic"], SHARES, 7).collect()}
    want: dict = {}
    for t, _, x in rows:
        if x is not None and not math.isnan(x):
            want.setdefault(t, []).append(x)
    assert set(got) == {(t, s) for t in want for s in SHARES}
    for (t, s), r in got.items():
        assert r.value == exact(want[t], s) and r.rows == len(want[t])


def test_days_add_up_within_the_bound(spark):
    rng = random.Random(2)
    rows = [(f"t{i % 3}", i % 5, math.copysign(math.exp(rng.gauss(0, 8)), rng.random() - 0.3)) for i in range(4000)]
    days = p.frequencies(table(spark, rows), ["topic", "day"], "x", 10)
    whole = p.frequencies(table(spark, rows), ["topic"], "x", 10)
    added = p.merged(days, ["topic"])
    assert sorted(map(str, added.collect())) == sorted(map(str, whole.select(*added.columns).collect()))
    for r in p.percentiles(added, ["topic"], SHARES).collect():
        x = exact([v for t, _, v in rows if t == r.topic], r.share)
        assert r.value == pytest.approx(x, rel=2**-10)


def test_empty(spark):
    assert p.percentiles(p.frequencies(table(spark, []), ["topic"], "x"), ["topic"], SHARES).count() == 0
