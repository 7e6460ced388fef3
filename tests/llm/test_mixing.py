import random

import pytest

from stratawave.llm import mixing as m

SIZED = "doc_id long, source string, tokens long, bucket string, threshold long"
TARGET = "source string, target_share double, max_repeats int"


def run(spark, rows, targets, **more):
    chosen, report = m.mix_sources(spark.createDataFrame([(*r, "b", 1) for r in rows], SIZED), spark.createDataFrame(targets, TARGET), **more)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_shares_repeats_and_nesting(spark):
    rng = random.Random(7)
    rows = [(i, "big", rng.randint(1, 200)) for i in range(6000)] + [(10_000 + i, "mid", rng.randint(1, 200)) for i in range(800)] + [(20_000 + i, "small", rng.randint(1, 200)) for i in range(100)]
    rows += [(30_000, None, 999), (30_001, "unlisted", 999), (30_002, "big", 0)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.15, 3), ("absent", 0.05, 9), ("big", 0.5, 1)]
    chosen, report = run(spark, rows, targets)
    have = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "mid", "small", "absent")}
    total = sum(have.values())
    for s, share, repeats in targets:
        r = report[s]
        assert r.tokens == have[s] and r.budget == pytest.approx(share * total) and r.reachable == (have[s] * repeats >= share * total)
        assert r.mixed == sum(c.tokens * c.copies for c in chosen if c.source == s) <= r.budget + 1e-6
        assert not r.reachable or r.budget - r.mixed <= 200
        assert r.reachable or r.mixed == have[s] * repeats
    assert max(c.copies for c in chosen if c.source == "mid") <= 4 and {c.source for c in chosen} == {"big", "mid", "small"}
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    less, _ = run(spark, rows, targets, total=total // 2)
    more = {c.doc_id: c.copies for c in chosen}
    assert all(c.copies <= more[c.doc_id] for c in less)


def test_empty_and_null(spark):
    chosen, report = run(spark, [], [("a", 1.0, 1), ("b", None, None), (None, 0.5, 1)])
    assert chosen == [] and report["a"].mixed == 0 and report["a"].share is None and set(report) == {"a", "b"}
    chosen, report = run(spark, [(1, "a", 5), (1, "a", 5), (None, "a", 7)], [("a", 1.0, 1)])
    assert report["a"].mixed == 17 and len(chosen) == 3
    chosen, report = run(spark, [(1, "a", 5)], [])
    assert chosen == [] and report == {}


def test_documents(spark):
    df = spark.createDataFrame([(1, "one two three", "a", "x"), (2, None, "a", "x"), (3, "", "b", "x"), (4, "four", "b", "x")], "doc_id long, text string, source string, tokens string")
    chosen, report = m.mix_documents(df, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET))
    assert {r.source: (r.tokens, r.mixed) for r in report.collect()} == {"a": (3, 0), "b": (1, 2)}
