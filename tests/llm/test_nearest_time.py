import bisect
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratawave.llm import nearest_time as n

QUERY = "id long, entity string, time double, tolerance double, block long, kind string"
RECORD = "id long, entity string, time double, tolerance double, data string"


NUMBERS = st.floats(allow_nan=False, allow_infinity=False, width=32)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(NUMBERS, min_size=1, max_size=40), min_size=1, max_size=4), st.lists(st.tuples(st.integers(0, 5), NUMBERS), min_size=1, max_size=20))
def test_trie_finds_both_neighbours(groups, queries):
    groups = [sorted(set(k + 0.0 for k in g)) for g in groups]
    keys, names = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    trie = n.XFastTrie(names, n.ordered_bits(keys))
    before, after = trie.neighbours(np.array([g for g, _ in queries]), n.ordered_bits(np.array([q for _, q in queries])))
    for (g, q), b, a in zip(queries, before.tolist(), after.tolist()):
        own, start = (groups[g], sum(map(len, groups[:g]))) if g < len(groups) else ([], 0)
        assert b == (start + i - 1 if (i := bisect.bisect_right(own, q + 0.0)) else -1)
        assert a == (start + i if (i := bisect.bisect_left(own, q + 0.0)) < len(own) else -1)


def test_hash_table_of_many_prefixes():
    rng = np.random.default_rng(2)
    pairs = np.unique(np.column_stack([rng.integers(0, 50, 20_000), rng.integers(0, 2**20, 20_000)]), axis=0)
    table = n.PrefixTable(pairs[:, 0], pairs[:, 1].astype(np.uint64))
    assert (table.find(pairs[:, 0], pairs[:, 1].astype(np.uint64)) == np.arange(len(pairs))).all()
    assert (table.find(pairs[:, 0] + 50, pairs[:, 1].astype(np.uint64)) == -1).all()


def run(spark, queries, records):
    out = n.nearest_in_time(spark.createDataFrame([(*q, 5, "k") for q in queries], QUERY), spark.createDataFrame([(*r, 1.0, "d") for r in records], RECORD))
    return {r.query_id: (r.record_id, round(r.distance, 6)) for r in out.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    records = [(i, rng.choice("aaab"), rng.uniform(0, 40000) if i % 3 else float(rng.randint(0, 40000))) for i in range(2000)]
    queries = [(i, rng.choice("aaabc"), rng.uniform(-10, 40010) if i % 3 else float(rng.randint(0, 40000)), rng.choice([0.0, 1.0, 6.0])) for i in range(600)]
    want = {}
    for q, e, t, tolerance in queries:
        near = [(abs(s - t), r) for r, f, s in records if f == e and abs(s - t) <= tolerance]
        if near:
            want[q] = (min(near)[1], round(min(near)[0], 6))
    assert run(spark, queries, records) == want


def test_width_of_blocks_does_not_show(spark):
    rng = random.Random(5)
    records = spark.createDataFrame([(i, rng.choice("ab"), rng.uniform(0, 500)) for i in range(400)], "id long, entity string, time double")
    queries = spark.createDataFrame([(i, rng.choice("ab"), rng.uniform(0, 500), 4.0) for i in range(150)], "id long, entity string, time double, tolerance double")
    plain = sorted(map(str, n.nearest_in_time(queries, records).collect()))
    for width in (0.0, 3.0, 1e5):
        w = F.when(F.col("entity") == "a", width).otherwise(7.0)
        assert sorted(map(str, n.nearest_in_time(queries.withColumn("width", w), records.withColumn("width", w)).collect())) == plain


def test_ties_dirt_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    records = [(5, "a", 10.0), (4, "a", 12.0), (9, "a", 10.0), (9, "a", 10.0), (1, "a", None), (2, "a", nan), (3, None, 11.0), (None, "a", 11.0)]
    queries = [(1, "a", 11.0, 1.0), (1, "a", 11.0, 1.0), (2, "a", 10.0, 0.0), (3, "a", None, 1.0), (4, "a", nan, 1.0), (5, None, 11.0, 1.0), (6, "a", 11.0, None), (7, "a", 11.0, -1.0), (8, "a", inf, 1.0), (9, "z", 11.0, 1.0), (10, "a", 12.5, 1.0)]
    assert run(spark, queries, records) == {1: (4, 1.0), 2: (5, 0.0), 10: (4, 0.5)}
    assert run(spark, [], records) == {} and run(spark, queries, []) == {}
