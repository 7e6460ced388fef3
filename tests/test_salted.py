from pyspark.sql import functions as F

from stratawave.operators import salted as s


def test_salted_equals_plain(spark):
    rows = [("hot", i, float(i % 7)) for i in range(3000)] + [(f"k{i % 50}", i, None if i % 3 else 1.0) for i in range(500)] + [(None, 1, 2.0)] * 600
    df = spark.createDataFrame(rows, "topic string, salt long, x double")
    aggregates = {"n": ("count", F.lit(1)), "m": ("count", F.col("x")), "total": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}
    plain = df.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("m"), F.sum("x").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    heavy = s.heavy_keys(df, "topic", 0.1)
    assert {r.topic for r in heavy.collect()} == {"hot", None}
    for h in (heavy, None):
        got = s.salted_aggregate(df, "topic", aggregates, F.struct("salt", "x"), h)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert s.salted_aggregate(df.limit(0), "topic", aggregates, F.col("salt"), heavy).count() == 0


def test_newest_counts_and_shares(spark):
    rows = [("a", "t", 5, 1), ("a", "t", 7, 3), ("a", "t", None, 4), ("a", "t", 6, 3), ("b", "t", None, 1), ("b", "u", 93, None), ("b", "u", 93, None), ("c", "v", 0, 2)]
    df = spark.createDataFrame(rows, "source_uri string, topic string, count long, written_at long")
    got = {r.topic: (r.records, r.series, round(r.share, 2)) for r in s.topic_totals(df).collect()}
    assert got == {"t": (7, 1, 0.07), "u": (93, 1, 0.93), "v": (0, 1, 0.0)}
    assert s.topic_totals(df.limit(0)).count() == 0


def test_topic_statistics(spark):
    rows = [("t", i, float(i), [float(i)]) for i in range(100)] + [("t", 1, None, None), ("t", 2, 1.0, []), ("t", 3, 1.0, [float("nan")]), (None, 1, 1.0, [5.0])]
    got = {r.topic: r for r in s.topic_statistics(spark.createDataFrame(rows, "topic string, msg_id long, timestamp double, data array<double>")).collect()}
    assert (got["t"].rows, got["t"].timed, got["t"]["values"], got["t"].least, got["t"].largest) == (103, 102, 100, 0.0, 99.0)
    assert got[None].rows == 1
