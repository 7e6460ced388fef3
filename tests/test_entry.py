"""The driver's contract: names, SQL and plans."""

import os
import re

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
    for n in range(1, 6):
        assert any(q.startswith(f"p{n}_") for q in e.queries())


def test_no_query_takes_a_part_of_its_tables():
    for name, sql in e.oracle_sql().items():
        assert not re.search(r"\bLIMIT\b|TABLESAMPLE", sql, re.I), name


@HERE
def test_entry_runs(spark):
    assert e.entry(spark).columns == ["source_uri", "topic", "slot"] and e.entry(spark).count() > 0


def test_families_are_registered():
    """A broken module of queries must not pass unseen."""
    assert len(e.queries()) > 195 and len(e.queries()) - len(e.oracle_sql()) < 16
    for name in ("recorded_messages", "buffer_reads", "frame_shifts", "stream_index_range", "p2_compacted"):
        assert name in e.queries() and name in e.oracle_sql()


COMPARED = ("p1_found", "p2_found", "p2_roles", "p2_compacted", "recorded_messages", "buffer_items", "resampled_imu", "stream_latest", "icp", "farthest_points", "sampled_image", "compensated_windows", "dead_reckoning", "p3_totals", "describe", "align_nearest", "resample_linear", "window_seconds", "differentiate", "slerp", "knn_search", "roughness", "depth_image", "split_groups")


@HERE
@pytest.mark.parametrize("name", COMPARED)
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    found = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = e.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted(repr(tuple(float(f"{x:.8g}") + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(found.fetchall())


@HERE
def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from stratawave.operators.topic import Dataset
    from stratawave.session import table

    rows = table(spark, SMALL, "message").select("topic", "seq", F.col("timestamp").alias("ts"), "data")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = Dataset(rows).select_topics("/hub/flow").time_range(1.0, 2.0).df.select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(topic,/hub/flow)" in plan and "GreaterThanOrEqual(timestamp,1.0)" in plan
    assert "ReadSchema: struct<topic:string,seq:bigint,timestamp:double>" in plan


@HERE
def test_elevation_of_every_fix(spark):
    import duckdb

    sql = e.oracle_sql()["elevation_at_all_fixes"]
    con = duckdb.connect()
    for f in ("part", "navsensor"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{SMALL}/{f}.parquet'")
    want = dict(con.execute(sql).fetchall())
    got = {r.nav_id: r.sample for r in e.queries()["elevation_at_all_fixes"](spark, SMALL).collect()}
    fixes = con.execute('SELECT count(DISTINCT nav_id) FROM navsensor WHERE "timestamp" IS NOT NULL AND len(data) = 3 AND abs(data[1]) <= 90 AND abs(data[2]) <= 180').fetchone()[0]
    assert len(got) == len(want) == fixes and got == pytest.approx(want, abs=1e-3)


@HERE
@pytest.mark.parametrize("name", ("angular_velocity", "differentiated_trajectory", "window_seconds"))
def test_agrees_with_sql_where_times_go_back(spark, name, tmp_path):
    """Over events of which each copy begins at the time of the first again."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, user_id, event_type, value, props FROM '{SMALL}/events.parquet', range(3) t(k) WHERE event_id < 200) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    plain = lambda rows: sorted(repr(tuple(float(f"{x:.8g}") + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(tuple(r) for r in e.queries()[name](spark, str(tmp_path)).select(*columns).collect()) == plain(found.fetchall())


@HERE
def test_buffer_reads_keeps_no_rows_on_the_driver(spark, monkeypatch):
    import duckdb

    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, _own=type(spark).createDataFrame, **k: (made.append(len(data)), _own(self, data, *a, **k))[1])
    got = {(r.backend, r.way): (r.n, r.total, r.seqs) for r in e.queries()["buffer_reads"](spark, SMALL).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = {(r[0], r[1]): r[2:] for r in con.execute(e.oracle_sql()["buffer_reads"]).fetchall()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want) and max(made) < 10
