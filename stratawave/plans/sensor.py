"""Queries of the sensor and array operators over the test tables.

``events`` stands for a message stream of five topics, ``navsensor`` for fixes of drives,
``embeddings`` for points (three values), orientations (four) and frames of 8 x 8,
``part`` for an elevation raster of 50 columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.functions import camera, geodesy, masks, transforms
from stratawave.functions import quaternion as q
from stratawave.functions import vectors as v
from stratawave.operators import align, image, ml, points, raster, summary, trajectory, windows
from stratawave.operators import order as o
from stratawave.operators.topic import Dataset, Topic
from stratawave.schema import spatial_bounds_for_data, topic_metadata
from stratawave.session import cut, finite, removed, shared_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL it must agree with."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def r6(x, digits: int = 6):
    return F.round(x, digits)


# ---- streams of events

MSGS = """msgs AS (
  SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, epoch_us(ts) / 1e6 AS ts, CAST(event_id AS VARCHAR) AS name,
    CAST(user_id % 4 AS VARCHAR) AS frame_id, CAST(value AS DOUBLE) AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_type").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").cast("string").alias("name"), (F.col("user_id") % 4).cast("string").alias("frame_id"),
        F.lit("events").alias("source_uri"), F.lit("float64").alias("dtype"), F.array(F.lit(2)).alias("shape"), F.array(F.col("value").cast("double"), F.get_json_object("props", "$.k").cast("double")).alias("data"), "event_id",
    )
    return o.positions(rows, ["topic"], ["event_id"], "seq").drop("event_id")


#: Stores of the messages by application and data directory, written when a query first asks for one.
STORED: dict[tuple[str, str], str] = {}


def shared_store(spark: SparkSession, sf_dir: str):
    """The messages in a store in the shared folder, closed and with their seq."""
    import uuid

    from stratawave.sources.store import Store

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in STORED or not Store(spark, STORED[key]).exists("manifest"):
        path = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
        Store(spark, path).append(messages(spark, sf_dir), closed=True)
        STORED[key] = path
    return Store(spark, STORED[key])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows: filters reach the store's files."""
    return shared_store(spark, sf_dir).messages()


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(stored(spark, sf_dir))


def flat(df: DataFrame) -> DataFrame:
    return df.select("topic", "seq", r6("ts").alias("ts"), "name", F.get("data", F.lit(0)).alias("a"), F.get("data", F.lit(1)).alias("b"))


OUT = "topic, seq, round(ts, 6) AS ts, name, a, b"
START, END = 1704067800.0, 1704200000.0


@query(f"WITH {MSGS} SELECT {OUT} FROM msgs WHERE ts BETWEEN {START} AND {END}")
def topic_time_range(spark, sf_dir):
    return flat(dataset(spark, sf_dir).time_range(START, END).df)


@query(f"WITH {MSGS}, f AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS i FROM msgs WHERE a > 20) SELECT {OUT} FROM f WHERE i >= 5 AND i < 400 AND (i - 5) % 3 = 0")
def topic_index_range(spark, sf_dir):
    return flat(dataset(spark, sf_dir).filter(F.get("data", F.lit(0)) > 20).index_range(5, 400, 3).df)


@query(f"WITH {MSGS} SELECT {OUT} FROM msgs WHERE frame_id IN ('1', '3') AND topic IN ('view', 'click')")
def topic_frame_id(spark, sf_dir):
    return flat(dataset(spark, sf_dir).select_topics("view", "click").frame_id("1", "3").df)


@query(f"WITH {MSGS} SELECT {OUT} FROM msgs WHERE a BETWEEN 10 AND 50 AND b BETWEEN 20 AND 60")
def topic_spatial_bounds(spark, sf_dir):
    return flat(dataset(spark, sf_dir).spatial_bounds((10, 20), (50, 60)).df)


@query(f"WITH {MSGS} SELECT topic, seq, round(ts, 6) AS ts, name, a * 2 + 1 AS a, b * 2 + 1 AS b FROM msgs")
def topic_map(spark, sf_dir):
    return flat(dataset(spark, sf_dir).map(F.transform("data", lambda x: x * 2 + 1)).df)


@query(f"WITH {MSGS} SELECT topic, seq, round(ts, 6) AS ts, name, b AS a, a AS b FROM msgs WHERE a > b")
def topic_map_callable(spark, sf_dir):
    return flat(dataset(spark, sf_dir).filter(lambda d: d[0] > d[1]).map(lambda d: d[::-1]).df)


@query(f"WITH {MSGS} SELECT topic, round(sum(a), 4) AS a, sum(b) AS b FROM msgs GROUP BY 1")
def topic_reduce(spark, sf_dir):
    return dataset(spark, sf_dir).reduce("sum").select("topic", r6(F.get("result", F.lit(0)), 4).alias("a"), F.get("result", F.lit(1)).alias("b"))


@query(f"WITH {MSGS} SELECT topic, min(a) AS a, min(b) AS b FROM msgs GROUP BY 1")
def topic_reduce_fold(spark, sf_dir):
    folded = dataset(spark, sf_dir).reduce(lambda a, d: F.zip_with(a, d, lambda x, y: F.least(x, y)))
    return folded.select("topic", F.get("result", F.lit(0)).alias("a"), F.get("result", F.lit(1)).alias("b"))


@query(f"WITH {MSGS}, l AS (SELECT max_by(ts, seq) AS last FROM msgs WHERE topic = 'view') SELECT {OUT} FROM msgs, l WHERE topic = 'view' AND ts >= last - 40000")
def topic_last_seconds(spark, sf_dir):
    return flat(Topic(stored(spark, sf_dir).filter("topic = 'view'")).last_seconds(40000).df)


@query(f"WITH {MSGS}, n AS (SELECT max(seq) + 1 AS n FROM msgs WHERE topic = 'view') SELECT {OUT} FROM msgs, n WHERE topic = 'view' AND seq >= n - 100 AND seq < n - 10 AND (seq - n + 100) % 4 = 0")
def topic_slice(spark, sf_dir):
    return flat(Topic(stored(spark, sf_dir).filter("topic = 'view'")).slice(-100, -10, 4).df)


@query(f"""WITH {MSGS} SELECT topic, CASE WHEN min(frame_id) = max(frame_id) THEN min(frame_id) END AS frame_id, count(*) AS count, round(min_by(ts, seq), 6) AS start_time, round(max_by(ts, seq), 6) AS end_time FROM msgs GROUP BY 1""")
def topic_meta(spark, sf_dir):
    return topic_metadata(messages(spark, sf_dir)).select("topic", "frame_id", "count", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"))


@query(f"""WITH {MSGS}, s AS (SELECT *, ts - lag(ts) OVER (PARTITION BY topic ORDER BY seq) AS dt FROM msgs)
SELECT topic, count(*) AS count, round(max_by(ts, seq) - min_by(ts, seq), 4) AS duration, round((count(*) - 1) / (max_by(ts, seq) - min_by(ts, seq)), 8) AS rate_hz,
  round(avg(dt), 4) AS dt_mean, round(stddev_pop(dt), 4) AS dt_std, round(min(dt), 4) AS dt_min, round(max(dt), 4) AS dt_max, least(min(a), min(b)) AS min, greatest(max(a), max(b)) AS max, round((sum(a) + sum(b)) / (2 * count(*)), 4) AS mean
FROM s GROUP BY 1""")
def describe(spark, sf_dir):
    d = summary.describe_dataset(messages(spark, sf_dir))
    return d.select("topic", "count", r6("duration", 4).alias("duration"), r6("rate_hz", 8).alias("rate_hz"), *(r6(c, 4).alias(c) for c in ("dt_mean", "dt_std", "dt_min", "dt_max")), "min", "max", r6("mean", 4).alias("mean"))


@query(f"WITH {MSGS} SELECT topic, round(avg(a - 10), 6) AS bias_0 FROM msgs GROUP BY 1")
def estimate_bias(spark, sf_dir):
    return summary.estimate_bias(messages(spark, sf_dir), [F.get("data", F.lit(0))], 10.0, by=["topic"]).select("topic", r6("bias_0").alias("bias_0"))


@query(f"WITH {MSGS} SELECT topic, seq, round(a - avg(a) OVER (PARTITION BY topic), 6) AS value FROM msgs")
def correct_bias(spark, sf_dir):
    m = messages(spark, sf_dir)
    return summary.correct_bias(m, {"value": F.get("data", F.lit(0))}, by=["topic"]).select("topic", "seq", r6("value").alias("value"))


# ---- alignment

PAIR = f"""{MSGS}, ref AS (SELECT * FROM msgs WHERE topic = 'view'), tgt AS (SELECT * FROM msgs WHERE topic = 'click'),
near AS (
  SELECT r.seq, r.ts, b.ts AS bt, b.seq AS bs, b.a AS ba, f.ts AS ft, f.seq AS fs, f.a AS fa
  FROM ref r ASOF LEFT JOIN tgt b ON r.ts > b.ts ASOF LEFT JOIN tgt f ON r.ts <= f.ts),
pick AS (
  SELECT seq, ts, CASE WHEN bt IS NULL OR ft - ts <= ts - bt THEN ft ELSE bt END AS tt, CASE WHEN bt IS NULL OR ft - ts <= ts - bt THEN fs ELSE bs END AS tseq, CASE WHEN bt IS NULL OR ft - ts <= ts - bt THEN fa ELSE ba END AS ta FROM near)"""


def pair(spark, sf_dir):
    m = messages(spark, sf_dir).select("topic", "ts", "seq", F.get("data", F.lit(0)).alias("a"), "data")
    return m.filter("topic = 'view'").select("ts", "seq"), m.filter("topic = 'click'").select("ts", "seq", "a")


@query(f"WITH {PAIR} SELECT seq, round(tt, 6) AS target_ts, tseq AS target_index, ta AS a FROM pick")
def align_nearest(spark, sf_dir):
    r, t = pair(spark, sf_dir)
    return align.align_nearest(r, t).select("seq", r6("target_ts").alias("target_ts"), "target_index", "a")


@query(f"WITH {PAIR} SELECT seq, coalesce(abs(tt - ts) <= 30, false) AS valid, CASE WHEN abs(tt - ts) <= 30 THEN tseq ELSE -1 END AS target_index, CASE WHEN abs(tt - ts) <= 30 THEN ta END AS a FROM pick")
def align_bounded(spark, sf_dir):
    r, t = pair(spark, sf_dir)
    return align.align_bounded(r, t, 30.0).select("seq", "valid", "target_index", "a")


@query(f"WITH {PAIR} SELECT seq, CASE WHEN ft = ts THEN fs WHEN bs IS NOT NULL THEN bs ELSE -1 END AS target_index, CASE WHEN ft = ts THEN fa ELSE ba END AS a FROM near")
def align_backward(spark, sf_dir):
    r, t = pair(spark, sf_dir)
    return align.align_backward(r, t).select("seq", "target_index", "a")


@query(f"""WITH {MSGS}, r AS (SELECT seq, floor(ts / 600) * 600 AS ts FROM msgs WHERE topic = 'view'), t AS (SELECT floor(ts / 600) * 600 AS ts, min(seq) AS seq FROM msgs WHERE topic = 'click' GROUP BY 1)
SELECT r.seq, coalesce(t.seq, -1) AS target_index, t.seq IS NOT NULL AS valid FROM r LEFT JOIN t USING (ts)""")
def align_exact(spark, sf_dir):
    r, t = pair(spark, sf_dir)
    rough = lambda d: d.withColumn("ts", F.floor(F.col("ts") / 600) * 600.0)
    return align.align_exact(rough(r), rough(t)).select("seq", "target_index", "valid")


@query(f"""WITH {MSGS}, r AS (SELECT * FROM msgs WHERE topic = 'view'), t AS (SELECT * FROM msgs WHERE topic = 'click'),
j AS (SELECT r.seq, t.seq AS tseq, t.a, row_number() OVER (PARTITION BY r.seq ORDER BY t.ts DESC, t.seq DESC) AS k FROM r JOIN t ON t.ts >= r.ts - 900 AND t.ts <= r.ts + 60)
SELECT r.seq, count(j.seq) AS count, min(j.tseq) AS first_index, round(coalesce(sum(j.a), 0), 4) AS total FROM r LEFT JOIN j ON r.seq = j.seq AND k <= 5 GROUP BY r.seq""")
def align_rolling_window(spark, sf_dir):
    r, t = pair(spark, sf_dir)
    w = align.rolling_window_join(r, t, lookback=900.0, lookahead=60.0, size=5)
    return w.select("seq", F.col("count").cast("long").alias("count"), F.get("window", F.lit(0))["seq"].alias("first_index"), r6(F.aggregate("window", F.lit(0.0), lambda s, x: s + x["a"]), 4).alias("total"))


@query(f"""WITH {MSGS}, r AS (SELECT * FROM msgs WHERE topic = 'view'), t AS (SELECT * FROM msgs WHERE topic = 'click'), c AS (SELECT r.seq, (SELECT count(*) FROM t WHERE t.ts <= r.ts) AS n FROM r)
SELECT seq, least(n, 4) AS count, CASE WHEN n > 0 THEN greatest(n - 4, 0) END AS first_index FROM c""")
def align_rolling_size(spark, sf_dir):
    r, t = pair(spark, sf_dir)
    return align.rolling_window_join(r, t, size=4).select("seq", F.col("count").cast("long").alias("count"), F.get("window", F.lit(0))["seq"].alias("first_index"))


GRID = f"""{MSGS}, e AS (SELECT topic, min_by(ts, seq) AS first, max_by(ts, seq) AS last FROM msgs GROUP BY 1),
grid AS (SELECT topic, unnest(range(CAST(floor((last - first) / 300 + 1e-12) AS BIGINT) + 1)) AS seq, first FROM e), g AS (SELECT topic, seq, first + seq * 300 AS ts FROM grid),
near AS (SELECT g.topic, g.seq, g.ts, b.ts AS bt, b.a AS ba, f.ts AS ft, f.a AS fa FROM g ASOF LEFT JOIN msgs b ON g.topic = b.topic AND g.ts > b.ts ASOF LEFT JOIN msgs f ON g.topic = f.topic AND g.ts <= f.ts)"""


@query(f"WITH {GRID} SELECT topic, seq, round(ts, 4) AS ts, round(CASE WHEN ft IS NULL THEN ba WHEN bt IS NULL OR ft = ts THEN fa ELSE ba + (fa - ba) * (ts - bt) / (ft - bt) END, 4) AS a, coalesce(ft = ts, false) OR (ft IS NOT NULL AND bt IS NOT NULL) AS valid FROM near")
def resample_linear(spark, sf_dir):
    return align.resample_topic(messages(spark, sf_dir), period=300.0).select("topic", "seq", r6("ts", 4).alias("ts"), r6(F.get("data", F.lit(0)), 4).alias("a"), "valid")


@query(f"WITH {GRID} SELECT topic, seq, CASE WHEN least(coalesce(ft - ts, 1e9), coalesce(ts - bt, 1e9)) <= 60 THEN CASE WHEN bt IS NULL OR ft - ts <= ts - bt THEN fa ELSE ba END END AS a, least(coalesce(ft - ts, 1e9), coalesce(ts - bt, 1e9)) <= 60 AS valid FROM near")
def resample_nearest(spark, sf_dir):
    return align.resample_topic(messages(spark, sf_dir), period=300.0, method="nearest", tolerance=60.0).select("topic", "seq", F.get("data", F.lit(0)).alias("a"), "valid")


# ---- windows

@query(f"""WITH {MSGS} SELECT topic, seq, count(*) OVER w AS count, round(sum(a) OVER w, 4) AS total FROM msgs WINDOW w AS (PARTITION BY topic ORDER BY seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def window_rows(spark, sf_dir):
    w = windows.window_topic(messages(spark, sf_dir), size=7)
    return w.select("topic", "seq", F.size("window").cast("long").alias("count"), r6(F.aggregate("window", F.lit(0.0), lambda s, x: s + F.get(x["data"], F.lit(0))), 4).alias("total"))


@query(f"""WITH {MSGS}, w AS (SELECT x.topic, x.seq, y.seq AS s, y.a, row_number() OVER (PARTITION BY x.topic, x.seq ORDER BY y.seq DESC) AS k FROM msgs x JOIN msgs y ON x.topic = y.topic AND y.ts >= x.ts - 1200 AND y.seq <= x.seq)
SELECT topic, seq, count(*) AS count, round(sum(a), 4) AS total FROM w WHERE k <= 8 GROUP BY 1, 2""")
def window_seconds(spark, sf_dir):
    w = windows.window_topic(messages(spark, sf_dir).select("topic", "seq", "ts", "name", "data"), size=8, seconds=1200.0)
    return w.select("topic", "seq", F.size("window").cast("long").alias("count"), r6(F.aggregate("window", F.lit(0.0), lambda s, x: s + F.get(x["data"], F.lit(0))), 4).alias("total"))


@query(f"""WITH {MSGS}, n AS (SELECT topic, max(seq) AS last FROM msgs GROUP BY 1), k AS (SELECT unnest(range(-2, 3)) AS k),
j AS (SELECT x.topic, x.seq, y.a FROM msgs x JOIN n ON n.topic = x.topic CROSS JOIN k JOIN msgs y ON y.topic = x.topic AND y.seq = least(greatest(x.seq + k.k, 0), n.last))
SELECT topic, seq, round(avg(a), 6) AS smoothed FROM j GROUP BY 1, 2""")
def smooth(spark, sf_dir):
    return windows.smooth_timeseries(messages(spark, sf_dir), "data", 5).select("topic", "seq", r6(F.get("smoothed", F.lit(0))).alias("smoothed"))


NEAR = f"""{MSGS}, near AS (SELECT *, lag(ts) OVER w AS pt, lead(ts) OVER w AS nt, lag(a) OVER w AS pa, lead(a) OVER w AS na FROM msgs WINDOW w AS (PARTITION BY topic ORDER BY seq)), h AS (SELECT *, ts - pt AS hs, nt - ts AS hd FROM near)"""


@query(f"""WITH {NEAR} SELECT topic, seq, round(CASE WHEN pt IS NULL THEN (na - a) / hd WHEN nt IS NULL THEN (a - pa) / hs ELSE (hs * hs * na + (hd * hd - hs * hs) * a - hd * hd * pa) / (hs * hd * (hs + hd)) END, 6) AS derivative FROM h""")
def differentiate(spark, sf_dir):
    return windows.differentiate_timeseries(messages(spark, sf_dir)).select("topic", "seq", r6(F.get("derivative", F.lit(0))).alias("derivative"))


@query(f"""WITH {NEAR} SELECT topic, seq, round(5 + sum(coalesce(0.5 * (a + pa) * hs, 0)) OVER (PARTITION BY topic ORDER BY seq), 2) AS integral FROM h""")
def integrate(spark, sf_dir):
    return windows.integrate_timeseries(messages(spark, sf_dir), "data", 2, 5.0).select("topic", "seq", r6(F.get("integral", F.lit(0)), 2).alias("integral"))


@query(f"""WITH {NEAR}, b AS (SELECT *, lag(b) OVER w AS pb, lead(b) OVER w AS nb FROM h WINDOW w AS (PARTITION BY topic ORDER BY seq))
SELECT topic, seq, round(sqrt(pow(coalesce(na, a) - coalesce(pa, a), 2) + pow(coalesce(nb, b) - coalesce(pb, b), 2)) / (coalesce(nt, ts) - coalesce(pt, ts)), 6) AS speed FROM b""")
def speed(spark, sf_dir):
    return windows.trajectory_speed(messages(spark, sf_dir), "data").select("topic", "seq", r6("speed").alias("speed"))


@query(f"""WITH {MSGS} SELECT topic, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS count, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts FROM msgs GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    from stratawave.streaming.source import source_pipeline

    w = source_pipeline(messages(spark, sf_dir)).event_windows("1 hour")
    return w.select("topic", F.unix_timestamp("window.start").alias("window_start"), "count", r6("first_ts").alias("first_ts"), r6("last_ts").alias("last_ts"))


# ---- fixes and trajectories

FIX = """fixes AS (
  SELECT source_uri AS topic, row_number() OVER (PARTITION BY source_uri ORDER BY "timestamp", nav_id) - 1 AS seq, "timestamp" AS ts, nav_id, data[1] AS lat, data[2] AS lon, data[3] AS alt, status
  FROM (SELECT DISTINCT nav_id, source_uri, "timestamp", data, status FROM navsensor WHERE "timestamp" IS NOT NULL AND len(data) = 3 AND abs(data[1]) <= 90 AND abs(data[2]) <= 180))"""


def fixes(spark, sf_dir):
    n = table(spark, sf_dir, "navsensor").filter(finite(F.col("timestamp")) & (F.size("data") == 3))
    n = n.filter((F.abs(F.get("data", F.lit(0))) <= 90) & (F.abs(F.get("data", F.lit(1))) <= 180))
    n = n.select("nav_id", F.col("source_uri").alias("topic"), F.col("timestamp").alias("ts"), "data", "status").distinct()
    return o.positions(n, ["topic"], ["ts", "nav_id"], "seq")


@query(f"""WITH {FIX} SELECT nav_id, round(radians(lon - 8) * 6378137 * cos(radians(50)), 3) AS e, round(radians(lat - 50) * 6378137, 3) AS n, round(alt - 100, 3) AS u FROM fixes""")
def navsat_to_enu(spark, sf_dir):
    e = geodesy.navsat_to_enu(*v.unpack("data", 3), 50.0, 8.0, 100.0)
    return fixes(spark, sf_dir).select("nav_id", *(r6(x, 3).alias(n) for x, n in zip(e, "enu")))


@query(f"WITH {FIX} SELECT nav_id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 4) AS alt FROM fixes")
def navsat_round_trip(spark, sf_dir):
    ned = geodesy.navsat_to_ned(*v.unpack("data", 3), 50.0, 8.0, 100.0)
    back = geodesy.local_to_navsat(ned, 50.0, 8.0, 100.0, "ned")
    return fixes(spark, sf_dir).select("nav_id", r6(back[0], 7).alias("lat"), r6(back[1], 7).alias("lon"), r6(back[2], 4).alias("alt"))


@query(f"""WITH {FIX}, r AS (SELECT topic, min_by(lat, seq) AS lat0, min_by(lon, seq) AS lon0, min_by(alt, seq) AS alt0 FROM fixes GROUP BY 1)
SELECT nav_id, round(radians(lat - lat0) * 6378137, 3) AS n, round(radians(lon - lon0) * 6378137 * cos(radians(lat0)), 3) AS e, round(alt0 - alt, 3) AS d FROM fixes JOIN r USING (topic)""")
def navsat_to_local(spark, sf_dir):
    t = trajectory.navsat_to_local(fixes(spark, sf_dir), frame="ned")
    return t.select("nav_id", *(r6(F.get("local", F.lit(i)), 3).alias(n) for i, n in enumerate("ned")))


@query(f"WITH {FIX} SELECT nav_id FROM fixes WHERE lat BETWEEN -40 AND 55 AND (lon >= 100 OR lon <= -100)")
def geographic_bounds(spark, sf_dir):
    return masks.crop_geographic_bounds(fixes(spark, sf_dir), "data", -40, 100, 55, -100).select("nav_id")


@query(f"WITH {FIX} SELECT nav_id FROM fixes WHERE lat BETWEEN -40 AND 55 AND lon BETWEEN -100 AND 60")
def dataset_geographic_bounds(spark, sf_dir):
    return Dataset(fixes(spark, sf_dir).withColumn("shape", F.array(F.lit(3)))).geographic_bounds(-40, -100, 55, 60).df.select("nav_id")


@query(f"WITH {FIX} SELECT nav_id, coalesce(status IN (0, 1, 2), false) AS good FROM fixes")
def quality_mask(spark, sf_dir):
    t = fixes(spark, sf_dir).withColumnRenamed("data", "position")
    return t.select("nav_id", trajectory.trajectory_quality_mask(t, ["position"], valid_statuses=[0, 1, 2]).alias("good"))


@query(f"WITH {FIX}, f AS (SELECT topic, min_by(ts, seq) AS t0 FROM fixes GROUP BY 1) SELECT nav_id, round((ts - t0) * 0.25, 3) AS c0, round((ts - t0) * 0.5, 3) AS c1 FROM fixes JOIN f USING (topic)")
def propagate_covariance(spark, sf_dir):
    t = fixes(spark, sf_dir).withColumn("position_covariance", trajectory.nan3())
    out = trajectory.propagate_trajectory_covariance(t, {"position": [0.25, 0.5, 1.0]})
    return out.select("nav_id", r6(F.get("position_covariance", F.lit(0)), 3).alias("c0"), r6(F.get("position_covariance", F.lit(1)), 3).alias("c1"))


XY = f"""{FIX}, r AS (SELECT topic, min_by(lat, seq) AS lat0, min_by(lon, seq) AS lon0, min_by(alt, seq) AS alt0 FROM fixes GROUP BY 1),
p AS (SELECT topic, seq, ts, radians(lon - lon0) * 6378137 * cos(radians(lat0)) AS x, radians(lat - lat0) * 6378137 AS y, alt - alt0 AS z FROM fixes JOIN r USING (topic))"""


@query(f"""WITH {XY}, c AS (
  SELECT a.topic, a.seq AS source_index, b.seq AS target_index, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM p a JOIN p b ON a.topic = b.topic AND b.seq <= a.seq - 100 AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30),
k AS (SELECT *, row_number() OVER (PARTITION BY topic, source_index ORDER BY sqrt(d2), target_index) AS k FROM c WHERE d2 <= 900)
SELECT topic, source_index, target_index, round(sqrt(d2), 4) AS pose_distance FROM k WHERE k <= 2""")
def loop_closures(spark, sf_dir):
    t = trajectory.navsat_to_local(fixes(spark, sf_dir)).withColumn("position", F.col("local"))
    return points.iter_loop_closure_candidates(t, 30.0, 100, 2).select("topic", "source_index", "target_index", r6("pose_distance", 4).alias("pose_distance"))


VELOCITY = f"""{XY}, near AS (SELECT *, lag(ts) OVER w AS pt, lead(ts) OVER w AS nt, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY topic ORDER BY seq)),
h AS (SELECT *, ts - pt AS hs, nt - ts AS hd, coalesce(pt = ts, false) OR coalesce(nt = ts, false) AS level FROM near),
vel AS (SELECT topic, seq, ts, x, y, CASE WHEN level THEN NULL WHEN pt IS NULL THEN (nx - x) / hd WHEN nt IS NULL THEN (x - px) / hs ELSE (hs * hs * nx + (hd * hd - hs * hs) * x - hd * hd * px) / (hs * hd * (hs + hd)) END AS vx,
  CASE WHEN level THEN NULL WHEN pt IS NULL THEN (ny - y) / hd WHEN nt IS NULL THEN (y - py) / hs ELSE (hs * hs * ny + (hd * hd - hs * hs) * y - hd * hd * py) / (hs * hd * (hs + hd)) END AS vy FROM h)"""
AT_MINUTES = """e AS (SELECT topic, min_by(ts, seq) AS first, max_by(ts, seq) AS last FROM vel GROUP BY 1),
grid AS (SELECT topic, unnest(range(CAST(floor((last - first) / 60 + 1e-12) AS BIGINT) + 1)) AS seq, first FROM e), g AS (SELECT topic, seq, first + seq * 60 AS ts FROM grid),
once AS (SELECT topic, ts, min_by(x, seq) AS x, min_by(y, seq) AS y, min_by(vx, seq) AS vx, max_by(x, seq) AS lx, max_by(y, seq) AS ly, CASE WHEN count(*) = 1 THEN min(vx) END AS lvx FROM vel GROUP BY 1, 2),
hit AS (SELECT g.topic, g.seq, g.ts, b.ts AS bt, b.lx AS bx, b.ly AS below, b.lvx AS bv, f.ts AS ft, f.x AS fx, f.y AS fy, f.vx AS fv FROM g ASOF LEFT JOIN once b ON g.topic = b.topic AND g.ts > b.ts ASOF LEFT JOIN once f ON g.topic = f.topic AND g.ts <= f.ts),
mixed AS (SELECT *, CASE WHEN ft IS NULL THEN 0.0 WHEN bt IS NULL OR ft = ts THEN 1.0 ELSE (ts - bt) / (ft - bt) END AS s FROM hit)""".replace('\\"', '"')


def number(x, digits):
    """Rounded, and null where it is not a number."""
    return F.when(~F.isnan(x), F.round(x, digits))


@query(f"""WITH {VELOCITY}, {AT_MINUTES}
SELECT topic, seq, round(CASE WHEN s = 0 THEN bx WHEN s = 1 THEN fx ELSE bx + (fx - bx) * s END, 3) AS x, round(CASE WHEN s = 0 THEN below WHEN s = 1 THEN fy ELSE below + (fy - below) * s END, 3) AS y,
  round(CASE WHEN s = 0 THEN bv WHEN s = 1 THEN fv ELSE bv + (fv - bv) * s END, 4) AS vx, CAST(1 AS DOUBLE) AS qw FROM mixed""")
def navsat_trajectory(spark, sf_dir):
    t = trajectory.navsat_to_trajectory(fixes(spark, sf_dir))
    r = trajectory.resample_trajectory(t, period=60.0)
    e = lambda c, i: F.get(c, F.lit(i))
    return r.select("topic", "seq", r6(e("position", 0), 3).alias("x"), r6(e("position", 1), 3).alias("y"), number(e("linear_velocity", 0), 4).alias("vx"), e("orientation", 3).alias("qw"))


@query(f"""WITH {FIX}, f AS (SELECT topic, ts, min(seq) AS s FROM fixes GROUP BY 1, 2), r AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY ts) - 1 AS seq, ts, sin(s * 0.05) * 0.01 AS w FROM f),
n AS (SELECT *, coalesce(0.5 * (w + lag(w) OVER t) * (ts - lag(ts) OVER t), 0) AS turn, coalesce(ts - lag(ts) OVER t, 0) AS dt FROM r WINDOW t AS (PARTITION BY topic ORDER BY seq)),
a AS (SELECT *, sum(turn) OVER (PARTITION BY topic ORDER BY seq) AS yaw FROM n), c AS (SELECT *, cos(yaw) AS vx, sin(yaw) AS vy FROM a),
d AS (SELECT *, coalesce(0.5 * (vx + lag(vx) OVER t) * dt, 0) AS dx, coalesce(0.5 * (vy + lag(vy) OVER t) * dt, 0) AS dy FROM c WINDOW t AS (PARTITION BY topic ORDER BY seq))
SELECT topic, seq, round(sum(dx) OVER t, 3) AS x, round(sum(dy) OVER t, 3) AS y, round(vx, 6) AS c, round(vy, 6) AS s FROM d WINDOW t AS (PARTITION BY topic ORDER BY seq)""")
def dead_reckoning(spark, sf_dir):
    e = lambda c, i: F.get(c, F.lit(i))
    z, w = e("orientation", 2), e("orientation", 3)
    r = trajectory.dead_reckon_trajectory(turning_fixes(spark, sf_dir), body_frame_velocity=True)
    return r.select("topic", "seq", r6(e("position", 0), 3).alias("x"), r6(e("position", 1), 3).alias("y"), r6(w * w - z * z).alias("c"), r6(2 * z * w).alias("s"))


def turning_fixes(spark, sf_dir):
    """One fix for each time, moving ahead by 1 m/s and turning about the vertical axis at a changing rate."""
    t = fixes(spark, sf_dir).groupBy("topic", "ts").agg(F.min("seq").alias("first"))
    placed = o.positions(t, ["topic"], ["ts"], "seq")
    rate = F.array(F.lit(0.0), F.lit(0.0), F.sin(F.col("first") * 0.05) * 0.01)
    return placed.select("topic", "seq", "ts", F.array(*map(F.lit, (1.0, 0.0, 0.0))).alias("linear_velocity"), rate.alias("angular_velocity"), F.array_repeat(F.lit(0.0), 3).alias("position"), trajectory.identity().alias("orientation"))


# ---- rotations, transforms, cameras, boxes

E4 = "emb AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS w, CAST(embedding[5] AS DOUBLE) AS a, CAST(embedding[6] AS DOUBLE) AS b, CAST(embedding[7] AS DOUBLE) AS c, label FROM embeddings)"
UNIT = f"{E4}, q AS (SELECT vec_id, a, b, c, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM emb))"


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(f"""WITH {UNIT} SELECT vec_id, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) AS roll, round(asin(greatest(-1, least(1, 2 * (w * y - z * x)))), 6) AS pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) AS yaw FROM q""")
def quaternion_to_euler(spark, sf_dir):
    e = q.quaternion_to_euler("e")
    return vecs(spark, sf_dir).select("vec_id", *(r6(x).alias(n) for x, n in zip(e, ("roll", "pitch", "yaw"))))


@query(f"WITH {UNIT} SELECT vec_id, round(x * s, 6) AS x, round(y * s, 6) AS y, round(z * s, 6) AS z, round(w * s, 6) AS w FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS s FROM q)")
def euler_round_trip(spark, sf_dir):
    back = q.euler_to_quaternion(*q.quaternion_to_euler("e"))
    sign = F.when(back[3] < 0, -1).otherwise(1)
    return vecs(spark, sf_dir).select("vec_id", *(r6(x * sign).alias(n) for x, n in zip(back, "xyzw")))


TURN = """round((1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c, 6) AS tx, round(2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c, 6) AS ty,
round(2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c, 6) AS tz"""


@query(f"WITH {UNIT} SELECT vec_id, {TURN} FROM q")
def rotate_vectors(spark, sf_dir):
    turned = q.rotate_vectors_by_quaternion(v.unpack("e", 3, 4), v.unpack("e", 4))
    return vecs(spark, sf_dir).select("vec_id", *(r6(x).alias(f"t{n}") for x, n in zip(turned, "xyz")))


@query(f"""WITH {UNIT} SELECT vec_id, round(a - 9.80665 * 2 * (x * z - w * y), 6) AS ax, round(b - 9.80665 * 2 * (y * z + w * x), 6) AS ay, round(c - 9.80665 * (1 - 2 * (x * x + y * y)), 6) AS az FROM q""")
def compensate_gravity(spark, sf_dir):
    out = q.compensate_gravity(v.unpack("e", 3, 4), v.unpack("e", 4))
    return vecs(spark, sf_dir).select("vec_id", *(r6(x).alias(f"a{n}") for x, n in zip(out, "xyz")))


@query(f"""WITH {UNIT}, o AS (SELECT q.vec_id, q.x AS x0, q.y AS y0, q.z AS z0, q.w AS w0, p.x AS x1, p.y AS y1, p.z AS z1, p.w AS w1 FROM q JOIN (SELECT vec_id, x, y, z, w FROM q WHERE vec_id = 0) p ON true),
d AS (SELECT *, x0 * x1 + y0 * y1 + z0 * z1 + w0 * w1 AS d FROM o), s AS (SELECT *, CASE WHEN d < 0 THEN -1 ELSE 1 END AS sg, acos(least(1, abs(d))) AS t FROM d),
k AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 0.7 ELSE sin(0.7 * t) / sin(t) END AS ka, sg * CASE WHEN abs(d) > 0.9995 THEN 0.3 ELSE sin(0.3 * t) / sin(t) END AS kb FROM s),
m AS (SELECT vec_id, x0 * ka + x1 * kb AS x, y0 * ka + y1 * kb AS y, z0 * ka + z1 * kb AS z, w0 * ka + w1 * kb AS w FROM k)
SELECT vec_id, round(x / n, 6) AS x, round(y / n, 6) AS y, round(z / n, 6) AS z, round(w / n, 6) AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM m)""")
def slerp(spark, sf_dir):
    e = vecs(spark, sf_dir)
    first = e.filter("vec_id = 0").select(F.col("e").alias("f"))  # one row
    s = q.slerp(v.unpack("e", 4), v.unpack("f", 4), 0.3)
    return e.crossJoin(F.broadcast(first)).select("vec_id", *(r6(x).alias(n) for x, n in zip(s, "xyzw")))


ROTATION = [[0.0, -1.0, 0.0, 0.5], [1.0, 0.0, 0.0, -0.25], [0.0, 0.0, 1.0, 2.0]]


@query(f"WITH {E4} SELECT vec_id, round(0.5 - y, 6) AS x, round(x - 0.25, 6) AS y, round(z + 2, 6) AS z FROM emb")
def apply_transform(spark, sf_dir):
    t = transforms.apply_transform("e", ROTATION)
    return vecs(spark, sf_dir).select("vec_id", *(r6(F.get(t, F.lit(i))).alias(n) for i, n in enumerate("xyz")))


@query(f"WITH {E4} SELECT vec_id, round(-b, 6) AS x, round(a, 6) AS y, round(c + 1, 6) AS z FROM emb")
def frame_graph(spark, sf_dir):
    g = transforms.FrameGraph().add_transform("lidar", "base", [[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0.5]]).add_transform("base", "map", [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.5]])
    t = g.transform_points(F.slice("e", 5, 3), "lidar", "map")
    return vecs(spark, sf_dir).select("vec_id", *(r6(F.get(t, F.lit(i))).alias(n) for i, n in enumerate("xyz")))


@query(f"WITH {E4} SELECT vec_id FROM emb WHERE x BETWEEN -0.05 AND 0.1 AND y >= -0.1")
def bounds(spark, sf_dir):
    return masks.crop_bounds(vecs(spark, sf_dir), "e", (-0.05, -0.1), (0.1, 9.0)).select("vec_id")


@query(f"WITH {E4}, d AS (SELECT vec_id, x - 0.01 AS x, y AS y, z AS z FROM emb) SELECT vec_id FROM d WHERE abs(x * sqrt(0.5) + y * sqrt(0.5)) <= 0.1 AND abs(-x * sqrt(0.5) + y * sqrt(0.5)) <= 0.05 AND abs(z) <= 0.15")
def oriented_bounds(spark, sf_dir):
    s = math.sqrt(0.5)
    return masks.crop_oriented_bounds(vecs(spark, sf_dir), "e", (0.01, 0, 0), (0.2, 0.1, 0.3), [[s, -s, 0], [s, s, 0], [0, 0, 1]]).select("vec_id")


PINHOLE = "fx=100.0, fy=120.0, cx=32.0, cy=24.0"
SEEN = f"{E4}, s AS (SELECT vec_id, 100 * x / (z + 0.3) + 32 AS u, 120 * y / (z + 0.3) + 24 AS v, z + 0.3 AS depth FROM emb WHERE z + 0.3 > 0), ok AS (SELECT * FROM s WHERE u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 47)"
LIFT = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.3]]


@query(f"WITH {SEEN} SELECT vec_id, round(u, 5) AS u, round(v, 5) AS v, round(depth, 6) AS depth FROM ok")
def project_points(spark, sf_dir):
    at = camera.project_points_to_image("e", 100.0, 120.0, 32.0, 24.0, (48, 64), LIFT)
    return vecs(spark, sf_dir).select("vec_id", at.alias("at")).filter("at.valid").select("vec_id", r6("at.u", 5).alias("u"), r6("at.v", 5).alias("v"), r6("at.depth").alias("depth"))


@query(f"""WITH {E4}, r AS (SELECT vec_id, x, y, x * x + y * y AS r2 FROM emb), d AS (SELECT vec_id, 1 + r2 * (0.1 + r2 * (-0.05 + r2 * 0.01)) AS k, x, y, r2 FROM r)
SELECT vec_id, round(x * k + 2 * 0.001 * x * y + 0.002 * (r2 + 2 * x * x), 6) AS x, round(y * k + 0.001 * (r2 + 2 * y * y) + 2 * 0.002 * x * y, 6) AS y FROM d""")
def distort_points(spark, sf_dir):
    d = camera.distort_normalized_points(v.unpack("e", 2), (0.1, -0.05, 0.001, 0.002, 0.01))
    return vecs(spark, sf_dir).select("vec_id", r6(d[0]).alias("x"), r6(d[1]).alias("y"))


@query(f"WITH {E4} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM emb")
def undistort_round_trip(spark, sf_dir):
    k = (0.1, -0.05, 0.001, 0.002, 0.01)
    u = camera.undistort_normalized_points(camera.distort_normalized_points(v.unpack("e", 2), k), k, 20)
    return vecs(spark, sf_dir).select("vec_id", r6(u[0]).alias("x"), r6(u[1]).alias("y"))


@query(f"""WITH {SEEN}, z AS (SELECT CAST(round_even(v, 0) AS INT) AS row, CAST(round_even(u, 0) AS INT) AS col, min(depth) AS z, arg_min(vec_id, depth) AS pid FROM s WHERE round_even(u, 0) BETWEEN 0 AND 63 AND round_even(v, 0) BETWEEN 0 AND 47 GROUP BY 1, 2),
g AS (SELECT CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM range(48 * 64) t(i)) SELECT row, col, round(coalesce(z, 0), 6) AS z, coalesce(pid, -1) AS pid FROM g LEFT JOIN z USING (row, col)""")
def depth_image(spark, sf_dir):
    p = cloud(spark, sf_dir)
    return image.points_to_depth_image(p, (48, 64), 100.0, 120.0, 32.0, 24.0, LIFT).select("row", "col", r6("z").alias("z"), "pid")


# ---- point clouds

def cloud(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")), "label")


DIST = f"{E4}, d AS (SELECT p.vec_id AS qid, e.vec_id AS pid, sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y) + (p.z - e.z) * (p.z - e.z)) AS distance FROM emb p CROSS JOIN emb e)"
KNN = f"{DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) - 1 AS rank FROM d)"


@query(f"WITH {E4} SELECT CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS count FROM emb GROUP BY 1, 2, 3")
def voxel_downsample(spark, sf_dir):
    return points.voxel_downsample(cloud(spark, sf_dir), 0.1).select("vx", "vy", "vz", *(r6(c).alias(c) for c in "xyz"), "count")


@query(f"WITH {E4} SELECT vec_id AS pid FROM emb WHERE vec_id >= 3 AND (vec_id - 3) % 7 = 0")
def uniform_downsample(spark, sf_dir):
    return points.uniform_downsample(cloud(spark, sf_dir), 7, 3).select("pid")


@query(f"WITH {KNN} SELECT qid, pid, rank, round(distance, 6) AS distance FROM k WHERE rank < 4")
def knn_search(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return points.knn_search(c, c, 4).select("qid", "pid", F.col("rank").cast("long").alias("rank"), r6("distance").alias("distance"))


@query(f"WITH {DIST} SELECT qid, count(*) AS n, min(pid) AS first, max(pid) AS last FROM d WHERE distance <= 0.05 GROUP BY 1")
def radius_search(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return points.radius_search(c, c, 0.05).select("qid", F.size("neighbors").cast("long").alias("n"), F.array_min("neighbors").alias("first"), F.array_max("neighbors").alias("last"))


@query(f"WITH {KNN} SELECT qid, pid, rank, round(distance, 6) AS distance FROM k WHERE rank < 3 AND distance <= 0.05")
def hybrid_search(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return points.hybrid_search(c, c, 0.05, 3).select("qid", "pid", F.col("rank").cast("long").alias("rank"), r6("distance").alias("distance"))


@query(f"WITH {KNN} SELECT round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, round(min(distance), 6) AS min, round(max(distance), 6) AS max FROM k WHERE rank BETWEEN 1 AND 2")
def neighbor_distance_stats(spark, sf_dir):
    return points.nearest_neighbor_distance_stats(cloud(spark, sf_dir), 2).select(*(r6(c).alias(c) for c in ("mean", "std", "min", "max")))


@query(f"WITH {KNN}, n AS (SELECT qid, e.x, e.y, e.z FROM k JOIN emb e ON e.vec_id = k.pid WHERE rank < 6) SELECT qid AS pid, round(covar_samp(x, x), 8) AS xx, round(covar_samp(x, y), 8) AS xy, round(covar_samp(z, z), 8) AS zz FROM n GROUP BY 1")
def local_covariances(spark, sf_dir):
    c = points.local_covariances(cloud(spark, sf_dir), 6)
    return c.select("pid", *(r6(F.get("covariance", F.lit(i)), 8).alias(n) for i, n in ((0, "xx"), (1, "xy"), (8, "zz"))))


@query(f"WITH {KNN}, m AS (SELECT qid, avg(distance) AS d FROM k WHERE rank BETWEEN 1 AND 5 GROUP BY 1) SELECT qid AS pid FROM m WHERE d <= (SELECT avg(d) + 1.5 * stddev_pop(d) FROM m)")
def statistical_outliers(spark, sf_dir):
    return points.statistical_outlier_filter(cloud(spark, sf_dir), 5, 1.5).select("pid")


@query(f"WITH {DIST} SELECT qid AS pid FROM d WHERE distance <= 0.05 GROUP BY 1 HAVING count(*) - 1 >= 2")
def radius_outliers(spark, sf_dir):
    return points.radius_outlier_filter(cloud(spark, sf_dir), 0.05, 2).select("pid")


REACH = """WITH RECURSIVE emb AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS MATERIALIZED (SELECT p.vec_id AS a, e.vec_id AS b FROM emb p JOIN emb e ON (p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y) + (p.z - e.z) * (p.z - e.z) <= {r} * {r}),
core AS MATERIALIZED (SELECT a FROM d GROUP BY 1 HAVING count(*) >= {least}), link AS MATERIALIZED (SELECT d.a, d.b FROM d SEMI JOIN core ON d.a = core.a SEMI JOIN core c ON d.b = c.a),
walk AS (SELECT a, a AS b FROM core UNION SELECT w.a, l.b FROM walk w JOIN link l ON w.b = l.a), root AS (SELECT b AS pid, min(a) AS root FROM walk GROUP BY 1)"""


@query(REACH.format(r=0.03, least=1) + ", s AS (SELECT root, count(*) AS size FROM root GROUP BY 1), n AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS label FROM s WHERE size >= 2) SELECT pid, coalesce(label, -1) AS label, size FROM root JOIN s USING (root) LEFT JOIN n USING (root)")
def connected_components(spark, sf_dir):
    return points.connected_components(cloud(spark, sf_dir), 0.03, 2).select("pid", "label", "size")


@query(REACH.format(r=0.04, least=3) + ", n AS (SELECT pid, dense_rank() OVER (ORDER BY root) - 1 AS label FROM root), near AS (SELECT d.b AS pid, min(n.label) AS label FROM d JOIN n ON d.a = n.pid GROUP BY 1) SELECT e.vec_id AS pid, coalesce(n.label, near.label, -1) AS label FROM emb e LEFT JOIN n ON e.vec_id = n.pid LEFT JOIN near ON e.vec_id = near.pid")
def dbscan(spark, sf_dir):
    return points.cluster_dbscan(cloud(spark, sf_dir), 0.04, 3).select("pid", "label")


@query(f"""WITH {E4}, s AS (SELECT count(*) AS n, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz, avg(2 * x + 1) AS tx, avg(2 * y + 1) AS ty, avg(2 * z + 1 + a) AS tz, avg(x * x + y * y + z * z) AS ss, avg(x * (2 * x + 1) + y * (2 * y + 1) + z * (2 * z + 1 + a)) AS st FROM emb)
SELECT round((st - sx * tx - sy * ty - sz * tz) / (ss - sx * sx - sy * sy - sz * sz), 6) AS scale, n AS correspondence_count FROM s""")
def metric_scale(spark, sf_dir):
    c = cloud(spark, sf_dir)
    e = vecs(spark, sf_dir)
    other = e.select(F.col("vec_id").alias("pid"), *((2 * F.get("e", F.lit(i)) + 1 + (F.get("e", F.lit(4)) if i == 2 else 0)).alias(n) for i, n in enumerate("xyz")))
    return points.calibrate_point_cloud_metric_scale(c, other).select(r6("scale").alias("scale"), "correspondence_count")


@query(f"WITH {E4} SELECT vec_id AS pid, round(x * (2 * (-z) + 0.1) / (-z), 5) AS x, round(-(2 * (-z) + 0.1), 6) AS z FROM emb WHERE -z > 0 AND 2 * (-z) + 0.1 BETWEEN 0.1 AND 0.4")
def depth_anything(spark, sf_dir):
    return points.calibrate_depth_anything_point_cloud(cloud(spark, sf_dir), 2.0, 0.1, 0.1, 0.4).select("pid", r6("x", 5).alias("x"), r6("z").alias("z"))


# ---- elevation rasters

DEM = "dem AS (SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CAST(p_retailprice AS DOUBLE) + p_size * 3.0 AS z FROM part), h AS (SELECT max(row) AS rr, max(col) AS cc FROM dem)"
GRAD = f"""{DEM}, n AS (SELECT *, lag(z) OVER r AS w, lead(z) OVER r AS e, lag(z) OVER c AS s, lead(z) OVER c AS n FROM dem WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)),
g AS (SELECT row, col, z, CASE WHEN w IS NULL THEN e - z WHEN e IS NULL THEN z - w ELSE (e - w) / 2 END / 30 AS dx, CASE WHEN s IS NULL THEN n - z WHEN n IS NULL THEN z - s ELSE (n - s) / 2 END / 30 AS dy FROM n)"""


def dem(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("part").alias("raster"), F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), (F.col("p_retailprice").cast("double") + F.col("p_size") * 3.0).alias("z"))


@query(f"WITH {GRAD} SELECT row, col, round(dx, 6) AS dz_dx, round(dy, 6) AS dz_dy FROM g")
def terrain_gradients(spark, sf_dir):
    return raster.terrain_gradients(dem(spark, sf_dir), 30.0).select("row", "col", r6("dz_dx").alias("dz_dx"), r6("dz_dy").alias("dz_dy"))


@query(f"WITH {GRAD} SELECT row, col, round(atan(sqrt(dx * dx + dy * dy)), 6) AS slope, round(atan2(-dx, -dy), 6) AS aspect FROM g")
def slope_aspect(spark, sf_dir):
    return raster.slope_aspect(dem(spark, sf_dir), 30.0).select("row", "col", r6("slope").alias("slope"), r6("aspect").alias("aspect"))


@query(f"WITH {GRAD}, s AS (SELECT *, atan(sqrt(dx * dx + dy * dy)) AS sl, atan2(-dx, -dy) AS a FROM g) SELECT row, col, round(greatest(0, least(1, sin(radians(45)) * cos(sl) + cos(radians(45)) * sin(sl) * cos(radians(315) - a))), 6) AS shade FROM s")
def hillshade(spark, sf_dir):
    return raster.hillshade(dem(spark, sf_dir), resolution=30.0).select("row", "col", r6("shade").alias("shade"))


@query(f"WITH {GRAD} SELECT row, col, round(-dx / sqrt(dx * dx + dy * dy + 1), 6) AS nx, round(1 / sqrt(dx * dx + dy * dy + 1), 6) AS nz FROM g")
def terrain_normals(spark, sf_dir):
    return raster.terrain_normals(dem(spark, sf_dir), 30.0).select("row", "col", r6(F.get("normal", F.lit(0))).alias("nx"), r6(F.get("normal", F.lit(2))).alias("nz"))


ROUGH = f"{DEM}, k AS (SELECT unnest(range(-1, 2)) AS k), near AS (SELECT d.row, d.col, y.z FROM dem d CROSS JOIN h CROSS JOIN k a CROSS JOIN k b JOIN dem y ON y.row = least(greatest(d.row + a.k, 0), rr) AND y.col = least(greatest(d.col + b.k, 0), cc))"


@query(f"WITH {ROUGH} SELECT row, col, round(stddev_pop(z), 4) AS roughness FROM near GROUP BY 1, 2")
def roughness(spark, sf_dir):
    return raster.roughness_map(dem(spark, sf_dir), 3).select("row", "col", r6("roughness", 4).alias("roughness"))


@query(f"WITH {GRAD} SELECT row, col, round(1 - least(1, atan(sqrt(dx * dx + dy * dy)) / radians(60)), 6) AS score FROM g")
def traversability(spark, sf_dir):
    return raster.traversability_map(dem(spark, sf_dir), 30.0, 60.0).select("row", "col", r6("score").alias("score"))


@query(f"""WITH {DEM}, q AS (SELECT vec_id, greatest(0, least(rr, (CAST(embedding[1] AS DOUBLE) + 0.2) * 60)) AS r, greatest(0, least(cc, (CAST(embedding[2] AS DOUBLE) + 0.2) * 80)) AS c, rr, cc FROM embeddings, h),
k AS (SELECT *, CAST(floor(r) AS INT) AS r0, CAST(floor(c) AS INT) AS c0 FROM q), m AS (SELECT *, least(r0 + 1, rr) AS r1, least(c0 + 1, cc) AS c1, r - r0 AS fr, c - c0 AS fc FROM k)
SELECT vec_id, round((1 - fr) * ((1 - fc) * a.z + fc * b.z) + fr * ((1 - fc) * c2.z + fc * d.z), 4) AS sample FROM m JOIN dem a ON a.row = r0 AND a.col = c0 JOIN dem b ON b.row = r0 AND b.col = c1 JOIN dem c2 ON c2.row = r1 AND c2.col = c0 JOIN dem d ON d.row = r1 AND d.col = c1""")
def sample_elevation(spark, sf_dir):
    asked = vecs(spark, sf_dir).select("vec_id", F.lit("part").alias("raster"), ((F.get("e", F.lit(1)) + 0.2) * 80).alias("x"), ((F.get("e", F.lit(0)) + 0.2) * 60).alias("y"))
    return raster.sample_elevation(dem(spark, sf_dir), asked).select("vec_id", r6("sample", 4).alias("sample"))


@query(f"WITH {DEM} SELECT row - 1 AS row, col - 10 AS col, z FROM dem WHERE row BETWEEN 1 AND 2 AND col BETWEEN 10 AND 19")
def crop_raster(spark, sf_dir):
    return raster.crop_raster(dem(spark, sf_dir), 1, 3, 10, 20).select("row", "col", "z")


@query(f"WITH {DEM}, g AS (SELECT CAST(i // 5 AS INT) AS row, CAST(i % 5 AS INT) AS col FROM range(25) t(i)) SELECT g.row, g.col, round(coalesce(z, -1), 6) AS z FROM g LEFT JOIN dem d ON d.row = g.row - 2 AND d.col = g.col + 8")
def terrain_patch(spark, sf_dir):
    return raster.terrain_patch(dem(spark, sf_dir), (10.0, 0.0), 5, fill_value=-1.0).select("row", "col", r6("z").alias("z"))


@query(f"WITH {DEM} SELECT row, col, 5 + col * 30.0 AS x, row * 30.0 AS y, z FROM dem")
def dem_points(spark, sf_dir):
    return raster.dem_to_point_cloud(dem(spark, sf_dir), resolution=30.0, origin=(5.0, 0.0)).select("row", "col", "x", "y", "z")


@query(f"WITH {DEM} SELECT a.row, a.col, 2 AS faces FROM dem a JOIN dem b ON b.row = a.row AND b.col = a.col + 1 JOIN dem c ON c.row = a.row + 1 AND c.col = a.col JOIN dem d ON d.row = a.row + 1 AND d.col = a.col + 1")
def dem_mesh(spark, sf_dir):
    _, faces = raster.dem_to_mesh(dem(spark, sf_dir))
    return faces.groupBy("row", "col").agg(F.count(F.lit(1)).cast("int").alias("faces"))


@query(f"""WITH {DEM}, g AS (SELECT CAST(i // 9 AS INT) AS row, CAST(i % 9 AS INT) AS col, (i // 9) * rr / 4.0 AS r, (i % 9) * cc / 8.0 AS c FROM range(45) t(i), h)
SELECT g.row, g.col, z FROM g JOIN dem d ON d.row = CAST(round_even(r, 0) AS INT) AND d.col = CAST(round_even(c, 0) AS INT)""")
def resample_raster(spark, sf_dir):
    return raster.resample_raster(dem(spark, sf_dir), (5, 9), "nearest").select("row", "col", "z")


@query(f"""WITH {DEM} SELECT CAST(CASE WHEN col < 25 THEN row ELSE row END AS INT) AS row, col, z FROM dem""")
def mosaic_tiles(spark, sf_dir):
    d = dem(spark, sf_dir)
    tiles = d.select(F.concat(F.lit("N10E0"), F.format_string("%02d", F.floor(F.col("col") / 25))).alias("raster"), "row", (F.col("col") % 25).alias("col"), "z")
    return raster.mosaic_dem_tiles(tiles).select("row", "col", "z")


# ---- images and depth

IMG = "px AS (SELECT vec_id AS seq, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS z FROM embeddings, range(1, 65) t(i))"
WINDOWED = f"{IMG}, k AS (SELECT unnest(range(-1, 2)) AS k), near AS (SELECT d.seq, d.row, d.col, a.k AS dr, b.k AS dc, y.z FROM px d CROSS JOIN k a CROSS JOIN k b JOIN px y ON y.seq = d.seq AND y.row = least(greatest(d.row + a.k, 0), 7) AND y.col = least(greatest(d.col + b.k, 0), 7))"


def pictures(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("topic"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("double").alias("ts"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def plane(df, column="data", name="z", digits=6):
    each = df.select("seq", F.element_at("shape", -1).alias("w"), F.posexplode(column).alias("i", "value"))
    return each.select("seq", F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), (F.col("i") % F.col("w")).cast("int").alias("col"), r6("value", digits).alias(name))


@query(f"WITH {IMG}, e AS (SELECT seq, min(z) AS lo, max(z) AS hi FROM px GROUP BY 1) SELECT seq, row, col, round(CAST(CAST((z - lo) / (hi - lo) AS FLOAT) AS DOUBLE), 5) AS z FROM px JOIN e USING (seq)")
def normalize_image(spark, sf_dir):
    return plane(image.normalize_image(pictures(spark, sf_dir)), digits=5)


@query(f"WITH {IMG} SELECT seq, row, col, CASE WHEN z >= 0.05 THEN 1.0 ELSE 0.0 END AS z FROM px")
def threshold_image(spark, sf_dir):
    p = pictures(spark, sf_dir)
    return plane(p.withColumn("data", image.threshold_image(0.05)))


@query(f"WITH {IMG} SELECT seq, row, col, CASE WHEN z >= -0.1 AND z <= 0.1 THEN round(z, 6) ELSE 9.0 END AS z FROM px")
def masked_image(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("mask", image.image_mask(-0.1, 0.1))
    return plane(p.withColumn("data", image.apply_image_mask("data", "mask", 9.0)))


@query(f"WITH {IMG} SELECT seq, row, col, round_even(greatest(0.0, least(1.0, z)) * 255, 0) AS z FROM px")
def image_dtype(spark, sf_dir):
    return plane(image.convert_image_dtype(pictures(spark, sf_dir), "uint8", "float64"))


@query(f"WITH {WINDOWED} SELECT seq, row, col, round(sum(z * dc * (2 - abs(dr))) / 8, 6) AS z FROM near GROUP BY 1, 2, 3")
def sobel(spark, sf_dir):
    return plane(image.image_gradients(pictures(spark, sf_dir)), "dx")


@query(f"WITH {WINDOWED} SELECT seq, row, col, round(stddev_pop(z), 6) AS z FROM near GROUP BY 1, 2, 3")
def local_std(spark, sf_dir):
    return plane(image.local_std(pictures(spark, sf_dir)), "std")


@query(f"WITH {IMG}, k AS (SELECT unnest(range(-1, 2)) AS k), near AS (SELECT d.seq, d.row, d.col, coalesce(y.z, 0) > 0.1 AS m FROM px d CROSS JOIN k a CROSS JOIN k b LEFT JOIN px y ON y.seq = d.seq AND y.row = d.row + a.k AND y.col = d.col + b.k) SELECT seq, row, col, CASE WHEN bool_or(m) THEN 1.0 ELSE 0.0 END AS z FROM near GROUP BY 1, 2, 3")
def dilate(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x > 0.1).cast("double")))
    return plane(image.dilate_mask(p))


@query(f"WITH {IMG}, k AS (SELECT unnest(range(-1, 2)) AS k), near AS (SELECT d.seq, d.row, d.col, coalesce(y.z, -1) > -0.1 AS m FROM px d CROSS JOIN k a CROSS JOIN k b LEFT JOIN px y ON y.seq = d.seq AND y.row = d.row + a.k AND y.col = d.col + b.k) SELECT seq, row, col, CASE WHEN bool_and(m) THEN 1.0 ELSE 0.0 END AS z FROM near GROUP BY 1, 2, 3")
def erode(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x > -0.1).cast("double")))
    return plane(image.erode_mask(p))


@query(f"WITH {IMG}, g AS (SELECT CAST(i // 3 AS INT) AS row, CAST(i % 3 AS INT) AS col FROM range(15) t(i)) SELECT seq, g.row, g.col, round(z, 6) AS z FROM g JOIN px ON px.row = CAST(round_even(g.row * 7 / 4.0, 0) AS INT) AND px.col = CAST(round_even(g.col * 7 / 2.0, 0) AS INT)")
def resize_image(spark, sf_dir):
    return plane(image.resize_images(pictures(spark, sf_dir), (5, 3)))


@query(f"WITH {IMG} SELECT seq, row - 2 AS row, col - 1 AS col, round(z, 6) AS z FROM px WHERE row BETWEEN 2 AND 4 AND col BETWEEN 1 AND 6")
def crop_image(spark, sf_dir):
    return plane(image.crop_image(pictures(spark, sf_dir), 2, 5, 1, 7))


@query(f"WITH {IMG} SELECT seq, row, col, round((col - 3.5) * (z + 0.5) / 10, 6) AS x, round((row - 3.5) * (z + 0.5) / 12, 6) AS y, round(z + 0.5, 6) AS z FROM px WHERE z + 0.5 > 0")
def depth_points(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("data", F.transform("data", lambda x: x + 0.5))
    return image.depth_to_points(p, 10.0, 12.0, 3.5, 3.5).select("seq", "row", "col", *(r6(c).alias(c) for c in "xyz"))


# ---- training samples

@query("""WITH u AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), n AS (SELECT user_id, row_number() OVER (ORDER BY first) - 1 AS i, count(*) OVER () AS n FROM u),
c AS (SELECT *, floor(n * 0.7 + 1e-9) AS a0, floor(n * 0.2 + 1e-9) AS b0, floor(n * 0.1 + 1e-9) AS c0, round(n * 0.7 - floor(n * 0.7 + 1e-9), 9) AS ra, round(n * 0.2 - floor(n * 0.2 + 1e-9), 9) AS rb, round(n * 0.1 - floor(n * 0.1 + 1e-9), 9) AS rc FROM n),
s AS (SELECT *, a0 + CAST(CAST(rb > ra AS INT) + CAST(rc > ra AS INT) < n - a0 - b0 - c0 AS INT) AS ca, b0 + CAST(CAST(ra >= rb AS INT) + CAST(rc > rb AS INT) < n - a0 - b0 - c0 AS INT) AS cb FROM c)
SELECT event_id, CASE WHEN i < ca THEN 'train' WHEN i < ca + cb THEN 'val' ELSE 'test' END AS split FROM events JOIN s USING (user_id)""")
def split_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ml.deterministic_split(e, "event_id", (0.7, 0.2, 0.1), group=F.col("user_id")).select("event_id", "split")


@query(f"WITH {MSGS}, n AS (SELECT *, count(*) OVER (PARTITION BY topic) AS n FROM msgs) SELECT topic, seq, CASE WHEN seq < n * 0.5 THEN 'a' ELSE 'b' END AS half FROM n")
def split_halves(spark, sf_dir):
    return ml.split_topic(messages(spark, sf_dir), "time", (0.5, 0.5), ("a", "b")).select("topic", "seq", F.col("split").alias("half"))


@query("WITH g AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, len(v) AS length, CAST((SELECT max(len(v)) FROM g) AS BIGINT) AS padded, round(list_sum(v), 4) AS total FROM g")
def collate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    c = ml.collate(e, ["v"])
    return c.select("user_id", F.col("v_length").cast("long").alias("length"), F.size("v").cast("long").alias("padded"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# ---- stores, sources, streams

@query(f"WITH {MSGS} SELECT topic, count(*) AS count, true AS closed, max_by(name, seq) AS name FROM msgs GROUP BY 1")
def store_manifest(spark, sf_dir):
    return shared_store(spark, sf_dir).manifest().select("topic", "count", "closed", "name")


@query(f"WITH {MSGS} SELECT {OUT} FROM msgs WHERE topic = 'view' AND a BETWEEN 10 AND 30 AND ts BETWEEN {START} AND {END}")
def store_query(spark, sf_dir):
    return flat(shared_store(spark, sf_dir).topic("view").time_range(START, END).spatial_bounds((10,), (30,), (0,)).df)


def filled_store(spark, sf_dir):
    import uuid

    from stratawave.sources.store import Store

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(messages(spark, sf_dir), closed=True)
    return store


def stream_of(spark, sf_dir):
    """The events as a stream; it reads folders, so the table's one file is told by its name."""
    stored = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(stored).option("pathGlobFilter", "events.parquet*").option("recursiveFileLookup", "true").parquet(sf_dir)
    return raw.select(
        F.col("event_type").alias("topic"), F.lit(0).cast("long").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.format_string("%012d", "event_id").alias("name"), F.lit(None).cast("string").alias("frame_id"),
        F.lit("events").alias("source_uri"), F.lit("float64").alias("dtype"), F.array(F.lit(1)).alias("shape"), F.array("value").alias("data"),
    )


def streamed(spark, sf_dir, build):
    """What ``build`` (pipeline, folder) gives from the store or files a stream wrote into a new folder."""
    import uuid

    from stratawave.streaming.source import source_pipeline

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = cut(build(source_pipeline(stream_of(spark, sf_dir)), base))
    removed(spark, base)
    return found


BY_TIME = "timed AS (SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1 AS i, epoch_us(ts) / 1e6 AS ts, event_id, CAST(value AS DOUBLE) AS a FROM events)"


@query("SELECT event_type AS topic, count(*) AS count, true AS closed, round(min(value), 6) AS least FROM events WHERE value > 10 GROUP BY 1")
def stream_to_store(spark, sf_dir):
    """A stream into a store, and its manifest."""
    from stratawave.sources.store import Store

    def build(pipe, base):
        pipe.filter(F.get("data", F.lit(0)) > 10).to_buffer(f"{base}/store", f"{base}/checkpoint")
        store = Store(spark, f"{base}/store")
        least = store.messages().groupBy("topic").agg(r6(F.min(F.get("data", F.lit(0)))).alias("least"))
        return store.manifest().select("topic", "count", "closed").join(least, "topic")

    return streamed(spark, sf_dir, build)


@query(f"WITH {BY_TIME} SELECT topic, i AS seq, event_id FROM timed WHERE topic IN ('view', 'click') AND i >= 20 AND i < 900 AND (i - 20) % 3 = 0")
def stream_index_range(spark, sf_dir):
    """Positions counted over a stream."""

    def build(pipe, base):
        chosen = pipe.select_topics("view", "click").index_range(20, 900, 3)
        chosen.to_parquet(f"{base}/out", f"{base}/checkpoint")
        rows = spark.read.parquet(f"{base}/out").select("topic", F.col("name").cast("long").alias("event_id"))
        return o.positions(rows, ["topic"], ["event_id"], "at").drop("at").join(places(spark, sf_dir), ["topic", "event_id"])

    return streamed(spark, sf_dir, build)


def places(spark, sf_dir):
    """The place of each event in its topic by time, from the whole table."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "event_id", "ts")
    return o.positions(e, ["topic"], ["ts", "event_id"], "seq").select("topic", "event_id", "seq")


@query("""WITH e AS (SELECT event_type AS topic, epoch_us(ts) AS us, event_id FROM events), v AS (SELECT * FROM e WHERE topic = 'view'), c AS (SELECT * FROM e WHERE topic = 'click'),
last AS (SELECT least((SELECT max(us) FROM v), (SELECT max(us) FROM c)) / 1e6 - 600 AS closed),
j AS (SELECT v.event_id AS name, c.event_id AS target, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(c.us / 1e6 - v.us / 1e6), c.us) AS k FROM v JOIN last ON v.us / 1e6 <= closed JOIN c ON abs(c.us / 1e6 - v.us / 1e6) <= 45) SELECT name, target FROM j WHERE k = 1""")
def stream_pairs(spark, sf_dir):
    """The nearest click to each view over a stream; views of the last ten minutes, which its watermark may leave open, are left out."""

    def build(pipe, base):
        pairs = pipe.nearest_topic_pairs("view", "click", 45.0, "1 minute")
        pairs.select(F.col("reference_name").cast("long").alias("name"), F.col("target_name").cast("long").alias("target"), "reference_ts").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        ends = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')").groupBy("event_type").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last")).agg((F.min("last") - 600).alias("closed"))
        return spark.read.parquet(f"{base}/out").crossJoin(F.broadcast(ends)).filter(F.col("reference_ts") <= F.col("closed")).select("name", "target")  # ends is one row

    return streamed(spark, sf_dir, build)


@query("SELECT event_type AS topic, CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS window_start, count(*) AS count FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Windows of event time over a stream, in update mode, so that the last ones count."""

    def build(pipe, base):
        windows = pipe.event_windows("1 hour")
        write = lambda rows, number: rows.select("topic", F.unix_timestamp("window.start").alias("window_start"), "count", F.lit(number).alias("batch")).write.mode("append").parquet(f"{base}/out")
        windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/out").groupBy("topic", "window_start").agg(F.max_by("count", "batch").alias("count"))

    return streamed(spark, sf_dir, build)


@query(f"WITH {BY_TIME}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY i DESC) AS k FROM timed) SELECT topic, event_id, round(a, 6) AS a FROM k WHERE k <= 4")
def stream_latest(spark, sf_dir):
    """Ring buffers over a stream."""

    def build(pipe, base):
        write = lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")
        pipe.latest(4).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        newest = spark.read.parquet(f"{base}/out").groupBy("topic").agg(F.max_by("rows", "batch").alias("rows"))
        return newest.select("topic", F.explode("rows").alias("r")).select("topic", F.col("r.name").cast("long").alias("event_id"), r6(F.get("r.data", F.lit(0))).alias("a"))

    return streamed(spark, sf_dir, build)


@query(f"WITH {IMG} SELECT seq, min(z) AS min_x, max(z) AS max_x FROM px WHERE col = 0 GROUP BY 1")
def payload_bounds(spark, sf_dir):
    b = pictures(spark, sf_dir).withColumn("box", spatial_bounds_for_data())
    return b.select("seq", "box.min_x", "box.max_x")


@query(f"""WITH emb AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings), p AS (SELECT vec_id AS seq, i AS pid, d[3 * i + 1] AS x, d[3 * i + 2] AS y, d[3 * i + 3] AS z FROM emb, range(3) t(i))
SELECT seq, CAST(pid AS INT) AS pid, round(cos(0.1 * seq) * x - sin(0.1 * seq) * y + seq, 5) AS x, round(sin(0.1 * seq) * x + cos(0.1 * seq) * y - 0.5 * seq, 5) AS y, round(z + 2, 5) AS z FROM p""")
def stitched_scans(spark, sf_dir):
    """Scans of three points, each placed by the pose just before it."""
    from stratawave.cli import flagship

    e = vecs(spark, sf_dir)
    i, half = F.col("vec_id"), F.col("vec_id") * 0.05
    common = lambda topic, late: [F.lit(topic).alias("topic"), i.alias("seq"), (i + late).cast("double").alias("ts")]
    scans = e.select(*common("/points", 0.5), F.array(F.lit(3), F.lit(3)).alias("shape"), F.slice("e", 1, 9).alias("data"))
    pose = F.array(i.cast("double"), i * -0.5, F.lit(2.0), *[F.lit(0.0)] * 5, F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))
    poses = e.select(*common("/odom", 0.0), F.array(F.lit(8), F.lit(4)).alias("shape"), F.concat(pose, F.array_repeat(F.lit(0.0), 20)).alias("data"))
    return flagship(scans.unionByName(poses)).select("seq", "pid", *(r6(c, 5).alias(c) for c in "xyz"))


# ---- further rotations, transforms and cameras

S = math.sqrt(0.5)


@query(f"""WITH {UNIT} SELECT vec_id, round(0.5 - b, 6) AS px, round(a - 0.25, 6) AS py, round(c + 2, 6) AS pz, round({S} * (x - y), 6) AS qx, round({S} * (y + x), 6) AS qy, round({S} * (z + w), 6) AS qz, round({S} * (w - z), 6) AS qw FROM q""")
def transform_poses(spark, sf_dir):
    t = transforms.transform_poses(F.concat(F.slice("e", 5, 3), F.slice("e", 1, 4)), ROTATION)
    return vecs(spark, sf_dir).select("vec_id", t.alias("t")).select("vec_id", *(r6(F.get("t", F.lit(i))).alias(n) for i, n in enumerate(("px", "py", "pz", "qx", "qy", "qz", "qw"))))


@query(f"WITH {UNIT} SELECT vec_id, round(1 - 2 * (y * y + z * z), 6) AS m00, round(2 * (x * y - w * z), 6) AS m01, round(a, 6) AS m03, round(1 - 2 * (x * x + y * y), 6) AS m22, 1.0 AS m33 FROM q")
def pose_to_matrix(spark, sf_dir):
    m = transforms.pose_to_matrix(F.concat(F.slice("e", 5, 3), F.slice("e", 1, 4)))
    return vecs(spark, sf_dir).select("vec_id", m.alias("m")).select("vec_id", *(r6(F.get("m", F.lit(i))).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m03"), (10, "m22"), (15, "m33"))))


@query(f"WITH {FIX} SELECT nav_id, round(lat + degrees(20 / 6378137.0), 7) AS lat, round(lon + degrees(10 / (6378137.0 * cos(radians(50)))), 7) AS lon FROM fixes")
def transform_navsat(spark, sf_dir):
    t = transforms.transform_navsat("data", [[1, 0, 0, 10], [0, 1, 0, 20], [0, 0, 1, 0]], 50.0, 8.0)
    return fixes(spark, sf_dir).select("nav_id", t.alias("t")).select("nav_id", r6(F.get("t", F.lit(0)), 7).alias("lat"), r6(F.get("t", F.lit(1)), 7).alias("lon"))


@query(f"WITH {E4} SELECT vec_id, round(a * (c + 1), 6) AS x, round(b * (c + 1) * 100 / 120, 6) AS y, round(c + 1, 6) AS z FROM emb")
def backproject(spark, sf_dir):
    k = camera.camera_matrix(100.0, 120.0, 32.0, 24.0)
    e = lambda i: F.get("e", F.lit(i))
    p = camera.backproject_pixels([e(4) * 100 + 32, e(5) * 100 + 24], e(6) + 1, k)
    return vecs(spark, sf_dir).select("vec_id", *(r6(x).alias(n) for x, n in zip(p, "xyz")))


@query("SELECT CAST(i // 8 AS INT) AS row, CAST(i % 8 AS INT) AS col, round((i % 8 - 4) / 50.0 * 100 + 3.5, 6) AS u, round((i // 8 - 3) / 50.0 * 100 + 2.5, 6) AS v FROM range(48) t(i)")
def rectification_map(spark, sf_dir):
    m = image.rectification_map(spark, (6, 8), [[100, 0, 3.5], [0, 100, 2.5], [0, 0, 1]], new_camera_matrix=[[50, 0, 4], [0, 50, 3], [0, 0, 1]])
    return m.select("row", "col", r6("u").alias("u"), r6("v").alias("v"))


@query("SELECT vec_id, round((x1 - x0 + 1) * (y1 - y0 + 1), 4) AS area, round(99 - x1, 4) AS left FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 + 20 AS x0, CAST(embedding[2] AS DOUBLE) * 10 + 20 AS y0, CAST(embedding[3] AS DOUBLE) * 10 + 50 AS x1, CAST(embedding[4] AS DOUBLE) * 10 + 50 AS y1 FROM embeddings)")
def image_boxes(spark, sf_dir):
    from stratawave.functions import boxes

    b = [F.get("e", F.lit(i)) * 10 + (20 if i < 2 else 50) for i in range(4)]
    return vecs(spark, sf_dir).select("vec_id", r6(boxes.area(b), 4).alias("area"), r6(boxes.transpose(b, 100, 100)[0], 4).alias("left"))


# ---- further trajectories

IMU = "imu AS (SELECT label AS topic, vec_id, list_transform(embedding[1:24], lambda x: CAST(x AS DOUBLE)) AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq FROM embeddings)"


def imu(spark, sf_dir, n=24):
    e = vecs(spark, sf_dir).select(F.col("label").cast("string").alias("topic"), "vec_id", F.col("vec_id").cast("double").alias("ts"), F.slice("e", 1, n).alias("data"))
    return o.positions(e, ["topic"], ["vec_id"], "seq")


@query(f"WITH {IMU} SELECT vec_id, round(d[9] - avg(d[9]) OVER t, 6) AS gx, round(d[19] - avg(d[19]) OVER t, 6) AS az FROM imu WINDOW t AS (PARTITION BY topic)")
def imu_bias(spark, sf_dir):
    c = trajectory.correct_imu_bias(imu(spark, sf_dir))
    return c.select("vec_id", r6(F.get("data", F.lit(8))).alias("gx"), r6(F.get("data", F.lit(18))).alias("az"))


@query(f"WITH {IMU}, q AS (SELECT vec_id, d, d[1] / n AS x, d[2] / n AS y, d[3] / n AS z, d[4] / n AS w FROM (SELECT *, sqrt(d[1] * d[1] + d[2] * d[2] + d[3] * d[3] + d[4] * d[4]) AS n FROM imu)) SELECT vec_id, round(d[17] - 9.80665 * 2 * (x * z - w * y), 6) AS ax, round(d[20], 6) AS kept FROM q")
def imu_gravity(spark, sf_dir):
    c = imu(spark, sf_dir).withColumn("data", q.compensate_imu_gravity("data"))
    return c.select("vec_id", r6(F.get("data", F.lit(16))).alias("ax"), r6(F.get("data", F.lit(19))).alias("kept"))


@query(f"WITH {IMU} SELECT topic::VARCHAR AS topic, seq, round(d[9], 6) AS wx, round(d[17], 6) AS ax, round(d[24 - 1], 6) AS caz, round(d[4] / sqrt(d[1] * d[1] + d[2] * d[2] + d[3] * d[3] + d[4] * d[4]), 6) AS qw FROM imu")
def imu_trajectory(spark, sf_dir):
    t = trajectory.imu_to_trajectory(imu(spark, sf_dir))
    return t.select("topic", "seq", r6(F.get("angular_velocity", F.lit(0))).alias("wx"), r6(F.get("linear_acceleration", F.lit(0))).alias("ax"), r6(F.get("linear_acceleration_covariance", F.lit(2))).alias("caz"), r6(F.get("pose", F.lit(6))).alias("qw"))


@query("WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings) SELECT vec_id, round(d[1], 6) AS px, round(d[17], 6) AS vx, round(d[25], 6) AS wx, round(d[29], 6) AS cw, round(d[9] / sqrt(d[9] * d[9] + d[10] * d[10] + d[11] * d[11] + d[12] * d[12]), 6) AS qx FROM d")
def odometry_trajectory(spark, sf_dir):
    m = imu(spark, sf_dir, 32)
    t = trajectory.odometry_to_trajectory(m).select(F.col("ts").cast("long").alias("vec_id"), "position", "orientation", "linear_velocity", "angular_velocity", "angular_velocity_covariance")
    return t.select("vec_id", *(r6(F.get(c, F.lit(0))).alias(n) for c, n in (("position", "px"), ("linear_velocity", "vx"), ("angular_velocity", "wx"), ("angular_velocity_covariance", "cw"), ("orientation", "qx"))))


def turning(spark, sf_dir):
    half = F.col("seq") * 0.05
    return messages(spark, sf_dir).select("topic", "seq", "ts", F.array(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("orientation"))


@query(f"WITH {NEAR} SELECT topic, seq, round(CASE WHEN hs IS NULL THEN 0.1 / hd WHEN hd IS NULL THEN 0.1 / hs ELSE (0.1 / hs + 0.1 / hd) / 2 END, 8) AS wz FROM h")
def angular_velocity(spark, sf_dir):
    w = trajectory.angular_velocity_from_quaternions(turning(spark, sf_dir), increasing=False)  # as its SQL, over times in any order
    return w.select("topic", "seq", r6(F.get("omega", F.lit(2)), 8).alias("wz"))


@query(f"""WITH {GRID}, n AS (SELECT g.topic, g.seq, g.ts, b.ts AS bt, b.seq AS bs, f.ts AS ft, f.seq AS fs FROM g ASOF LEFT JOIN msgs b ON g.topic = b.topic AND g.ts > b.ts ASOF LEFT JOIN msgs f ON g.topic = f.topic AND g.ts <= f.ts),
y AS (SELECT topic, seq, 0.1 * CASE WHEN ft IS NULL THEN bs WHEN bt IS NULL OR ft = ts THEN fs ELSE bs + (fs - bs) * (ts - bt) / (ft - bt) END AS yaw FROM n) SELECT topic, seq, round(cos(yaw), 6) AS c, round(sin(yaw), 6) AS s FROM y""")
def interpolate_quaternions(spark, sf_dir):
    t = turning(spark, sf_dir)
    at = align.grid(t, 300.0, None, None, ["topic"]).select("topic", "ts", "seq")
    i = trajectory.interpolate_quaternions(t, at)
    z, w = F.get("orientation", F.lit(2)), F.get("orientation", F.lit(3))
    return i.select("topic", "seq", r6(w * w - z * z).alias("c"), r6(2 * z * w).alias("s"))


@query(f"WITH {FIX} SELECT topic, seq, round(lat, 6) AS x, CASE WHEN status IS NOT NULL AND status >= 0 THEN 1.0 ELSE 0.0 END AS qw FROM fixes WHERE status IS NOT NULL AND status >= 0")
def masked_tum(spark, sf_dir):
    t = fixes(spark, sf_dir).withColumnRenamed("data", "position").withColumn("orientation", trajectory.identity())
    kept = trajectory.mask_trajectory(t, F.col("status") >= 0, drop=True)
    return trajectory.to_tum_trajectory(kept).select("topic", "seq", r6("x").alias("x"), "qw")


# ---- further streams

@query(f"""WITH {PAIR} SELECT name, seq, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR ts - bt <= ft - ts) THEN bs ELSE fs END AS target_index FROM (SELECT near.*, r.name FROM near JOIN ref r USING (seq)) WHERE least(coalesce(ft - ts, 1e9), coalesce(ts - bt, 1e9)) <= 45""")
def topic_pairs(spark, sf_dir):
    from stratawave.streaming.source import source_pipeline

    return source_pipeline(messages(spark, sf_dir)).nearest_topic_pairs("view", "click", 45.0).select("name", "seq", "target_index")


@query(f"WITH {MSGS}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq DESC) AS k FROM msgs) SELECT {OUT} FROM k WHERE k <= 3")
def ring_buffer(spark, sf_dir):
    from stratawave.sources.store import DataBuffer

    return flat(DataBuffer(messages(spark, sf_dir), buffer_depth=3).rows())


@query(f"WITH {MSGS} SELECT topic, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seqs, round(sum(a), 3) AS total FROM msgs GROUP BY 1")
def store_compacted(spark, sf_dir):
    store = filled_store(spark, sf_dir)
    store.compact()
    return store.messages().groupBy("topic").agg(F.count(F.lit(1)).alias("rows"), F.sum("seq").alias("seqs"), r6(F.sum(F.get("data", F.lit(0))), 3).alias("total"))


@query("SELECT user_id::VARCHAR AS topic, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS seq, event_id::VARCHAR AS name FROM events")
def arrival_order(spark, sf_dir):
    from stratawave.schema import normalize_messages

    e = table(spark, sf_dir, "events")
    raw = e.select(F.col("user_id").cast("string").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.col("event_id").alias("id"), F.array("value").alias("data"))
    return normalize_messages(raw).select("topic", "seq", "name")


# ---- further points and rasters

@query(f"WITH {E4} SELECT regr_count(3 * x + 1.5 + 0.1 * y, x + 1) AS correspondence_count, round(regr_slope(3 * x + 1.5 + 0.1 * y, x + 1), 6) AS scale, round(regr_intercept(3 * x + 1.5 + 0.1 * y, x + 1), 6) AS offset FROM emb WHERE x + 1 > 0 AND 3 * x + 1.5 + 0.1 * y > 0")
def depth_scale(spark, sf_dir):
    c = cloud(spark, sf_dir).select(F.floor(F.col("pid") / 8).alias("row"), (F.col("pid") % 8).alias("col"), "x", "y")
    d = points.calibrate_depth_metric_scale(c.select("row", "col", (F.col("x") + 1).alias("z")), c.select("row", "col", (3 * F.col("x") + 1.5 + 0.1 * F.col("y")).alias("z")))
    return d.select("correspondence_count", r6("scale").alias("scale"), r6("offset").alias("offset"))


@query(f"WITH {DEM} SELECT row, cc - col AS col, z FROM dem, h")
def reproject_raster(spark, sf_dir):
    d = dem(spark, sf_dir)
    rows = d.agg(F.max("row") + 1).first()[0]
    flip = raster.reproject_raster(d, (0, 0, 49, rows - 1), (rows, 50), transform=[[-1, 0, 49], [0, 1, 0], [0, 0, 1]])
    return flip.select("row", "col", "z")


@query(f"WITH {DEM} SELECT row, col, round(-row * 30.0 + 1, 6) AS x, round(col * 30.0, 6) AS y, round(z + 5, 6) AS z FROM dem")
def transform_dem(spark, sf_dir):
    t = transforms.transform_dem_grid(dem(spark, sf_dir), [[0, -1, 0, 1], [1, 0, 0, 0], [0, 0, 1, 5]], resolution=30.0)
    return t.select("row", "col", *(r6(c).alias(c) for c in "xyz"))


@query(f"WITH {DEM} SELECT row, col, round(10.0 * col * 30 / z + 320, 4) AS u, round(10.0 * row * 30 / z + 240, 4) AS v FROM dem WHERE z > 0")
def project_dem(spark, sf_dir):
    p = image.project_dem_to_image(dem(spark, sf_dir), 10.0, 10.0, 320.0, 240.0, resolution=30.0)
    return p.filter("valid").select("row", "col", r6("u", 4).alias("u"), r6("v", 4).alias("v"))


#: The raster laid over the earth for fixes: south-west corner in metres from (0, 0), and a cell's side, so that 50 columns span all longitudes.
WORLD, WORLD_CELL = (-20037508.0, -10018754.0), 801500.0


@query(f"""WITH {DEM}, {FIX}, p AS (SELECT nav_id, (radians(lon - 0) * 6378137 - {WORLD[0]}) / {WORLD_CELL} AS c, (radians(lat - 0) * 6378137 - {WORLD[1]}) / {WORLD_CELL} AS r FROM fixes),
q AS (SELECT nav_id, greatest(0, least(rr, r)) AS r, greatest(0, least(cc, c)) AS c, rr, cc FROM p, h),
k AS (SELECT *, CAST(floor(r) AS INT) AS r0, CAST(floor(c) AS INT) AS c0 FROM q), m AS (SELECT *, least(r0 + 1, rr) AS r1, least(c0 + 1, cc) AS c1, r - r0 AS fr, c - c0 AS fc FROM k)
SELECT nav_id, round((1 - fr) * ((1 - fc) * a.z + fc * b.z) + fr * ((1 - fc) * c2.z + fc * d.z), 4) AS sample FROM m JOIN dem a ON a.row = r0 AND a.col = c0 JOIN dem b ON b.row = r0 AND b.col = c1 JOIN dem c2 ON c2.row = r1 AND c2.col = c0 JOIN dem d ON d.row = r1 AND d.col = c1""")
def elevation_at_all_fixes(spark, sf_dir):
    asked = fixes(spark, sf_dir).select("nav_id", F.lit("part").alias("raster"), "data")
    return raster.sample_elevation_at_navsat(dem(spark, sf_dir), asked, "data", 0.0, 0.0, resolution=WORLD_CELL, origin=WORLD).select("nav_id", r6("sample", 4).alias("sample"))


# ---- further images

FOUR = "px AS (SELECT vec_id AS seq, CAST((i - 1) // 16 AS INT) AS row, CAST((i - 1) // 4 % 4 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS r, CAST(embedding[i + 1] AS DOUBLE) AS g, CAST(embedding[i + 2] AS DOUBLE) AS b FROM embeddings, range(1, 65, 4) t(i))"


@query(f"WITH {FOUR} SELECT seq, row, col, round(0.299 * b + 0.587 * g + 0.114 * r, 6) AS z FROM px")
def convert_color(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("shape", F.array(*map(F.lit, (4, 4, 4))))
    return plane(image.convert_color(image.convert_color(p, "rgba_to_rgb"), "bgr_to_gray"))


@query(f"WITH {IMG}, g AS (SELECT CAST(i // 4 AS INT) AS row, CAST(i % 4 AS INT) AS col FROM range(16) t(i)) SELECT seq, g.row, g.col, round(z, 6) AS z FROM g JOIN px ON px.row = CAST(round_even(g.row * 7 / 3.0, 0) AS INT) AND px.col = CAST(round_even(g.col * 7 / 3.0, 0) AS INT)")
def image_pyramid(spark, sf_dir):
    return plane(image.image_pyramid(pictures(spark, sf_dir), 3).filter("level = 1"))


@query(f"WITH {IMG}, s AS (SELECT DISTINCT seq FROM px), g AS (SELECT seq, CAST(i // 10 AS INT) AS row, CAST(i % 10 AS INT) AS col FROM s, range(100) t(i)) SELECT g.seq, g.row, g.col, coalesce(round(z, 6), 5) AS z FROM g LEFT JOIN px ON px.seq = g.seq AND px.row = g.row - 1 AND px.col = g.col - 1")
def pad_image(spark, sf_dir):
    return plane(image.pad_image(pictures(spark, sf_dir), 1, 5.0))


@query(f"WITH {IMG} SELECT seq, row, 7 - col AS col, round(z * 2 + 1, 6) AS z FROM px")
def augment_image(spark, sf_dir):
    return plane(ml.augment_image(pictures(spark, sf_dir), flip_horizontal=True, contrast=2.0, brightness=1.0))


@query(f"WITH {IMG} SELECT seq, row, col, round(coalesce(lag(z, 2) OVER (PARTITION BY seq, col ORDER BY row), 0), 6) AS z FROM px")
def translate_image(spark, sf_dir):
    return plane(image.translate_image(pictures(spark, sf_dir), (2, 0)))


@query(f"WITH {IMG} SELECT seq, row, col, round((col - 3.5) * (z + 1) / 10 + seq, 6) AS x, round(z, 6) AS color FROM px")
def fused_rgbd(spark, sf_dir):
    p = pictures(spark, sf_dir)
    deep = p.withColumn("data", F.transform("data", lambda x: x + 1))
    lit = lambda *values: [F.lit(float(x)) for x in values]
    t = p.select("topic", "seq", F.array(*lit(1, 0, 0), F.col("seq").cast("double"), *lit(0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)).alias("transform"))
    f = image.fuse_rgbd_frames(deep, p, 10.0, 12.0, 3.5, 3.5, transforms=t)
    return f.select("seq", "row", "col", r6("x").alias("x"), r6(F.get("attrs", F.lit(0))).alias("color"))


@query(f"WITH {IMG}, s AS (SELECT *, z * 2 AS w FROM px) SELECT seq, CAST(row * 8 + col AS INT) // 4 AS pid, round(max(CASE WHEN (row * 8 + col) % 4 = 0 THEN -2 * p1 + 1 END), 6) AS x FROM (SELECT *, lead(z) OVER (PARTITION BY seq ORDER BY row, col) AS p1 FROM s) GROUP BY 1, 2")
def augment_cloud(spark, sf_dir):
    c = pictures(spark, sf_dir).withColumn("shape", F.array(F.lit(16), F.lit(4)))
    a = ml.augment_point_cloud(c, 2.0, (1, 0, 0), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return points.explode_points(a).select("seq", "pid", r6("x").alias("x"))


@query("""WITH c AS (SELECT nav_id, source_uri AS topic, "timestamp" AS ts, concat_ws(':', CAST(floor(data[1] / 0.05) AS BIGINT), CAST(floor(data[2] / 0.05) AS BIGINT)) AS cell FROM (SELECT DISTINCT nav_id, source_uri, "timestamp", data FROM navsensor WHERE "timestamp" IS NOT NULL AND len(data) = 3 AND abs(data[1]) <= 90 AND abs(data[2]) <= 180)),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts, nav_id) - 1 AS seq FROM c), u AS (SELECT topic, cell, min(seq) AS first FROM k GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY first) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n FROM u)
SELECT nav_id, CASE WHEN i < ceil(n / 2.0) THEN 'a' ELSE 'b' END AS split FROM k JOIN n USING (topic, cell)""")
def split_geography(spark, sf_dir):
    return ml.split_topic(fixes(spark, sf_dir).withColumn("name", F.lit("")).withColumn("source_uri", F.lit("")), "geography", (0.5, 0.5), ("a", "b"), geography_cell_size=0.05).select("nav_id", "split")
