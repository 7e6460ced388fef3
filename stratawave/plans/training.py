"""Queries of the general training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.operators import consolidate, salted, spikes, trips
from stratawave.operators import regular_grid as rg
from stratawave.session import cut, removed, shared_dir, table


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = table(spark, sf_dir, "topic_spec")
    bounds = rg.series_bounds(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "recording"), spec)
    width = spec.filter("period > 0").agg(F.max(F.get("shape", F.lit(0)))).first()[0] or 1  # of a reference table of fixed size
    return rg.regular_grid(table(spark, sf_dir, "message"), bounds, spec, elements=int(width))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a usable reading."""
    return grid_of(spark, sf_dir).filter(F.col("status").isin("filled", "missing")).select("source_uri", "topic", "slot")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regular series."""
    return grid_of(spark, sf_dir).select(
        "source_uri", "topic", "slot", "readings", "status", F.round("support", 6).alias("support"),
        F.round(F.get("value", F.lit(0)), 6).alias("value_0"), F.round(F.get("value", F.lit(1)), 6).alias("value_1"),
    )


def compacted(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    out = f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}"
    return out, consolidate.compact_records(table(spark, sf_dir, "message"), out)


def p2_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every fragment when all were copied into files that hold each record once."""
    out, report = compacted(spark, sf_dir)
    removed(spark, out)  # this query asks only for the report
    return consolidate.fragment_roles(table(spark, sf_dir, "fragment"), report)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that added no record."""
    return p2_roles(spark, sf_dir).filter("role = 'drop'").select("fragment_id")


def p2_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and records by topic, read back from the consolidated files of the message table."""
    message, report = consolidate.consolidated(spark, f"{sf_dir}/message.parquet")
    found = cut(message.groupBy("topic").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("msg_id").alias("records"), F.count("timestamp").alias("timed")))
    for folder in {r.folder for r in report.filter("refused IS NULL").select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct().collect()}:  # one folder
        removed(spark, folder)
    return found


def p2_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments left of every topic, and its records as they are read back from the files that hold each once."""
    out, report = compacted(spark, sf_dir)
    schema = table(spark, sf_dir, "message").schema
    records = cut(spark.read.schema(schema).parquet(out).groupBy("topic").agg(F.count(F.lit(1)).alias("records")))
    removed(spark, out)
    blocks = report.filter("owned > 0").groupBy("topic").agg(F.countDistinct("fragment_id").alias("blocks"))
    b, r = blocks.alias("b"), records.alias("r")
    return b.join(r, F.col("b.topic").eqNullSafe(F.col("r.topic"))).select("b.topic", "blocks", "records")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics holding at least 5 % of the declared records."""
    return salted.topic_totals(table(spark, sf_dir, "manifest")).filter("share >= 0.05").select("topic")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared records of all topics."""
    return salted.topic_totals(table(spark, sf_dir, "manifest")).select("topic", "records", "series", F.round("share", 9).alias("share"))


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages of all topics."""
    return salted.topic_statistics(table(spark, sf_dir, "message"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable messages with an implausible element."""
    return p4_flags(spark, sf_dir).select("msg_id").distinct()


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason for every implausible element."""
    return spikes.flag_implausible(table(spark, sf_dir, "message"), table(spark, sf_dir, "topic_spec"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings within a stop."""
    return trips.mark_stops(table(spark, sf_dir, "navsensor")).filter("stopped AND nav_id IS NOT NULL").select("nav_id")


def p5_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops and trips of every drive."""
    return trips.stops_and_trips(table(spark, sf_dir, "navsensor"))


#: Usable messages, each record once, as the tables' description defines them.
USABLE_SQL = """usable AS (
  SELECT DISTINCT msg_id, source_uri, topic, seq, "timestamp" AS ts, data FROM message
  WHERE "timestamp" IS NOT NULL AND isfinite("timestamp") AND data IS NOT NULL AND len(data) > 0
    AND len(list_filter(data, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
SLOTS_SQL = """bounds AS (
  SELECT m.source_uri, m.topic, r.start, s.period, CAST(floor((r.stop - r.start) / s.period) AS BIGINT) AS n, s.shape[1] AS width
  FROM (SELECT DISTINCT source_uri, topic FROM manifest) m
  JOIN (SELECT source_uri, min(start_time) AS start, max(end_time) AS stop FROM recording GROUP BY 1) r USING (source_uri)
  JOIN topic_spec s USING (topic) WHERE s.period > 0),
slots AS (SELECT source_uri, topic, start, period, unnest(range(n)) AS slot FROM bounds)"""

QUERIES = {q.__name__: q for q in (p1_found, p1_grid, p2_found, p2_roles, p2_consolidated, p2_compacted, p3_found, p3_totals, p3_statistics, p4_found, p4_flags, p5_found, p5_trips)}
TOTALS_SQL = """counts AS (
  SELECT source_uri, topic, max("count") AS n FROM manifest x
  WHERE "count" IS NOT NULL AND written_at = (SELECT max(written_at) FROM manifest y WHERE y.source_uri = x.source_uri AND y.topic = x.topic AND y."count" IS NOT NULL)
  GROUP BY 1, 2),
totals AS (SELECT topic, CAST(sum(n) AS BIGINT) AS records, count(*) AS series FROM counts GROUP BY 1)"""
ROLES_SQL = """held AS (SELECT source_uri, topic, msg_id, fragment_id, count(*) AS copies FROM message WHERE fragment_id IS NOT NULL GROUP BY ALL),
first AS (SELECT source_uri, topic, msg_id, min(fragment_id) AS fragment_id FROM held GROUP BY ALL),
owned AS (SELECT fragment_id, count(*) AS owned FROM first GROUP BY 1),
total AS (SELECT fragment_id, count(*) AS held, max(copies) AS copies FROM held GROUP BY 1),
roles AS (
  SELECT f.fragment_id, coalesce(held, 0) AS held, coalesce(owned, 0) AS owned,
    CASE WHEN owned IS NULL THEN 'drop' WHEN owned = held AND copies = 1 THEN 'copy' ELSE 'rewrite' END AS role
  FROM (SELECT DISTINCT fragment_id FROM fragment) f LEFT JOIN total USING (fragment_id) LEFT JOIN owned USING (fragment_id))"""
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {USABLE_SQL}, {SLOTS_SQL}
SELECT source_uri, topic, slot FROM slots g WHERE NOT EXISTS (
  SELECT 1 FROM usable m WHERE m.source_uri = g.source_uri AND m.topic = g.topic
    AND m.ts >= g.start + g.slot * g.period AND m.ts < g.start + (g.slot + 1) * g.period)""",
    "p1_grid": f"""WITH {USABLE_SQL}, {SLOTS_SQL},
near AS (
  SELECT g.source_uri, g.topic, g.slot, m.data, (m.ts - (g.start + g.slot * g.period + g.period / 2)) / (g.period * {rg.BANDWIDTH}) AS u,
    m.ts >= g.start + g.slot * g.period AND m.ts < g.start + (g.slot + 1) * g.period AS inside
  FROM slots g JOIN usable m ON m.source_uri = g.source_uri AND m.topic = g.topic
    AND m.ts > g.start + (g.slot - 3) * g.period AND m.ts < g.start + (g.slot + 4) * g.period),
w AS (SELECT *, CASE WHEN abs(u) < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0 END AS w FROM near),
f AS (
  SELECT source_uri, topic, slot, count(*) FILTER (inside) AS readings, sum(w) * sum(w) / nullif(sum(w * w), 0) AS support,
    sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * data[1]) AS t0, sum(w * data[1] * u) AS t1, sum(w * data[2]) AS v0, sum(w * data[2] * u) AS v1
  FROM w GROUP BY 1, 2, 3),
o AS (
  SELECT g.source_uri, g.topic, g.slot, coalesce(readings, 0) AS readings, coalesce(support, 0) AS support, s0, s1, s2, t0, t1, v0, v1,
    CASE WHEN coalesce(readings, 0) > 0 THEN 'observed' WHEN coalesce(support, 0) >= {rg.MIN_SUPPORT} THEN 'filled' ELSE 'missing' END AS status
  FROM slots g LEFT JOIN f USING (source_uri, topic, slot))
SELECT source_uri, topic, slot, readings, status, round(support, 6) AS support,
  CASE WHEN status <> 'missing' THEN round(CASE WHEN s0 * s2 - s1 * s1 > s0 * s0 * 1e-6 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / nullif(s0, 0) END, 6) END AS value_0,
  CASE WHEN status <> 'missing' THEN round(CASE WHEN s0 * s2 - s1 * s1 > s0 * s0 * 1e-6 THEN (s2 * v0 - s1 * v1) / (s0 * s2 - s1 * s1) ELSE v0 / nullif(s0, 0) END, 6) END AS value_1
FROM o""",
    "p2_found": f"WITH {ROLES_SQL} SELECT fragment_id FROM roles WHERE role = 'drop'",
    "p2_roles": f"WITH {ROLES_SQL} SELECT * FROM roles",
    "p2_consolidated": 'SELECT topic, count(*) AS rows, count(DISTINCT msg_id) AS records, count("timestamp") AS timed FROM message GROUP BY 1',
    "p2_compacted": f"""WITH {ROLES_SQL}, r AS (SELECT topic, count(DISTINCT (source_uri, msg_id)) AS records FROM message GROUP BY 1), b AS (SELECT topic, count(DISTINCT fragment_id) AS blocks FROM first GROUP BY 1)
SELECT topic, CAST(blocks AS BIGINT) AS blocks, records FROM r JOIN b USING (topic)""",
    "p3_found": f"WITH {TOTALS_SQL} SELECT topic FROM totals WHERE records >= 0.05 * (SELECT sum(records) FROM totals)",
    "p3_totals": f"WITH {TOTALS_SQL} SELECT topic, records, series, round(records / (SELECT CAST(sum(records) AS DOUBLE) FROM totals), 9) AS share FROM totals",
    "p3_statistics": """SELECT topic, count(*) AS rows, CAST(sum(CASE WHEN "timestamp" IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS timed,
  count(data[1]) FILTER (NOT isnan(data[1])) AS "values", min(data[1]) FILTER (NOT isnan(data[1])) AS least, max(data[1]) FILTER (NOT isnan(data[1])) AS largest
FROM message GROUP BY 1""",
}
