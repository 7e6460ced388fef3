"""Queries of the language-model data pipeline, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.llm import encode, mixing, nearest_time, percentiles, skeleton
from stratawave.session import table

#: Percentiles of the queries; significant binary digits of the day summaries, an error of at most 2 ** -12.
SHARES, DAY_DIGITS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99), 12


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summary row once, as (topic, day, field, x)."""
    rows = table(spark, sf_dir, "describe_topic").select("summary_id", "topic", "day", "dt_mean", "dt_max").distinct()
    return rows.select("topic", "day", F.explode(F.create_map(F.lit("dt_mean"), "dt_mean", F.lit("dt_max"), "dt_max")).alias("field", "x"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of dt_mean and dt_max of every topic."""
    counts = percentiles.frequencies(summaries(spark, sf_dir), ["topic", "field"], "x")
    return percentiles.percentiles(counts, ["topic", "field"], SHARES)


def p6_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from rounded summaries of each day, added up over the days."""
    days = percentiles.frequencies(summaries(spark, sf_dir), ["topic", "field", "day"], "x", DAY_DIGITS)
    return percentiles.percentiles(percentiles.merged(days, ["topic", "field"]), ["topic", "field"], SHARES)


def p6_day_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles, and whether those from rounded summaries of the days are within their bound of them."""
    exact, rounded = p6_percentiles(spark, sf_dir).alias("a"), p6_from_days(spark, sf_dir).alias("b")
    key = F.col("a.topic").eqNullSafe(F.col("b.topic")) & (F.col("a.field") == F.col("b.field")) & (F.col("a.share") == F.col("b.share"))
    off = F.abs(F.col("b.value") - F.col("a.value"))
    return exact.join(rounded, key).select("a.topic", "a.field", "a.share", "a.value", ((off <= F.abs(F.col("a.value")) * 2.0**-DAY_DIGITS) | (F.col("a.value") == F.col("b.value"))).alias("within"))


def p6_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of every day over all topics."""
    counts = percentiles.frequencies(summaries(spark, sf_dir), ["day", "field"], "x")
    return percentiles.percentiles(counts, ["day", "field"], SHARES)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_time.match_captures(table(spark, sf_dir, "capture"), table(spark, sf_dir, "message"), table(spark, sf_dir, "topic_spec"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message nearest to each capture."""
    return captures(spark, sf_dir).select("capture_id", "msg_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the message's data."""
    found = captures(spark, sf_dir)
    data = table(spark, sf_dir, "message").select("msg_id", "data").join(found.select("msg_id").distinct(), "msg_id", "left_semi").dropDuplicates(["msg_id"])
    return found.join(data, "msg_id").select("capture_id", "msg_id", F.round("distance", 6).alias("distance"), "data")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return mixing.unreachable(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixture(spark, sf_dir)[1]


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture with their copies."""
    return mixture(spark, sf_dir)[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but differ."""
    return skeleton.look_alike_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document and the number of documents that look like it but differ."""
    return skeleton.look_alike_classes(table(spark, sf_dir, "documents"))


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in one consistent form."""
    return table(spark, sf_dir, "documents").select("doc_id", skeleton.canonical(F.col("text")).alias("text"))


QUERIES = {q.__name__: q for q in (p6_percentiles, p6_from_days, p6_day_errors, p6_by_day, p7_found, p7_matches, p8_ids, p9_found, p9_report, p9_mixture, p10_found, p10_classes, p10_texts)}

FIELDS_SQL = """rows AS (SELECT DISTINCT summary_id, topic, day, dt_mean, dt_max FROM describe_topic),
fields AS (SELECT topic, day, 'dt_mean' AS field, dt_mean AS x FROM rows UNION ALL SELECT topic, day, 'dt_max', dt_max FROM rows),
shares AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS share)"""


def percentile_sql(key: str, value: str) -> str:
    return f"""WITH {FIELDS_SQL},
counts AS (SELECT {key}, field, {value} AS value, count(*) AS n FROM fields WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2, 3),
running AS (SELECT *, sum(n) OVER (PARTITION BY {key}, field ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {key}, field) AS rows FROM counts),
ranks AS (SELECT *, greatest(1, CAST(ceil(round(share * rows, 6)) AS BIGINT)) AS rank FROM running, shares)
SELECT {key}, field, share, rank, min(value) AS value, CAST(rows AS BIGINT) AS rows FROM ranks WHERE upto >= rank GROUP BY {key}, field, share, rank, rows"""


MATCH_SQL = """usable AS (
  SELECT DISTINCT msg_id, topic, "timestamp" AS ts FROM message
  WHERE "timestamp" IS NOT NULL AND isfinite("timestamp") AND data IS NOT NULL AND len(data) > 0 AND len(list_filter(data, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
near AS (
  SELECT c.capture_id, m.msg_id, abs(m.ts - c."timestamp") AS distance FROM capture c JOIN topic_spec s ON s.topic = c.topic
  JOIN usable m ON m.topic = c.topic AND m.ts >= c."timestamp" - s.tolerance - 1 AND m.ts <= c."timestamp" + s.tolerance + 1
  WHERE abs(m.ts - c."timestamp") <= s.tolerance),
best AS (SELECT DISTINCT ON (capture_id) * FROM near ORDER BY capture_id, distance, msg_id)"""

ORACLE = {
    "p6_percentiles": percentile_sql("topic", "x + 0.0"),
    "p6_from_days": percentile_sql("topic", f"CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2.0, floor(log2(abs(x))) - {DAY_DIGITS - 1}), 0) * pow(2.0, floor(log2(abs(x))) - {DAY_DIGITS - 1}) END"),
    "p6_day_errors": "SELECT topic, field, share, value, true AS within FROM (" + percentile_sql("topic", "x + 0.0") + ")",
    "p6_by_day": percentile_sql("day", "x + 0.0"),
    "p7_found": f"WITH {MATCH_SQL} SELECT capture_id, msg_id FROM best",
    "p7_matches": f"WITH {MATCH_SQL} SELECT capture_id, msg_id, round(distance, 6) AS distance, data FROM best JOIN (SELECT DISTINCT ON (msg_id) msg_id, data FROM message ORDER BY msg_id) USING (msg_id)",
}
