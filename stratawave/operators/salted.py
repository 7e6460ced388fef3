"""Per-key aggregation when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE, SALTS = 0.01, 32

#: How each aggregate is computed for one salt (first) and merged over the salts (second).
MERGE = {"count": ("count", "sum"), "sum": ("sum", "sum"), "min": ("min", "min"), "max": ("max", "max"), "bool_or": ("bool_or", "bool_or"), "bool_and": ("bool_and", "bool_and")}


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys holding at least ``share`` of the rows, with their row counts; the null key can be one.

    The counts are combined before the shuffle. At most 1 / ``share`` keys come out,
    whatever the size of ``df``.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("rows") >= F.col("total") * share).select(key, "rows")


def salted_aggregate(
    df: DataFrame,
    key: str,
    aggregates: Mapping[str, tuple[str, Column]],
    spread: Column,
    heavy: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Aggregate ``df`` by ``key`` in two stages: by (key, salt), then by key.

    ``aggregates`` maps an output name to (kind, expression); kind is one of ``MERGE``.
    ``spread`` identifies a row: the salt of a heavy key's row is drawn from its hash, so
    a task that runs again draws the same salts. ``heavy`` (from :func:`heavy_keys`, at
    most 1 / HEAVY_SHARE rows) says which keys get salts; None salts every key.

    Result: one row for each key with the named columns. Null keys form one group. An
    empty input gives no row. A count of no values is 0, the other aggregates null.
    """
    clash = "salt" if "salt" not in df.columns else "salt_" + "_".join(df.columns)
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    if heavy is None:
        salted = df.withColumn(clash, salt)
    else:
        listed = heavy.select(F.col(key).alias("heavy_key"), F.lit(True).alias("is_heavy"))
        salted = df.join(F.broadcast(listed), df[key].eqNullSafe(listed["heavy_key"]), "left").withColumn(clash, F.when(F.col("is_heavy"), salt).otherwise(F.lit(0).cast("long")))
    partial = salted.groupBy(key, clash).agg(*(getattr(F, MERGE[kind][0])(column).alias(name) for name, (kind, column) in aggregates.items()))
    return partial.groupBy(key).agg(*(getattr(F, MERGE[kind][1])(F.col(name)).alias(name) for name, (kind, _) in aggregates.items()))


def newest_counts(manifest: DataFrame) -> DataFrame:
    """One row (source_uri, topic, count): the count of the newest revision whose count is not null.

    Of revisions written at the same time the larger count holds; revisions without a
    time are older than all others. A series whose revisions all lack a count is left out.
    """
    newest = F.max(F.struct(F.col("written_at"), F.col("count")))
    return manifest.filter(F.col("count").isNotNull()).groupBy("source_uri", "topic").agg(newest["count"].alias("count"))


def topic_totals(manifest: DataFrame) -> DataFrame:
    """Records of each topic as its manifests declare them, by salted aggregation: topic, records, series, share of all records."""
    counts = newest_counts(manifest)
    totals = salted_aggregate(counts, "topic", {"records": ("sum", F.col("count")), "series": ("count", F.col("source_uri"))}, F.col("source_uri"), heavy_keys(counts, "topic"))
    whole = totals.agg(F.sum("records").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).select("topic", "records", "series", (F.col("records") / F.nullif(F.col("whole"), F.lit(0).cast("long"))).alias("share"))


def topic_statistics(message: DataFrame) -> DataFrame:
    """Stored rows, usable rows, sum, least and largest first element of each topic, by salted aggregation.

    The hot topics are split by the hash of msg_id. Rows without topic form the group of
    the null topic.
    """
    first = F.get("data", F.lit(0))
    value = F.when(first.isNotNull() & ~F.isnan(first), first)
    narrow = message.select("topic", "msg_id", F.col("timestamp").isNotNull().cast("long").alias("timed"), value.alias("value"))
    return salted_aggregate(
        narrow, "topic",
        {"rows": ("count", F.lit(1)), "timed": ("sum", F.col("timed")), "values": ("count", F.col("value")), "least": ("min", F.col("value")), "largest": ("max", F.col("value"))},
        F.col("msg_id"), heavy_keys(message.select("topic"), "topic"),
    )
