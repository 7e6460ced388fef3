"""Percentiles per group over very large columns, by cumulative frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Significant binary digits a value keeps in a summary; None keeps all.
DIGITS: int | None = None


def rounded(value: Column, digits: int | None) -> Column:
    """``value`` with ``digits`` significant binary digits, so with a relative error of at most 2 ** -digits.

    Zero stays zero and the sign stays. With None the value itself, and no error.
    """
    if digits is None:
        return value + F.lit(0.0)  # -0.0 becomes 0.0, one value
    size = F.abs(value)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size)) - (digits - 1))
    return F.when(size == 0, F.lit(0.0)).when(size < 1e-290, value).otherwise(F.rint(value / unit) * unit)


def frequencies(df: DataFrame, groups: Sequence[str], value: str, digits: int | None = DIGITS) -> DataFrame:
    """The summary of a column: (*groups, value, n), each value of each group once.

    Summaries of parts of the data (partitions, days) are added up by :func:`merged` and
    give exactly the summary of the whole. Null and NaN values count for nothing;
    infinities count as values. Null groups are groups. With ``digits`` the number of
    different values of a group is bounded by the range of the data, not by its rows.
    """
    column = F.col(value).cast("double")
    return (
        df.filter(column.isNotNull() & ~F.isnan(column))
        .groupBy(*groups, rounded(column, digits).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add summaries up over every column that is not in ``groups``."""
    return summary.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, groups: Sequence[str], shares: Sequence[float], partitions: int | None = None) -> DataFrame:
    """The first value of each group whose cumulative frequency reaches ``share`` of the group's rows.

    ``summary`` has the columns of :func:`frequencies`. Result: (*groups, share, rank,
    value, rows), one row for each group and share; rank is max(1, ceil(share · rows)), so
    share 0.5 of an even number of rows gives the lower median. The value is exact for
    the summary's values and off by their rounding for the raw ones.

    The summary is sorted by range once, so a hot group lies in many partitions. Within a
    partition running sums come from a window; what lies before a partition comes as an
    offset from the sums of the partitions, one row for each partition and group in it.
    An empty input gives no rows.
    """
    from stratawave.session import cut

    keys = list(groups)
    ranged = summary.repartitionByRange(*([partitions] if partitions else []), *keys, "value")
    placed = cut(ranged.sortWithinPartitions(*keys, "value").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy(*keys, "part").agg(F.sum("n").alias("within"))
    order = Window.partitionBy(*keys).orderBy("part")
    offsets = parts.select(
        *keys, "part", (F.sum("within").over(order) - F.col("within")).alias("offset"), F.sum("within").over(Window.partitionBy(*keys)).alias("rows")
    )
    targets = (
        offsets.join(parts.withColumnRenamed("within", "size"), on=[*(offsets[k].eqNullSafe(parts[k]) for k in keys), offsets["part"] == parts["part"]])
        .select(*(offsets[k] for k in keys), offsets["part"], "offset", "rows", "size", F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share"))
        .withColumn("rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.round(F.col("share") * F.col("rows"), 6))))
        .filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + F.col("size")))
    )
    # targets has one row for each group and share, each naming the partition that holds its rank
    running = placed.withColumn("upto", F.sum("n").over(Window.partitionBy("part", *keys).orderBy("value")))
    a, b = running.alias("a"), targets.alias("b")
    match = [F.col("a.part") == F.col("b.part"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    found = a.join(b, on=match).filter(F.col("offset") + F.col("upto") >= F.col("rank"))
    return (
        found.groupBy(*(F.col(f"b.{k}").alias(k) for k in keys), F.col("share"), F.col("rank"), F.col("rows"))
        .agg(F.min("value").alias("value"))
        .select(*keys, "share", "rank", "value", "rows")
    )
