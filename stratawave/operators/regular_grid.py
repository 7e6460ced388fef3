"""Irregular readings onto a regular grid by compact-kernel local linear regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratawave.session import usable

#: Half-width of the kernel in periods; slots of one block; least effective number of readings behind a filled value.
BANDWIDTH, BLOCK_SLOTS, MIN_SUPPORT = 2.5, 512, 1.5


def series_bounds(manifest: DataFrame, recording: DataFrame, spec: DataFrame) -> DataFrame:
    """One row (source_uri, topic, start, period, slots) for each series of the manifest.

    Repeated recording rows agree on the bounds and become one. Series without a known
    recording, bounds or a positive period have no grid and are left out.
    """
    bounds = recording.groupBy("source_uri").agg(F.min("start_time").alias("start"), F.max("end_time").alias("stop"))
    return (
        manifest.select("source_uri", "topic").distinct()
        .join(F.broadcast(spec.select("topic", "period").dropDuplicates(["topic"])), "topic")
        .join(bounds, "source_uri")
        .filter((F.col("period") > 0) & ~F.isnan("period"))
        .select("source_uri", "topic", "start", "period", F.floor((F.col("stop") - F.col("start")) / F.col("period")).alias("slots"))
        .filter("slots > 0")
    )


def regular_grid(
    readings: DataFrame,
    bounds: DataFrame,
    spec: DataFrame,
    elements: int = 1,
    bandwidth: float = BANDWIDTH,
    min_support: float = MIN_SUPPORT,
    id_col: str = "msg_id",
) -> DataFrame:
    """Evaluate every slot of every series from the readings near it.

    ``readings`` has source_uri, topic, timestamp, data and ``id_col``; ``bounds`` comes
    from :func:`series_bounds`; ``spec`` has one period for each topic and is a reference
    table of fixed size. Slot k of a series is [start + k·period, start + (k+1)·period)
    and is evaluated at its middle, by a line fitted with biweight weights that vanish
    ``bandwidth`` periods away.

    Result: source_uri, topic, slot, grid_time, value (an array of ``elements`` values),
    support (Kish's effective number of readings), readings (records in the slot) and
    status: observed, filled, or missing where the slot is empty and its support is below
    ``min_support`` (value null then). Records stored repeatedly count once; readings
    whose ``id_col`` is null are one record where timestamp, data and seq (if ``readings``
    has it) agree. Unusable readings (null or non-finite time or payload) and readings of
    series without bounds count for nothing. A payload shorter than ``elements`` serves the
    elements it has.

    Blocks of slots, not series, are what one task sees, so a hot series is spread; a
    reading within the kernel's reach of a block's border goes to both blocks. One
    shuffle carries readings and grid alike; the windows and aggregates behind it reuse
    its partitioning.
    """
    width = F.col("period") * BLOCK_SLOTS
    reach = F.col("period") * (bandwidth + 1.0)
    periods = F.broadcast(spec.select("topic", "period").dropDuplicates(["topic"]))
    block = F.floor(F.col("timestamp") / width)
    unnamed = F.when(F.col(id_col).isNull(), F.struct("timestamp", "data", *(["seq"] if "seq" in readings.columns else [])))
    parts = (
        usable(readings).join(periods, "topic").filter(F.col("period") > 0)
        .select(
            "source_uri", "topic",
            F.explode(F.array_distinct(F.array(block, F.floor((F.col("timestamp") - reach) / width), F.floor((F.col("timestamp") + reach) / width)))).alias("block"),
            F.lit(1).alias("kind"), F.col(id_col).cast("string").alias("id"), unnamed.alias("unnamed"), "timestamp", "data",
            *(F.lit(None).cast(t).alias(c) for c, t in (("start", "double"), ("period", "double"), ("slots", "long"))),
        )
    )
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("slots") * F.col("period")) / width)
    grid = bounds.select(
        "source_uri", "topic", F.explode(F.sequence(first, last)).alias("block"), F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast(parts.schema["unnamed"].dataType).alias("unnamed"), F.lit(None).cast("double").alias("timestamp"), F.lit(None).cast("array<double>").alias("data"),
        "start", "period", "slots",
    )
    ordered = Window.partitionBy("source_uri", "topic", "block").orderBy("kind", "id", "unnamed")
    rows = (
        grid.unionByName(parts)
        .repartition("source_uri", "topic", "block")
        .withColumns({c: F.first(c, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) for c in ("start", "period", "slots")})
        .withColumn("again", F.lag("id").over(ordered).eqNullSafe(F.col("id")) & F.lag("unnamed").over(ordered).eqNullSafe(F.col("unnamed")) & (F.col("kind") == 1))
        .filter(F.col("start").isNotNull() & ~F.col("again"))
    )
    # the slot of a time by its own borders, not by a rounded quotient
    guess = F.floor((F.col("timestamp") - F.col("start")) / F.col("period"))
    own = (
        F.when(F.col("timestamp") < F.col("start") + guess * F.col("period"), guess - 1)
        .when(F.col("timestamp") >= F.col("start") + (guess + 1) * F.col("period"), guess + 1)
        .otherwise(guess)
    )
    span = int(bandwidth) + 1
    begin = F.ceil((F.col("block") * width - F.col("start")) / F.col("period"))
    slots = F.when(
        F.col("kind") == 0,
        F.sequence(F.greatest(F.lit(0), begin - 1), F.greatest(F.lit(0), F.least(F.col("slots") - 1, begin + BLOCK_SLOTS + 1))),
    ).when(
        (F.col("own") >= -span) & (F.col("own") < F.col("slots") + span),
        F.sequence(F.greatest(F.lit(0), F.col("own") - span), F.greatest(F.lit(0), F.least(F.col("slots") - 1, F.col("own") + span))),
    )
    at = F.col("start") + F.col("slot") * F.col("period")
    u = (F.col("timestamp") - (at + F.col("period") / 2)) / (F.col("period") * bandwidth)
    shares = (
        rows.withColumn("own", own)
        .withColumn("slot", F.explode(slots))
        .filter((F.col("slot") < F.col("slots")) & (F.floor(at / width) == F.col("block")))
        .select(
            "source_uri", "topic", "block", "slot", at.alias("at"), "period", "data", u.alias("u"),
            F.when((F.col("kind") == 1) & (F.abs(u) < 1), F.pow(1 - u * u, F.lit(2.0))).alias("w"),
            ((F.col("kind") == 1) & (F.col("own") == F.col("slot"))).cast("long").alias("inside"),
        )
    )
    sums: list[Column] = [F.sum("inside").alias("readings"), F.sum("w").alias("w0"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.first("at").alias("at"), F.first("period").alias("period")]
    for j in range(elements):
        here = F.get("data", F.lit(j))
        w = F.when(here.isNotNull(), F.col("w"))
        for k in range(3):
            sums.append(F.sum(w * F.pow(F.col("u"), F.lit(float(k))) if k else w).alias(f"s{k}_{j}"))
        for k in range(2):
            sums.append(F.sum(w * here * F.col("u") if k else w * here).alias(f"t{k}_{j}"))
    support = F.coalesce(F.col("w0") * F.col("w0") / F.nullif(F.col("ww"), F.lit(0.0)), F.lit(0.0))
    status = F.when(F.col("readings") > 0, "observed").when(F.col("support") >= min_support, "filled").otherwise("missing")

    def fitted(j: int) -> Column:
        s0, s1, s2, t0, t1 = (F.col(f"{c}_{j}") for c in ("s0", "s1", "s2", "t0", "t1"))
        det = s0 * s2 - s1 * s1
        return F.when(det > s0 * s0 * 1e-6, (s2 * t0 - s1 * t1) / det).otherwise(t0 / F.nullif(s0, F.lit(0.0)))

    return (
        shares.groupBy("source_uri", "topic", "block", "slot").agg(*sums)
        .withColumn("support", support)
        .withColumn("status", status)
        .select(
            "source_uri", "topic", "slot", (F.col("at") + F.col("period") / 2).alias("grid_time"),
            F.when(F.col("status") != "missing", F.array(*(fitted(j) for j in range(elements)))).alias("value"),
            "support", "readings", "status",
        )
    )
