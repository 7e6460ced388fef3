"""Positions, neighbours and running sums along an order, without one task holding a hot key.

Rows of a key are cut into blocks (of their position, or of a number given). Windows run
inside blocks; what crosses a border comes from a table with one row for each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    while stem in df.columns:
        stem += "_"
    return stem


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row among those of its key, in the order given.

    Rows are sorted by range over (keys, order), so a hot key lies in many partitions;
    each partition numbers its rows, and one row for each key and partition carries the
    offset. Ties in the order are numbered as they come: give an order without ties where
    the numbering must be the same each time.
    """
    from stratawave.session import cut

    keys, order = list(keys), list(order)
    part, within = free(df, "part"), free(df, "within")
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys, *order) if keys or order else df
    placed = cut(ranged.sortWithinPartitions(*keys, *order).withColumn(part, F.spark_partition_id()))
    sizes = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.withColumn("offset", F.sum("size").over(Window.partitionBy(*keys).orderBy(part)) - F.col("size")).drop("size")
    numbered = placed.withColumn(within, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order)) - 1)
    a, b = numbered.alias("a"), offsets.alias("b")
    joined = a.join(b, same("a", "b", [*keys, part]))
    return joined.select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("b.offset") + F.col(f"a.`{within}`")).cast("long").alias(name))


def bordered(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: int, ahead: bool = True) -> tuple[DataFrame, str, str]:
    """``df`` in blocks along ``order``, each with the last row before it and, with ``ahead``, the first behind it; the names of the block's number and of the side (-1, 0 for own rows, 1).

    Border rows have only the keys, ``order`` and ``columns``. They come from a table of one
    row for each block, so rows move once, to their block.
    """
    keys, at, side = list(keys), free(df, "block_at"), free(df, "block_side")
    blocked = df.withColumn(at, F.floor(F.col(order) / block))
    packed = F.struct(*dict.fromkeys([order, *columns]))
    edges = blocked.groupBy(*keys, at).agg(F.max_by(packed, order).alias("last"), F.min_by(packed, order).alias("first"))
    line = Window.partitionBy(*keys).orderBy(at)
    sides = [F.struct(F.lag("last").over(line).alias("row"), F.lit(-1).alias("side"))] + ([F.struct(F.lead("first").over(line).alias("row"), F.lit(1).alias("side"))] if ahead else [])
    edges = edges.select(*keys, at, F.array(*sides).alias("sides")).select(*keys, at, F.explode("sides").alias("edge")).filter("edge.row IS NOT NULL")
    given = {order, *columns}
    row = [F.col(c) if c in keys else F.col("edge.row")[c].alias(c) if c in given else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return blocked.withColumn(side, F.lit(0)).unionByName(edges.select(*row, at, F.col("edge.side").alias(side))), at, side


def with_neighbours(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: int = BLOCK, ahead: bool = True) -> DataFrame:
    """Adds prev_<c> and, with ``ahead``, next_<c> of ``columns`` along the whole number ``order``; null at the ends."""
    rows, at, side = bordered(df, keys, order, columns, block, ahead)
    packed, w = F.struct(*columns), Window.partitionBy(*keys, at).orderBy(side, order)
    near = rows.withColumns({"lag_own": F.lag(packed).over(w)} | ({"lead_own": F.lead(packed).over(w)} if ahead else {})).filter(F.col(side) == 0)
    return near.select(*df.columns, *(F.col("lag_own")[c].alias(f"prev_{c}") for c in columns), *(F.col("lead_own")[c].alias(f"next_{c}") for c in columns if ahead))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, terms: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds the sum of each term over the rows up to and with this one, along the whole number ``order``."""
    keys, at, side = list(keys), free(df, "block_at"), free(df, "block_side")
    held = {free(df, f"term_{name}"): (name, term) for name, term in terms.items()}
    blocked = df.withColumn(at, F.floor(F.col(order) / block)).withColumns({k: term for k, (_, term) in held.items()})
    totals = blocked.groupBy(*keys, at).agg(*(F.sum(k).alias(k) for k in held))
    line = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, at, *(F.coalesce(F.sum(k).over(line), F.lit(0)).alias(k) for k in held))
    # each block begins with a row that carries the sum so far, so rows move once, to their block
    types = {f.name: f.dataType for f in offsets.schema}
    own = blocked.select(*df.columns, at, *(F.col(k).cast(types[k]).alias(k) for k in held), F.lit(0).alias(side))
    first = [F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    rows = own.unionByName(offsets.select(*first, at, *held, F.lit(-1).alias(side)))
    w = Window.partitionBy(*keys, at).orderBy(side, order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({k: F.sum(k).over(w) for k in held}).filter(F.col(side) == 0)
    return summed.select(*(c for c in df.columns if c not in terms), *(F.col(k).alias(name) for k, (name, _) in held.items()))
