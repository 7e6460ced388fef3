"""Session helpers: tables, checkpoints, sorted group streaming."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and the
    master is local; on a cluster an absent setting is an error.
    """
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratawave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, with all that is in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def finite(column) -> F.Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def usable(message: DataFrame) -> DataFrame:
    """Messages with a timestamp and a non-empty payload of finite elements."""
    return message.filter(
        finite(F.col("timestamp"))
        & F.col("data").isNotNull()
        & (F.size("data") > 0)
        & F.forall("data", lambda x: finite(x))
    )


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup the batches of a partition sorted by ``keys`` so that no group is split.

    The last group of a batch waits for the next batch, so memory is bounded by one
    batch and one group; callers bound the groups by cutting them into blocks.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and not same_key(held[-1], batch, keys):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        start = last_group_start(batch, keys)
        if start == 0:
            held.append(batch)
            continue
        held.append(batch.iloc[:start])
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        held = [batch.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def whole_tables(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 50_000) -> Iterator[pa.Table]:
    """Arrow tables of at least ``least`` rows, but for the last, in which no group of a partition sorted by ``keys`` is split."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= least:
            start = last_group_start(held.select(list(keys)).to_pandas(), keys)
            if start:
                yield held.slice(0, start).combine_chunks()
                held = held.slice(start)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def same_key(before: pd.DataFrame, after: pd.DataFrame, keys: Sequence[str]) -> bool:
    return all(equal(before[k].iloc[-1], after[k].iloc[0]) for k in keys)


def equal(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or (not pd.isna(a) and not pd.isna(b) and a == b)


def changes(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """True at each row whose key differs from that of the row before; nulls equal nulls."""
    out = np.zeros(len(frame), bool)
    if len(frame):
        out[0] = True
    for k in keys:
        column = frame[k]
        codes = pd.factorize(column)[0] if column.dtype == object or not isinstance(column.dtype, np.dtype) else column.to_numpy()
        if codes.dtype.kind == "f":
            differ = (codes[1:] != codes[:-1]) & ~(np.isnan(codes[1:]) & np.isnan(codes[:-1]))
        else:
            differ = codes[1:] != codes[:-1]
        out[1:] |= differ
    return out


def last_group_start(frame: pd.DataFrame, keys: Sequence[str]) -> int:
    return int(np.flatnonzero(changes(frame, keys))[-1])
