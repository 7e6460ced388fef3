"""Pipelines over message streams, batch or Structured Streaming."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratawave.operators.order import positions
from stratawave.operators.topic import Dataset, between_times
from stratawave.schema import normalize_messages


class PipelineCancelled(RuntimeError):
    """Raised when a pipeline was stopped by its token; what it processed is committed in its checkpoint."""


class CancellationToken:
    """A flag that stops a running pipeline."""

    def __init__(self):
        self.flag = False

    def cancel(self) -> None:
        self.flag = True

    @property
    def cancelled(self) -> bool:
        return self.flag


def is_cancelled(token) -> bool:
    if token is None:
        return False
    for name in ("cancelled", "is_cancelled"):
        if hasattr(token, name):
            found = getattr(token, name)
            return bool(found() if callable(found) else found)
    return bool(token())


class PipelineProgress:
    """Rows read and written by a query so far, from Spark's own progress reports."""

    def __init__(self, query):
        # recentProgress repeats no batch; a batch without rows reports zeros
        reports = {p["batchId"]: p for p in query.recentProgress}
        self.processed = sum(int(p["numInputRows"]) for p in reports.values())
        self.emitted = sum(max(0, int(p["sink"].get("numOutputRows", 0))) for p in reports.values())
        self.batches, self.done = len(reports), not query.isActive


def watch(query, token=None, progress: Callable[[PipelineProgress], None] | None = None, interval: float = 0.2) -> None:
    """Wait for a query; report its progress, stop it when the token says so."""
    while query.isActive:
        if is_cancelled(token):
            query.stop()
            if progress:
                progress(PipelineProgress(query))
            raise PipelineCancelled("the pipeline was cancelled")
        if progress:
            progress(PipelineProgress(query))
        time.sleep(interval)
    if query.exception() is not None:
        raise query.exception()
    if progress:
        progress(PipelineProgress(query))


def counted(start: int, stop: int | None, step: int, columns: list[str]):
    """Numbers the rows of each topic as they arrive, over all batches, and keeps some.

    A topic's rows of one batch reach a task in pieces that are in no order, so they are
    held until all are there; the stream's limit for a batch bounds them. Behind the last
    position that is asked for, rows are only counted.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (at,) = state.get if state.exists else (0,)
        if stop is not None and at >= stop:
            state.update((at + sum(len(f) for f in frames),))
            return
        whole = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "name"], kind="stable")
        place = at + np.arange(len(whole))
        chosen = (place >= start) & ((place - start) % step == 0)
        if stop is not None:
            chosen &= place < stop
        state.update((at + len(whole),))
        yield whole.loc[chosen, columns]

    return run


@dataclass
class ReadProgress:
    """Rows that a reader on the driver has taken so far."""

    processed: int
    topic: str | None = None
    ts: float | None = None
    done: bool = False


class SourcePipeline(Dataset):
    """A lazy pipeline over messages; over a stream, steps that count rows keep their counts as state."""

    def __init__(self, df: DataFrame, topics=None):
        super().__init__(df, topics)

    def time_range(self, start: float, end: float, inclusive: bool = True) -> "SourcePipeline":
        return self.with_df(self.df.filter(between_times(start, end, inclusive)))

    def index_range(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> "SourcePipeline":
        """Positions among the rows of each topic that reach this step, in arrival order (by time within a batch of a stream)."""
        if not self.df.isStreaming:
            return super().index_range(start, stop, step)
        start, step = start or 0, 1 if step is None else step
        if start < 0 or (stop is not None and stop < 0) or step < 1:
            raise ValueError("a range has start >= 0, stop >= 0 and step >= 1")
        out = self.df.groupBy("topic").applyInPandasWithState(counted(start, stop, step, self.df.columns), self.df.schema, "at long", "append", GroupStateTimeout.NoTimeout)
        return self.with_df(out)

    def nearest_topic_pairs(self, reference_topic: str, target_topic: str, tolerance: float, watermark: str = "10 minutes") -> DataFrame:
        """Pairs of two topics within ``tolerance``; the earlier target on a tie, references without a target are left out.

        Over a stream, a reference waits in the state of its time bucket until the
        watermark has passed all targets that could be its own, so late rows within the
        watermark still count and state is bounded by it.
        """
        if not self.df.isStreaming:
            from stratawave.operators.align import nearest_topic_pairs

            return nearest_topic_pairs(self.df, reference_topic, target_topic, tolerance)
        timed = self.df.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", watermark)
        side = lambda topic, prefix: timed.filter(F.col("topic") == topic).select(F.col("ts").alias(f"{prefix}_ts"), F.col("seq").alias(f"{prefix}_seq"), F.col("name").alias(f"{prefix}_name"), F.col("data").alias(f"{prefix}_data"), F.col("event_time").alias(f"{prefix}_time"))
        # both sides meet in buckets of time: a target is in one, a reference in those its tolerance reaches
        width = max(2.0 * tolerance, 1e-3)
        reach = F.sequence(F.floor((F.col("reference_ts") - tolerance) / width), F.floor((F.col("reference_ts") + tolerance) / width))
        a = side(reference_topic, "reference").withColumn("reference_bucket", F.explode(reach))
        b = side(target_topic, "target").withColumn("target_bucket", F.floor(F.col("target_ts") / width))
        span = F.make_dt_interval(secs=F.lit(float(tolerance)))
        pairs = a.join(b, (F.col("reference_bucket") == F.col("target_bucket")) & (F.col("target_time") >= F.col("reference_time") - span) & (F.col("target_time") <= F.col("reference_time") + span))
        rank = F.struct(F.abs(F.col("target_ts") - F.col("reference_ts")), F.col("target_ts"), F.col("target_seq"))
        best = F.min_by(F.struct("target_ts", "target_seq", "target_name", "target_data"), rank).alias("target")
        return pairs.filter(F.abs(F.col("target_ts") - F.col("reference_ts")) <= tolerance).groupBy(F.window("reference_time", "1 second"), "reference_seq", "reference_ts", "reference_name").agg(best, F.first("reference_data").alias("reference_data")).select("reference_seq", "reference_ts", "reference_name", "reference_data", "target.*")

    def iter_messages(self, token=None, progress: Callable[[ReadProgress], None] | None = None, checkpoint: dict | None = None, progress_interval: int = 1) -> Iterator:
        """Rows of a batch topic by topic in order, a partition at a time on the driver; resumable.

        ``checkpoint`` is a dict that keeps how many rows were taken: read again with it, the
        rows behind those come. A row counts when the next one is asked for. A cancelled
        reader raises PipelineCancelled.
        """
        if progress_interval < 1:
            raise ValueError("an interval has at least one row")
        kept = {} if checkpoint is None else checkpoint
        before, n, row = int(kept.get("processed", 0)), 0, None
        for n, row in enumerate(self.iter_rows(), 1):
            if n <= before:
                continue
            if is_cancelled(token):
                raise PipelineCancelled("the reader was cancelled")
            yield row
            kept["processed"] = n
            if progress and n % progress_interval == 0:
                progress(ReadProgress(n, row.topic, row.ts))
        if progress:
            progress(ReadProgress(n, None if row is None else row.topic, None if row is None else row.ts, True))

    def to_buffer(self, data_uri: str, checkpoint: str | None = None, token=None, progress=None, available_now: bool = True):
        """Write the messages to a :class:`Store`, a stream batch by batch and resumable from ``checkpoint``.

        Each row of the source is stored once however often the pipeline breaks and starts
        again. When a stream has come to its end the store is closed; a cancelled pipeline
        raises PipelineCancelled and leaves it open. The store of a batch pipeline, the query
        of a stream.
        """
        from stratawave.sources.store import Store

        store = Store(self.df.sparkSession, data_uri)
        if not self.df.isStreaming:
            store.append(self.df, closed=True)
            return store
        if not checkpoint:
            raise ValueError("a stream needs a checkpoint")
        name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        writer = self.df.writeStream.foreachBatch(lambda rows, number: store.append_batch(rows, f"{name}-{number}")).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
        watch(query, token, progress)
        if available_now and store.exists("data"):
            store.write_manifest(True)
        return query

    def to_parquet(self, path: str, checkpoint: str, token=None, progress=None, available_now: bool = True, partition: bool = True):
        """Write a stream to plain Parquet files, by topic, resumable from ``checkpoint``."""
        writer = self.df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        writer = writer.partitionBy("topic") if partition else writer
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
        watch(query, token, progress)
        return query

    write_to_buffer = to_buffer
    persist_to_tiledb = to_buffer

    def latest(self, depth: int) -> DataFrame:
        """Streaming ring buffers: after each batch the newest ``depth`` rows (ts, name, data) of each topic that got rows."""
        schema = "topic string, rows array<struct<ts: double, name: string, data: array<double>>>"

        def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held = list(zip(*state.get)) if state.exists else []
            for frame in frames:
                held += list(zip(frame["ts"].tolist(), frame["name"].tolist(), [list(map(float, d)) for d in frame["data"]]))
            held = sorted(held, key=lambda r: r[0])[-depth:]
            state.update(tuple(map(list, zip(*held))))
            yield pd.DataFrame({"topic": [key[0]], "rows": [[{"ts": t, "name": n, "data": d} for t, n, d in held]]})

        return self.df.groupBy("topic").applyInPandasWithState(run, schema, "ts array<double>, name array<string>, data array<array<double>>", "update", GroupStateTimeout.NoTimeout)

    def event_windows(self, width: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
        """Counts, first and last time by topic and window of event time; late rows within the watermark count."""
        timed = self.df.withColumn("event_time", F.timestamp_seconds("ts"))
        timed = timed.withWatermark("event_time", watermark) if self.df.isStreaming else timed
        window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
        return timed.groupBy("topic", window.alias("window")).agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def source_pipeline(df: DataFrame, topics=None) -> SourcePipeline:
    """A pipeline over messages in the model (a stream must be in it), or any batch that can be brought into it."""
    model = {"topic", "seq", "ts", "name", "data", "shape"} <= set(df.columns)
    return SourcePipeline(df if model or df.isStreaming else normalize_messages(df), topics)


def arrival_index(df: DataFrame) -> DataFrame:
    """seq for messages without one, by time within each topic."""
    return positions(df.drop("seq"), ["topic"], ["ts", "name"], "seq")


def nearest_buffered(column: Column, at: Column) -> Column:
    """Of an array of structs with ts the one nearest to a time, the first on a tie."""
    ranked = F.transform(column, lambda x, i: F.struct(F.abs(x["ts"] - at).alias("distance"), i.alias("place")))
    return F.get(column, F.array_min(ranked)["place"])
