"""The incremental forms: file streams into tables, running statistics, ledgers, sessions and stateful filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from kinetable.operators.stats import blocks, merged
from kinetable.operators.tracks import OneEuro


def source(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def started(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Works through all that is there, in batches, and ends."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def appended(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Into a Parquet table, each file once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_stats(df: DataFrame, keys: list[str], value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Mergeable statistics of each batch, under its number: a repeated batch replaces itself, and ``whole_stats`` adds up."""
    return started(df, checkpoint, lambda batch, n: blocks(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={n}"))


def whole_stats(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return merged(spark.read.parquet(path).drop("batch"), keys)


def ledger(df: DataFrame, keys: list[str], event: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each event once among those that come within ``late`` of one another; see ``recorded`` for replays at any time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, event])


def recorded(df: DataFrame, keys: list[str], event: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each event of (keys, event) once, however late it is sent again, in the table at ``path``.

    Which events have been is state of the stream, by key: a batch looks up its own events only, and reads no history.
    The state is kept with the checkpoint, on disk with the RocksDB provider, and never forgets; ``ledger`` does, after a
    time.  Null keys are keys like any other.  A batch that is repeated replaces what it wrote before.
    """
    once = df.dropDuplicates([*keys, event])
    return started(once, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))


def first_uploads(df: DataFrame, digest: str, ts: str, window: str) -> DataFrame:
    """Uploads whose archive was not uploaded within the window before: state that expires with the watermark.  Uploads
    without a digest are never the same."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_same", F.coalesce(digest, F.expr("uuid()")))
    return timed.withWatermark(ts, window).dropDuplicatesWithinWatermark(["_same"]).drop("_same")


def totals(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(amount).alias("total"))


def tumbling(df: DataFrame, ts: str, width: str, late: str, keys: list[str] | None = None) -> DataFrame:
    own = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return own.groupBy(F.window(ts, width), *(keys or [])).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *(keys or []), "n")


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Events no more than ``gap`` apart as one session."""
    own = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return own.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def accounted(df: DataFrame, ts: str, start, end, path: str, checkpoint: str) -> StreamingQuery:
    """Samples within a recording into one table, how many fell outside of it, or have no time, into another."""

    def put(batch: DataFrame, n: int) -> None:
        inside = F.coalesce(F.col(ts).between(F.lit(start), F.lit(end)), F.lit(False))
        own = batch.persist()
        own.filter(inside).write.mode("overwrite").parquet(f"{path}/kept/batch={n}")
        own.filter(~inside).agg(F.count("*").alias("dropped")).write.mode("overwrite").parquet(f"{path}/dropped/batch={n}")
        own.unpersist()

    return started(df, checkpoint, put)


class _Smoothing(StatefulProcessor):
    """A One-Euro filter for each key, whose state lasts from batch to batch."""

    def __init__(self, key: str, time: str, value: str, params: dict) -> None:
        self.key, self.time, self.value, self.params = key, time, value, params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "x double, speed double, t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        x = pdf[self.value].to_numpy(float, na_value=np.nan)
        real = np.isfinite(x)
        held = tuple(self.state.get()) if self.state.exists() else None
        held, levels = OneEuro(**self.params).run(held, pdf[self.time].to_numpy(float)[real].tolist(), x[real].tolist(), [False] * int(real.sum()))
        if held is not None:
            self.state.update(tuple(float(v) for v in held))
        out = np.full(len(x), None, object)
        out[real] = levels
        yield pd.DataFrame({self.key: key[0], self.time: pdf[self.time].to_numpy(), "smooth": pd.Series(out, dtype=object)})

    def close(self) -> None:
        pass


def smoothing(df: DataFrame, key: str, time: str, value: str, **params) -> DataFrame:
    """Needs the RocksDB state store."""
    kinds = dict(df.dtypes)
    return df.groupBy(key).transformWithStateInPandas(_Smoothing(key, time, value, params), f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, smooth double", "Append", "None")


class _Gaps(StatefulProcessor):
    """Time lost beyond the nominal period for each key: the last reading and the sums last.

    Readings come in the order of ``order``; a backward step is a new beginning and is counted, time 0 is no reading.
    """

    def __init__(self, key: str, order: str, ts: str, nominal: float, least: float) -> None:
        self.key, self.order, self.ts, self.nominal, self.least = key, order, ts, nominal, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "last double, lost double, peak double, gaps long, resyncs long, readings long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, lost, peak, gaps, resyncs, readings = self.state.get() if self.state.exists() else (None, 0.0, None, 0, 0, 0)
        t = pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.ts].to_numpy(float, na_value=np.nan)
        t = t[np.isfinite(t) & (t != 0)]
        step = np.diff(t, prepend=np.nan if last is None else last)
        over = (step - self.nominal)[(step > 0) & (step - self.nominal >= self.least)]
        lost, gaps = lost + float(over.sum()), gaps + len(over)
        resyncs, readings = resyncs + int((step < 0).sum()), readings + len(t)
        peak = max([*([] if peak is None else [peak]), *over.tolist()], default=None)
        if len(t):
            self.state.update((float(t[-1]), lost, peak, gaps, resyncs, readings))
        yield pd.DataFrame({self.key: [key[0]], "readings": [readings], "gaps": [gaps], "lost": [lost], "peak": pd.Series([peak], dtype=object), "resyncs": [resyncs]})

    def close(self) -> None:
        pass


def gap_watch(df: DataFrame, key: str, order: str, ts: str, nominal: float, least: float) -> DataFrame:
    """The sums up to now of each key that a batch has rows of, as ``clocks.gap_watch`` gives them over all."""
    kind = dict(df.dtypes)[key]
    return df.groupBy(key).transformWithStateInPandas(_Gaps(key, order, ts, nominal, least), f"`{key}` {kind}, readings long, gaps long, lost double, peak double, resyncs long", "Update", "None")
