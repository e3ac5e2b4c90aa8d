"""Live watch on Structured Streaming: classify, batch alerts, windowed alert counts."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opslake.functions.redact import collapse_repeats, sanitise_line
from opslake.functions.text import blank, once
from opslake.operators.batching import MAX_LINES, SILENCE_SECONDS, first_boundary, next_batch_start

BATCH_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("service", T.StringType()),
    T.StructField("batch_no", T.LongType()), T.StructField("n_lines", T.LongType()),
    T.StructField("n_alerts", T.LongType()), T.StructField("first_seq", T.LongType()),
    T.StructField("last_seq", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("text", T.StringType()),
])
ROW_SCHEMA = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("tagged", T.StringType()), T.StructField("alert", T.BooleanType())])
HEAD_SCHEMA = T.StructType([
    T.StructField("batch_no", T.LongType()), T.StructField("last_us", T.LongType()),
    T.StructField("next_us", T.LongType()), T.StructField("timer_ms", T.LongType())])

#: The store that keeps list state, so that rows are appended and not written anew with all others.
LIST_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def classify_stream(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Sanitised, tagged lines; blank input and blank results are dropped."""
    return once(df.filter(~blank(F.col(raw))), "tagged", sanitise_line(F.col(raw))).filter(F.col("tagged") != "")


class AlertBatches(StatefulProcessor):
    """Alert batches of one key, folded in order of (ts, seq) behind the watermark.

    State of a key: a list of rows that wait for the watermark, a list of the lines of the open
    batch, and a short head (batch number, last line, earliest waiting row, timer). Waiting rows are
    appended; the list is written anew only when some of them leave it. Rows that leave are
    stepped through batch by batch, not line by line.
    """

    def __init__(self, max_lines: int, silence_us: int, late_us: int):
        self.max_lines, self.silence, self.late = max_lines, silence_us, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD_SCHEMA)
        self.open = handle.getListState("open", ROW_SCHEMA)
        self.waiting = handle.getListState("waiting", ROW_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            stamps = part["ts"].astype("datetime64[us]").astype("int64")
            new.append(pd.DataFrame({"us": stamps, "seq": part["seq"], "tagged": part["tagged"], "alert": part["alert"]}))
        yield from self._advance(key, pd.concat(new, ignore_index=True), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, _frame([]), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _advance(self, key, new: pd.DataFrame, watermark_ms: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        number, last_us, next_us, timer = self.head.get() if self.head.exists() else (1, 0, None, None)
        # the watermark will stand at least this high before another row of the key is let in
        passed = max(watermark_ms * 1000, int(new["us"].max()) - self.late if len(new) else 0)
        first = min([t for t in (int(new["us"].min()) if len(new) else None, next_us) if t is not None], default=None)
        out, ended = [], False
        if first is None or first > passed:
            ready = _frame([])
            if len(new):
                self.waiting.appendList(_tuples(new))
            next_us = first
        else:
            held = _frame(list(self.waiting.get())) if next_us is not None else _frame([])
            # of equal times the end marker comes last
            every = pd.concat([held, new], ignore_index=True) if len(held) else new
            every = every.assign(ends=every["tagged"].isna()).sort_values(["us", "ends", "seq"], kind="stable")
            ready, rest = every[every["us"] <= passed], every[every["us"] > passed]
            if len(rest):
                self.waiting.put(_tuples(rest))
            elif len(held):
                self.waiting.clear()
            next_us = int(rest["us"].iloc[0]) if len(rest) else None
        lines = _frame(list(self.open.get())) if self.open.exists() else _frame([])
        before = len(lines)
        ends = np.flatnonzero(ready["tagged"].isna().to_numpy())
        for lo, hi in zip([0, *(ends + 1)], [*ends, len(ready)]):
            part = ready.iloc[lo:hi]
            if len(part):
                lines, number, done = self._step(lines, part, number, last_us)
                before, ended = -1, False
                last_us = max(last_us, int(part["us"].iloc[-1]))
                out += done
            if hi < len(ready):  # an end marker
                lines, number, done = self._flush(lines, number, "shutdown")
                before, ended = -1, True
                out += done
        alerting = bool(len(lines)) and bool(lines["alert"].any())
        if alerting and last_us + self.silence <= passed:
            # an end marker that waits will say shutdown, if it is the next row
            nxt = _frame(list(self.waiting.get())).assign(ends=lambda d: d["tagged"].isna()).sort_values(
                ["us", "ends", "seq"]) if next_us is not None else _frame([])
            if not len(nxt) or nxt["tagged"].notna().iloc[0]:
                lines, number, done = self._flush(lines, number, "silence")
                before, alerting = -1, False
                out += done
        if before != len(lines):
            self.open.put(_tuples(lines)) if len(lines) else self.open.clear()
        if timer is not None and timer != fired:
            self.handle.deleteTimer(timer)
        if ended and next_us is None:
            self.head.clear()
        else:
            due = [t for t in (next_us, last_us + self.silence if alerting else None) if t is not None]
            timer = max(-(-min(due) // 1000), watermark_ms + 1) if due else None
            if timer is not None:
                self.handle.registerTimer(timer)
            self.head.update((number, last_us, next_us, timer))
        rows = [(*key, *b) for b in out]
        for at in range(0, len(rows), OUT_ROWS):
            yield pd.DataFrame(rows[at:at + OUT_ROWS], columns=BATCH_SCHEMA.names)

    def _step(self, lines: pd.DataFrame, rows: pd.DataFrame, number: int, last_us: int):
        """The open batch after ``rows``, and the batches they close."""
        ts, alert = rows["us"].to_numpy(), rows["alert"].to_numpy(dtype=bool)
        done = []
        if len(lines) and lines["alert"].any() and ts[0] - last_us >= self.silence:
            lines, number, done = self._flush(lines, number, "silence")
        n = len(ts)
        nxt, next_quiet, next_alert = next_batch_start(ts, alert, self.max_lines, self.silence)
        has_alert = bool(alert[0]) or (bool(len(lines)) and bool(lines["alert"].any()))
        stop = first_boundary(len(lines) + 1, has_alert, next_quiet, next_alert, self.max_lines)
        start = 0
        while True:
            stop = min(stop, n)
            lines = pd.concat([lines, rows.iloc[start:stop]], ignore_index=True) if len(lines) else rows.iloc[start:stop]
            if stop == n and len(lines) < self.max_lines:
                return lines[ROW_SCHEMA.names], number, done
            lines, number, closed = self._flush(lines, number, "full" if len(lines) >= self.max_lines else "silence")
            done += closed
            if stop == n:
                return lines, number, done
            start, stop = stop, int(nxt[stop])

    @staticmethod
    def _flush(lines: pd.DataFrame, number: int, reason: str):
        n_alerts = int(lines["alert"].sum()) if len(lines) else 0
        closed = [(number, len(lines), n_alerts, int(lines["seq"].min()), int(lines["seq"].max()), reason,
                   "\n".join(lines["tagged"]))] if n_alerts else []
        return _frame([]), number + (len(lines) > 0), closed


#: Batches handed on at a time.
OUT_ROWS = 10_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in rows], columns=ROW_SCHEMA.names)


def _tuples(rows: pd.DataFrame) -> list[tuple]:
    columns = (rows[c].tolist() for c in ("us", "seq", "tagged", "alert"))
    return [(us, seq, None if tagged is None or tagged != tagged else tagged, bool(alert)) for us, seq, tagged, alert in zip(*columns)]


def batch_alert_stream(df: DataFrame, max_lines: int = MAX_LINES,
                       silence_seconds: float = SILENCE_SECONDS, late_seconds: int = 60) -> DataFrame:
    """Alert batches of a classified stream with (host, service, seq, ts timestamp, tagged, alert).

    Rows wait until the watermark has passed them and are then taken in order of (ts, seq), so
    micro-batches and their order do not change the batches; later rows are dropped
    (``late_rows`` counts them). A batch with an alert is flushed by the row that follows a silence, or by the
    watermark passing the silence. A row whose ``tagged`` is null is an end marker: it flushes what is
    left and the key's state goes. State of a key is at most ``max_lines`` lines, and the rows of the
    last ``late_seconds``. The session's state store is set to one that keeps lists.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", LIST_STATE_STORE)
    folded = AlertBatches(max_lines, int(silence_seconds * 1_000_000), late_seconds * 1_000_000)
    batches = df.withWatermark("ts", f"{late_seconds} seconds").groupBy("host", "service").transformWithStateInPandas(
        folded, BATCH_SCHEMA, "append", "EventTime")
    return batches.withColumn("text", collapse_repeats(F.col("text")))


def end_markers(keys: DataFrame, last: datetime.datetime, late_seconds: int = 60) -> DataFrame:
    """Rows that end the stream of every (host, service), and one that moves the watermark past them."""
    end = last + datetime.timedelta(days=1)
    row = lambda df, at: df.select(
        "host", "service", F.lit(1 << 62).cast("long").alias("seq"), F.lit(at).cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("tagged"), F.lit(False).alias("alert"))
    beyond = keys.sparkSession.range(1).select(F.lit("").alias("host"), F.lit("").alias("service"))
    return row(keys.select("host", "service").distinct(), end).unionByName(
        row(beyond, end + datetime.timedelta(seconds=late_seconds + 1)))


def with_seed(seed: DataFrame, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that puts the seed lines in front of the first micro-batch."""
    def run(df: DataFrame, epoch: int) -> None:
        handle(seed.select(*df.columns).unionByName(df) if epoch == 0 else df, epoch)
    return run


def tumbling_alerts(df: DataFrame, size: str, alert: Column, late: str = "1 hour") -> DataFrame:
    return _windowed(df, F.window("ts", size), alert, late)


def sliding_alerts(df: DataFrame, size: str, slide: str, alert: Column, late: str = "1 hour") -> DataFrame:
    return _windowed(df, F.window("ts", size, slide), alert, late)


def session_alerts(df: DataFrame, gap: str, key: str, alert: Column, late: str = "1 hour") -> DataFrame:
    """Sessions per key; lines exactly ``gap`` apart are one session."""
    return _windowed(df, F.session_window("ts", gap), alert, late, key)


def _windowed(df: DataFrame, win: Column, alert: Column, late: str, *keys: str) -> DataFrame:
    counted = df.withWatermark("ts", late).groupBy(win.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(alert).alias("n_alerts"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "n_lines", "n_alerts")


def run_available(df: DataFrame, path: str) -> DataFrame:
    """Run a stream over everything available now and return what it appended under ``path``."""
    spark: SparkSession = df.sparkSession
    out = f"{path}/out"
    (df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
     .format("parquet").option("path", out).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(out)
