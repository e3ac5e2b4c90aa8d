"""Alert batching of an ordered log: the batch form of the live watch.

A batch closes when it holds ``max_lines`` lines, or when it holds an alert and the next
line comes ``silence`` or more after the last one. Batches without an alert are dropped.
The state after a line is (line count, has alert), so a long stream is cut into time
slices, each slice is reduced to what it does to every possible entry state, and those
small tables are chained per key. No task ever holds more than one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.redact import collapse_repeats
from opslake.plans.partitioning import balanced_chunks, last_per_group
from opslake.plans.session import materialise

# Watch defaults.
MAX_LINES = 50
SILENCE_SECONDS = 3.0
SEED_LINES = 20

CHUNK_ROWS = 500_000


def seed_lines(df: DataFrame, keys: Sequence[str], n: int = 0) -> DataFrame:
    """Lines shown before following starts; zero or less means the default."""
    return last_per_group(df, keys, ("ts", "seq"), n if n > 0 else SEED_LINES)


def next_batch_start(ts: np.ndarray, alert: np.ndarray, max_lines: int, silence: int):
    """For each row, where the following batch starts if one starts at this row.

    Also returns, for each row, the first later row that follows a silence.
    """
    n = len(ts)
    at = np.arange(n)
    quiet = np.zeros(n, dtype=bool)
    quiet[1:] = np.diff(ts) >= silence

    def first_from(flag: np.ndarray) -> np.ndarray:
        hit = np.where(flag, at, n)
        return np.append(np.minimum.accumulate(hit[::-1])[::-1], [n, n])

    next_quiet, next_alert = first_from(quiet), first_from(alert)
    silent = next_quiet[np.minimum(next_alert + 1, n)]
    return np.minimum(at + max_lines, silent[:n]), next_quiet, next_alert


def first_boundary(count: int, has_alert: bool, next_quiet, next_alert, max_lines: int) -> int:
    """First row after row 0 that starts a batch, given the state that includes row 0."""
    n = len(next_quiet) - 2
    if has_alert:
        silent = next_quiet[1]
    else:
        silent = next_quiet[min(next_alert[1] + 1, n)]
    return int(min(max_lines - count + 1, silent))


def _sorted(pdf: pd.DataFrame):
    pdf = pdf.sort_values(["us", "seq"], kind="stable")
    return pdf, pdf["us"].to_numpy(), pdf["alert"].to_numpy(dtype=bool)


def _slice_effect(keys: Sequence[str], max_lines: int, silence: int):
    """Per slice: exit state and batches opened for every entry state."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ts, alert = _sorted(pdf)
        n = len(ts)
        nxt, next_quiet, next_alert = next_batch_start(ts, alert, max_lines, silence)
        # last batch start reached from each row, and batches opened on the way, by pointer doubling
        last, opened = np.where(nxt < n, nxt, np.arange(n)), (nxt < n).astype(np.int64)
        while (last[last] != last).any():
            opened, last = opened + opened[last], last[last]
        alerts_from = np.append(np.cumsum(alert[::-1])[::-1], 0) > 0
        exit_n, exit_alert, n_opened = [], [], []
        for count in range(1, max_lines + 1):
            for has_alert in (False, True):
                f = first_boundary(count, has_alert, next_quiet, next_alert, max_lines)
                if f >= n:
                    exit_n.append(count + n - 1)
                    exit_alert.append(bool(has_alert or alerts_from[1]))
                    n_opened.append(0)
                else:
                    exit_n.append(int(n - last[f]))
                    exit_alert.append(bool(alerts_from[last[f]]))
                    n_opened.append(int(opened[f]) + 1)
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(chunk=int(pdf["chunk"].iloc[0]), first_us=int(ts[0]), last_us=int(ts[-1]),
                   first_alert=bool(alert[0]), exit_n=exit_n, exit_alert=exit_alert, opened=n_opened)
        return pd.DataFrame([row])
    return run


def _chain(keys: Sequence[str], max_lines: int, silence: int):
    """Entry state of every slice of one key, from the slices' effects in time order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        out, state = [], None
        for r in pdf.itertuples():
            if state is None:
                count, has_alert, number = 1, r.first_alert, 1
            else:
                count, has_alert, last_us, number = state
                if count >= max_lines or (has_alert and r.first_us - last_us >= silence):
                    count, has_alert, number = 1, r.first_alert, number + 1
                else:
                    count, has_alert = count + 1, has_alert or r.first_alert
            row = {k: getattr(r, k) for k in keys}
            out.append(dict(row, chunk=r.chunk, entry_n=count, entry_alert=bool(has_alert), entry_batch=number))
            i = (count - 1) * 2 + int(has_alert)
            state = (r.exit_n[i], r.exit_alert[i], r.last_us, number + r.opened[i])
        return pd.DataFrame(out)
    return run


def _number(kept: Sequence[str], max_lines: int, silence: int):
    """Batch number of every row of one slice, given its entry state."""
    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({c: [] for c in [*kept, "batch_no"]})
        pdf, ts, alert = _sorted(pdf)
        n = len(ts)
        if entry.empty:
            count, has_alert, number = 1, bool(alert[0]), 1
        else:
            e = entry.iloc[0]
            count, has_alert, number = int(e.entry_n), bool(e.entry_alert), int(e.entry_batch)
        nxt, next_quiet, next_alert = next_batch_start(ts, alert, max_lines, silence)
        starts = np.zeros(n, dtype=np.int64)
        i = first_boundary(count, has_alert, next_quiet, next_alert, max_lines)
        while i < n:
            starts[i] = 1
            i = int(nxt[i])
        return pdf[kept].assign(batch_no=number + np.cumsum(starts))
    return run


def number_batches(df: DataFrame, keys: Sequence[str], alert: Column, max_lines: int = MAX_LINES,
                   silence_seconds: float = SILENCE_SECONDS, chunk_rows: int = CHUNK_ROWS,
                   ts: str = "ts") -> DataFrame:
    """(keys, seq, us, alert, batch_no) for every line; ``seq`` is unique per key and orders equal times.

    Three passes need the lines, so the few columns they use are written once first; the
    alert test, and the redaction below it, does not run again.
    """
    keys = list(keys)
    silence = int(silence_seconds * 1_000_000)
    slim = materialise(df.select(*keys, "seq", F.col(ts).alias("_ts"), alert.alias("alert")), "watch-lines")
    cut = balanced_chunks(slim, keys, ["_ts", "seq"], chunk_rows).select(
        *keys, "seq", "alert", "chunk", "chunks_many",
        F.unix_micros(F.col("_ts").cast("timestamp")).alias("us"))
    key_fields = [cut.schema[k] for k in keys]
    effect_schema = T.StructType(key_fields + [
        T.StructField("chunk", T.LongType()), T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()), T.StructField("first_alert", T.BooleanType()),
        T.StructField("exit_n", T.ArrayType(T.IntegerType())),
        T.StructField("exit_alert", T.ArrayType(T.BooleanType())),
        T.StructField("opened", T.ArrayType(T.LongType()))])
    entry_schema = T.StructType(key_fields + [
        T.StructField("chunk", T.LongType()), T.StructField("entry_n", T.LongType()),
        T.StructField("entry_alert", T.BooleanType()), T.StructField("entry_batch", T.LongType())])
    kept = [*keys, "seq", "us", "alert"]
    out_schema = T.StructType([cut.schema[c] for c in kept] + [T.StructField("batch_no", T.LongType())])

    rows = cut.drop("chunks_many")
    entries = (
        cut.filter("chunks_many").select(*keys, "seq", "us", "alert", "chunk")
        .groupBy(*keys, "chunk").applyInPandas(_slice_effect(keys, max_lines, silence), effect_schema)
        .groupBy(*keys).applyInPandas(_chain(keys, max_lines, silence), entry_schema))
    return rows.groupBy(*keys, "chunk").cogroup(entries.groupBy(*keys, "chunk")).applyInPandas(
        _number(kept, max_lines, silence), out_schema)


def alert_batches(df: DataFrame, keys: Sequence[str], alert: Column, max_lines: int = MAX_LINES,
                  silence_seconds: float = SILENCE_SECONDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Batches that hold an alert, with the reason they were flushed."""
    keys = list(keys)
    numbered = number_batches(df, keys, alert, max_lines, silence_seconds, chunk_rows)
    batches = numbered.groupBy(*keys, "batch_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("alert").alias("n_alerts"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    final = batches.groupBy(*keys).agg(F.max("batch_no").alias("_final"))
    return batches.join(final, keys).filter("n_alerts > 0").select(
        *keys, "batch_no", "n_lines", "n_alerts", "first_seq", "last_seq",
        F.when(F.col("n_lines") >= max_lines, "full").when(F.col("batch_no") == F.col("_final"), "shutdown")
        .otherwise("silence").alias("reason"))


def alert_batch_texts(df: DataFrame, keys: Sequence[str], alert: Column, line: str,
                      max_lines: int = MAX_LINES, silence_seconds: float = SILENCE_SECONDS,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The text of each alert batch with repeats collapsed; at most ``max_lines`` lines each."""
    keys = list(keys)
    numbered = number_batches(df, keys, alert, max_lines, silence_seconds, chunk_rows)
    alerting = numbered.groupBy(*keys, "batch_no").agg(F.bool_or("alert").alias("_any")).filter("_any")
    wanted = numbered.join(alerting, [*keys, "batch_no"], "left_semi").select(*keys, "seq", "us", "batch_no")
    grouped = df.select(*keys, "seq", line).join(wanted, [*keys, "seq"]).groupBy(*keys, "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("us", "seq", line))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r[line]), "\n")
    return grouped.select(*keys, "batch_no", collapse_repeats(text).alias("text"))
