"""Failed-attempt lockout (X1): the login limiter re-aimed as event-log analysis.

Per key, in time order, with state (count, window_start, locked_until):
  * an attempt while ``ts < locked_until`` is rejected and changes nothing;
  * otherwise, if ``ts − window_start > window`` the count restarts and the window starts at ts;
  * a failure adds one; reaching ``max_attempts`` locks the key for ``lockout`` seconds and
    zeroes the count; a success resets the whole state.
Batch: keys of up to ``WHOLE`` attempts are folded in order, many keys a task, which keeps only the state of the key it is at. The attempts of
longer keys are cut into chunks of time. Each chunk is a transfer function from the state it is entered with to the state
it leaves behind; the functions are composed by doubling and every chunk is folded on its own from its true entry
state (``transfer``), so no task holds more than one chunk of one key, however long the key goes on without a pause. Stream:
``applyInPandasWithState`` keeps the three numbers per key between micro-batches and drops them, by
an event-time timeout, once a pause longer than window and lockout lies behind the watermark; attempts older than the
watermark are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize
from cohortlab.streaming import transfer

OUT_SCHEMA = "key long, ts timestamp_ntz, kind string, outcome string, fail_count int, locked_until timestamp_ntz"
STATE_SCHEMA = "count int, window_start long, locked_until long"
#: Attempts of a key that one task folds in order; the attempts of longer keys are cut into chunks.
WHOLE = 100_000


def attempts(events: DataFrame, *extra: str) -> DataFrame:
    """Event log -> attempts: key = user, error = failure, purchase = success, others ignored."""
    kind = F.when(F.col("event_type") == "error", F.lit("failure")).when(F.col("event_type") == "purchase", F.lit("success"))
    return events.select(F.col("user_id").alias("key"), "ts", "event_id", kind.alias("kind"), *extra) \
        .filter(F.col("kind").isNotNull())


def fold(pdf: pd.DataFrame, state=(0, 0, 0), max_attempts: int = 5, window: int = 60, lockout: int = 300):
    """Fold one key's attempts (sorted here) from ``state``, whose times are microseconds; returns (rows, new state)."""
    pdf = pdf.sort_values(["ts", "event_id"], kind="mergesort")
    micros = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
    out = []
    for ts, t, kind in zip(pdf["ts"], micros, pdf["kind"]):
        outcome, state = step(t, kind, state, max_attempts, window * 1_000_000, lockout * 1_000_000)
        out.append((ts, kind, outcome, state[0], state[2]))
    return out, tuple(state)


def step(t: int, kind: str, state, max_attempts: int, window: int, lockout: int):
    """(outcome, new state) of an attempt at ``t``; all times are microseconds."""
    count, wstart, locked = state
    if t < locked:
        return "rejected", state
    if t - wstart > window:
        count, wstart = 0, t
    if kind != "failure":
        return "success", (0, 0, 0)
    if count + 1 >= max_attempts:
        return "locked", (0, wstart, t + lockout)
    return "failure", (count + 1, wstart, 0)


def fold_in_order(attempts: DataFrame, max_attempts: int, window: int, lockout: int) -> DataFrame:
    """The outcomes of keys that are each folded by one task; rows stream through it in order of key and time."""
    micros = (max_attempts, window * 1_000_000, lockout * 1_000_000)

    def folded(batches):
        import pyarrow as pa

        at, state = None, (0, 0, 0)
        for batch in batches:
            ts, outcomes, counts, until = batch.column("ts").cast(pa.timestamp("us")), [], [], []
            for key, t, kind in zip(batch.column("key").to_pylist(), ts.cast(pa.int64()).to_pylist(), batch.column("kind").to_pylist()):
                if key != at:
                    at, state = key, (0, 0, 0)
                outcome, state = step(t, kind, state, *micros)
                outcomes.append(outcome)
                counts.append(state[0])
                until.append(state[2] if state[2] > 0 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), ts, batch.column("kind"), pa.array(outcomes, pa.string()), pa.array(counts, pa.int32()),
                 pa.array(until, pa.int64()).cast(pa.timestamp("us"))], names=["key", "ts", "kind", "outcome", "fail_count", "locked_until"])

    rows = attempts.select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "kind")
    return rows.repartition("key").sortWithinPartitions("key", "ts", F.col("event_id").asc_nulls_last()).select("key", "ts", "kind") \
        .mapInArrow(folded, OUT_SCHEMA)


def _frame(key, rows) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["ts", "kind", "outcome", "fail_count", "locked_until"])
    df.insert(0, "key", key)
    df["locked_until"] = pd.to_datetime(df["locked_until"].where(df["locked_until"] > 0), unit="us").astype("datetime64[us]")
    df["fail_count"] = df["fail_count"].astype("int32")
    return df


def failed_attempt_lockout(events: DataFrame, max_attempts: int = 5, window: int = 60, lockout: int = 300,
                           chunk: int | None = None, whole: int | None = None) -> DataFrame:
    """Batch: every attempt with its outcome (failure / locked / rejected / success).

    Keys of up to ``whole`` attempts are folded in order (``WHOLE`` unless given, none if a chunk is). ``chunk`` is the length in seconds of the
    stretches of a longer key that tasks fold on their own; it must exceed window and lockout together, and is twice that or an hour unless given.
    Neither changes the result. Attempts without a time are left out; those without a key are one key; an empty table gives no row.
    """
    limits = transfer.Limits(max_attempts, window * 1_000_000, lockout * 1_000_000)
    length = (max(3600, 2 * (window + lockout)) if chunk is None else chunk) * 1_000_000
    whole = (WHOLE if chunk is None else 0) if whole is None else whole
    a = transfer.chunked(attempts(events).filter(F.col("ts").isNotNull()), limits, length)
    if not whole:
        return _by_chunk(a, limits, length)
    busy = materialize(a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).select(F.col("key").alias("_key")), "busy-keys")
    if busy.isEmpty():
        return fold_in_order(a, max_attempts, window, lockout)
    same = a["key"].eqNullSafe(busy["_key"])
    return fold_in_order(a.join(busy, same, "left_anti"), max_attempts, window, lockout) \
        .unionByName(_by_chunk(materialize(a.join(busy, same, "left_semi"), "busy-attempts"), limits, length))


def _by_chunk(a: DataFrame, limits: transfer.Limits, length: int) -> DataFrame:
    """The outcomes of attempts with their chunk, each chunk folded from its entry state."""
    entries = transfer.entry_states(a, limits, length)
    max_attempts, window, lockout = limits.max_attempts, limits.window // 1_000_000, limits.lockout // 1_000_000

    def per_chunk(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _frame(None, [])
        state = tuple(int(x) for x in entry[["count", "start", "locked"]].iloc[0]) if len(entry) else (0, 0, 0)
        key = pdf["key"].iloc[0]
        return _frame(None if pd.isna(key) else int(key), fold(pdf, state, max_attempts, window, lockout)[0])

    return a.groupBy("key", "chunk").cogroup(entries.groupBy("key", "chunk")).applyInPandas(per_chunk, OUT_SCHEMA)


def lockout_summary(outcomes: DataFrame) -> DataFrame:
    """Per key: attempts, failures, lockouts, rejected attempts."""
    return outcomes.groupBy("key").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum((F.col("kind") == "failure").cast("int")).alias("failures"),
        F.sum((F.col("outcome") == "locked").cast("int")).alias("lockouts"),
        F.sum((F.col("outcome") == "rejected").cast("int")).alias("rejected"))


def lockout_stream(stream: DataFrame, max_attempts: int = 5, window: int = 60, lockout: int = 300,
                   watermark: str = "10 minutes") -> DataFrame:
    """Streaming twin over an event stream with (event_id, ts, user_id, event_type)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        st = state.get if state.exists else (0, 0, 0)
        pdf = pd.concat(list(pdfs), ignore_index=True)
        rows, new = fold(pdf, tuple(st), max_attempts, window, lockout)
        state.update(new)
        last = int(pdf["event_time"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + max(window, lockout) * 1000, state.getCurrentWatermarkMs()) + 1)
        yield _frame(int(key[0]), rows)

    # watermarks need TIMESTAMP; the fold keeps the local (NTZ) event time
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    a = attempts(timed, "event_time")
    return a.groupBy("key").applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "append",
                                                  GroupStateTimeout.EventTimeTimeout)
