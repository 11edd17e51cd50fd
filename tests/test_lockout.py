"""The lockout folded chunk by chunk equals one fold over the whole key, for keys that never pause."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.streaming import lockout as LK
from cohortlab.streaming import transfer as TR

START = dt.datetime(2024, 3, 1, 0, 0, 7)


def _events(rng, n, gaps, errors, user=1):
    at = START + pd.to_timedelta(np.cumsum(rng.choice(gaps, n)), unit="s")
    return pd.DataFrame({"event_id": np.arange(n), "ts": at, "user_id": user,
                         "event_type": np.where(rng.random(n) < errors, "error", "purchase")})


def _folded(pdf, limits):
    a = pdf.assign(kind=np.where(pdf["event_type"] == "error", "failure", "success"))
    rows, _ = LK.fold(a, (0, 0, 0), *limits)
    return [(r[0], r[2], r[3]) for r in rows]


@pytest.mark.parametrize("limits", [(5, 60, 300), (3, 60, 20), (1, 60, 300), (2, 30, 0), (4, 100, 7)])
def test_left_states_equal_the_fold(limits):
    """Transfer functions against the fold itself, for every state that a predecessor lists."""
    rng = np.random.default_rng(sum(limits))
    micros = TR.Limits(limits[0], limits[1] * 1_000_000, limits[2] * 1_000_000)
    length = 400_000_000
    for trial in range(60):
        pdf = _events(rng, 150, [0, 0.5, 1, 7, 30, 31][: 3 + trial % 4], [0.5, 0.8, 0.95, 1.0][trial % 4])
        pdf = pdf.assign(kind=np.where(pdf["event_type"] == "error", "failure", "success"))
        pdf["chunk"] = pdf["ts"].astype("datetime64[us]").astype("int64") // length
        left, state = np.zeros((1, 3), np.int64), (0, 0, 0)
        for _, part in pdf.groupby("chunk"):
            chunk = TR.Chunk(part, micros, length)
            for entry, end in zip(left, chunk.left_from(left)):
                _, want = LK.fold(part, tuple(int(x) for x in entry), *limits)
                # a lock that has run out, and a window that has, are the empty state
                assert tuple(chunk.alive(np.array([want], np.int64))[0]) == tuple(end), (limits, trial)
            before = state
            _, state = LK.fold(part, before, *limits)
            left = np.unique(np.append(chunk.left_from_renewals(), np.zeros((1, 3), np.int64), 0), axis=0)
            assert (left == chunk.alive(np.array([state], np.int64))[0]).all(axis=1).any()


def test_one_unbroken_key_in_chunks(spark):
    """A key without a pause in 40 chunks, beside others and one without a name: equal to the fold, and no task holds more than a chunk."""
    rng = np.random.default_rng(3)
    parts = [_events(rng, 4000, [0, 3, 9], 0.97), _events(rng, 300, [1, 50, 90], 0.9, 2), _events(rng, 300, [1, 400], 0.9, 3)]
    pdf = pd.concat(parts, ignore_index=True).assign(event_id=lambda x: np.arange(len(x)))
    ev = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("user_id", F.expr("nullif(user_id, 3)"))
    got = LK.failed_attempt_lockout(ev, chunk=400).select("key", "ts", "outcome", "fail_count").toPandas()
    for user, rows in pdf.groupby("user_id"):
        mine = got[got["key"].isna()] if user == 3 else got[got["key"] == user]
        assert sorted(zip(mine["ts"], mine["outcome"], mine["fail_count"])) == sorted(_folded(rows, (5, 60, 300)))
    assert set(got["outcome"]) == {"failure", "locked", "rejected", "success"}
    sizes = TR.chunked(LK.attempts(ev), TR.Limits(5, 60_000_000, 300_000_000), 400_000_000).groupBy("key", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < len(parts[0]) / 10


def test_chunk_length_and_empty_table(spark):
    ev = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert LK.failed_attempt_lockout(ev).count() == 0
    with pytest.raises(ValueError):
        LK.failed_attempt_lockout(ev, chunk=360)


def test_short_keys_are_folded_in_order(spark, monkeypatch):
    """Short keys need no chunk tables; with a longer key among them, whole or in chunks, every outcome equals the fold."""
    rng = np.random.default_rng(5)
    parts = [_events(rng, n, [0, 3, 50, 90, 400], 0.9, user) for user, n in enumerate([900, *[40] * 30])]
    pdf = pd.concat(parts, ignore_index=True).assign(event_id=lambda x: np.arange(len(x)))
    ev = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("user_id", F.expr("nullif(user_id, 3)")).repartition(5)
    want = sorted((-1 if user == 3 else user, *r) for user, rows in pdf.groupby("user_id") for r in _folded(rows, (5, 60, 300)))
    mixed = LK.failed_attempt_lockout(ev, whole=500)
    monkeypatch.setattr(TR, "entry_states", lambda *_: pytest.fail("no key is long enough for chunks"))
    for got in (mixed, LK.failed_attempt_lockout(ev)):
        rows = got.select(F.coalesce("key", F.lit(-1)).alias("key"), "ts", "outcome", "fail_count", "locked_until").toPandas()
        assert sorted(zip(rows["key"], rows["ts"], rows["outcome"], rows["fail_count"])) == want
        assert (rows["locked_until"].notna() == rows["outcome"].isin(["locked", "rejected"])).all()
