"""Composition of the lockout's state over chunks of time of one key.

The state (count, start, locked) is renewed at an attempt that is not rejected and lies beyond the window: whatever came before, the
attempt then starts a window of its own. So all that a chunk can leave behind follows from the renewal it is left from, and a chunk
longer than window and lockout together can only be entered with a state that its direct predecessor may leave behind:

  1. each chunk lists the states that it leaves behind from a renewal at any of its attempts, as far as they outlive it;
  2. each chunk maps every state that its predecessor lists, the empty one among them, to the state it leaves behind;
  3. chunks whose predecessor lists nothing are entered empty; from them the maps are followed by doubling, in as many rounds as the
     logarithm of the longest row of chunks.

All of it is grouped by key and chunk. Times are microseconds; the empty state is (0, 0, 0).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize

STATE = ["count", "start", "locked"]
NODE = ["key", "chunk", *STATE]


class Limits(NamedTuple):
    max_attempts: int
    window: int
    lockout: int


def chunked(attempts: DataFrame, limits: Limits, length: int) -> DataFrame:
    """The attempts (key, ts, event_id, kind), stored, with the number of their chunk of time."""
    if length <= limits.window + limits.lockout:
        raise ValueError("a chunk must be longer than window and lockout together")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return materialize(attempts.select("key", "ts", "event_id", "kind", F.floor(at / length).cast("long").alias("chunk")), "attempts")


class Chunk:
    """The attempts of one key and chunk in order, and where states lead in them."""

    def __init__(self, pdf: pd.DataFrame, limits: Limits, length: int):
        pdf = pdf.sort_values(["ts", "event_id"], kind="mergesort")
        self.limits = limits
        self.time = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        self.end = (int(pdf["chunk"].iloc[0]) + 1) * length
        failed = (pdf["kind"] == "failure").to_numpy()
        n = len(failed)
        self.failures = np.append(np.flatnonzero(failed), n)
        self.failed_before = np.append(0, np.cumsum(failed))
        successes = np.append(np.flatnonzero(~failed), n)
        self.next_success = successes[np.searchsorted(successes, np.arange(n + 1))]

    def until_renewal(self, place, count, start):
        """For each unlocked state at an attempt's place: the place of the next renewal, or else the number of attempts, and the state
        at the chunk's end should there be none."""
        n, limits = len(self.time), self.limits
        place, count, start = (np.asarray(x, np.int64).copy() for x in (place, count, start))
        renewal, locked = np.full(len(place), n), np.zeros(len(place), np.int64)
        beyond = np.searchsorted(self.time, start + limits.window, "right")
        going = np.flatnonzero(place < n)
        while len(going):
            p, b = place[going], beyond[going]
            success = self.next_success[p]
            wanted = self.failed_before[p] + limits.max_attempts - count[going] - 1
            failure = self.failures[np.minimum(wanted, len(self.failures) - 1)]
            first = np.minimum(np.maximum(b, p), np.minimum(success, failure))
            ended = first == n
            outside = ~ended & (first == np.maximum(b, p))
            reset = ~ended & ~outside & (first == success)
            lock = ~ended & ~outside & ~reset
            count[going[ended]] += self.failed_before[n] - self.failed_before[p[ended]]
            renewal[going[outside]] = first[outside]
            renewal[going[reset]] = first[reset] + 1
            count[going[reset]], start[going[reset]] = 0, 0
            shut = going[lock]
            locked[shut], count[shut] = self.time[first[lock]] + limits.lockout, 0
            place[shut] = np.maximum(np.searchsorted(self.time, locked[shut]), first[lock] + 1)
            # a lock that ends within the window leaves the window running
            going = shut[place[shut] < n]
            locked[going] = 0
        return renewal, np.stack([count, start, locked], 1)

    def alive(self, states: np.ndarray) -> np.ndarray:
        """The states at the chunk's end, those that can't outlive it empty."""
        lasting = (states[:, 1] + self.limits.window >= self.end) | (states[:, 2] > self.end)
        return np.where(lasting[:, None], states, 0)

    def left_from_renewals(self) -> np.ndarray:
        """The state left behind when there is a renewal at each attempt; last the empty one."""
        n = len(self.time)
        after, state = self.until_renewal(np.arange(n), np.zeros(n), self.time)
        after, state = np.append(after, n), np.append(self.alive(state), np.zeros((1, 3), np.int64), 0)
        last = np.where(after < n, after, np.arange(n + 1))
        while ((further := last[last]) != last).any():
            last = further
        return state[last]

    def left_from(self, states: np.ndarray) -> np.ndarray:
        """The state left behind by each state that the chunk is entered with."""
        n = len(self.time)
        count, start, locked = states.T
        place = np.searchsorted(self.time, locked)
        renewal, state = self.until_renewal(place, count, start)
        state[place == n] = states[place == n]
        of = self.left_from_renewals()
        return np.where((renewal < n)[:, None], of[np.minimum(renewal, n)], self.alive(state))


def _on(left: DataFrame, right: DataFrame, columns: dict):
    """Equality of left and right columns; attempts without a key are a key like any other."""
    return reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in columns.items()])


def _rows(pdf: pd.DataFrame, step: int, **columns) -> pd.DataFrame:
    """Rows of the group's key and chunk, the chunk moved on by ``step``."""
    out = pd.DataFrame(columns)
    out.insert(0, "key", pdf["key"].iloc[0])
    out.insert(1, "chunk", pdf["chunk"].iloc[0] + step)
    return out


def _named(states: np.ndarray, end: str = "") -> dict:
    return {c + end: states[:, i] for i, c in enumerate(STATE)}


def entry_states(attempts: DataFrame, limits: Limits, length: int) -> DataFrame:
    """(key, chunk, count, start, locked) of each chunk that its direct predecessor may leave a state for; all others are entered empty."""
    def listed(pdf: pd.DataFrame) -> pd.DataFrame:
        left = Chunk(pdf, limits, length).left_from_renewals()
        states = np.unique(left, axis=0)
        if not states.any():
            states = states[:0]
        # an empty chunk entry is a renewal at the first attempt
        return _rows(pdf, 1, **_named(states), entered_empty=(states == left[0]).all(axis=1))

    def mapped(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(entries):
            return pd.DataFrame({c: [] for c in [*NODE, *[c + "2" for c in STATE]]})
        states = entries[STATE].to_numpy(np.int64)
        return _rows(pdf, 0, **_named(states), **_named(Chunk(pdf, limits, length).left_from(states), "2"))

    node = ", ".join(f"{c} long" for c in NODE)
    lists = materialize(attempts.groupBy("key", "chunk").applyInPandas(listed, node + ", entered_empty boolean"), "lockout-lists")
    asked = lists.select(F.col("key").alias("_key"), F.col("chunk").alias("_chunk")).distinct()
    here = {"key": "_key", "chunk": "_chunk"}
    first = lists.filter("entered_empty").withColumn("before", F.col("chunk") - 1)
    reached = first.join(asked, _on(first, asked, {"key": "_key", "before": "_chunk"}), "left_anti").select(*NODE)
    inner = attempts.join(asked, _on(attempts, asked, here), "left_semi")
    steps = (inner.groupBy("key", "chunk").cogroup(lists.groupBy("key", "chunk"))
             .applyInPandas(mapped, node + ", " + ", ".join(f"{c}2 long" for c in STATE)).withColumn("chunk2", F.col("chunk") + 1))
    steps = materialize(steps.join(asked, _on(steps, asked, {"key": "_key", "chunk2": "_chunk"}), "left_semi"), "lockout-steps")
    reached = materialize(reached, "lockout-entries")
    target = ["chunk2", *[c + "2" for c in STATE]]
    while not steps.isEmpty():
        further = steps.select(*[F.col(c).alias("_" + c) for c in [*NODE, *target]])
        onward = reached.join(further, _on(reached, further, {c: "_" + c for c in NODE}))
        onward = onward.select("key", *[F.col("_" + t).alias(c) for t, c in zip(target, NODE[1:])])
        reached = materialize(reached.unionByName(onward), "lockout-entries")
        pairs = steps.join(further, _on(steps, further, {"key": "_key", **{t: "_" + c for t, c in zip(target, NODE[1:])}}))
        steps = materialize(pairs.select(*NODE, *[F.col("_" + t).alias(t) for t in target]), "lockout-steps")
    return reached
