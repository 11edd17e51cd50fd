"""Toxicity by character n-grams scaled with naive Bayes log-count ratios.

A text's features are the distinct character n-grams it holds, hashed. Labelled texts give each
feature its log-count ratio between toxic and other texts; a logistic regression on the features, each
scaled by its ratio, is fitted to the same texts and scores every text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import TEXTS, packed, small_batches, store, unpacked
from cohortlab.llm.crf import minimise

ORDERS = (3, 4, 5)
HASH_BITS = 18
#: The classifier is fitted on about this many labelled texts, chosen by a hash of the id.
MAX_TRAIN_ROWS = 15_000
SMOOTHING, PENALTY, STEPS = 1.0, 1e-3, 40
#: The features of the texts to learn from, bounded as they are, are stored in so many parts; each step sends one sum of slopes a part.
PARTS = 8
#: A text is hashed in pieces of so many characters.
PIECE = 100_000


class Grams:
    """The distinct hashed n-grams of one text after another."""

    def __init__(self):
        self.place = np.zeros(1 << HASH_BITS, np.int64)
        self.seen = np.full(1 << HASH_BITS, -1, np.int64)
        self.text = -1

    def __call__(self, text: str) -> np.ndarray:
        self.text += 1
        code = np.frombuffer((" " + text.lower() + " " * max(ORDERS)).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = []
        for a in range(0, len(code) - max(ORDERS) + 1, PIECE):
            part = code[a:a + PIECE + max(ORDERS) - 1]
            n = len(part) - max(ORDERS) + 1
            h = np.zeros(n, np.uint32)
            every = []
            for j in range(max(ORDERS)):
                h = h * np.uint32(0x01000193) + part[j:j + n] + np.uint32(1)
                if j + 1 in ORDERS:
                    x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                    every.append(((x ^ (x >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS))
            x = np.concatenate(every)
            here = np.arange(len(x))
            self.place[x] = here
            x = x[self.place[x] == here]
            x = x[self.seen[x] != self.text]
            self.seen[x] = self.text
            out.append(x)
        return np.concatenate(out)


def pack_places(x: np.ndarray) -> bytes:
    """Hashed n-grams in two bytes each: how many fall into each stretch of 2^16 places, then their places in it."""
    x = np.sort(x)
    return np.bincount(x >> 16, minlength=1 << HASH_BITS - 16).astype(np.int32).tobytes() + x.astype(np.uint16).tobytes()


def unpack_places(packed: bytes) -> np.ndarray:
    """The n-grams of ``pack_places``, in ascending order."""
    head = 4 << HASH_BITS - 16
    stretch = np.frombuffer(packed[:head], np.int32)
    return np.repeat(np.arange(len(stretch), dtype=np.int32) << 16, stretch) + np.frombuffer(packed[head:], np.uint16)


def held_out() -> Column:
    """Every fifth id by crc32: its label is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(y, text), stored, of about ``max_rows`` labelled texts at most. A document with several labels counts as
    toxic when at least half of them say so; null labels and null ids don't count; equal rows count once."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(~held_out())
             .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y")))
    share = int(min(1.0, max_rows / max(1, known.count())) * 1_000_000)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").distinct()
    rows = store(rows.select("y", "text"), "toxic-train")
    found = rows.count()
    if found <= 2 * max_rows:
        return rows
    # one id with many texts
    return store(rows.filter(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1_000_000)) < int(max_rows / found * 1_000_000)), "toxic-train")


def _counts(batches):
    grams, counts, rows = Grams(), np.zeros((2, 1 << HASH_BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for y, text in zip(batch["y"], batch["text"]):
            counts[y][grams(text)] += 1
            rows[y] += 1
    if rows.sum():
        yield pd.DataFrame({"y": [0, 1], "rows": rows, "counts": [x.astype(np.int32).tobytes() for x in counts]})


def _added(key, group):
    total = np.zeros(1 << HASH_BITS, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x, np.int32)
    return pd.DataFrame({"y": [key[0]], "rows": [group["rows"].sum()], "counts": [total.tobytes()]})


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ratio and the number of texts of every feature, over all training texts. Each task adds up
    its own counts; what a task sends, and the result, has a fixed size."""
    added = (train.mapInPandas(_counts, "y int, rows long, counts binary").groupBy("y")
             .applyInPandas(_added, "y int, rows long, counts binary").toPandas())
    found = {int(r.y): (np.frombuffer(r.counts, np.int64), int(r.rows)) for r in added.itertuples()}
    none = (np.zeros(1 << HASH_BITS, np.int64), 0)
    (neg, n_neg), (pos, n_pos) = found.get(0, none), found.get(1, none)
    ratio = np.log((pos + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    return ratio, pos + neg


def loss_and_slopes(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, scaled: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Logistic loss of some texts and its slope by each feature's scaled weight, the intercept's last."""
    of = np.repeat(np.arange(len(y)), sizes)
    z = np.bincount(of, scaled[x], len(y)) + bias
    error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    return float((np.logaddexp(0, z) - y * z).sum()), np.append(np.bincount(x, error[of], len(scaled)), error.sum())


def fit_logistic(train: DataFrame, ratio: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression on every feature, each scaled by ``ratio``, by L-BFGS.

    ``train`` is a stored table (y, x: a text's packed features). In each step every task adds up the slopes of its texts;
    the driver gets one vector of fixed size from each of at most ``PARTS`` parts and nothing is shuffled.
    """
    context, width = train.sparkSession.sparkContext, len(ratio)
    rows = max(1, train.count())

    def summed(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((w[:-1] * ratio, w[-1]))

        def part(batches):
            from pyspark import TaskContext

            scaled, bias = shared.value
            loss, slopes = 0.0, np.zeros(width + 1)
            for batch in batches:
                for a in range(0, len(batch), TEXTS):
                    texts = [unpack_places(t) for t in batch["x"].iloc[a:a + TEXTS]]
                    y = batch["y"].iloc[a:a + TEXTS].to_numpy(np.float64)
                    more, further = loss_and_slopes(np.concatenate(texts), np.array([len(t) for t in texts]), y, scaled, bias)
                    loss, slopes = loss + more, slopes + further
            if loss:
                yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "loss": [loss], "slopes": [slopes.tobytes()]})

        # in the order of tasks, so that reruns agree
        sums = sorted(train.mapInPandas(part, "task int, loss double, slopes binary").collect(), key=lambda r: r["task"])
        shared.destroy()
        slopes = sum((np.frombuffer(r["slopes"]) for r in sums), np.zeros(width + 1)) * np.append(ratio, 1.0)
        slopes[:-1] += PENALTY * rows * w[:-1]
        return sum(r["loss"] for r in sums) + PENALTY * rows / 2 * float(w[:-1] @ w[:-1]), slopes

    w = minimise(summed, np.zeros(width + 1), steps)
    return w[:-1], float(w[-1])


def train_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weight of every hashed feature, intercept); without any labelled text all zero."""
    def numbered(batches):
        grams = Grams()
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [pack_places(grams(t)) for t in batch["text"]]})

    with small_batches(docs.sparkSession):
        train = training_rows(docs, labels, max_rows)
        ratio, _ = log_count_ratios(train)
        weight, bias = fit_logistic(store(train.coalesce(PARTS).mapInPandas(numbered, "y int, x binary"), "toxic-grams"), ratio)
    return weight * ratio, bias


def _scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        grams = Grams()
        weights, bias = shared.value
        z = np.array([weights[grams(t or "")].sum() + bias for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is likelier toxic) and predicted (1 from 0.5 on) of every input row.

    Only texts are scored, whole; a null text scores as an empty one, whose only n-grams are spaces. A
    null id counts as not held out. Repeated ids and rows each give a row; further columns are ignored;
    without labels every score is 0.5; an empty table gives no row.
    """
    score = _scorer(docs, train_classifier(docs, labels, max_rows))
    return (docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, at: float = 0.5) -> DataFrame:
    """All columns of the rows that score below ``at``. Without any label nothing is known and all rows stay."""
    weights, bias = model = train_classifier(docs, labels, max_rows)
    if not weights.any() and not bias:
        return docs
    score = _scorer(docs, model)
    return unpacked(packed(docs, "text").withColumn("score", score("text")).filter(F.col("score") < at).select("_doc"), docs.columns)
