"""Gaussian mixture (M10) by expectation maximisation, a Spark job per step.

The start, and the first step, are those of Spark ML, whose measures (its least probability, its pseudo-inverse of a covariance, its end) hold
for the later ones, too. In these every task adds up weights, means and products of its rows by matrix operations over batches and sends one row of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: Every probability density is raised by so much, as in Spark ML.
LEAST = np.finfo(float).eps
MAX_ITER, TOLERANCE = 100, 0.01
#: Rows of a part of the table that the steps read, about.
PART_ROWS = 100_000


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each component the root of its inverse covariance (directions without variance left out) and its density's constant."""
        root, constant = [], []
        for c in self.covariances:
            d, u = np.linalg.eigh(c)
            held = d > LEAST * d.max() * len(d)
            root.append(np.where(held, np.sqrt(1 / np.where(held, d, 1.0)), 0.0)[:, None] * u.T)
            constant.append(-0.5 * (len(d) * np.log(2 * np.pi) + np.log(d[held]).sum()))
        return np.stack(root), np.array(constant)


def densities(x: np.ndarray, mixture: Mixture, root: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """The weighted densities (rows x components), none below ``LEAST``."""
    k, dims = mixture.means.shape
    turned = x @ root.reshape(k * dims, dims).T - np.einsum("kij,kj->ki", root, mixture.means).ravel()
    turned *= turned
    return LEAST + mixture.weights * np.exp(constant - 0.5 * turned.reshape(len(x), k, dims).sum(2))


def sums(x: np.ndarray, mixture: Mixture, root: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Log-likelihood, then the sums of weights, weighted rows and weighted products of the components, in one line."""
    p = densities(x, mixture, root, constant)
    whole = p.sum(1, keepdims=True)
    p /= whole
    products = (p[:, :, None] * x[:, None, :]).reshape(len(x), -1).T @ x
    return np.concatenate([[np.log(whole).sum()], p.sum(0), (p.T @ x).ravel(), products.ravel()])


def blocks(vectors: DataFrame, cols: list[str]) -> DataFrame:
    """The features, stored in blocks of rows (x: their doubles) and in as many parts as there are tasks at once, or more. They are read from there in
    every step and not held by executors, whose tasks would wait for one another's places."""
    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.float64, "C")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()] if len(x) else [], pa.binary())], names=["x"])

    spread = max(vectors.sparkSession.sparkContext.defaultParallelism, vectors.count() // PART_ROWS + 1)
    return materialize(vectors.select("customer_id", *cols).repartition(spread, "customer_id").select(*cols).mapInArrow(packed, "x binary"), "mixture")


def _step(points: DataFrame, mixture: Mixture) -> tuple[float, Mixture]:
    """The log-likelihood of a mixture and the one that follows it."""
    root, constant = mixture.roots()
    k, dims = mixture.means.shape

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(1 + k * (1 + dims + dims * dims))
        for batch in batches:
            for x in batch.column("x"):
                total += sums(np.frombuffer(x.as_buffer()).reshape(-1, dims), mixture, root, constant)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "sums"])

    # in the order of tasks, so that reruns agree; a row of fixed size from each
    rows = sorted(points.mapInArrow(add, "task int, sums binary").collect(), key=lambda r: r["task"])
    total = sum(np.frombuffer(r["sums"]) for r in rows)
    n, first, second = np.split(total[1:], [k, k + k * dims])
    means = first.reshape(k, dims) / n[:, None]
    covariances = second.reshape(k, dims, dims) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    return float(total[0]), Mixture(n / n.sum(), means, covariances)


def fit(vectors: DataFrame, cols: list[str], k: int, seed: int, max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> Mixture:
    """The mixture of a stored table with a column ``features_vec`` beside the features it is made of. It ends when the log-likelihood changes by ``tol``
    or less, after ``max_iter`` steps at most."""
    begun = GaussianMixture(k=k, seed=seed, featuresCol="features_vec", maxIter=1).fit(vectors)
    parts = begun.gaussiansDF.collect()                                   # k rows
    mixture = Mixture(np.array(begun.weights), np.array([r["mean"].toArray() for r in parts]), np.array([r["cov"].toArray() for r in parts]))
    likelihood = begun.summary.logLikelihood
    points = blocks(vectors, cols)
    for _ in range(max_iter - 1):
        before, (likelihood, mixture) = likelihood, _step(points, mixture)
        if abs(likelihood - before) <= tol:
            break
    return mixture


def label(mixture: Mixture, cols: list[str]) -> Column:
    """The likeliest component, of equally likely ones the first."""
    root, constant = mixture.roots()

    @F.pandas_udf("int")
    def likeliest(frame: pd.DataFrame) -> pd.Series:
        p = densities(frame.to_numpy(np.float64), mixture, root, constant)
        return pd.Series((p / p.sum(1, keepdims=True)).argmax(1).astype(np.int32))

    return likeliest(F.struct(*cols))
