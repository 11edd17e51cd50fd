"""A linear-chain conditional random field of two labels over sparse binary features.

The weights are fitted by L-BFGS; each step is one Spark job whose tasks add up the gradient of their
sequences, so no task holds more than its share of the training set and the driver holds sums only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Training sequences: the features of each item, and its label 0 or 1.
SCHEMA = "features array<array<int>>, labels array<int>"


@dataclass
class Weights:
    """``item`` holds what each feature adds to label 1, ``first`` and ``step`` the weights of first labels and of pairs."""
    item: np.ndarray
    first: np.ndarray
    step: np.ndarray

    @classmethod
    def unpack(cls, x: np.ndarray) -> Weights:
        return cls(x[:-6], x[-6:-4], x[-4:].reshape(2, 2))


def unary(item: np.ndarray, features: list[list[int]]) -> np.ndarray:
    """The summed weight of label 1 of each item; an item may have no feature."""
    counts = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.fromiter((f for fs in features for f in fs), np.int64, int(counts.sum()))
    sums = np.concatenate([[0.0], np.cumsum(item[flat])])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def marginals(u: np.ndarray, size: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences ``u[k, :size[k]]``: log partition, probability of label 1 per item (0 beyond the size) and the
    expected pairs of labels, summed."""
    n, most = u.shape
    both = np.stack([np.zeros_like(u), u], axis=2)
    there = np.arange(most)[None, :] < size[:, None]
    ahead, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    ahead[:, 0] = w.first + both[:, 0]
    for t in range(1, most):
        new = np.logaddexp(ahead[:, t - 1, :1] + w.step[0], ahead[:, t - 1, 1:] + w.step[1]) + both[:, t]
        ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
    for t in range(most - 2, -1, -1):
        onward = both[:, t + 1] + back[:, t + 1]
        new = np.logaddexp(w.step[:, 0] + onward[:, :1], w.step[:, 1] + onward[:, 1:])
        back[:, t] = np.where(there[:, t + 1, None], new, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.where(there, np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]), 0.0)
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            x = ahead[:, :-1, a] + w.step[a, b] + both[:, 1:, b] + back[:, 1:, b] - total[:, None]
            pairs[a, b] = np.exp(x[there[:, 1:]]).sum()
    return total, p, pairs


def loss_and_gradient(x: np.ndarray, features: list, labels: list) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of the sequences and its gradient; sequences of like size are added up together."""
    w, loss, gradient = Weights.unpack(x), 0.0, np.zeros(len(x))
    by_size: dict[int, list[int]] = {}
    for k, seq in enumerate(labels):
        if len(seq):
            by_size.setdefault(len(seq).bit_length(), []).append(k)
    for group in by_size.values():
        size = np.array([len(labels[k]) for k in group])
        u, y = np.zeros((len(group), size.max())), np.zeros((len(group), size.max()), np.int64)
        for r, k in enumerate(group):
            u[r, :size[r]], y[r, :size[r]] = unary(w.item, features[k]), labels[k]
        total, p, pairs = marginals(u, size, w)
        there = np.arange(size.max())[None, :] < size[:, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
        loss += total.sum() - (u * y)[there].sum() - w.first[y[:, 0]].sum() - (w.step * seen).sum()
        for r, k in enumerate(group):
            off = p[r, :size[r]] - y[r, :size[r]]
            flat = np.concatenate([np.asarray(f, np.int64) for f in features[k]])
            np.add.at(gradient, flat, np.repeat(off, [len(f) for f in features[k]]))
        first = np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()]) - np.bincount(y[:, 0], minlength=2)
        gradient[-6:] += np.concatenate([first, (pairs - seen).ravel()])
    return loss, gradient


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS; a step that does not lower the loss enough is halved."""
    loss, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y / (y @ y))
        else:
            d = d / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(alphas)):
            d = d + s * (a - y @ d / (s @ y))
        rate = 1.0
        while True:
            new_loss, new_g = f(x + rate * d)
            if new_loss <= loss + 1e-4 * rate * (g @ d) or rate < 1e-4:
                break
            rate /= 2
        if new_loss >= loss:
            break
        s, y = rate * d, new_g - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        done = loss - new_loss < 1e-4 * max(1.0, loss)
        x, loss, g = x + s, new_loss, new_g
        if done:
            break
    return x


def fit(sequences: DataFrame, n_features: int, steps: int = 40, penalty: float = 0.3) -> Weights:
    """Weights that fit the sequences (``SCHEMA``, best a stored table). Without sequences all weights are 0."""
    def summed(x: np.ndarray) -> tuple[float, np.ndarray]:
        def part(batches):
            import pandas as pd

            loss, gradient = 0.0, np.zeros(len(x))
            for batch in batches:
                a, b = loss_and_gradient(x, list(batch["features"]), list(batch["labels"]))
                loss, gradient = loss + a, gradient + b
            yield pd.DataFrame({"loss": [loss], "gradient": [gradient.tobytes()]})

        rows = sequences.mapInPandas(part, "loss double, gradient binary").collect()
        return (sum(r["loss"] for r in rows) + penalty / 2 * float(x @ x),
                sum((np.frombuffer(r["gradient"]) for r in rows), np.zeros(len(x))) + penalty * x)

    return Weights.unpack(minimise(summed, np.zeros(n_features + 6), steps))


def viterbi(u: np.ndarray, w: Weights) -> list[int]:
    """The most probable labels of one sequence; of equal ones label 0."""
    if not len(u):
        return []
    (s00, s01), (s10, s11) = w.step.tolist()
    a, b = w.first.tolist()
    values = u.tolist()
    b += values[0]
    back = []
    for v in values[1:]:
        from_a, from_b = a >= b + s10 - s00, a + s01 >= b + s11
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + v
    out = [0 if a >= b else 1]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]
