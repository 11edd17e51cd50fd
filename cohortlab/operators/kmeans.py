"""K-Means (M3, M4) whose result does not depend on how rows are partitioned.

Coordinates are kept as whole multiples of 2 ** -24, so the sums of a cluster are exact in any order. Centres are seeded by squared
distance: every row draws an exponential key from a hash of its id, divides it by that distance, and the least key wins, which picks rows in
proportion to it. All restarts, and all K of a sweep, run in the same passes: one Spark job per step, whose tasks give one row per centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 2 ** 24
#: Squared distances are added up as multiples of 2 ** -20.
COST_SCALE = 2 ** 20


@dataclass
class Model:
    centres: np.ndarray
    cost: float
    steps: int


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres), each added up in the order of the features."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[None, :, j]) ** 2
    return out


def nearest(x: np.ndarray, centres: list[np.ndarray]):
    """For each set of centres the nearest one of each row, of equally near ones the first, as ``squares`` tells it: a product of matrices over all sets
    leaves few rows whose nearest is too close to tell, and only these are measured."""
    products, size, end = -2 * np.concatenate(centres) @ x.T, (x ** 2).sum(1), 0
    for c in centres:
        norm = (c ** 2).sum(1)
        about, end = products[end:end + len(c)] + norm[:, None], end + len(c)
        own, least, second = np.zeros(len(x), np.int64), about[0].copy(), np.full(len(x), np.inf)
        for j in range(1, len(c)):
            np.minimum(second, np.maximum(about[j], least), out=second)
            np.putmask(own, about[j] < least, j)
            np.minimum(least, about[j], out=least)
        unsure = np.flatnonzero(second <= least + 1e-12 * (size + norm.max()))
        if len(unsure):
            own[unsure] = squares(x[unsure], c).argmin(1)
        yield own


def squares_to(x: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The squared distance of each row to its centre, as ``squares`` tells it."""
    d = np.zeros(len(x))
    for j in range(x.shape[1]):
        d += (x[:, j] - centres[own, j]) ** 2
    return d


def cluster_sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each cluster; as doubles where they are whole numbers below 2 ** 53 all along, so always exact."""
    if int(np.abs(x).max(initial=0)) * len(x) < 2 ** 53:
        return ((np.arange(k)[:, None] == own).astype(float) @ x.astype(float)).astype(np.int64)
    total = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(total, own, x)
    return total


def race_keys(h: np.ndarray, distance: np.ndarray, seed: int, run: int, turn: int) -> np.ndarray:
    """An exponential key per row (least wins), by the hash ``h`` of its id; rows at distance 0 never win."""
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + run * 0xD1342543DE82EF95 + turn * 0xA0761D6478BD642F) % 2 ** 64)
    u = ((_mix(_mix(h ^ salt) + salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    with np.errstate(divide="ignore"):
        return np.where(distance > 0, -np.log(u) / distance, np.inf)


def whole(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """customer_id, h (a hash of it) and x0, x1, ...: the features as whole numbers. Rows with a null feature are left out."""
    return scaled.dropna(subset=cols).select("customer_id", F.xxhash64(F.col("customer_id").cast("string")).alias("h"),
                                             *[F.round(F.col(c) * SCALE).cast("long").alias(f"x{i}") for i, c in enumerate(cols)])


def _arrays(batch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(dims)], axis=1)
    return batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), x


def _seed(points: DataFrame, runs: list[list[np.ndarray]], todo: list[int], dims: int, seed: int, turn: int) -> None:
    """Adds a centre to the runs ``todo``."""
    kind = points.schema["customer_id"].dataType.simpleString()
    now = {r: np.array(runs[r]) for r in todo}

    def race(batches):
        import pyarrow as pa

        best: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            h, x = _arrays(batch, dims)
            ids, real = batch.column("customer_id"), x / SCALE
            for r, centres in now.items():
                d = squares(real, centres).min(1) if len(centres) else np.ones(len(x))
                key = race_keys(h, d, seed, r, turn)
                for k in np.flatnonzero(key == key.min()):
                    mine = (float(key[k]), ids[int(k)].as_py(), x[k].tolist())
                    if r not in best or mine < best[r]:
                        best[r] = mine
        rows = [{"run": r, "key": v[0], "customer_id": v[1], "x": v[2]} for r, v in best.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("run", pa.int32()), ("key", pa.float64()), ("customer_id", pa.string() if kind == "string" else pa.int64()), ("x", pa.list_(pa.int64()))]))

    found = points.mapInArrow(race, f"run int, key double, customer_id {kind}, x array<long>")
    for row in found.groupBy("run").agg(F.min(F.struct("key", "customer_id", "x")).alias("m")).select("run", "m.x").collect():
        runs[row["run"]].append(np.array(row["x"]) / SCALE)


def _step(points: DataFrame, centres: dict[int, np.ndarray], dims: int, costs: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Of each run: counts and exact sums of its clusters, and with ``costs`` its cost."""
    def add(batches):
        import pyarrow as pa

        count = {r: np.zeros(len(c), np.int64) for r, c in centres.items()}
        total = {r: np.zeros((len(c), dims), np.int64) for r, c in centres.items()}
        cost = dict.fromkeys(centres, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, x = _arrays(batch, dims)
            real = x / SCALE
            for (r, c), own in zip(centres.items(), nearest(real, list(centres.values()))):
                total[r] += cluster_sums(x, own, len(c))
                count[r] += np.bincount(own, minlength=len(c))
                if costs:
                    cost[r] += int(np.rint(squares_to(real, c, own) * COST_SCALE).astype(np.int64).sum())
        rows = [{"run": r, "c": k, "n": int(count[r][k]), "cost": cost[r] if k == 0 else 0, **{f"s{i}": int(total[r][k, i]) for i in range(dims)}}
                for r, c in centres.items() for k in range(len(c))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("run", pa.int32()), ("c", pa.int32()), *[(x, pa.int64()) for x in ("n", "cost", *(f"s{i}" for i in range(dims)))]]))

    names = ["n", "cost", *(f"s{i}" for i in range(dims))]
    rows = points.mapInArrow(add, "run int, c int, " + ", ".join(f"{x} long" for x in names)) \
        .groupBy("run", "c").agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in names]).collect()       # a row per centre
    out = {r: (np.zeros(len(c)), np.zeros((len(c), dims)), 0) for r, c in centres.items()}
    for row in rows:
        n, sums, cost = out[row["run"]]
        n[row["c"]] = int(row["n"])
        sums[row["c"]] = [int(row[f"s{i}"]) / SCALE for i in range(dims)]
        out[row["run"]] = (n, sums, cost + int(row["cost"]))
    return out


def fit(points: DataFrame, ks: list[int], dims: int, seed: int = 42, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4) -> dict[int, Model]:
    """The best of ``n_init`` runs for each K (least cost, then first). A run ends when its centres move by no more than ``tol`` times the mean
    variance, as in the source's library. An empty cluster keeps its centre; with fewer distinct rows than K, centres coincide."""
    points = points.cache()
    try:
        of = [(k, i) for k in ks for i in range(max(1, n_init))]
        runs: list[list[np.ndarray]] = [[] for _ in of]
        for turn in range(max(ks)):
            _seed(points, runs, [r for r, (k, _) in enumerate(of) if k > turn], dims, seed, turn)
        if not runs[0]:
            return {k: Model(np.zeros((k, dims)), 0.0, 0) for k in ks}
        centres = {r: np.array(c) for r, c in enumerate(runs)}
        spread = points.agg(*[F.var_pop(F.col(f"x{i}") / SCALE).alias(f"x{i}") for i in range(dims)]).first()
        limit = tol * float(np.mean([round(v or 0.0, 9) for v in spread]))
        open_, cost, steps = set(centres), {}, dict.fromkeys(centres, 0)
        for _ in range(max_iter):
            for r, (n, sums, _) in _step(points, {r: centres[r] for r in sorted(open_)}, dims).items():
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[r])
                steps[r] += 1
                if float(((new - centres[r]) ** 2).sum()) <= limit:
                    open_.discard(r)
                centres[r] = new
            if not open_:
                break
        for r, (_, _, total) in _step(points, centres, dims, costs=True).items():
            cost[r] = total
        best = {k: min((r for r, (kk, _) in enumerate(of) if kk == k), key=lambda r: (cost[r], r)) for k in ks}
        return {k: Model(centres[r], cost[r] / COST_SCALE, steps[r]) for k, r in best.items()}
    finally:
        points.unpersist()


def assign_each(points: DataFrame, models: dict[int, Model], dims: int) -> DataFrame:
    """customer_id and for each K a column k2, k3, ... with its labels as in ``assign``, in one pass."""
    kind = points.schema["customer_id"].dataType.simpleString()

    def label(batches):
        import pyarrow as pa

        for batch in batches:
            real = _arrays(batch, dims)[1] / SCALE if batch.num_rows else np.zeros((0, dims))
            own = [pa.array(own.astype(np.int32)) for own in nearest(real, [m.centres for m in models.values()])]
            yield pa.RecordBatch.from_arrays([batch.column("customer_id"), *own], names=["customer_id", *[f"k{k}" for k in models]])

    return points.mapInArrow(label, f"customer_id {kind}, " + ", ".join(f"k{k} int" for k in models))


def assign(points: DataFrame, model: Model, dims: int) -> DataFrame:
    """customer_id, cluster: the nearest centre, of equally near ones the first."""
    kind = points.schema["customer_id"].dataType.simpleString()

    def label(batches):
        import pyarrow as pa

        for batch in batches:
            own = next(nearest(_arrays(batch, dims)[1] / SCALE, [model.centres])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("customer_id"), pa.array(own.astype(np.int32))], names=["customer_id", "cluster"])

    return points.mapInArrow(label, f"customer_id {kind}, cluster int")
