"""Ward linkage (M11) over clustering features.

Every row falls into a cell of a stated width (width 0: equal rows are one cell); a cell is known by its count and sums. Cells, then
clusters, merge in rounds: each finds its nearest by Ward's distance, and all pairs that are nearest to each other merge at once.
Ward's distance is reducible, so the merges are those of merging the closest pair one at a time. The search for the nearest, quadratic in the
cells at worst, runs on Spark. While there are more clusters than the driver takes in hand, they are a stored table: those without a nearest are
taken through all others in chunks by leaves, small boxes of near clusters, of which only those that may hold a nearer one are looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.functions.chunks import chunks_of, spread
from cohortlab.functions.frames import numbered
from cohortlab.operators.density import with_curve
from cohortlab.session import materialize

#: Clusters of which the driver takes counts and means in hand, and clusters of a leaf.
IN_HAND, LEAF = 10_000, 64
#: So many clusters or fewer are searched without a Spark job.
FEW = 1024
FIRST_WIDTH = 1 / 16


def cells(scaled: DataFrame, cols: list[str], width: float) -> DataFrame:
    """customer_id and cell, the position of the row in the grid."""
    place = [(F.floor(F.col(c) / F.lit(width)) if width else F.col(c)).cast("double") for c in cols]
    return scaled.select("customer_id", *cols, F.array(*[p + F.lit(0.0) for p in place]).alias("cell"))


def clustering_features(placed: DataFrame, cols: list[str]) -> DataFrame:
    """(node, cell, n, mean): cells numbered in order of position."""
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(c)) for c in cols]).alias("mean"))
    return numbered(stats, ["cell"], "node")


def nearest(n: np.ndarray, mean: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Of these rows the nearest other cluster (ties: the first) and the increase of the sum of squares by a merge."""
    best, cost = [], []
    for lo in range(rows.start, rows.stop, 64):
        part = np.arange(lo, min(lo + 64, rows.stop))
        d = np.zeros((len(part), len(n)))
        for k in range(mean.shape[1]):
            d += (mean[part, k, None] - mean[None, :, k]) ** 2
        d *= (n[part, None] * n[None, :]) / (n[part, None] + n[None, :])
        d[np.arange(len(part)), part] = np.inf
        best.append(d.argmin(1))
        cost.append(d[np.arange(len(part)), best[-1]])
    return np.concatenate(best), np.concatenate(cost)


def _searched(spark, n: np.ndarray, mean: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of all clusters: on Spark, a range of rows a task, while there are more than ``few``."""
    if len(n) <= few:
        return nearest(n, mean, slice(0, len(n)))
    parts = -(-len(n) // 256)
    shared = spark.sparkContext.broadcast((n, mean))                 # IN_HAND rows at most

    def find(batches):
        for batch in batches:
            for lo, hi in zip(batch["lo"], batch["hi"]):
                best, cost = nearest(*shared.value, slice(int(lo), int(hi)))
                yield pd.DataFrame({"row": np.arange(lo, hi), "best": best, "cost": cost})

    edges = np.linspace(0, len(n), parts + 1).astype(int).tolist()
    ranges = spark.createDataFrame(list(zip(edges, edges[1:])), "lo long, hi long").repartition(parts)
    found = ranges.mapInPandas(find, "row long, best long, cost double").toPandas().sort_values("row")
    shared.destroy()
    return found["best"].to_numpy(), found["cost"].to_numpy()


def in_leaves(node: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple:
    """Clusters in order of leaves, which hold near ones of like size: node, n, mean, starts of the leaves, their boxes and least n."""
    size = np.floor(np.log2(n))
    todo, rows = [np.flatnonzero(size == s) for s in np.unique(size)], []
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            rows.append(part)
            continue
        x = mean[part]
        part = part[np.argpartition(x[:, np.ptp(x, axis=0).argmax()], len(part) // 2)]
        todo += [part[:len(part) // 2], part[len(part) // 2:]]
    order, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    node, n, mean = node[order], n[order], mean[order]
    return node, n, mean, starts, np.minimum.reduceat(mean, starts[:-1]), np.maximum.reduceat(mean, starts[:-1]), np.minimum.reduceat(n, starts[:-1])


def nearer(some: tuple, others: tuple, best: np.ndarray, cost: np.ndarray) -> None:
    """Takes into ``best`` and ``cost``, in the order of ``some``, what of ``others`` (both ``in_leaves``) is nearer, of equally near ones the least node.

    The distance of a leaf's box with the least counts is never above that of its clusters, so leaves beyond the nearest known are passed over. Products
    of matrices find the few pairs that may be nearest; only these are measured as in ``nearest``.
    """
    node, n, mean, starts, low, high, least = some
    node_b, n_b, mean_b, starts_b, low_b, high_b, least_b = others
    squares_b = (mean_b ** 2).sum(1)
    for leaf in range(len(least)):
        rows = slice(starts[leaf], starts[leaf + 1])
        gap = (np.maximum(np.maximum(low_b - high[leaf], low[leaf] - high_b), 0.0) ** 2).sum(1)
        bound = gap * (least[leaf] * least_b) / (least[leaf] + least_b) * (1 - 1e-9)
        order = np.argsort(bound, kind="stable")
        x, squares = mean[rows], (mean[rows] ** 2).sum(1)
        left = np.column_stack([-2 * x, np.ones(len(x)), squares])
        at = 0
        while at < len(order) and bound[order[at]] <= cost[rows].max():
            to = min(len(order), at + (4 if at < 16 else 32))
            near = order[at:to][bound[order[at:to]] <= cost[rows].max()]
            at = to
            b = np.concatenate([np.arange(starts_b[i], starts_b[i + 1]) for i in near])
            share = (1 / n[rows])[:, None] + (1 / n_b[b])[None, :]
            about = left @ np.vstack([mean_b[b].T, squares_b[b], np.ones(len(b))]) / share
            about[node[rows][:, None] == node_b[b][None, :]] = np.inf
            slack = 1e-12 * (squares.max() + squares_b[b].max()) / share.min()
            i, j = np.nonzero(about <= np.minimum(about.min(1), cost[rows])[:, None] + 2 * slack)
            if not len(i):
                continue
            j, i = b[j], i + starts[leaf]
            d = np.zeros(len(i))
            for k in range(mean.shape[1]):
                d += (mean[i, k] - mean_b[j, k]) ** 2
            d *= (n[i] * n_b[j]) / (n[i] + n_b[j])
            first = np.lexsort((node_b[j], d, i))
            first = first[np.append(True, i[first][1:] != i[first][:-1])]
            i, j, d = i[first], j[first], d[first]
            take = (d < cost[i]) | ((d == cost[i]) & (node_b[j] < best[i]))
            best[i[take]], cost[i[take]] = node_b[j[take]], d[take]


def _packed(pdf: pd.DataFrame) -> tuple:
    return in_leaves(pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(float), np.array(pdf["mean"].tolist(), float))


def _with_nearest(clusters: DataFrame, live: int) -> DataFrame:
    """The clusters, each with the nearest other one: those that have none look for it. Stretches of the curve keep near ones together."""
    chunks = chunks_of(clusters, live, _packed, ["curve", "node"])

    def find(batches):
        for pdf in batches:
            if len(pdf):
                some = _packed(pdf)
                best, cost = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.inf)
                nearer(some, some, best, cost)
                for others in chunks:
                    nearer(some, others, best, cost)
                yield pdf.drop(columns=["best", "cost"]).merge(pd.DataFrame({"node": some[0], "best": best, "cost": cost}), on="node")[list(pdf.columns)]

    lost = clusters.filter("best is null")
    found = spread(lost, lost.count(), ["curve", "node"]).mapInPandas(find, clusters.schema)
    out = materialize(clusters.filter("best is not null").unionByName(found), "ward-nearest")
    chunks.destroy()
    return out


MERGES = "a long, b long, parent long, n long, square double"


def _merged_on_spark(features: DataFrame, cols: int, in_hand: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Rounds over stored tables until ``in_hand`` clusters are left: the merges of each round, the clusters left, the next number."""
    clusters, live = with_curve(features.select("node", "n", "mean", *[F.col("mean")[i].alias(f"m{i}") for i in range(cols)]), [f"m{i}" for i in range(cols)])
    clusters = clusters.select("node", "n", "mean", "curve", F.lit(None).cast("long").alias("best"), F.lit(None).cast("double").alias("cost"))
    clusters, fresh, rounds = materialize(clusters, "ward-clusters") if live > in_hand else clusters, live + 1, []
    while live > in_hand:
        found = _with_nearest(clusters, live)
        one, other = found.alias("one"), found.alias("other")
        pairs = one.join(other, (F.col("one.best") == F.col("other.node")) & (F.col("other.best") == F.col("one.node")) & (F.col("one.node") < F.col("other.node")))
        total = F.col("one.n") + F.col("other.n")
        pairs = pairs.select(F.col("one.node").alias("a"), F.col("other.node").alias("b"), total.alias("n"), F.col("one.cost").alias("square"), F.col("one.curve").alias("curve"),
                             F.zip_with("one.mean", "other.mean", lambda x, y: (x * F.col("one.n") + y * F.col("other.n")) / total).alias("mean"))
        pairs = materialize(numbered(pairs, ["a"], "parent", fresh), "ward-merges")
        merged = pairs.count()
        gone = pairs.select(F.col("a").alias("gone")).unionByName(pairs.select(F.col("b").alias("gone")))
        kept = found.join(gone, F.col("node") == F.col("gone"), "left_anti").join(gone, F.col("best") == F.col("gone"), "left")
        # a merged cluster is no nearer than its parts were, so only those whose nearest is gone look again; all do where rounding hid every pair
        stays = F.when(F.col("gone").isNull() & F.lit(merged > 0), F.col("best"))
        kept = kept.select("node", "n", "mean", "curve", stays.alias("best"), F.when(stays.isNotNull(), F.col("cost")).alias("cost"))
        new = pairs.select(F.col("parent").alias("node"), "n", "mean", "curve", F.lit(None).cast("long").alias("best"), F.lit(None).cast("double").alias("cost"))
        clusters = materialize(kept.unionByName(new), "ward-clusters")
        rounds.append(pairs.select("a", "b", "parent", "n", "square"))
        live, fresh = live - merged, fresh + merged
    return rounds, clusters, fresh


def ward_tree(features: DataFrame, cols: int, few: int = FEW, in_hand: int = IN_HAND) -> DataFrame:
    """The merges of (node, n, mean) of ``cols`` features: a, b, parent, n, square, the increase of the sum of squares. Counts and means of ``in_hand``
    clusters at most pass through the driver; more merge in the same rounds over stored tables."""
    spark = features.sparkSession
    rounds, left, fresh = _merged_on_spark(features, cols, in_hand)
    known = left.select("node", "n", "mean").orderBy("node").toPandas()
    node, n, mean = known["node"].to_numpy(), known["n"].to_numpy(float), np.array(known["mean"].tolist())
    out = []
    while len(node) > 1:
        best, cost = _searched(spark, n, mean, few)
        here = np.arange(len(node))
        a = np.flatnonzero((best[best] == here) & (here < best))
        b = best[a]
        parent, total = fresh + np.arange(len(a)), n[a] + n[b]
        out += zip(node[a].tolist(), node[b].tolist(), parent.tolist(), total.astype(int).tolist(), cost[a].tolist())
        middle = (mean[a] * n[a, None] + mean[b] * n[b, None]) / total[:, None]
        keep = np.setdiff1d(here, np.concatenate([a, b]))
        node, n, mean = np.append(node[keep], parent), np.append(n[keep], total), np.concatenate([mean[keep], middle])
        fresh += len(a)
    return reduce(DataFrame.unionByName, rounds, spark.createDataFrame(out, MERGES))


def cut(features: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(node, cluster): the cluster of each cell when the last ``k`` - 1 merges are undone, numbered by first cell."""
    tree = materialize(tree, "ward-tree")
    undone = [r["parent"] for r in tree.orderBy(F.desc("square"), F.desc("parent")).limit(k - 1).collect()]          # k - 1 rows
    kept = tree.filter(~F.col("parent").isin(undone))
    up = kept.select(F.col("a").alias("node"), F.col("parent").alias("top")).unionByName(kept.select(F.col("b").alias("node"), F.col("parent").alias("top")))
    moved = True
    while moved:                                                       # twice as far each time
        up = materialize(up.join(up.select(F.col("node").alias("top"), F.col("top").alias("further")), "top", "left")
                         .select("node", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")), "ward-up")
        moved, up = bool(up.filter("moved").limit(1).count()), up.select("node", "top")
    cells = features.select("node").join(up, "node", "left").select("node", F.coalesce("top", "node").alias("top"))
    number = F.row_number().over(Window.orderBy("first")) - 1                                                       # k rows
    first = cells.groupBy("top").agg(F.min("node").alias("first")).select("top", number.cast("int").alias("cluster"))
    return cells.join(first, "top").select("node", "cluster")


def _prepared(scaled: DataFrame, cols: list[str], width: float | None, most_cells: int | None) -> tuple[DataFrame, DataFrame]:
    w = width or 0.0
    kept = materialize(scaled.select("customer_id", *cols), "model_input")       # read once for each width, and for the labels
    while True:
        placed = cells(kept.dropna(subset=cols), cols, w)
        if most_cells is None or placed.select("cell").distinct().limit(most_cells + 1).count() <= most_cells:
            return placed, materialize(clustering_features(placed, cols), "ward-cells")
        w = max(FIRST_WIDTH, 2 * w)


def dendrogram(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES, width: float | None = None, most_cells: int | None = None, few: int = FEW,
               in_hand: int = IN_HAND) -> DataFrame:
    """All merges in order of height: step, a, b, parent, n, height (M11), the height as the source's library gives it, the root of twice the increase of
    the sum of squares. Cells are numbered from 1, later clusters from there on. ``few`` and ``in_hand`` say where the work is done, not what comes out."""
    tree = numbered(ward_tree(_prepared(scaled, cols, width, most_cells)[1], len(cols), few, in_hand), ["square", "parent"], "step")
    return tree.select(F.col("step").cast("int").alias("step"), "a", "b", "parent", "n", F.sqrt(2 * F.col("square")).alias("height"))


def ward_segments(scaled: DataFrame, k: int = 4, cols: list[str] = FX.FEATURE_NAMES, width: float | None = None, most_cells: int | None = None, few: int = FEW,
                  in_hand: int = IN_HAND) -> DataFrame:
    """customer_id, cluster and the features (M11): the ``k`` clusters of Ward linkage, numbered by their first cell.

    Every row counts. With ``width`` 0 or None equal rows are one cell and the result is exact, however many there are. A caller who wants no more than
    ``most_cells`` cells names them: then the width is doubled (from 1/16) until there are no more. Rows with a null feature have no cluster and are left
    out; fewer cells than ``k`` give as many clusters as cells.
    """
    placed, features = _prepared(scaled, cols, width, most_cells)
    labels = cut(features, ward_tree(features, len(cols), few, in_hand), k)
    return placed.join(features.join(labels, "node").select("cell", "cluster"), "cell").select("customer_id", "cluster", *cols)
