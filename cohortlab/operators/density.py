"""Density clustering (M12): exact DBSCAN over blocks of near points.

Points are put in order along a curve that goes through all features, and cut into blocks of bounded size; blocks whose bounding boxes come
within epsilon meet. A meeting compares the blocks in numpy by leaves, small boxes of a few points: leaves too far apart are passed over,
those wholly within epsilon are counted without looking at their points, and only the rest is compared point by point. Core points are joined inside
each block first; blocks then only link these parts. Blocks are not sent to those they meet: all blocks are broadcast in chunks, and each block
goes through the chunks for those it meets. So what is shuffled is a row per point and a few links, never one per meeting and point.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.functions.chunks import Chunks, chunks_of
from cohortlab.functions.graph import components
from cohortlab.session import materialize

#: Points of a block, and of a leaf.
BLOCK, LEAF = 16384, 64
#: Bits of the place along the curve.
CURVE_BITS = 60


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d += (a[:, k, None] - b[None, :, k]) ** 2
    return d


def _within(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """Whether ``_squares`` is no more than ``square``: by a product of matrices, and by ``_squares`` itself where that is too close to tell."""
    middle = a.mean(0)
    x, y = a - middle, b - middle
    left, right = (x ** 2).sum(1), (y ** 2).sum(1)
    d = np.column_stack([-2 * x, np.ones(len(x)), left]) @ np.vstack([y.T, right, np.ones(len(y))])
    slack = 1e-12 * (left.max() + right.max() + square)
    hit, sure = d <= square + slack, d <= square - slack
    if np.count_nonzero(hit) != np.count_nonzero(sure):
        i, j = np.nonzero(hit & ~sure)
        exact = np.zeros(len(i))
        for k in range(a.shape[1]):
            exact += (a[i, k] - b[j, k]) ** 2
        hit[i, j] = exact <= square
    return hit


class Leaves:
    """Points cut at medians of their widest feature into leaves: the leaf of each point, and boxes and sizes of the leaves.

    Bounds of distances are added up in the order of the features, like the distances, so rounding can't set them against each other.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.of, self.rows = x, np.zeros(len(x), np.int64), []
        todo = [np.arange(len(x))] if len(x) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.of[rows] = len(self.rows)
                self.rows.append(np.sort(rows))
                continue
            part = x[rows]
            rows = rows[np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)]
            todo += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
        self.low = np.array([x[r].min(0) for r in self.rows]).reshape(-1, x.shape[1])
        self.high = np.array([x[r].max(0) for r in self.rows]).reshape(-1, x.shape[1])
        self.size = np.array([len(r) for r in self.rows], np.int64)

    def arrays(self) -> tuple:
        return self.x, self.of, self.rows, self.low, self.high, self.size

    @classmethod
    def of_arrays(cls, arrays: tuple) -> Leaves:
        out = cls.__new__(cls)
        out.x, out.of, out.rows, out.low, out.high, out.size = arrays
        return out

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of a box to each leaf."""
        near, far = np.zeros(len(self.rows)), np.zeros(len(self.rows))
        for k in range(self.x.shape[1]):
            near += np.maximum(np.maximum(self.low[:, k] - high[k], low[k] - self.high[:, k]), 0.0) ** 2
            far += np.maximum(np.abs(self.high[:, k] - low[k]), np.abs(high[k] - self.low[:, k])) ** 2
        return near, far

    def within(self, x: np.ndarray, square: float) -> np.ndarray:
        """The points, in order, of leaves that come so near to the box of ``x``."""
        return np.flatnonzero((self.bounds(x.min(0), x.max(0))[0] <= square)[self.of])


def counted(a: Leaves, b: Leaves, square: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a, and each of b, the points of the other side within reach."""
    to_a, to_b, leaf_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64), np.zeros(len(b.rows), np.int64)
    for leaf, rows in enumerate(a.rows):
        near, far = b.bounds(a.low[leaf], a.high[leaf])
        whole = far <= square
        to_a[rows] += b.size[whole].sum()
        leaf_b[whole] += len(rows)
        others = np.flatnonzero((~whole & (near <= square))[b.of])
        if len(others):
            hit = _within(a.x[rows], b.x[others], square)
            to_a[rows] += hit.sum(1)
            to_b[others] += hit.sum(0)
    return to_a, to_b + leaf_b[b.of] if len(b.x) else to_b


def parts_of(points: Leaves, square: float) -> np.ndarray:
    """For each point the first point of its part: points joined by steps within reach."""
    root, unseen = np.full(len(points.x), -1), np.ones(len(points.x), bool)
    for start in range(len(points.x)):
        if not unseen[start]:
            continue
        unseen[start], front, root[start] = False, [np.array([start])], start
        while front:
            rows = front.pop()
            others = points.within(points.x[rows], square)
            others = others[unseen[others]]
            if not len(others):
                continue
            found = others[_within(points.x[rows], points.x[others], square).any(0)]
            unseen[found], root[found] = False, start
            found = found[np.argsort(points.of[found], kind="stable")]               # near ones together
            front += [found[lo:lo + LEAF] for lo in range(0, len(found), LEAF)]
    return root


def linked(a: Leaves, part_a: np.ndarray, b: Leaves, part_b: np.ndarray, square: float) -> list[tuple[int, int]]:
    """Pairs of parts of a and of b with points within reach, enough to join all that are."""
    group_a, group_b, out = np.arange(part_a.max(initial=-1) + 1), np.arange(part_b.max(initial=-1) + 1) + part_a.max(initial=-1) + 1, []
    for rows in a.rows:
        for part in np.unique(part_a[rows]):
            mine = rows[part_a[rows] == part]
            others = b.within(a.x[mine], square)
            while len(others := others[group_b[part_b[others]] != group_a[part]]):
                hit = others[_within(a.x[mine], b.x[others], square).any(0)]
                if not len(hit):
                    break
                for other in np.unique(part_b[hit]):
                    if group_b[other] != group_a[part]:
                        out.append((int(part), int(other)))
                        old = group_b[other]
                        group_a[group_a == old], group_b[group_b == old] = group_a[part], group_a[part]
    return out


def nearest(rest: Leaves, cores: Leaves, square: float) -> list[tuple[int, int, float]]:
    """(point, core, squared distance): the nearest core point within reach, of equally near ones the first."""
    out = []
    for rows in rest.rows:
        others = cores.within(rest.x[rows], square)
        if len(others):
            d = _squares(rest.x[rows], cores.x[others])
            best = d.argmin(1)
            out += [(int(r), int(others[c]), float(d[i, c])) for i, (r, c) in enumerate(zip(rows, best)) if d[i, c] <= square]
    return out


def with_curve(points: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """The points with ``curve``, their place along a curve that goes through the bits of all features in turn, and how many points there are."""
    facts = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.stddev_pop, "sd"), (F.min, "lo"), (F.max, "hi"))]).first()
    axes = sorted(cols, key=lambda c: -(facts[f"sd_{c}"] or 0.0))
    bits = max(1, min(16, CURVE_BITS // len(cols)))
    used = axes[:CURVE_BITS // bits]

    def place(c):
        if facts["n"] == 0 or not 0 < (wide := facts[f"hi_{c}"] - facts[f"lo_{c}"]) < float("inf"):
            return F.lit(0).cast("long")
        return F.floor((F.col(c) - F.lit(facts[f"lo_{c}"])) / F.lit(wide) * F.lit(2 ** bits - 1)).cast("long")

    x = points.select("*", *[place(c).alias(f"_{i}") for i, c in enumerate(used)])
    turns = [F.shiftleft(F.shiftright(f"_{i}", bit).bitwiseAND(F.lit(1).cast("long")), bit * len(used) + len(used) - 1 - i) for bit in range(bits) for i in range(len(used))]
    return x.select(*points.columns, reduce(lambda a, b: a.bitwiseOR(b), turns).alias("curve")), facts["n"]


def blocks(points: DataFrame, cols: list[str], eps: float, size: int = BLOCK) -> DataFrame:
    """customer_id, x (the features) and block: cell, a stretch of about ``size`` points of the curve (``with_curve``), and a part of it by a hash where
    it came out twice as long. The stretches don't depend on ``eps``."""
    x, n = with_curve(points.select("customer_id", *cols), cols)
    x = x.select("customer_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), "curve")
    parts = -(-n // size)
    if parts > 1:
        x = x.repartitionByRange(parts, "curve", F.xxhash64("customer_id"))
    x = materialize(x.select("customer_id", "x", (F.spark_partition_id() if parts > 1 else F.lit(0)).cast("long").alias("cell")), "curve")
    split = F.broadcast(x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).alias("parts")))
    return x.join(split, "cell").select("customer_id", "x", "cell", F.pmod(F.xxhash64("customer_id"), F.col("parts")).alias("part"))


def meetings(points: DataFrame, eps: float) -> DataFrame:
    """(cell, part, meeting, side): the different blocks that meet, two rows each."""
    dims = range(len(points.select("x").first()["x"]))
    box = materialize(points.groupBy("cell", "part").agg(F.array(*[F.min(F.col("x")[i]) for i in dims]).alias("lo"),
                                                         F.array(*[F.max(F.col("x")[i]) for i in dims]).alias("hi")), "blocks")
    block = F.struct("cell", "part")
    other = F.broadcast(box.select(block.alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")))          # a row per block
    gap = [F.greatest(F.col("lo")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi")[i], F.lit(0.0)) for i in dims]
    pairs = box.select(block.alias("a"), "lo", "hi").join(other, F.col("a") < F.col("b")).filter(sum(g * g for g in gap) <= eps * eps)
    pairs = materialize(pairs.select("a", "b").withColumn("meeting", F.monotonically_increasing_id()), "meetings")
    return pairs.select("a.*", "meeting", F.lit(0).alias("side")).unionByName(pairs.select("b.*", "meeting", F.lit(1).alias("side")))


def _matrix(pdf, dims: int) -> np.ndarray:
    return np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), dims)


def _in_chunks(points: DataFrame, pack) -> Chunks:
    """Chunks of whole blocks: a dictionary each, of what ``pack`` makes of the rows of a block."""
    return chunks_of(points, points.count(), lambda pdf: {(int(c), int(p)): pack(rows) for (c, p), rows in pdf.groupby(["cell", "part"])}, ["cell", "part"])


def _each_met(points: DataFrame, meet: DataFrame, chunks: Chunks, made, schema: str) -> DataFrame:
    """What ``made`` makes of each block: its key, its rows, and an iterator of (key, what is packed) over the blocks of the chunks that it meets."""
    other = meet.select("meeting", F.col("side").alias("_side"), F.col("cell").alias("met_cell"), F.col("part").alias("met_part"))
    met = meet.join(other, "meeting").filter(F.col("side") != F.col("_side")).select("cell", "part", "met_cell", "met_part")

    def block(key, pdf, names):
        wanted = set(zip(names["met_cell"].tolist(), names["met_part"].tolist()))
        return made(tuple(map(int, key)), pdf, ((k, packed) for chunk in (chunks if wanted else ()) for k, packed in chunk.items() if k in wanted))

    return points.groupBy("cell", "part").cogroup(met.groupBy("cell", "part")).applyInPandas(block, schema)


def neighbour_counts(points: DataFrame, meet: DataFrame, dims: int, eps: float) -> DataFrame:
    """(customer_id, n): points within eps, the point itself included."""
    import pandas as pd

    kind = points.schema["customer_id"].dataType.simpleString()

    def count(key, pdf, met):
        own = Leaves(_matrix(pdf, dims))
        n = counted(own, own, eps * eps)[0]
        for _, other in met:
            n += counted(own, Leaves.of_arrays(other), eps * eps)[0]
        return pd.DataFrame({"customer_id": pdf["customer_id"], "n": n})

    chunks = _in_chunks(points.select("cell", "part", "x"), lambda pdf: Leaves(_matrix(pdf, dims)).arrays())
    found = _each_met(points.select("cell", "part", "customer_id", "x"), meet, chunks, count, f"customer_id {kind}, n long")
    found = materialize(found.groupBy("customer_id").agg(F.sum("n").alias("n")), "counts")
    chunks.destroy()
    return found


def core_parts(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(customer_id, core, square, is_core) inside each block: for a core point the least id of its part; for another the nearest core point within
    eps, of equally near ones the least id, with its squared distance."""
    kind = points.schema["customer_id"].dataType.simpleString()

    def inside(pdf):
        import pandas as pd

        pdf = pdf.sort_values("customer_id")
        x, core, ids = _matrix(pdf, dims), pdf["core"].to_numpy().astype(bool), pdf["customer_id"].to_numpy()
        cores, ids_core, ids_rest = Leaves(x[core]), ids[core], ids[~core]
        out = [(i, ids_core[r], 0.0, True) for i, r in zip(ids_core, parts_of(cores, eps * eps))]
        out += [(ids_rest[r], ids_core[c], d, False) for r, c, d in nearest(Leaves(x[~core]), cores, eps * eps)]
        return pd.DataFrame(out, columns=["customer_id", "core", "square", "is_core"])

    return points.select("cell", "part", "customer_id", "x", "core").groupBy("cell", "part").applyInPandas(inside, f"customer_id {kind}, core {kind}, square double, is_core boolean")


def core_links(points: DataFrame, meet: DataFrame, dims: int, eps: float) -> DataFrame:
    """(customer_id, core, square, is_core) between blocks: links of parts (``root``) of core points that join all that come within eps; for other
    points the nearest core point as in ``core_parts``."""
    import pandas as pd

    kind = points.schema["customer_id"].dataType.simpleString()

    def cores_of(pdf):
        pdf = pdf.sort_values("customer_id")
        number, names = pd.factorize(pdf["root"].to_numpy())
        return Leaves(_matrix(pdf, dims)).arrays(), number, names, pdf["customer_id"].to_numpy()

    def link(key, pdf, met):
        core = pdf["core"].to_numpy().astype(bool)
        arrays, number, names, _ = cores_of(pdf[core])
        rest = pdf[~core].sort_values("customer_id")
        own, others, ids, out, near = Leaves.of_arrays(arrays), Leaves(_matrix(rest, dims)), rest["customer_id"].to_numpy(), [], {}
        for other, (arrays, number_b, names_b, ids_b) in met:
            b = Leaves.of_arrays(arrays)
            if key < other:
                out += [(names[i], names_b[j], 0.0, True) for i, j in linked(own, number, b, number_b, eps * eps)]
            for r, c, d in nearest(others, b, eps * eps):
                near[r] = min(near.get(r, (d, ids_b[c])), (d, ids_b[c]))
        out += [(ids[r], core_id, d, False) for r, (d, core_id) in near.items()]
        return pd.DataFrame(out, columns=["customer_id", "core", "square", "is_core"])

    points = points.select("cell", "part", "customer_id", "x", "core", "root")
    chunks = _in_chunks(points.filter("core").drop("core"), cores_of)
    found = materialize(_each_met(points, meet, chunks, link, f"customer_id {kind}, core {kind}, square double, is_core boolean"), "core-links")
    chunks.destroy()
    return found


def dbscan(scaled: DataFrame, eps: float = 0.8, min_samples: int = 10, cols: list[str] = FX.FEATURE_NAMES, size: int = BLOCK) -> DataFrame:
    """customer_id, cluster, n_near, is_core (M12), one row per customer.

    A core point has ``min_samples`` points within ``eps``, itself included. Core points within ``eps`` of one another are
    in one cluster; any other point joins the cluster of its nearest core point within ``eps`` (ties: least id), which the source leaves to
    the order of rows; the rest is noise, cluster -1. Clusters are numbered by their least core id. Rows with a null feature are noise
    without neighbours; ids must be distinct; an empty table gives no row.
    """
    known = scaled.select("customer_id", *cols).dropna(subset=cols)
    if not known.limit(1).count():
        return scaled.select("customer_id", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("n_near"), F.lit(False).alias("is_core"))
    dims = len(cols)
    points = materialize(blocks(known, cols, eps, size), "points")
    meet = materialize(meetings(points, eps), "meetings")
    counts = neighbour_counts(points, meet, dims, eps)
    points = points.join(counts.select("customer_id", (F.col("n") >= min_samples).alias("core")), "customer_id")
    inner = materialize(core_parts(points, dims, eps), "core-parts")
    parts = inner.filter("is_core").select("customer_id", F.col("core").alias("root"))
    outer = core_links(materialize(points.join(parts, "customer_id", "left"), "cores"), meet, dims, eps)
    joined = components(outer.filter("is_core").select(F.col("customer_id").alias("a"), F.col("core").alias("b")))
    roots = parts.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left") \
        .select("customer_id", F.coalesce("least", "root").alias("root"))
    number = roots.select("root").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))
    roots = materialize(roots.join(number, "root").select("customer_id", "cluster"), "core-clusters")
    border = inner.unionByName(outer).filter("not is_core").groupBy("customer_id").agg(F.min(F.struct("square", "core")).alias("near")) \
        .select("customer_id", F.col("near.core").alias("core"))
    border = border.join(roots.withColumnRenamed("customer_id", "core"), "core").select("customer_id", "cluster")
    labels = roots.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    return scaled.select("customer_id").join(counts, "customer_id", "left").join(labels, "customer_id", "left").select(
        "customer_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("n", F.lit(0)).alias("n_near"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
