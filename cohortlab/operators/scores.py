"""Cluster quality scores and model comparison.

Scores are aggregates over the labelled frame: per-cluster statistics (K rows) are computed
in Spark and combined there, over all rows.
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
from cohortlab.operators.cluster import sample_customers
from cohortlab.session import materialize


def _valid(labelled: DataFrame, label: str) -> DataFrame:
    """Noise (label < 0) is excluded from every score."""
    return labelled.filter(F.col(label) >= 0)


def silhouette(labelled: DataFrame, label: str = "cluster", cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Mean silhouette of all points with squared Euclidean distances (M13); < 2 clusters -> null.

    The mean squared distance of a point x to a cluster of n points is |x|^2 - 2 x.sum / n + squares / n, so the
    per-cluster counts, sums and squared norms (K rows) and one pass over the points do; no pairs.
    A point alone in its cluster scores 0.
    """
    v = _valid(labelled, label).select(F.col(label).alias("c"), *cols)
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])
    stats = v.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("sq"), F.array(*[F.sum(c) for c in cols]).alias("s"))
    every = stats.agg(F.collect_list(F.struct("c", "n", "sq", "s")).alias("_all"))                  # K entries
    total = lambda o: o["n"] * norm - 2 * reduce(lambda a, b: a + b, [F.col(c) * o["s"][i] for i, c in enumerate(cols)]) + o["sq"]
    x = v.crossJoin(F.broadcast(every))
    own = F.filter("_all", lambda o: o["c"] == F.col("c"))[0]
    a = F.greatest(total(own), F.lit(0.0)) / F.greatest(own["n"] - 1, F.lit(1))
    b = F.greatest(F.array_min(F.transform(F.filter("_all", lambda o: o["c"] != F.col("c")), lambda o: total(o) / o["n"])), F.lit(0.0))
    x = x.select(own["n"].alias("n"), F.size("_all").alias("k"), a.alias("a"), b.alias("b"))
    s = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0))
    return x.agg(F.avg(F.when(F.col("k") > 1, s)).alias("silhouette"))


def silhouette_sampled(labelled: DataFrame, sample: int, label: str = "cluster", cols: list[str] = FX.FEATURE_NAMES,
                       seed: int = 42) -> DataFrame:
    """The Euclidean silhouette of a fixed-seed sample of ``sample`` points, the size being the caller's
    choice. The sample is broadcast as a block; each task scores its share against it."""
    spark = labelled.sparkSession
    s = sample_customers(_valid(labelled, label).select("customer_id", F.col(label).alias("_lab"), *cols), sample, seed)
    pdf = s.toPandas()                      # bounded by ``sample`` rows
    if pdf["_lab"].nunique() < 2:
        return spark.createDataFrame([(None,)], "silhouette double")
    X = pdf[cols].to_numpy(dtype=float)
    lab = pdf["_lab"].to_numpy()
    bx = spark.sparkContext.broadcast((X, lab))
    n_parts = max(1, len(pdf) // 500)

    def score(batches):
        Xa, la = bx.value
        uniq = np.unique(la)
        for whole in batches:
          for lo in range(0, len(whole), 256):     # 256 x sample x d doubles per step
            b = whole.iloc[lo:lo + 256]
            pts = b[cols].to_numpy(dtype=float)
            own = b["_lab"].to_numpy()
            d = np.sqrt(((pts[:, None, :] - Xa[None, :, :]) ** 2).sum(-1))
            sums = np.stack([d[:, la == u].sum(1) for u in uniq], 1)
            cnts = np.array([(la == u).sum() for u in uniq], dtype=float)
            oi = np.searchsorted(uniq, own)
            n_own = cnts[oi]
            a = np.where(n_own > 1, sums[np.arange(len(own)), oi] / np.maximum(n_own - 1, 1), 0.0)
            means = sums / cnts
            means[np.arange(len(own)), oi] = np.inf
            bmin = means.min(1)
            sv = np.where(n_own > 1, (bmin - a) / np.maximum(np.maximum(a, bmin), 1e-300), 0.0)
            yield pd.DataFrame({"s": sv})

    per_point = spark.createDataFrame(pdf[["_lab", *cols]]).repartition(n_parts).mapInPandas(score, "s double")
    return per_point.agg(F.avg("s").alias("silhouette"))


#: Rows by columns of distances in one step of the exact Euclidean silhouette, and running sums that a task keeps.
TILE, SUMS = (256, 512), 1 << 22
#: Squared distances below this part of the norms are computed anew, from differences.
NEAR = 1e-6


def in_runs(x: np.ndarray, code: np.ndarray) -> tuple:
    """Rows in order of ``code``, without their middle, which keeps digits: middle, rows, squared norms, starts of the runs of equal codes, codes."""
    order, middle = np.lexsort(code.T[::-1]), x.mean(0)
    x, code = x[order] - middle, code[order]
    starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]).any(1)))
    return middle, x, (x ** 2).sum(1), starts, code[starts]


def add_distances(points: np.ndarray, chunk: tuple, totals: np.ndarray) -> None:
    """Adds the distances of the points to the rows of the chunk to ``totals`` (places in codes x points)."""
    middle, x, squares, starts, codes = chunk
    points = points - middle
    norm = (points ** 2).sum(1)
    left = np.column_stack([points, norm, np.ones(len(points))])
    for at in range(0, len(x), TILE[1]):
        y, square = x[at:at + TILE[1]], squares[at:at + TILE[1]]
        right = np.vstack([-2 * y.T, np.ones(len(y)), square])
        inside = starts[(starts > at) & (starts < at + len(y))]
        runs, code = np.append(0, inside - at), codes[np.searchsorted(starts, np.append(at, inside), "right") - 1]
        for lo in range(0, len(points), TILE[0]):
            d = left[lo:lo + TILE[0]] @ right
            near = np.flatnonzero(d <= NEAR * (norm[lo:lo + TILE[0]].max() + square.max()))
            if len(near):
                i, j = np.divmod(near, len(y))
                d.ravel()[near] = ((points[lo + i] - y[j]) ** 2).sum(1)
            for kinds, total in zip(code, np.add.reduceat(np.sqrt(d, out=d), runs, axis=1).T):
                totals[kinds, lo:lo + TILE[0]] += total


def euclidean_silhouettes(labelled: DataFrame, labels: list[str], cols: list[str] = FX.FEATURE_NAMES) -> dict[str, float | None]:
    """Exact mean silhouette with Euclidean distances of each column of labels; None for fewer than 2 clusters.

    Every row is measured from every row, once for all columns of labels: the work is quadratic in the rows, as the score is. Rows are dealt to tasks, which
    go through all rows in chunks and keep only sums per cluster. Noise (label < 0 or null) is left out; a row alone in its cluster scores 0.
    """
    own = [F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"_l{i}") for i, c in enumerate(labels)]
    rows = labelled.dropna(subset=cols).select(*own, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    rows = materialize(rows.filter(F.greatest(F.lit(-1), *[F.col(f"_l{i}") for i in range(len(labels))]) >= 0), "silhouette")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_l{i}").alias("c")) for i in range(len(labels))])).alias("o")
    found = sorted((r["i"], r["c"], r["n"]) for r in rows.select(each).groupBy("o.i", "o.c").agg(F.count(F.lit(1)).alias("n")).collect() if r["c"] >= 0)
    kinds = [np.array([c for i, c, _ in found if i == k], np.int64) for k in range(len(labels))]
    sizes, first = np.array([n for _, _, n in found], float), np.cumsum([0, *map(len, kinds)])
    xs, ls, step = [f"_x{i}" for i in range(len(cols))], [f"_l{i}" for i in range(len(labels))], max(16, SUMS // (len(found) + 1))

    def coded(pdf):
        """For each row and column of labels the place of its cluster among all; noise comes last."""
        c = pdf[ls].to_numpy(np.int64)
        return np.column_stack([np.where(c[:, k] < 0, first[-1], first[k] + np.searchsorted(kinds[k], c[:, k])) for k in range(len(kinds))])

    n = rows.count()
    chunks = chunks_of(rows, n, lambda pdf: in_runs(pdf[xs].to_numpy(float), coded(pdf)))

    def score(batches):
        for pdf in (whole.iloc[lo:lo + step] for whole in batches for lo in range(0, len(whole), step)):
            x, code, totals = pdf[xs].to_numpy(float), coded(pdf), np.zeros((first[-1] + 1, len(pdf)))
            for chunk in chunks:
                add_distances(x, chunk, totals)
            for k in range(len(kinds)):
                at = np.flatnonzero(code[:, k] < first[-1])
                if len(kinds[k]) < 2 or not len(at):
                    continue
                mine, here = code[at, k], slice(first[k], first[k + 1])
                size = sizes[mine]
                a = totals[mine, at] / np.maximum(size - 1, 1)
                means = totals[here, at] / sizes[here, None]
                means[mine - first[k], np.arange(len(at))] = np.inf
                least = means.min(0)
                top = np.maximum(a, least)
                s = np.where((size > 1) & (top > 0), (least - a) / np.where(top > 0, top, 1.0), 0.0)
                yield pd.DataFrame({"k": [k], "s": [s.sum()], "n": [len(s)]})

    scored = spread(rows, n).mapInPandas(score, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    chunks.destroy()
    means = {labels[r["k"]]: r["s"] for r in scored}
    return {c: means.get(c) for c in labels}


#: Rows that stand for a cluster at least, where a caller asks for an estimate.
LEAST_SAMPLE = 50


def cluster_sample(labelled: DataFrame, label: str, cols: list[str], sample: int, seed: int = 42) -> DataFrame:
    """(c, x, p, n): rows drawn with probability p from clusters of n. A cluster of no more rows than its share of ``sample`` is taken as a whole;
    of others a row's p is in proportion to its distance from the cluster's mean, half of it evenly, which keeps a far row from weighing too much.
    Which rows are drawn depends on a digest of the id alone."""
    rows = labelled.select("customer_id", F.col(label).alias("c"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    cen = centroids(labelled, label, cols).select("c", "n", F.array(*[f"m_{c}" for c in cols]).alias("mean"))
    far = F.sqrt(F.aggregate(F.zip_with("x", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    rows = rows.join(F.broadcast(cen), "c").withColumn("far", far)
    size = rows.groupBy("c").agg(F.sum("far").alias("all_far")).crossJoin(F.broadcast(cen.agg(F.count(F.lit(1)).alias("k"))))
    share = F.greatest(F.floor(F.lit(sample) / F.col("k")), F.lit(LEAST_SAMPLE))
    even = F.lit(0.5) / F.col("n")
    p = F.when(F.col("n") <= share, 1.0).otherwise(F.least(F.lit(1.0), share * (even + F.when(F.col("all_far") > 0, F.lit(0.5) * F.col("far") / F.col("all_far")).otherwise(even))))
    u = F.conv(F.substring(F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f"#{seed}"))), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return rows.join(F.broadcast(size), "c").withColumn("p", p).filter(u < F.col("p")).select("c", "x", "p", "n")


def silhouette_euclidean(labelled: DataFrame, label: str = "cluster", cols: list[str] = FX.FEATURE_NAMES, sample: int | None = None,
                         seed: int = 42) -> DataFrame:
    """Mean silhouette of all rows with Euclidean distances (M13), and ``bound``: one row, nulls for fewer than 2 clusters.

    Exact over all pairs of rows, with bound 0 (``euclidean_silhouettes``), unless the caller asks for an estimate by naming a ``sample``: then a row's mean
    distance to a cluster is estimated from the cluster's sampled rows (``cluster_sample``), each weighed by 1 / p. The estimate is exact, and bound 0,
    while the sample holds all rows; beyond, the relative standard error of each mean distance is below 2 / sqrt(rows drawn a cluster), and bound is four
    times the least such figure of the clusters. Noise (label < 0) is left out; a row alone in its cluster scores 0.
    """
    if sample is None:
        score = euclidean_silhouettes(labelled, [label], cols)[label]
        return labelled.sparkSession.createDataFrame([(score, None if score is None else 0.0)], "silhouette double, bound double")
    v = _valid(labelled, label).dropna(subset=cols)
    spark = labelled.sparkSession
    drawn = cluster_sample(v, label, cols, sample, seed).toPandas()          # ``sample`` rows, or LEAST_SAMPLE a cluster
    kinds = sorted(drawn["c"].unique())
    if len(kinds) < 2:
        return spark.createDataFrame([(None, None)], "silhouette double, bound double")
    parts = [drawn[drawn["c"] == c] for c in kinds]
    shared = spark.sparkContext.broadcast([(np.array(p["x"].tolist()), 1 / p["p"].to_numpy(), int(p["n"].iloc[0])) for p in parts])
    place = {c: i for i, c in enumerate(kinds)}

    def score(batches):
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.iloc[lo:lo + 256]
                x, own = b[cols].to_numpy(dtype=float), b["_c"].map(place).to_numpy()
                totals, n = np.zeros((len(b), len(kinds))), np.array([m for _, _, m in shared.value], float)
                for j, (y, weight, _) in enumerate(shared.value):
                    d = np.zeros((len(x), len(y)))
                    for i in range(x.shape[1]):
                        d += (x[:, i, None] - y[None, :, i]) ** 2
                    totals[:, j] = np.sqrt(d) @ weight
                rows = np.arange(len(b))
                a = totals[rows, own] / np.maximum(n[own] - 1, 1)
                means = totals / n
                means[rows, own] = np.inf
                least = means.min(1)
                top = np.maximum(a, least)
                yield pd.DataFrame({"s": np.where((n[own] > 1) & (top > 0), (least - a) / np.where(top > 0, top, 1.0), 0.0)})

    bound = max([0.0] + [8 / float(np.sqrt(len(p))) for p in parts if len(p) < p["n"].iloc[0]])
    return v.select(F.col(label).alias("_c"), *cols).mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette")) \
        .withColumn("bound", F.lit(bound))


def centroids(labelled: DataFrame, label: str, cols: list[str]) -> DataFrame:
    return _valid(labelled, label).groupBy(F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols])


def davies_bouldin(labelled: DataFrame, label: str = "cluster", cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j) (M14). K-row statistics only."""
    v = _valid(labelled, label)
    cen = centroids(v, label, cols)
    dist = F.sqrt(sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in cols))
    s = v.join(F.broadcast(cen), v[label] == cen["c"]).groupBy("c").agg(F.avg(dist).alias("s"))
    k = cen.join(s, "c")
    allc = k.agg(F.collect_list(F.struct("c", "s", *[f"m_{c}" for c in cols])).alias("_all"))   # K entries
    x = k.join(F.broadcast(allc), how="inner")

    def ratio(o):
        d = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"m_{c}") - o[f"m_{c}"]) ** 2 for c in cols]))
        return (F.col("s") + o["s"]) / d

    r = x.select("c", F.array_max(F.transform(F.filter("_all", lambda o: o["c"] != F.col("c")), ratio)).alias("r"))
    return r.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(labelled: DataFrame, label: str = "cluster", cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """(between / (K − 1)) / (within / (n − K))."""
    v = _valid(labelled, label)
    cen = centroids(v, label, cols)
    within = v.join(F.broadcast(cen), v[label] == cen["c"]) \
        .agg(F.sum(sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in cols)).alias("w"))
    glob = v.agg(F.count(F.lit(1)).alias("n_all"), *[F.avg(c).alias(f"g_{c}") for c in cols])
    between = cen.crossJoin(F.broadcast(glob)).agg(
        F.sum(F.col("n") * sum((F.col(f"m_{c}") - F.col(f"g_{c}")) ** 2 for c in cols)).alias("b"),
        F.count(F.lit(1)).alias("k"), F.first("n_all").alias("n_all"))
    x = between.crossJoin(within)
    return x.select(F.when((F.col("k") > 1) & (F.col("w") > 0),
                           (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n_all") - F.col("k"))))
                    .alias("calinski_harabasz"))


def feature_importance(scaled_labelled: DataFrame, label: str = "seg", cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Population std of the scaled segment centroids per feature, divided by the largest (M9)."""
    cen = scaled_labelled.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])
    stack = "stack({}, {}) AS (feature, v)".format(len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    long = cen.select(F.expr(stack))
    sd = long.groupBy("feature").agg(F.stddev_pop("v").alias("sd"))
    mx = F.max("sd").over(Window.partitionBy())
    return sd.select("feature", (F.col("sd") / F.when(mx > 0, mx).otherwise(F.lit(1.0))).alias("value"))


def compare_algorithms(scaled: DataFrame, k: int = 4, seed: int = 42, n_init: int = 10,
                       cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Algorithm x (segments, silhouette, Davies-Bouldin, Calinski-Harabasz, noise) with the winner
    per metric and the overall winner (most wins) (M16)."""
    from cohortlab.operators.cluster import gmm_segments, kmeans_segments
    from cohortlab.operators.density import dbscan
    from cohortlab.operators.linkage import ward_segments
    spark = scaled.sparkSession
    scaled = materialize(scaled.select("customer_id", *cols), "model_input")
    runs = {"KMeans": kmeans_segments(scaled, k, seed, n_init, cols),
            "GaussianMixture": gmm_segments(scaled, k, seed, cols),
            "Hierarchical": ward_segments(scaled, k, cols),
            "DBSCAN": scaled.join(dbscan(scaled, cols=cols).select("customer_id", "cluster"), "customer_id")}
    runs, rows = {name: lab.cache() for name, lab in runs.items()}, []
    ids = scaled.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("ids")).first()
    if ids["n"] == ids["ids"]:                     # all labels beside each row: its distances are measured once for all algorithms
        beside = reduce(lambda x, name: x.join(runs[name].select("customer_id", F.col("cluster").alias(name)), "customer_id", "left"), runs, scaled)
        scores = euclidean_silhouettes(beside, list(runs), cols)
    else:
        scores = {name: euclidean_silhouettes(lab, ["cluster"], cols)["cluster"] for name, lab in runs.items()}
    for name, lab in runs.items():
        segs = lab.filter(F.col("cluster") >= 0).select("cluster").distinct().count()
        noise = lab.filter(F.col("cluster") < 0).count()
        db = davies_bouldin(lab, "cluster", cols).first()[0] if segs >= 2 else None
        ch = calinski_harabasz(lab, "cluster", cols).first()[0] if segs >= 2 else None
        rows.append((name, int(segs), scores[name], db, ch, int(noise)))
        lab.unpersist()
    t = spark.createDataFrame(rows, "algorithm string, segments int, silhouette double, davies_bouldin double, "
                                    "calinski_harabasz double, noise_points int")
    w = Window.partitionBy()
    best_sil = F.max("silhouette").over(w)
    best_db = F.min("davies_bouldin").over(w)
    best_ch = F.max("calinski_harabasz").over(w)
    t = t.withColumn("wins", (F.col("silhouette") == best_sil).cast("int") + (F.col("davies_bouldin") == best_db).cast("int")
                     + (F.col("calinski_harabasz") == best_ch).cast("int"))
    t = t.withColumn("wins", F.coalesce("wins", F.lit(0)))
    # most wins; ties go to the silhouette's winner first, then by name; nobody wins without a valid score
    return t.withColumn("_leads", F.coalesce(F.col("silhouette") == best_sil, F.lit(False))) \
        .withColumn("overall_winner", (F.row_number().over(Window.orderBy(F.desc("wins"), F.desc("_leads"), F.asc("algorithm"))) == 1) & (F.col("wins") > 0)).drop("_leads")
