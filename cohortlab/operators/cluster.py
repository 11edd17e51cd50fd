"""Clustering, ranking, naming and projection.

Model fits use ``pyspark.ml`` on a cached vector frame; only model facts sized by K or by the
10 features (centroids, costs, loadings) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.operators import kmeans as KM
from cohortlab.operators import mixture as MX
from cohortlab.session import materialize

# ---- vectors ----------------------------------------------------------------------------


def assemble(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features_vec").transform(scaled) \
        .select("customer_id", "features_vec", *cols)


def model_input(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Vector frame for iterative fits: lineage cut by a table written to the shared
    ``spark.checkpoint.dir`` (survives executor loss). Fits cache it while they iterate and release it."""
    return assemble(materialize(scaled, "model_input"), cols)


# ---- M3 / M4 ----------------------------------------------------------------------------


def kmeans_segments(scaled: DataFrame, k: int = 4, seed: int = 42, n_init: int = 10,
                    cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """customer_id, cluster (raw K-Means label) and the features (M3). The labels depend on ids, values and seed, not on how
    the rows are partitioned."""
    if not FX.K_MIN <= k <= FX.K_MAX:
        raise ValueError(f"k must be in [{FX.K_MIN}, {FX.K_MAX}]")
    kept = materialize(scaled.select("customer_id", *cols), "model_input")
    points = KM.whole(kept, cols)
    labels = KM.assign(points, KM.fit(points, [k], len(cols), seed, n_init)[k], len(cols))
    return labels.join(kept, "customer_id").select("customer_id", "cluster", *cols)


def k_sweep(scaled: DataFrame, ks=range(2, 9), seed: int = 42, n_init: int = 10,
            cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Inertia and silhouette over all rows per K, 2 to 8 (M4); naming alone is limited to 7."""
    from cohortlab.operators.scores import euclidean_silhouettes
    kept = materialize(scaled.select("customer_id", *cols), "model_input")
    points = KM.whole(kept, cols)
    models = KM.fit(points, list(ks), len(cols), seed, n_init)
    labelled = materialize(KM.assign_each(points, models, len(cols)).join(kept, "customer_id"), "labels")
    scores = euclidean_silhouettes(labelled, [f"k{k}" for k in models], cols)
    rows = [(int(k), model.cost, scores[f"k{k}"]) for k, model in models.items()]
    return scaled.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


# ---- M5 / M6 ----------------------------------------------------------------------------


def cluster_stats(feat: DataFrame, label: str) -> DataFrame:
    return feat.groupBy(F.col(label).alias("cluster")).agg(
        F.avg("spend_365").alias("avg_spend"), F.avg("order_count").alias("avg_orders"),
        F.avg("recency").alias("avg_recency"))


def rank_clusters(feat: DataFrame, label: str = "cluster") -> DataFrame:
    """cluster -> seg: min-max of mean spend_365, mean orders and inverted mean recency across
    clusters, score .4/.3/.3, best score -> seg 0 (ties: lower cluster first) (M5)."""
    st = cluster_stats(feat, label)
    w = Window.partitionBy()

    def mm(c, invert=False):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        v = (F.col(c) - lo) / (hi - lo)
        v = (F.lit(1.0) - v) if invert else v
        return F.when(hi - lo > 0, v).otherwise(F.lit(0.0))

    sc = st.withColumn("score", F.lit(FX.RANK_WEIGHTS["spend"]) * mm("avg_spend")
                       + F.lit(FX.RANK_WEIGHTS["orders"]) * mm("avg_orders")
                       + F.lit(FX.RANK_WEIGHTS["recency"]) * mm("avg_recency", invert=True))
    return sc.withColumn("seg", (F.row_number().over(Window.orderBy(F.desc("score"), F.asc("cluster"))) - 1).cast("int")) \
        .select("cluster", "seg", "score")


def templates(spark, k: int) -> DataFrame:
    t = FX.SEGMENT_TEMPLATES.get(k, FX.SEGMENT_TEMPLATES[4])
    return spark.createDataFrame([(i, *row) for i, row in enumerate(t)],
                                 "name_rank int, name string, icon string, color string, color_bg string, description string")


def name_segments(feat: DataFrame, k: int, label: str = "seg") -> DataFrame:
    """seg -> template name: segments ranked by mean spend_365 desc, mean recency asc (ties: lower
    seg first) take the K-template names in order (M6)."""
    st = feat.groupBy(F.col(label).alias("seg")).agg(F.avg("spend_365").alias("avg_sp365"),
                                                     F.avg("recency").alias("avg_recency"))
    r = st.withColumn("name_rank", (F.row_number().over(
        Window.orderBy(F.desc("avg_sp365"), F.asc("avg_recency"), F.asc("seg"))) - 1).cast("int"))
    return r.join(F.broadcast(templates(feat.sparkSession, k)), "name_rank", "left") \
        .select("seg", "name_rank", "name", "icon", "color", "color_bg", "description")


def segment_customers(features: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """Features + cluster -> seg id (M5) and segment name (M6)."""
    f = features.join(clusters.select("customer_id", "cluster"), "customer_id")
    ranked = f.join(F.broadcast(rank_clusters(f)), "cluster")
    names = name_segments(ranked, k).select("seg", F.col("name").alias("segment"))
    return ranked.join(F.broadcast(names), "seg")


# ---- M7 / M8 / M17 ----------------------------------------------------------------------


def fit_pca(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES, k: int = 2):
    """2-component PCA on the (already centred) scaled features; each component's sign is fixed
    so that its largest absolute loading is positive. Returns (model, components[k x d], ratios)."""
    vec = model_input(scaled, cols)
    model = PCA(k=k, inputCol="features_vec", outputCol="pca_vec").fit(vec)
    pc = model.pc.toArray().T.copy()                       # k x d (d = 10: a model fact)
    for i in range(pc.shape[0]):
        if pc[i, np.argmax(np.abs(pc[i]))] < 0:
            pc[i] = -pc[i]
    return model, pc, [float(v) for v in model.explainedVariance.toArray()]


def pca_2d(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES, fit=None) -> DataFrame:
    """customer_id, pca_x, pca_y: projection as a column expression of the 10 loadings (M7). ``fit`` is a
    result of ``fit_pca`` to use again."""
    _, pc, _ = fit or fit_pca(scaled, cols)
    proj = [sum(F.col(c) * float(pc[i, j]) for j, c in enumerate(cols)) for i in range(2)]
    return scaled.select("customer_id", proj[0].alias("pca_x"), proj[1].alias("pca_y"))


def pca_meta(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES, fit=None) -> DataFrame:
    """Explained variance % per component and the total (M7)."""
    _, _, ev = fit or fit_pca(scaled, cols)
    rows = [(f"pc{i + 1}", v * 100.0) for i, v in enumerate(ev)]
    df = scaled.sparkSession.createDataFrame(rows, "component string, explained_variance double")
    return df.withColumn("total_explained", F.sum("explained_variance").over(Window.partitionBy()))


def pca_loadings(scaled: DataFrame, cols: list[str] = FX.FEATURE_NAMES, fit=None) -> DataFrame:
    """feature, pc1, pc2 (M8)."""
    _, pc, _ = fit or fit_pca(scaled, cols)
    rows = [(c, float(pc[0, j]), float(pc[1, j])) for j, c in enumerate(cols)]
    return scaled.sparkSession.createDataFrame(rows, "feature string, pc1 double, pc2 double")


# FIXED VALUES: display labels of the model features (in the source's order).
FEATURE_LABELS = {
    "total_spend": "Spending Power",
    "spend_velocity": "Spending Velocity",
    "aov": "Avg Order Value",
    "order_count": "Order Frequency",
    "recency": "Recency",
    "avg_discount": "Discount Usage",
    "active_months": "Activity Duration",
    "return_rate": "Return Rate",
    "diversity": "Category Diversity",
    "clv_slope": "CLV Growth",
}


def dominant_feature(loadings: DataFrame) -> DataFrame:
    """Per component: the feature with the largest absolute loading and its label."""
    long = loadings.select("feature", F.expr("stack(2, 'pc1', pc1, 'pc2', pc2) AS (component, loading)"))
    lab = loadings.sparkSession.createDataFrame(list(FEATURE_LABELS.items()), "feature string, label string")
    top = long.groupBy("component").agg(F.max_by(F.struct("feature", "loading"), F.abs("loading")).alias("t"))
    return top.select("component", "t.feature", "t.loading").join(F.broadcast(lab), "feature", "left") \
        .withColumn("label", F.coalesce("label", "feature"))


# ---- M10 / M11 --------------------------------------------------------------------------


def gmm_segments(scaled: DataFrame, k: int = 4, seed: int = 42, cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Gaussian mixture labels."""
    vec = model_input(scaled, cols)
    return vec.select("customer_id", MX.label(MX.fit(vec, cols, k, seed), cols).alias("cluster"), *cols)


def hierarchical_segments(scaled: DataFrame, k: int = 4, seed: int = 42, cols: list[str] = FX.FEATURE_NAMES) -> DataFrame:
    """Hierarchical labels by bisecting K-Means over every row: the divisive form, beside Ward linkage
    (``linkage.ward_segments``, M11)."""
    vec = model_input(scaled, cols)
    m = BisectingKMeans(k=k, seed=seed, featuresCol="features_vec", predictionCol="cluster").fit(vec)
    return m.transform(vec).select("customer_id", F.col("cluster").cast("int").alias("cluster"), *cols)


# ---- M18 --------------------------------------------------------------------------------


def sample_customers(feat: DataFrame, n: int = FX.SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """Deterministic fixed-seed sample: the n customers with the smallest md5(id#seed) — a
    distributed top-k (TakeOrderedAndProject), identical in any engine that has md5 (M18)."""
    key = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f"#{seed}")))
    return feat.withColumn("_k", key).orderBy("_k").limit(n).drop("_k")
