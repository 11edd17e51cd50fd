"""End-to-end batch job and retrain (M19): raw tables -> order lines -> features -> model ->
scored customers -> profiles / KPIs, each written as a parquet table (overwrite).

    python -m cohortlab.plans.job --data /path/to/tables --out /shared/results --k 4

The three big intermediates (order lines, features, scored features) are written once and
everything downstream reads them, so a lost executor only recomputes from the last table.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortlab.functions import fixed as FX
from cohortlab.operators import cleaning as C
from cohortlab.operators import cluster as M
from cohortlab.operators import kpis as K
from cohortlab.operators import prep as P
from cohortlab.operators import profile as G
from cohortlab.operators import scores as SC
from cohortlab.plans.pipeline import Inputs
from cohortlab.sources import result_sets as R
from cohortlab.sources.tables import write_table


@dataclass
class ModelConfig:
    n_clusters: int = 4
    random_state: int = 42
    n_init: int = 10
    scaler: str = "standard"
    features: list[str] = field(default_factory=lambda: list(FX.FEATURE_NAMES))
    k_sweep: bool = False

    def validate(self) -> "ModelConfig":
        if not FX.K_MIN <= self.n_clusters <= FX.K_MAX:
            raise ValueError(f"n_clusters must be in [{FX.K_MIN}, {FX.K_MAX}]")
        if self.scaler not in P.SCALERS:
            raise ValueError(f"scaler must be one of {sorted(P.SCALERS)}")
        unknown = set(self.features) - set(FX.FEATURE_NAMES)
        if unknown:
            raise ValueError(f"unknown features {sorted(unknown)}")
        return self


def run(spark: SparkSession, data_dir: str, out_dir: str, cfg: ModelConfig | None = None) -> dict:
    """Rebuild every result table for ``cfg`` as one set below ``out_dir``, published when all of it is written; returns
    {table: path}. Until then, and when the run fails, ``read_result`` goes on giving the set before it."""
    from cohortlab import session
    cfg = (cfg or ModelConfig()).validate()
    before = set(session.STORED)
    I = Inputs(spark, data_dir)                        # lines and features materialised once
    out: dict[str, str] = {}
    folder = R.new_set(out_dir)

    def save(name, df, **kw):
        path = f"{folder}/{name}"
        write_table(df, path, **kw)
        out[name] = path

    save("order_lines", I.flines, sort_by=["customer_id", "order_date"])
    save("returns", I.returns)
    save("customers", I.customers)
    save("products", I.products)

    scaled = P.scaled_features(I.features, cfg.features, cfg.scaler)
    clusters = M.kmeans_segments(scaled, cfg.n_clusters, cfg.random_state, cfg.n_init, cfg.features)
    scored = M.segment_customers(I.features, clusters, cfg.n_clusters).drop(*[c for c in cfg.features
                                                                             if c not in I.features.columns])
    fit = M.fit_pca(scaled, cfg.features)
    pca = M.pca_2d(scaled, cfg.features, fit)
    save("features_scored", scored.join(pca, "customer_id", "left"), sort_by=["seg", "customer_id"])
    scored = spark.read.parquet(out["features_scored"])

    save("segments", M.name_segments(scored, cfg.n_clusters).join(G.segment_counts(scored), "seg", "left"))
    save("segment_profile", G.segment_profile(scored))
    save("segment_monthly_spend", G.segment_monthly_spend(I.flines, scored))
    save("segment_category_share", G.segment_category_share(I.flines, scored))
    total = C.deduped_paid_revenue(I.payment_log)
    save("segment_revenue", G.segment_revenue(I.flines, I.returns, scored, total))
    save("segment_actions", G.segment_actions(spark, scored))
    save("summary", K.global_summary(I.flines, I.returns, I.features, I.ref))
    save("monthly_revenue", K.monthly_revenue(I.flines))
    save("monthly_aov", K.monthly_aov(I.flines, I.returns))
    save("category_revenue", K.category_revenue(I.flines))
    save("quarterly_top_products", K.quarterly_top_products(I.flines, I.ref, I.products))
    save("quarterly_top_categories", K.quarterly_top_categories(I.flines, I.ref))
    save("distributions", K.distributions(I.flines, I.customers))
    save("payment_stats", C.payment_stats(I.payment_log))
    save("pca_meta", M.pca_meta(scaled, cfg.features, fit))
    save("pca_loadings", M.pca_loadings(scaled, cfg.features, fit))
    save("feature_importance", SC.feature_importance(scaled.join(scored.select("customer_id", "seg"), "customer_id"),
                                                     "seg", cfg.features))
    save("sample", M.sample_customers(scored, FX.SAMPLE_SIZE, cfg.random_state))
    if cfg.k_sweep:
        save("k_scores", M.k_sweep(scaled, range(2, 9), cfg.random_state, cfg.n_init, cfg.features))
    kept = {"revenue_by_segment": ("segment_revenue", ["seg", "revenue"]), "monthly_revenue": ("monthly_revenue", ["ym", "revenue"]),
            "monthly_aov": ("monthly_aov", ["ym", "aov"]), "category_revenue": ("category_revenue", ["category", "revenue"]),
            "k_scores": ("k_scores", ["k", "silhouette"])}
    save("summary_sections", K.summary_sections(**{part: spark.read.parquet(out[name]).select(*cols)
                                                   for part, (name, cols) in kept.items() if name in out}))
    save("config", spark.createDataFrame([(json.dumps(asdict(cfg)),)], "config string"))
    R.publish(spark, folder)
    R.drop_superseded(spark, out_dir)
    session.drop_stored(spark, [p for p in session.STORED if p not in before])     # all results are written by now
    return out


def retrain(spark: SparkSession, data_dir: str, out_dir: str, **config) -> dict:
    """Re-run the whole job for a new model configuration (validated first)."""
    return run(spark, data_dir, out_dir, ModelConfig(**config))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--data", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--k", type=int, default=4)
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--n-init", type=int, default=10)
    ap.add_argument("--scaler", default="standard")
    ap.add_argument("--k-sweep", action="store_true")
    a = ap.parse_args()
    spark = SparkSession.builder.appName("cohortlab-job").getOrCreate()
    res = run(spark, a.data, a.out, ModelConfig(a.k, a.seed, a.n_init, a.scaler, k_sweep=a.k_sweep))
    print(json.dumps(res))


if __name__ == "__main__":
    main()
