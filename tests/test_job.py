"""End-to-end batch job (M19) with the invariants of SURVEY §5."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import cleaning as C
from cohortlab.plans import job
from cohortlab.plans.pipeline import Inputs
from cohortlab.sources import result_sets as R

SF = "/root/testdata/sf0.001"


def test_job_tables_and_invariants(spark):
    out = tempfile.mkdtemp(prefix="cohortlab-job-")
    res = job.run(spark, SF, out, job.ModelConfig(n_clusters=3, n_init=2))
    for name in ("order_lines", "features_scored", "segments", "segment_profile", "segment_revenue", "summary", "pca_meta"):
        assert name in res
    scored = spark.read.parquet(res["features_scored"])
    segs = spark.read.parquet(res["segments"])
    n = scored.count()
    assert segs.agg(F.sum("customers")).first()[0] == n
    assert sorted(r.name for r in segs.collect()) == sorted(["VIP", "Loyal", "Lost"])
    total = C.deduped_paid_revenue(Inputs(spark, SF).payment_log).first()[0]
    rev = spark.read.parquet(res["segment_revenue"]).agg(F.sum("revenue")).first()[0]
    assert rev == pytest.approx(round(total, 2), abs=0.005)
    ev = spark.read.parquet(res["pca_meta"]).collect()
    assert all(0 < r.explained_variance <= 100 for r in ev)
    assert R.current_set(spark, out) == res["summary"].rsplit("/", 1)[0]

    again = job.retrain(spark, SF, out, n_clusters=2, n_init=1)
    now = R.read_result(spark, out, "segments")
    assert now.count() == 2 and R.current_set(spark, out) == again["summary"].rsplit("/", 1)[0]
    assert now.agg(F.sum("customers")).first()[0] == n and '"n_clusters": 2' in R.read_result(spark, out, "config").first()[0]
    assert spark.read.parquet(res["segments"]).count() == 3       # the set before is still there for its readers


def test_config_validation():
    with pytest.raises(ValueError):
        job.ModelConfig(n_clusters=8).validate()
    with pytest.raises(ValueError):
        job.ModelConfig(scaler="log").validate()
