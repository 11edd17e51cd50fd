"""The registered queries: SQL twins where there are some, and the pipeline stage by stage."""

import pytest
from harness import compare, duck
from llm_cases import SF, edge_docs, empty_docs, table

import __spark_entry__ as E
import corpus_pipeline
from cohortlab.llm import common, decontam, probminhash, queries, secret_scan, toxicity


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    ok, info = compare(E.queries()[name](spark, SF), E.oracle_sql()[name], con)
    assert ok, info


def test_all_are_registered():
    names = [n for n in E.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def test_stages(spark):
    """Every stage on all that the one before kept, against what the operators say row by row."""
    docs = table(spark, "documents")
    labels, benchmark = table(spark, "labels"), table(spark, "benchmark")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, SF).cache()
        if name == "toxicity":
            assert ids(out) == ids(before) - ids(toxicity.score_toxicity(before, labels).filter("predicted = 1"))
        elif name == "near_duplicates":
            assert ids(out) == {r["class_id"] for r in probminhash.near_duplicates(before).collect()} and out.count() == len(ids(out))
        elif name == "decontamination":
            assert ids(out) == ids(before) - ids(decontam.find_leaks(before, benchmark))
        elif name == "secrets":
            assert ids(out) == ids(before) and secret_scan.scan_secrets(out).filter("n_access + n_hex > 0").count() == 0
        if name != "mixing":
            assert out.columns == docs.columns
    assert ids(out) <= ids(before) and {"copy", "shard", "shard_order"} <= set(out.columns)


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        assert set(docs.columns) <= set(out.columns) and (out.count() > 0) == (docs.count() > 0)


def test_stages_read_whole_texts_in_small_batches(spark, monkeypatch):
    """Training, near duplicates and passage counts read and send few rows at once, whoever calls the stage; settings come back."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    seen, before = {}, [spark.conf.get(n) for n in names]

    def noted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a: (seen.setdefault(name, []).append([int(spark.conf.get(n)) for n in names]), real(*a))[1])

    for module, name in ((toxicity, "training_rows"), (toxicity, "log_count_ratios"), (decontam, "passage_frequencies"), (probminhash, "store")):
        noted(module, name)
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(9)], "doc_id long, text string")
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        stage(spark, docs, SF)
    assert len(seen) == 4 and all(rows <= common.TEXTS for at in seen.values() for both in at for rows in both), seen
    assert [spark.conf.get(n) for n in names] == before
