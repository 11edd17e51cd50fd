"""Quality by hierarchical empirical Bayes.

A logistic regression on simple counts of the text gives each document's own evidence. Hosts and the
paths below them get posteriors by grouped aggregation: a path's mean is shrunk toward its host's,
a host's toward the mean of all, the more so the fewer documents there are; how strongly, the spread
between groups tells. A document's quality combines its evidence with the posterior of its path, which
leaves out the document itself.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import WORD, store

#: The evidence is fitted on about this many labelled texts, chosen by a hash of the id.
MAX_TRAIN_ROWS = 100_000
FEATURES = ("long", "word_length", "symbols", "digits", "ends", "upper", "repeated_lines", "repeated_words", "line_length")
_EDGE = 1e-6


def _features(text: Column) -> list[Column]:
    """Counts of the whole text, as shares or logarithms; all 0 for an empty one."""
    chars = F.greatest(F.length("text"), F.lit(1))
    words = F.greatest(F.size("words"), F.lit(1))
    return [F.log1p(F.size("words")).alias("long"), (F.length("text") / words / 10).alias("word_length"),
            (F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / chars * 10).alias("symbols"), (F.regexp_count(text, F.lit("[0-9]")) / chars * 10).alias("digits"),
            (F.regexp_count(text, F.lit(r"[.!?]")) / words * 10).alias("ends"), (F.regexp_count(text, F.lit("[A-Z]")) / chars * 10).alias("upper"),
            (1 - F.size(F.array_distinct("lines")) / F.size("lines")).alias("repeated_lines"),
            (1 - F.size(F.array_distinct("words")) / words).alias("repeated_words"),
            F.log1p(F.length("text") / F.size("lines")).alias("line_length")]


def _measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    work = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), text.alias("text"))
    work = work.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.split("text", "\n").alias("lines"))
    return work.select("doc_id", "host", "path", *_features(F.col("text")))


def _evidence(measured: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``measured`` with p, the probability of good quality by the text alone; 0.5 without two classes of labels."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("double").alias("label")))
    share = int(min(1.0, max_rows / max(1, known.count())) * 1_000_000)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < share)
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = store(gather.transform(measured.join(F.broadcast(chosen), "doc_id")).select("label", "features"), "quality-train")
    if train.select("label").distinct().count() < 2:
        return measured.withColumn("p", F.lit(0.5))
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(train)
    return (model.transform(gather.transform(measured))
            .withColumn("p", F.least(F.greatest(vector_to_array("probability")[1], F.lit(_EDGE)), F.lit(1 - _EDGE))))


def _pull(groups: DataFrame, parent: str) -> float:
    """How many documents' worth a group is pulled toward its parent's mean: variance within groups over
    variance between them (method of moments). ``groups`` has n, total, squares and the parent's mean."""
    mean = F.col("total") / F.col("n")
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("groups"),
                     F.sum(F.col("squares") - F.col("total") * mean).alias("within"),
                     F.sum(F.col("n") * (mean - F.col(parent)) ** 2).alias("between")).first()
    if not row["n"] or row["groups"] < 2 or row["n"] <= row["groups"]:
        return 1.0
    within = max(row["within"] / (row["n"] - row["groups"]), 1e-9)
    between = (row["between"] - (row["groups"] - 1) * within) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(max(within / max(between, 1e-9), 1.0), 1e6))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(stored table host, path, n, total, host_mean), pull of paths, mean of all, from rows (host, path, p)."""
    paths = store(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") ** 2).alias("squares")), "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    every = hosts.agg(F.sum("n"), F.sum("total")).first()
    mean = every[1] / every[0] if every[0] else 0.5
    pull = _pull(hosts.withColumn("mean", F.lit(mean)), "mean")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("total") + pull * mean) / (F.col("n") + pull)).alias("host_mean"))
    joined = store(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-sites")
    return joined, _pull(joined, "host_mean"), mean


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, evidence, site, score, kept) for every input row: the probability of good quality by the text, the
    posterior of its path without it, both together, and whether that is at least 0.5.

    Documents without urls take ``host`` and ``path`` from columns; a null host or path is a site of its own. Null
    and empty texts have counts of 0. Null and repeated ids and repeated rows give their own rows; null labels
    are left out and several of one id go by majority; further columns are ignored; an empty table gives no row.
    """
    scored = store(_evidence(_measured(docs, host, path), labels, max_rows).select("doc_id", "host", "path", "p"), "quality-evidence")
    sites, pull, mean = site_posteriors(scored)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "total", "host_mean")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    site = (F.col("total") - F.col("p") + pull * F.col("host_mean")) / (F.col("n") - 1 + pull)
    logit = lambda x: F.log(x / (1 - x))
    out = joined.withColumn("site", F.least(F.greatest(site, F.lit(_EDGE)), F.lit(1 - _EDGE)))
    score = 1 / (1 + F.exp(-(logit(F.col("p")) + logit(F.col("site")) - F.lit(mean_logit(mean)))))
    return out.select("doc_id", F.col("p").alias("evidence"), "site", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def mean_logit(mean: float) -> float:
    mean = min(max(mean, _EDGE), 1 - _EDGE)
    return math.log(mean / (1 - mean))
