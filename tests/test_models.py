"""Clustering operators against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import campaigns as CP
from cohortlab.operators import density as D
from cohortlab.operators import kmeans as KM
from cohortlab.operators import linkage as W
from cohortlab.operators import scores as SC

COLS = ["p", "q", "r"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (50, 3)) for c in ([0, 0, 0], [3, 0, 1], [0, 3, 3])] + [rng.uniform(-3, 6, (40, 3)), np.zeros((5, 3))]).round(3)
    rows = [(f"c{i:04d}", *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "customer_id string, p double, q double, r double").repartition(5).cache()
    return frame, x


def brute_dbscan(x, eps, least):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    n = (d <= eps * eps).sum(1)
    core, label, c = n >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                j = todo.pop()
                for k in np.flatnonzero((d[j] <= eps * eps) & core & (label < 0)):
                    label[k] = c
                    todo.append(k)
            c += 1
    for i in np.flatnonzero(~core):
        k = np.flatnonzero(core & (d[i] <= eps * eps))
        if len(k):
            label[i] = label[k[np.argmin(d[i, k])]]
    return [(int(a), int(b), bool(c)) for a, b, c in zip(label, n, core)]


@pytest.mark.parametrize("eps,least,size", [(0.6, 8, 4096), (0.4, 5, 9)])
def test_dbscan_against_brute_force(points, eps, least, size):
    frame, x = points
    got = {r["customer_id"]: (r["cluster"], r["n_near"], r["is_core"]) for r in D.dbscan(frame, eps, least, COLS, size).collect()}
    assert [got[f"c{i:04d}"] for i in range(len(x))] == brute_dbscan(x, eps, least)
    assert {c for c, _, _ in got.values()} >= {-1, 0, 1, 2}


def test_dbscan_of_odd_rows(spark):
    odd = spark.createDataFrame([("a", None, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 1.0)], "customer_id string, p double, q double")
    got = {r["customer_id"]: (r["cluster"], r["n_near"]) for r in D.dbscan(odd, 0.5, 2, ["p", "q"]).collect()}
    assert got == {"a": (-1, 0), "b": (0, 2), "c": (0, 2)}
    assert D.dbscan(odd.limit(0), 0.5, 2, ["p", "q"]).count() == 0 and D.dbscan(odd.limit(1), 0.5, 2, ["p", "q"]).first()["cluster"] == -1


def test_a_crowded_cell_is_many_meetings(points):
    frame, _ = points
    blocks = D.blocks(frame, COLS, 10.0, 16).cache()
    meet = D.meetings(blocks, 10.0)
    held = blocks.groupBy("cell", "part").count().join(meet, ["cell", "part"]).groupBy("meeting").agg(F.sum("count").alias("n"))
    assert held.agg(F.max("n")).first()[0] < 80 and held.count() > 50


def brute_ward(x, k):
    held, heights = {i: [i] for i in range(len(x))}, []
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    costs = {(a, b): cost(held[a], held[b]) for a in held for b in held if a < b}
    parts = None
    while len(held) > 1:
        if len(held) == k:
            parts = sorted(sorted(v) for v in held.values())
        (a, b) = min(costs, key=lambda p: (costs[p], p))
        heights.append(np.sqrt(2 * costs[a, b]))
        new = len(x) + len(heights)
        held[new] = held.pop(a) + held.pop(b)
        costs = {p: v for p, v in costs.items() if a not in p and b not in p} | {(o, new): cost(held[o], held[new]) for o in held if o != new}
    return sorted(heights), parts


@pytest.mark.parametrize("few", [1024, 60])
def test_ward_against_brute_force(points, few):
    frame, x = points
    frame, x = frame.filter("customer_id >= 'c0090'"), x[90:]
    heights, parts = brute_ward(x, 4)
    rows = W.dendrogram(frame, COLS, few=few).orderBy("step").collect()
    assert len(rows) == len(np.unique(x, axis=0)) - 1 and rows[-1]["n"] == len(x)
    assert np.allclose([r["height"] for r in rows], [h for h in heights if h > 1e-12])
    label = {int(r["customer_id"][1:]) - 90: r["cluster"] for r in W.ward_segments(frame, 4, COLS, few=few).collect()}
    assert sorted(sorted(i for i in label if label[i] == c) for c in set(label.values())) == parts


def test_ward_of_wide_cells_covers_every_row(points):
    frame, x = points
    rows = W.ward_segments(frame, 3, COLS, most_cells=30).collect()
    assert len(rows) == len(x) and {r["cluster"] for r in rows} == {0, 1, 2}
    assert W._prepared(frame, COLS, None, 30)[1].count() <= 30
    assert {r["cluster"] for r in W.ward_segments(frame.limit(2), 4, COLS).collect()} == {0, 1}


def brute_kmeans(ids_hash, x, k, seed, n_init):
    """The same seeding and steps over all rows at once."""
    best = None
    for run in range(n_init):
        centres = []
        for turn in range(k):
            d = KM.squares(x, np.array(centres)).min(1) if centres else np.ones(len(x))
            centres.append(x[np.argmin(KM.race_keys(ids_hash, d, seed, run, turn))])
        c = np.array(centres)
        for _ in range(300):
            own = KM.squares(x, c).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= 1e-4 * x.var(0).mean():
                break
        cost = KM.squares(x, c).min(1).sum()
        if best is None or cost < best[0] - 1e-6:
            best = (cost, KM.squares(x, c).argmin(1))
    return best


def test_kmeans_against_numpy_and_partitioning(points):
    frame, _ = points
    rows = KM.whole(frame, COLS).orderBy("customer_id").toPandas()
    x = rows[["x0", "x1", "x2"]].to_numpy() / KM.SCALE
    cost, label = brute_kmeans(rows["h"].to_numpy().view(np.uint64), x, 4, 7, 3)
    for parts in (1, 4, 13):
        pts = KM.whole(frame.repartition(parts, F.rand()), COLS)
        model = KM.fit(pts, [4], 3, seed=7, n_init=3)[4]
        got = KM.assign(pts, model, 3).orderBy("customer_id").toPandas()
        assert got["cluster"].tolist() == label.tolist() and model.cost == pytest.approx(cost, rel=1e-5)


def test_kmeans_of_few_rows(points):
    frame, _ = points
    pts = KM.whole(frame.limit(2), COLS)
    model = KM.fit(pts, [3], 3, n_init=2)[3]
    assert KM.assign(pts, model, 3).select("cluster").distinct().count() <= 2 and model.cost < 1e-6
    assert KM.assign(pts.limit(0), KM.fit(pts.limit(0), [2], 3)[2], 3).count() == 0


def brute_silhouette(x, label):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == k].mean() for k in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_euclidean_silhouette(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (900, 2)), rng.normal(3, 1, (700, 2)), rng.standard_cauchy((60, 2)) * 5, [[50.0, 50.0]]])
    label = np.array([0] * 900 + [1] * 700 + [2] * 60 + [3])
    frame = spark.createDataFrame([(str(i), int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(label, x))], "customer_id string, cluster int, p double, q double")
    want = brute_silhouette(x, label)
    full = SC.silhouette_euclidean(frame, "cluster", ["p", "q"], sample=4000).first()
    assert full["silhouette"] == pytest.approx(want, rel=1e-9) and full["bound"] == 0
    for sample in (400, 1600):
        got = SC.silhouette_euclidean(frame, "cluster", ["p", "q"], sample=sample).first()
        assert 0 < got["bound"] and abs(got["silhouette"] - want) <= got["bound"] * max(1, abs(want)) and abs(got["silhouette"] - want) < 0.05
    assert SC.silhouette_euclidean(frame.filter("cluster = 0"), "cluster", ["p", "q"]).first()["silhouette"] is None


def test_repeated_ids_of_incoming_campaigns(spark):
    schema = "id string, status string, created_at int"
    old = spark.createDataFrame([("a", "sent", 1)], schema)
    new = spark.createDataFrame([("a", "late", 5), ("b", "first", 2), ("b", "last", 3), ("b", "last", 3)], schema)
    assert sorted(map(tuple, CP.merge_new_campaigns(old, new).collect())) == [("a", "sent", 1), ("b", "last", 3)]
    assert sorted(map(tuple, CP.replace_campaigns(old, new).collect())) == [("a", "late", 5), ("b", "last", 3)]


def test_alerts_open_close_and_open_again(spark):
    share = {1: 30, 2: 40, 3: 50, 4: 20, 5: 36, 6: 60, 7: 10}
    snaps = spark.createDataFrame([(t, n, x) for t, p in share.items() for n, x in (("At Risk", p), ("VIP", 100 - p))] + [(None, "Lost", 9)],
                                  "at int, segment string, customers long")
    acks = spark.createDataFrame([("at_risk_high", 1), ("at_risk_high", 3), ("at_risk_high", 3), ("at_risk_high", 4), ("lost_high", 2), (None, 5), ("at_risk_high", None)],
                                 "type string, at int")
    history = CP.alert_history(snaps, acks)
    rows = [(r.opening, r.opened_at, r.closed_at, r.breaches, r.current_pct, r.baseline_pct) for r in history.orderBy("opening").collect()]
    assert rows == [(1, 2, 3, 2, 40.0, 35.0), (2, 5, None, 2, 36.0, 31.0)]
    still = CP.open_alerts(history)
    now = spark.createDataFrame([(0, "At Risk", 60), (1, "Lost", 40)], "seg int, segment string, customers long")
    assert [(r.type, r.current_pct) for r in CP.segment_alerts(now, still).collect()] == [("at_risk_high", 36.0)]
    two = snaps.withColumn("shop", F.lit("a")).unionByName(snaps.withColumn("shop", F.lit("b")))
    apart = CP.alert_history(two, acks.withColumn("shop", F.lit("a")), by=("shop",))
    assert sorted((r.shop, r.opened_at, r.closed_at) for r in apart.collect()) == [("a", 2, 3), ("a", 5, None), ("b", 2, None)]
    assert CP.alert_history(snaps.limit(0), acks).count() == 0 and CP.alert_history(snaps, acks.limit(0)).count() == 1


def test_log_of_campaign_edits(spark):
    schema = "id string, status string, created_at int"
    old = spark.createDataFrame([("a", "sent", 1), ("b", "pending", 1), ("c", "pending", 1), (None, "pending", 1)], schema)
    log = spark.createDataFrame([("a", "pending", 1, 5, False), ("a", "sent", 1, 4, True), ("b", "x", 1, 3, None), ("b", "y", 1, 7, True), ("b", "z", 1, 7, False),
                                 ("d", "new", 2, 1, False), ("d", "newer", 2, 2, None), ("e", "gone", 2, 1, True), (None, "lost", 0, 9, False)],
                                schema + ", changed_at int, deleted boolean")
    want = [("", "pending", 1), ("a", "pending", 1), ("c", "pending", 1), ("d", "newer", 2)]
    for parts in (1, 5):
        assert sorted((r.id or "", r.status, r.created_at) for r in CP.fold_changes(old, log.repartition(parts)).collect()) == want
    assert CP.fold_changes(old, log.limit(0)).count() == 4 and CP.fold_changes(old.limit(0), log).count() == 2


def test_leaves_count_crowds_without_their_pairs(monkeypatch):
    """Neighbour counts and parts equal brute force, and most pairs of a crowd are never compared."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.03, (1500, 4)), rng.normal(3, 0.03, (1500, 4)), rng.normal(0, 3, (200, 4))])
    compared, whole = [], D._squares
    monkeypatch.setattr(D, "_squares", lambda a, b: compared.append(len(a) * len(b)) or whole(a, b))
    a, b = D.Leaves(x), D.Leaves(x[::2])
    to_a, to_b = D.counted(a, b, 0.36)
    assert sum(compared) < len(x) * len(x[::2]) / 2
    near = whole(x, x[::2]) <= 0.36
    assert (to_a == near.sum(1)).all() and (to_b == near.sum(0)).all()
    root, near = D.parts_of(a, 0.36), whole(x, x) <= 0.36
    i, j = np.nonzero(near)
    assert (root[i] == root[j]).all() and len(set(root[:1500])) == 1 and root[0] != root[1500] and (root <= np.arange(len(x))).all()


def test_a_sweep_labels_all_k_in_one_pass(points):
    frame = points[0] if isinstance(points, tuple) else points
    pts = KM.whole(frame, COLS)
    models = KM.fit(pts, [2, 3, 5], 3, seed=7, n_init=2)
    both = KM.assign_each(pts, models, 3)
    for k, model in models.items():
        assert both.select("customer_id", f"k{k}").exceptAll(KM.assign(pts, model, 3)).count() == 0
    x = np.random.default_rng(1).integers(-2 ** 52, 2 ** 52, (500, 2))
    own = np.arange(500) % 3
    for values in (x, x >> 12):
        assert (KM.cluster_sums(values, own, 3) == np.stack([values[own == c].sum(0) for c in range(3)])).all()


def test_mixture_is_that_of_spark_ml(points):
    from pyspark.ml.clustering import GaussianMixture

    from cohortlab.operators import cluster as M
    from cohortlab.operators import mixture as MX
    frame, x = points
    vectors = M.model_input(frame, COLS)
    old = GaussianMixture(k=3, seed=42, featuresCol="features_vec", predictionCol="cluster").fit(vectors)
    mixture = MX.fit(vectors, COLS, 3, 42)
    assert np.allclose(mixture.weights, old.weights, atol=1e-6)
    assert np.allclose(mixture.means, [r["mean"].toArray() for r in old.gaussiansDF.collect()], atol=1e-5)
    want = {r["customer_id"]: r["cluster"] for r in old.transform(vectors).collect()}
    held = frame.sparkSession.sparkContext._jsc.sc().getPersistentRDDs
    before = held().size()
    assert {r["customer_id"]: r["cluster"] for r in M.gmm_segments(frame, 3, 42, COLS).collect()} == want
    packed = MX.blocks(vectors, COLS)
    assert sum(len(r["x"]) for r in packed.collect()) == x.size * 8 and packed.rdd.getNumPartitions() > 1
    assert held().size() <= before


def test_ward_builds_its_input_once(points, monkeypatch):
    frame, _ = points
    seen = []
    monkeypatch.setattr(W, "cells", lambda scaled, cols, width, real=W.cells: (seen.append(scaled), real(scaled, cols, width))[1])
    assert W.ward_segments(frame, 3, COLS, most_cells=20).count() == frame.count()
    assert len(seen) > 1 and all("parquet" in s._jdf.queryExecution().executedPlan().toString().lower() for s in seen)


@pytest.fixture(scope="module")
def many(spark):
    """A cluster of more rows than a sample used to hold, some of them equal."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.5, (n, 2)) for c, n in ((100.0, 2700), (103.0, 150), (108.0, 150))] + [np.full((100, 2), 100.5)])
    frame = spark.createDataFrame([(f"c{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "customer_id string, p double, q double").cache()
    return frame, x


def test_silhouette_of_many_rows_is_exact(many, monkeypatch):
    from cohortlab.functions import chunks
    frame, x = many
    label = np.repeat([0, 1, 2, 3, -1], [2500, 300, 200, 1, 99])
    labelled = frame.join(frame.sparkSession.createDataFrame([(f"c{i:05d}", int(c)) for i, c in enumerate(label)], "customer_id string, cluster int"), "customer_id")
    want = brute_silhouette(x[label >= 0], label[label >= 0])
    for size in (chunks.CHUNK, 700):
        monkeypatch.setattr(chunks, "CHUNK", size)
        got = SC.silhouette_euclidean(labelled, "cluster", ["p", "q"]).first()
        assert got["bound"] == 0 and got["silhouette"] == pytest.approx(want, rel=1e-9)


def test_distances_of_equal_rows_are_nothing(spark):
    same = spark.createDataFrame([(str(i), i % 2, 0.1 + 0.2, 1 / 3) for i in range(40)], "customer_id string, cluster int, p double, q double")
    assert SC.silhouette_euclidean(same, "cluster", ["p", "q"]).first()["silhouette"] == 0
    assert SC.silhouette_euclidean(same.limit(0), "cluster", ["p", "q"]).first()["silhouette"] is None


def test_a_sweep_scores_every_row(many):
    from cohortlab.operators import cluster as M
    frame, x = many
    label = M.kmeans_segments(frame, 3, 5, 1, ["p", "q"]).orderBy("customer_id").toPandas()["cluster"].to_numpy()
    assert M.k_sweep(frame, [3], 5, 1, ["p", "q"]).first()["silhouette"] == pytest.approx(brute_silhouette(x, label), rel=1e-9)


def test_ward_over_stored_tables_is_that_in_hand(points, monkeypatch):
    """Rounds on Spark, over several chunks, merge the same clusters under the same numbers, and more cells than the driver takes in hand are no wider."""
    from cohortlab.functions import chunks
    frame, _ = points
    key = lambda rows: sorted((r["a"], r["b"], r["parent"], r["n"], r["step"], round(r["height"], 9)) for r in rows)
    want, label = W.dendrogram(frame, COLS).collect(), sorted(map(tuple, W.ward_segments(frame, 4, COLS).select("customer_id", "cluster").collect()))
    monkeypatch.setattr(chunks, "CHUNK", 90)
    monkeypatch.setattr(W, "LEAF", 8)
    assert key(W.dendrogram(frame, COLS, in_hand=40).collect()) == key(want)
    assert sorted(map(tuple, W.ward_segments(frame, 4, COLS, in_hand=100).select("customer_id", "cluster").collect())) == label


def test_ward_of_many_rows_merges_every_row(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.001, (10500, 1)).cumsum(0) + np.arange(10500)[:, None] // 5000 * 50.0
    frame = spark.createDataFrame([(f"c{i}", float(v)) for i, (v,) in enumerate(x)], "customer_id string, p double")
    last = W.dendrogram(frame, ["p"]).orderBy(F.desc("step")).first()
    assert last["step"] == len(np.unique(x)) - 1 and last["n"] == len(x)


def test_blocks_are_not_sent_to_all_they_meet(points, monkeypatch):
    """Each point comes to Python for its own block and once for the chunks, however many blocks meet."""
    frame, x = points
    sent, real = frame.sparkSession.sparkContext.accumulator(0), D._matrix
    blocks = D.blocks(frame, COLS, 0.6, 16).cache()
    monkeypatch.setattr(D, "_matrix", lambda pdf, dims: (sent.add(len(pdf)), real(pdf, dims))[1])
    got = {r["customer_id"]: r["n"] for r in D.neighbour_counts(blocks, D.meetings(blocks, 0.6), 3, 0.6).collect()}
    assert [got[f"c{i:04d}"] for i in range(len(x))] == [n for _, n, _ in brute_dbscan(x, 0.6, 8)]
    assert 0 < sent.value <= 2 * len(x)


def test_reach_is_told_as_by_the_distances():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-4, 5, (90, 3)) * 0.1 + 1000 for _ in range(2))                # many pairs just at the distance
    for square in (0.01, 0.02, 0.09, 0.25):
        assert (D._within(a, b, square) == (D._squares(a, b) <= square)).all()


def test_algorithms_are_scored_as_one_by_one(points):
    from cohortlab.operators import cluster as M
    frame, x = points
    got = {r["algorithm"]: r for r in SC.compare_algorithms(frame, 3, n_init=2, cols=COLS).collect()}
    for name, lab in (("KMeans", M.kmeans_segments(frame, 3, 42, 2, COLS)), ("Hierarchical", W.ward_segments(frame, 3, COLS))):
        label = {r["customer_id"]: r["cluster"] for r in lab.collect()}
        assert got[name]["silhouette"] == pytest.approx(brute_silhouette(x, np.array([label[f"c{i:04d}"] for i in range(len(x))])), rel=1e-9)
    label = {r["customer_id"]: r["cluster"] for r in D.dbscan(frame, cols=COLS).collect()}
    label = np.array([label[f"c{i:04d}"] for i in range(len(x))])
    assert got["DBSCAN"]["noise_points"] == (label < 0).sum()
    assert got["DBSCAN"]["silhouette"] == pytest.approx(brute_silhouette(x[label >= 0], label[label >= 0]), rel=1e-9)


def test_nearest_centres_are_those_of_the_distances():
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (500, 3)) * 0.1 + 50                                         # many rows halfway between two centres
    sets = [rng.integers(-3, 4, (k, 3)) * 0.1 + 50 for k in (2, 3, 8)] + [np.zeros((3, 3))]
    for c, own in zip(sets, KM.nearest(x, sets), strict=True):
        want = KM.squares(x, c)
        assert (own == want.argmin(1)).all() and (KM.squares_to(x, c, own) == want.min(1)).all()
