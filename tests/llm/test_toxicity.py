import random
import zlib

import numpy as np
from llm_cases import CLASHING, edge_docs, empty_docs, table

from cohortlab.llm import toxicity as T


def made(spark, n=600):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic = int(i % 8 == 0)
        for _ in range(rng.randint(1, 4) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["grumpkin", "vexhog"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    rows = {r["doc_id"]: r for r in T.score_toxicity(docs, labels).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in rows)
    wrong = [i for i in held if rows[i]["predicted"] != int(i % 8 == 0)]
    assert len(wrong) <= 0.03 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels = made(spark, 200)
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in T.score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_grams_are_distinct_and_whole():
    grams = T.Grams()
    text = "abc" * (T.PIECE // 2) + " grumpkin"
    x = grams(text)
    assert len(x) == len(set(x.tolist())) and set(T.Grams()("grumpkin").tolist()) <= set(x.tolist())
    assert set(grams("grumpkin").tolist()) == set(T.Grams()("grumpkin").tolist())


def test_places_survive_packing():
    for x in ([], [0], [65535, 65536, (1 << T.HASH_BITS) - 1, 7], range(0, 1 << T.HASH_BITS, 11)):
        assert T.unpack_places(T.pack_places(np.array(x, np.uint32))).tolist() == sorted(x)


def test_batch_size_of_the_session_is_restored(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs, labels = made(spark, 60)
    T.train_classifier(docs, labels)
    assert spark.conf.get(name) == before


def test_logistic_separates(spark):
    y, x = np.tile([0, 1], 20), [T.pack_places(np.array([k])) for k in np.tile([0, 1], 20)]
    train = spark.createDataFrame(list(zip(y.tolist(), x)), "y int, x binary").repartition(3)
    w, b = T.fit_logistic(train, np.array([-1.0, 1.0]))
    assert w[0] * -1 + b < 0 < w[1] + b


def test_fit_is_the_minimum_over_all_features(spark):
    """Ratios by definition from all texts; at the fitted weights the slope, recomputed on dense rows, vanishes."""
    docs, labels = made(spark, 120)
    rows = [(r["y"], r["text"]) for r in T.training_rows(docs, labels, 1000).collect()]
    dense, y = np.zeros((len(rows), 1 << T.HASH_BITS), np.float32), np.array([r[0] for r in rows], float)
    grams = T.Grams()
    for i, (_, text) in enumerate(rows):
        dense[i, grams(text)] = 1
    ratio, count = T.log_count_ratios(T.training_rows(docs, labels, 1000))
    pos, neg = dense[y == 1].sum(0, dtype=float), dense[y == 0].sum(0, dtype=float)
    want = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / (len(y) - y.sum() + 2))
    assert np.allclose(ratio, want) and (count == pos + neg).all()
    weights, bias = T.train_classifier(docs, labels, 1000)
    seen = count > 0
    assert (weights[seen & (np.abs(ratio) > 0.1)] != 0).mean() > 0.99 and not weights[~seen].any()
    z = dense @ weights + bias
    error = 1 / (1 + np.exp(-z)) - y
    w = np.divide(weights, ratio, out=np.zeros_like(weights), where=ratio != 0)
    slope = (error @ dense) * ratio + T.PENALTY * len(y) * w
    start = ((0.5 - y) @ dense) * ratio
    assert np.linalg.norm(slope) < 0.02 * np.linalg.norm(start)


def test_repeated_ids_stay_bounded(spark):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(spark.sql("SELECT 2L AS doc_id, 'other' AS text"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    known = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5]
    assert known and T.training_rows(docs, labels, 100).count() <= 200
    assert T.training_rows(docs.unionByName(docs), labels, 5000).count() == T.training_rows(docs, labels, 5000).count()


def test_edges(spark):
    docs, labels = edge_docs(spark), table(spark, "labels")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int"))
    rows = T.score_toxicity(docs, odd).collect()
    assert len(rows) == docs.count() and all(r["score"] is not None for r in rows)
    assert {r["score"] for r in T.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert T.score_toxicity(empty_docs(spark), labels).count() == 0
    assert T.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    out = T.drop_toxic(docs, odd)
    assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
