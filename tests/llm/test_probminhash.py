import collections
import random

import numpy as np
from llm_cases import edge_docs, empty_docs, table

from cohortlab.llm import probminhash as P
from cohortlab.llm.components import components


def brute_similarity(a: dict, b: dict) -> float:
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})


def test_similarity_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = []
        for _ in range(2):
            c = np.unique(rng.integers(0, 40, 20)).astype(np.uint32)
            sets.append((c, rng.integers(1, 5, len(c))))
        a, b = (dict(zip(c.tolist(), w.tolist())) for c, w in sets)
        assert abs(P.similarity(*sets) - brute_similarity(a, b)) < 1e-9


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    w = [rng.integers(1, 4, 200), rng.integers(1, 4, 200)]
    sets = [(np.sort(codes[:200]), w[0]), (np.sort(codes[60:260]), w[1])]
    of = np.repeat([0, 1], 200)
    owner = P.signatures(2, of, np.concatenate([s[0] for s in sets]), np.concatenate(w), 4096)
    assert abs((owner[0] == owner[1]).mean() - P.similarity(*sets)) < 0.04
    assert (owner > 0).all()


def test_white_space_is_no_word():
    texts = [" \n\t ", "", "a b \n\t \n", "\t a\u00a0b", "a b"]
    for _ in range(300):
        of, code, _ = P.shingles(texts)
        assert of.tolist() == [2, 3, 4] and len(set(code.tolist())) == 1


def test_many_registers_end_and_fill():
    for registers in (1, 160, 2048, 4096, 10_000):
        owner = P.signatures(1, np.zeros(50, np.int64), np.arange(1, 51, dtype=np.uint64), np.ones(50), registers)
        assert (owner > 0).all()


def classes_by_brute_force(docs):
    first = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        first.setdefault((t or "").lower(), i)
    keys = list(first)
    of, code, weight = P.shingles(keys)
    sets, post = [collections.Counter() for _ in keys], collections.defaultdict(set)
    for i, c, w in zip(of, code, weight):
        sets[i][int(c)] = int(w)
        post[c].add(i)
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for g in post.values() if len(g) > 1 for a in g for b in g if a < b}
    arrays = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in sets]
    for a, b in pairs:
        if root(a) != root(b) and P.similarity(arrays[a], arrays[b]) >= P.SIMILARITY:
            parent[root(a)] = root(b)
    least = collections.defaultdict(lambda: 10 ** 12)
    for k, i in enumerate(keys):
        least[root(k)] = min(least[root(k)], first[i])
    where = {k: least[root(n)] for n, k in enumerate(keys)}
    return {i: where[(t or "").lower()] for i, t in docs}


def test_classes_against_brute_force(spark):
    """The given documents, and groups of edited copies whose similarities lie around the limit."""
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    at = 10 ** 6
    for g in range(4):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(25):
            words = [w if rng.random() > rng.choice([0.005, 0.02, 0.04]) else f"new{rng.random()}" for w in base]
            docs.append((at := at + 1, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes_by_brute_force(docs)


def test_components_of_a_long_chain(spark):
    rng = random.Random(4)
    names = list(range(300))
    rng.shuffle(names)
    links = spark.createDataFrame([*zip(names[:200], names[1:200]), (names[250], names[251])], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {got[n] for n in names[:200]} == {min(names[:200])} and got[names[250]] == got[names[251]] == min(names[250:252]) and len(got) == 202
    assert components(links.limit(0)).count() == 0


def test_edges(spark):
    docs = edge_docs(spark)
    rows = P.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert by[6] == by[7] == 6 and by[2] == by[3] == by[4] == 2 and by[1] == 1 and by[5] == 5
    kept = P.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    assert P.near_duplicates(empty_docs(spark)).count() == 0 and P.drop_near_duplicates(empty_docs(spark)).count() == 0


def test_texts_come_to_python_in_small_batches(spark, monkeypatch):
    from cohortlab.llm import common, probminhash
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    real = probminhash.store
    monkeypatch.setattr(probminhash, "store", lambda df, label: (seen.append(int(spark.conf.get(name))), real(df, label))[1])
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(9)], "doc_id long, text string")
    assert probminhash.drop_near_duplicates(docs).count() == 3
    assert seen and set(seen) - {common.TEXTS} <= {int(before)} and common.TEXTS in seen and spark.conf.get(name) == before
