import collections

from llm_cases import SCHEMA, edge_docs, empty_docs, table

from cohortlab.llm import mixing as M


def water_fill(sizes):
    """Targets by the rule as told: share by weight, stop at 3 times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_taken_and_reruns(spark):
    docs = table(spark, "documents").unionByName(spark.createDataFrame(
        [(10 ** 6 + i, "only a few words", "en", "a-small", 3) for i in range(3)] + [(10 ** 6 + 9, "words of nobody " * 40, "en", None, 3)], SCHEMA))
    rows = M.mix_counts(docs, shards=5).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) <= 3
    target = water_fill(sizes)
    largest = max(r["size"] for r in rows)
    for r in rows:
        assert abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[source[r["doc_id"]]]
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest / 2 + 1
    assert target["a-small"] == 36 and taken["a-small"] == 36
    again = M.mix_counts(docs.repartition(7), shards=5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_tree_keeps_exact_quotas(spark):
    quotas = {1: 40, 2: 7, 3: 0, 4: 1000}
    rows = M.split_quotas(spark.createDataFrame(list(quotas.items()), "sid int, quota long"), 6, 3).collect()
    per_source, per_shard = collections.Counter(), collections.Counter()
    for r in rows:
        per_source[r["sid"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert {s: per_source[s] for s in quotas} == quotas
    assert len(per_shard) == 6 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_mix_gives_rows_of_counts(spark):
    docs = table(spark, "documents")
    counts = {r["doc_id"]: (len(r["shards"]), sorted(r["shards"])) for r in M.mix_counts(docs, shards=4).collect()}
    mixed = collections.defaultdict(list)
    for r in M.mix(docs, shards=4).select("doc_id", "shard").collect():
        mixed[r["doc_id"]].append(r["shard"])
    assert {d: sorted(s) for d, s in mixed.items()} == {d: s for d, (n, s) in counts.items() if n}


def test_edges(spark):
    docs = edge_docs(spark)
    rows = M.mix_counts(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    out = M.mix(docs)
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns) and out.count() > 0
    assert M.mix_counts(empty_docs(spark)).count() == 0 and M.mix(empty_docs(spark)).count() == 0
    assert {r["taken"] for r in M.mix_counts(docs.filter("doc_id IN (2, 3)")).collect()} == {0}
