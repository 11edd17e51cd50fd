import collections
import math

from llm_cases import edge_docs, empty_docs, table

from cohortlab.llm import quality as Q


def test_agrees_with_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r["doc_id"]: r["kept"] for r in Q.score_quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(got[i] == bool(q) for i, q in truth.items()) >= 0.93 * len(truth)


def test_posteriors_against_brute_force(spark):
    rows = [(h, p, x) for h, p, xs in (("a", "x", [0.9, 0.8, 0.95, 0.7]), ("a", "y", [0.2, 0.3]), ("b", "x", [0.1]), (None, None, [0.5, 0.6, 0.55]), ("c", "z", [0.9] * 20)) for x in xs]
    sites, pull, mean = Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): r for r in sites.collect()}

    def worth(groups, parent):
        n, sizes = sum(len(g) for g in groups.values()), [len(g) for g in groups.values()]
        within = sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for g in groups.values()) / (n - len(groups))
        between = (sum(len(g) * (sum(g) / len(g) - parent[k]) ** 2 for k, g in groups.items()) - (len(groups) - 1) * within) / (n - sum(s * s for s in sizes) / n)
        return min(max(within / max(between, 1e-9), 1.0), 1e6)

    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, x in rows:
        paths[h, p].append(x)
        hosts[h].append(x)
    every = [x for *_, x in rows]
    mu = sum(every) / len(every)
    k = worth(hosts, {h: mu for h in hosts})
    host_mean = {h: (sum(g) + k * mu) / (len(g) + k) for h, g in hosts.items()}
    assert math.isclose(mean, mu) and set(got) == set(paths)
    assert all(math.isclose(r["host_mean"], host_mean[h], rel_tol=1e-9) for (h, _), r in got.items())
    assert math.isclose(pull, worth(paths, {hp: host_mean[hp[0]] for hp in paths}), rel_tol=1e-6)


def test_sparse_sites_shrink_to_the_mean(spark):
    rows = [(f"h{i}", "x", 0.9 if i % 2 else 0.1) for i in range(20) for _ in range(50)] + [("one", "x", 0.99)]
    sites, pull, mean = Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r["host"]: r["host_mean"] for r in sites.collect()}
    assert abs(got["h1"] - 0.9) < 0.02 and mean < got["one"] < 0.99


def test_edges(spark):
    docs, labels = edge_docs(spark), table(spark, "labels")
    rows = Q.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] is not None for r in Q.score_quality(docs, labels.limit(0)).collect())
    assert Q.score_quality(empty_docs(spark), labels).count() == 0
