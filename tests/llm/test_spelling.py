import random
import zlib

from llm_cases import edge_docs, empty_docs
from pyspark.sql import functions as F

from cohortlab.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(n, times=10):
    out = {}
    for w in n:
        close = [x for x in n if x != w and near(x, w)]
        form = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = (form if form is not None and n[form] >= times * n[w] else None, len(close))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    n = {"".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 6))): rnd.choice([1, 1, 2, 20, 20, 200, 3000]) for _ in range(250)}
    n |= {"aaaa": 7, "aaaaa": 70, "aaaaaa": 700}
    want = expected(n)
    got = {r["word"]: r for r in S.group_spellings(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(got) == set(n)
    for w, r in got.items():
        root = w
        while want[root][0]:
            root = want[root][0]
        assert (r["form"], r["n_near"], r["root"], r["n"], r["form_n"]) == (*want[w], root, n[w], n.get(want[w][0]))


def test_long_chain_of_forms(spark):
    words = [("a" * k, 10 ** k) for k in range(1, 14)]
    got = {r["word"]: r for r in S.group_spellings(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(got["a" * k]["root"] == "a" * 13 for k in range(1, 14)) and got["a" * 13]["form"] is None


def test_group_is_bounded_by_the_alphabet(spark):
    words = spark.createDataFrame([(f"commo{chr(97 + i)}", 5) for i in range(26)], "word string, n long")
    assert S.rotations(words).groupBy("key").count().agg(F.max("count")).first()[0] == 26
    assert {r["n_near"] for r in S.group_spellings(words).collect()} == {25}


def test_garbled_runs(spark):
    docs = [(i, "Straße während ganzer Wochen Überlänge") for i in range(60)]
    found = {r["run"]: r["out"] for r in spark.createDataFrame(docs, "doc_id long, run string")
             .select(F.concat(F.lit("x"), F.col("doc_id").cast("string"), "run").alias("run"), "doc_id")
             .select("run", S.garbled(F.col("doc_id"), F.col("run")).alias("out")).collect()}
    hits = 0
    for run, out in found.items():
        h = zlib.crc32((run[1:].split("S")[0] + ":" + run).encode())
        k = h % len(run)
        assert out == (run[:k] + run[k + 1:] if h % 31 == 0 else run)
        hits += h % 31 == 0
    assert hits


def test_words_of_texts(spark):
    docs = spark.createDataFrame([(1, "Einerlei einerlei, ÉTERNEL éternel eternel"), (2, "einerlei short short ÉTernEL")], "doc_id long, text string")
    assert {(r["word"], r["n"]) for r in S.corpus_words(docs).collect()} == {("einerlei", 3), ("Éternel", 2)}


def test_edges(spark):
    rows = {r["word"]: r for r in S.spelling_variants(edge_docs(spark)).collect()}
    assert rows == {} or all(r["n"] >= 2 for r in rows.values())
    assert S.spelling_variants(empty_docs(spark)).count() == 0
    odd = spark.createDataFrame([(None, 3), ("", 4), ("cat", None), ("cat", 2), ("cat", 3), ("cart", 50)], "word string, n long").withColumn("key", F.lit(1))
    got = {r["word"]: (r["form"], r["n"], r["n_near"]) for r in S.group_spellings(odd).collect()}
    assert got == {"cat": ("cart", 5, 1), "cart": (None, 50, 1)}
