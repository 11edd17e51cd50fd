import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import edge_docs, empty_docs

from cohortlab.llm import repeats as R


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start:i + q]
            if i > start and len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, len(part), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_two_words_against_brute_force(texts):
    assert list(R.runs_of(texts)) == [brute(t) for t in texts]


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 60),
       st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_planted_run_against_brute_force(head, period, length, tail):
    text = head + [period[i % len(period)] for i in range(length)] + tail
    assert list(R.runs_of([text, text[::-1], []])) == [brute(text), brute(text[::-1]), []]


def test_nested_and_long_runs():
    inner = ["x"] * 8 + ["y"]
    text = inner * 400 + [f"w{i}" for i in range(3000)] + ["z"] * 50_000
    runs = next(iter(R.runs_of([text])))
    assert (0, 3600, 9) in runs and (6600, 50_000, 1) in runs and sum(1 for r in runs if r[2] == 1) == 401
    assert R.collapsed(text, runs).count("z") == 1


def test_many_texts_in_portions(monkeypatch):
    texts = [[str(i * k % 7) for i in range(40)] for k in range(50)]
    whole = list(R.runs_of(texts))
    monkeypatch.setattr(R, "CHUNK_WORDS", 100)
    monkeypatch.setattr(R, "CHUNK_PAIRS", 17)
    assert list(R.runs_of(texts)) == whole == [brute(t) for t in texts]


def test_colliding_hashes_are_seen(monkeypatch):
    """With a base of 1 all anagrams collide; the comparison word by word calls for another base."""
    text = list("abbaabbaababbaba" * 3)
    tried = []

    class Weak(R.Repeats):
        def __init__(self, word, base):
            tried.append(base)
            super().__init__(word, 1 if len(tried) == 1 else base)

    monkeypatch.setattr(R, "Repeats", Weak)
    assert list(R.runs_of([text])) == [brute(text)] and len(tried) > 1


def test_edges(spark):
    docs = edge_docs(spark)
    rows = R.periodic_runs(docs, with_runs=True).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (2, 3, 4):
        assert (by[i]["n_runs"], by[i]["start"], by[i]["runs_sha256"], by[i]["collapsed_sha256"], by[i]["collapsed"]) == (0, None, nothing, nothing, "")
    assert R.periodic_runs(empty_docs(spark)).count() == 0


def test_result_of_a_row(spark):
    text = "go now " + "one two " * 5 + "stop"
    r = R.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_runs=True).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"]) == (1, 2, 10, 2, 5000, "go now one two stop")
    assert r["runs_sha256"] == hashlib.sha256(b"2,10,2\n").hexdigest()
