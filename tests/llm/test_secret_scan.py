import hashlib
import random
import re

import pytest
from llm_cases import edge_docs, empty_docs

from cohortlab.llm import secret_scan as S


def brute(text):
    out = []
    for n, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), n, m.end()))
    return [f"{S.RULES[n].kind}:{a}:{b}" for a, n, b in sorted(out)]


def test_trigram_queries():
    assert S.trigram_query(r"[0-9a-f]{24,}") is None and S.trigram_query("ab") is None
    assert S.trigram_query(r"AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert frozenset({"pas", "ass", "ssw", "swd"}) in S.trigram_query(S.BASE[0].pattern)
    assert S.trigram_query("abc(def|x.*)ghi") == [frozenset({"abc", "ghi"})]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    bits = ["token", "Token=", "secret: ", "api_key", "apikey='", "password", "=", ":", '"', "'", " ", "abcdef", "x1", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2,
            "ghp_" + "a1" * 20, "xoxb-1234567890-z", "AIza" + "b" * 35, "sk_live_" + "9" * 20, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghijk", "-----BEGIN RSA PRIVATE KEY-----",
            "https://bob:hunter2@x.org", "é😀", "\n", "word "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["token=token: abcdefg", "token = abcdef " * 3000]


def test_spans_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.scan_secrets(docs).collect():
        want = brute(texts[r["doc_id"]])
        assert r["spans"] == ",".join(want)
        base = [x for x in want if x.split(":")[0] in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign:", "access:", "hex:"))


def test_redaction_covers_every_span(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    for r in S.redact_secrets(docs).collect():
        text, out, at = texts[r["doc_id"]], [], 0
        spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in brute(text)))
        merged = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[at:a], "[SECRET]"]
            at = b
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == (len(r["text"]) if merged else 0)


def test_rules_without_trigrams_scan_all(spark):
    docs = spark.createDataFrame([(1, "x" + "ab12" * 8), (2, "nothing")], "doc_id long, text string")
    rows = S.scan_secrets(docs, (S.BASE[2],), 1).collect()
    assert {r["doc_id"]: r["n_hex"] for r in rows} == {1: 1, 2: 0}


def test_edges_and_plan(spark):
    docs = edge_docs(spark)
    rows = S.scan_secrets(docs).collect()
    assert len(rows) == docs.count() and {r["spans"] for r in rows} == {""}
    out = S.redact_secrets(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert S.scan_secrets(empty_docs(spark)).count() == 0 and S.redact_secrets(empty_docs(spark)).count() == 0
    plan = S.scan_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
