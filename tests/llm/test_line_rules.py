import collections
import re

from llm_cases import edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import line_rules as L


@given(st.lists(st.sampled_from("abc"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeated_words_against_brute_force(words):
    n = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if n[tuple(words[i:i + 5])] > 1 for j in range(5)}
    assert L.repeated_words(words) == len(hit)


def test_repeated_words_of_many_kinds():
    words = [f"w{i}" for i in range(20_000)] + [f"w{i}" for i in range(7)]
    assert L.repeated_words(words) == 14


def test_rules():
    fails = lambda line, seen=False: L.line_fails(line, len(line.split()), seen)
    assert fails("Home") and fails("one | two | three.") and fails("Licensed under some license.") and fails("no mark at its end")
    assert fails("A fine sentence.", True) and fails("### $$$ a.") and not fails("A fine sentence.") and not fails("word " * 40)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = L.clean_lines(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"] and by[2]["clean_text"] == ""
    assert by[1]["kept"] and by[1]["n_words"] == 10 and by[5]["n_words"] == 4000 * 6
    assert L.clean_lines(empty_docs(spark)).count() == 0


def test_loses_too_much(spark):
    good = "This is a line of words that ends well."
    text = "\n".join([good] + [f"menu{i} item{i} without{i} end{i}" for i in range(9)])
    row = L.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["clean_text"] == good and not row["kept"] and not row["base_failed"] and row["lost_words"] == len(re.findall(r"\S+", text)) - 9
