import random

from llm_cases import edge_docs, empty_docs, table
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import decontam as D


@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcde"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_common_subsequence_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert D.common_subsequence(a, b) == t[-1][-1]


def test_passages_cover_items():
    for n in range(1, 200):
        found = D.item_passages(n)
        assert {i for a, b in found for i in range(a, b)} == set(range(n)) and all(b - a <= 2 * D.BLOCK for a, b in found)


def test_all_links_against_brute_force(spark):
    """Every copy that comparing each item with all regions of each text finds, and nothing that this does not."""
    docs, benchmark = table(spark, "documents"), table(spark, "benchmark")
    items = {r["item_id"]: D.words_of(r["text"]) for r in benchmark.collect()}
    copied, some = set(), set()
    for r in docs.collect():
        words = D.words_of(r["text"])
        for k, item in items.items():
            for a in range(0, len(words), D.BLOCK):
                share, _, leaks = D.leak(item, words[max(0, a - len(item)):a + 2 * D.BLOCK + len(item)])
                if leaks:
                    some.add((r["doc_id"], k))
                    if share >= 0.8:
                        copied.add((r["doc_id"], k))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, benchmark).collect()}
    assert copied <= got <= some and len(copied) > 2


def test_copies_and_paraphrases(spark):
    rng = random.Random(8)
    benchmark = table(spark, "benchmark")
    filler = [f"filler{rng.randint(0, 3000)}" for _ in range(400)]
    exact, changed, clean = [], [], [(10 ** 6, " ".join(filler)), (10 ** 6 + 1, " ".join(filler[::-1]))]
    for r in benchmark.collect():
        words = r["text"].split()
        at = rng.randint(0, 400)
        exact.append((r["item_id"], " ".join(filler[:at] + words + filler[at:])))
        other = [w if rng.random() > 0.2 else "other" for w in words]
        changed.append((r["item_id"], " ".join(filler[:at] + other + filler[at:])))
    for rows, least in ((exact, 1.0), (changed, 0.9)):
        found = D.find_leaks(spark.createDataFrame(rows + clean, "doc_id long, text string"), benchmark).collect()
        hit = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
        assert len(hit) >= least * len(rows) and not {10 ** 6, 10 ** 6 + 1} & {r["doc_id"] for r in found}


def test_queries_in_blocks_give_the_same(spark):
    docs, benchmark = table(spark, "documents"), table(spark, "benchmark")
    key = lambda rows: sorted((r["doc_id"], r["item_id"]) for r in rows)
    assert key(D.find_leaks(docs, benchmark).collect()) == key(D.find_leaks(docs, benchmark, query_words=400).collect())


def test_edges(spark):
    docs, benchmark = edge_docs(spark), table(spark, "benchmark")
    item = benchmark.first()
    odd = benchmark.unionByName(spark.createDataFrame([(None, None), (7, ""), (None, "twin text that is told two times.")], "item_id long, text string"))
    found = D.find_leaks(docs, odd).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(6, None), (6, None), (7, None)]
    out = D.drop_leaks(docs, odd)
    assert out.columns == docs.columns and out.count() == docs.count() - 3
    assert D.find_leaks(empty_docs(spark), benchmark).count() == 0 and D.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert D.drop_leaks(docs, benchmark.limit(0)).count() == docs.count()
    twice = spark.createDataFrame([(1, item["text"]), (1, item["text"])], "doc_id long, text string")
    assert D.find_leaks(twice, benchmark).count() == 2


def cut_items(n: int, least: int, most: int, words: int = 4000):
    """``n`` items of random words, and a document around each."""
    rng = random.Random(n)
    said = lambda k: [f"w{int(words ** rng.random())}x{rng.randint(0, 9)}" for _ in range(k)]
    items = [said(rng.randint(least, most)) for _ in range(n)]
    return items, [said(60) + item + said(60) for item in items]


def frames(spark, items, docs):
    rows = lambda x: [(i, " ".join(w)) for i, w in enumerate(x)]
    return spark.createDataFrame(rows(docs), "doc_id long, text string").repartition(8), spark.createDataFrame(rows(items), "item_id long, text string")


def test_many_more_items_than_directions(spark):
    items, texts = cut_items(3000, 16, 59)
    docs, benchmark = frames(spark, items, texts)
    got = {r["doc_id"] for r in D.find_leaks(docs, benchmark).collect() if r["doc_id"] == r["item_id"]}
    assert len(got) == len(items)


def test_an_item_that_a_third_of_all_passages_hold(spark):
    items, texts = cut_items(4, 16, 32)
    other = [[f"o{i}x{k}" for k in range(64)] for i in range(200)]
    for n in (20, 200):                                       # under 100 passages and many more
        docs, benchmark = frames(spark, items, [items[0]] * n + other[:n] + texts)
        got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, benchmark).collect()}
        assert got == {(i, 0) for i in range(n)} | {(2 * n + i, i) for i in range(4)}


def test_everything_that_counts_as_a_leak_is_found(spark):
    """Short items as they stand, items of a few words, and items with half of the words replaced, all by brute force."""
    rng = random.Random(5)
    said = lambda k: [f"w{int(2000 ** rng.random())}" for _ in range(k)]
    items, texts, meant = [], [], []
    for i in range(240):
        kind = i % 4
        item = said(rng.randint(*((3, 7), (8, 12), (8, 12), (16, 59))[kind]))
        lost = rng.sample(range(len(item) - D.CLOSING * (kind == 3)), int(len(item) * (0, 0, 0.4, 0.6)[kind]))
        held = [rng.choice((["other"], [], ["two", "more"])) if k in lost else [w] for k, w in enumerate(item)]
        items.append(item)
        texts.append(said(rng.randint(0, 150)) + [w for x in held for w in x] + said(rng.randint(0, 150)))
    brute = {(d, k) for d, words in enumerate(texts) for k, item in enumerate(items) for a in range(0, len(words), D.BLOCK)
             if D.leak(item, words[max(0, a - len(item)):a + 2 * D.BLOCK + len(item)])[2]}
    docs, benchmark = frames(spark, items, texts)
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, benchmark).collect()}
    assert got == brute and sum((i, i) in brute for i in range(240)) > 230


def test_words_by_table_are_those_of_the_expression():
    from cohortlab.llm import decontam
    every = "".join(map(chr, range(0x10FFFF + 1)))
    texts = [None, "", "Don't Éµß\x85 x_1²", "İstanbul ΣΣ a—b", every[:256], *(f"A{c}b" for c in every[::97])]
    assert [decontam.words_of(t) for t in texts] == [decontam.WORDS.findall((t or "").lower()) for t in texts]
    assert len(decontam.LATIN) == 256
