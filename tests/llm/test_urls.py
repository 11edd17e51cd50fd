import itertools
import math

from cohortlab.llm import urls as U

SCHEMA = "page_id long, url string, html string, host string, tokens string"


def brute_split(counts, name):
    total = math.log(sum(counts.values()))
    best = None
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        words, word = [], name[0]
        for c, ch in zip(cuts, name[1:]):
            words, word = (words + [word], ch) if c else (words, word + ch)
        words.append(word)
        score = sum(math.log(counts[w]) - total if w in counts else -total - 3.26 * len(w) for w in words)
        if best is None or score > best[0] + 1e-9:
            best = (score, words)
    return best


def test_viterbi_against_all_splits():
    counts = {"free": 50, "bets": 20, "bet": 20, "casino": 9, "in": 70, "win": 12, "as": 60, "o": 2, "cat": 5}
    split = U.Segmenter(counts)
    total = math.log(sum(counts.values()))
    for name in ("freebets", "casinowin", "catzzin", "betsin", "q", "asinowinx"):
        score, _ = brute_split(counts, name)
        got = sum(math.log(counts[w]) - total if w in counts else -total - 3.26 * len(w) for w in split(name))
        assert abs(got - score) < 1e-9 and "".join(split(name)) == name


def test_rules_and_parts(spark):
    urls = ["http://www.example.org/en/12", "https://EXAMPLE.org/es/", "x://a.org/x?y", "x://a.com/fr/1#z", "x://com/de/", "x://a.com/de", "x://a.org?x/y", "x://notorg/", "no colon", None, "a://b://c/d", "x://org"]
    got = U.judge_urls(spark.createDataFrame([(i, u, None, "h", "t") for i, u in enumerate(urls)], SCHEMA)).collect()
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert rows == {0: ("www.example.org", "/en/12", "example.org/en/1"), 1: ("example.org", "/es/", "example.org/es/"), 2: ("a.org", "/x", "org/"), 3: ("a.com", "/fr/1", "com/fr/"),
                    4: ("com", "/de/", "com/de/"), 5: ("a.com", "/de", None), 6: ("a.org", "", None), 7: ("notorg", "/", None), 8: ("", "", None), 9: ("", "", None), 10: ("b:", "//c/d", None), 11: ("org", "", None)}
    assert all(r["verdict"] == {"example.org/en/1": "block", "example.org/es/": "block", "org/": "allow", "com/fr/": "allow", "com/de/": "block"}[r["rule"]] for r in got if r["rule"])


def test_classifier_learns_words_beside_the_seeds(spark):
    rows = [(i, f"http://{'freecasino' if i % 2 else 'gardennews'}{i}.net/{'bonus' if i % 2 else 'plants'}/{i}", "<p>free casino bonus garden news plants</p>", "h", "t") for i in range(200)]
    rows += [(1000, "http://freething.net/bonus/1", "<p>thing</p>", "h", "t"), (1001, "http://gardenthing.net/plants/1", "<style>x</style>", "h", "t")]
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000] == "block" and got[1001] == "allow" and all(got[i] == ("block" if i % 2 else "allow") for i in range(200))


def test_edges(spark):
    frame = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "h", "t"), (1, "", "", "h", "t"), (2, "x://" + "a" * 50_000 + ".net/", "<p>" + "b " * 50_000, "h", "t")], SCHEMA)
    rows = U.judge_urls(frame).collect()
    assert len(rows) == 4 and {r["verdict"] for r in rows} <= {"allow", "block"}
    assert U.judge_urls(frame.limit(0)).count() == 0


def test_rare_words_count_however_many_there_are(spark):
    """60,000 words that are more frequent push none out of the model: a name of two rare words is split into them."""
    letters = "bcdfghjklm"
    made = lambda i: "z" + "".join(letters[int(d)] for d in str(i).zfill(5))
    many = " ".join(made(i) for i in range(60_000))
    rows = [(1, "http://gardenplanet.net/a/1", f"<p>{many} {many} garden planet</p>", "h", "t"), (2, f"http://x.net/{made(59_999)}garden/", None, "h", "t")]
    frame = spark.createDataFrame(rows, SCHEMA)
    counts, total = U.word_counts(frame)
    assert counts.count() == 60_002 + len(U.SEEDS) and total == 120_002 + len(U.SEEDS)
    names = spark.createDataFrame([(x,) for x in ("gardenplanet", made(59_999) + "garden", "net")], "name string")
    split = {r["name"]: r["words"] for r in U.split_names(names, counts, total).collect()}
    assert split == {"gardenplanet": ["garden", "planet"], made(59_999) + "garden": [made(59_999), "garden"], "net": ["?"]}
    assert U.judge_urls(frame).count() == 2
