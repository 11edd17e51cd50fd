"""URL filters: host and path rules, and a naive Bayes judge of the words in host and path.

Names such as ``freebets`` are split into words by a unigram Viterbi search, whose counts come from
the pages' own visible text: all of them, each name being joined with the words that stand in it. Hosts whose words hold a seed word teach a multinomial naive Bayes
classifier, which then scores every url by its host and path words.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import store

#: The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that mark a host as unwanted when training.
SEEDS = ("adult", "ads", "adserver", "bet", "bets", "betting", "casino", "cialis", "clickbait", "escort", "gambling", "jackpot",
         "malware", "payday", "phishing", "pills", "poker", "porn", "roulette", "sex", "slots", "spam", "track", "tracker",
         "tracking", "viagra", "warez", "xxx")
LONGEST_WORD = 20
#: Words of so few letters stand in most names, and the alphabet bounds their number; longer ones are joined.
SHORT_WORD = 3
SMOOTHING = 1.0


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased; empty where there is none."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, of equally long ones the first; else null.
    A rule fits its host and all subdomains where the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> tuple[DataFrame, int]:
    """(word, n) of all words of the pages' visible text, and the sum of n; the seeds count at least as often
    as the mean word."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"[a-z]+"), F.lit(0))).alias("word"))
    found = store(words.filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count("*").alias("n")), "url-words")
    total, distinct = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mean = max(1, total // max(1, distinct))
    held = {r["word"]: r["n"] for r in found.filter(F.col("word").isin(*SEEDS)).collect()}
    seeds = [(w, max(mean, held.get(w, 0))) for w in SEEDS]
    counts = found.filter(~F.col("word").isin(*SEEDS)).unionByName(pages.sparkSession.createDataFrame(seeds, "word string, n long"))
    return counts, total + sum(n for _, n in seeds) - sum(held.values())


class Segmenter:
    """The most probable split of a name into words of a unigram model. An unknown word of n letters
    has the probability 1 / (total * 26 ** n)."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``counts`` of all words that may stand in the names, ``total`` of all words there are."""
        self.total = math.log((sum(counts.values()) if total is None else total) or 1)
        self.log = {w: math.log(n) - self.total for w, n in counts.items()}

    def __call__(self, name: str) -> list[str]:
        best = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(max((best[a][0] + self.log.get(name[a:end], -self.total - 3.26 * (end - a)), a)
                            for a in range(max(0, end - LONGEST_WORD), end)))
        cut, words = len(name), []
        while cut:
            words.append(name[best[cut][1]:cut])
            cut = best[cut][1]
        return words[::-1]


def _parts(name: str, least: int, most: int) -> set[str]:
    return {name[a:a + k] for k in range(least, most + 1) for a in range(len(name) - k + 1)}


def split_names(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of the distinct ``name``s, unknown words as ?."""
    short = {r["word"]: r["n"] for r in counts.filter(F.length("word") <= SHORT_WORD).collect()}
    shared = names.sparkSession.sparkContext.broadcast(short)

    @F.pandas_udf("array<string>")
    def parts(names: pd.Series) -> pd.Series:
        return pd.Series([list(_parts(x, SHORT_WORD + 1, LONGEST_WORD)) for x in names])

    @F.pandas_udf("array<string>")
    def words(names: pd.Series, found: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for name, ws, ns in zip(names, found, n):
            own = {w: shared.value[w] for w in _parts(name, 1, SHORT_WORD) if w in shared.value}
            if ws is not None:
                own.update(zip(ws, ns))
            out.append([w if w in own else "?" for w in Segmenter(own, total)(name)])
        return pd.Series(out)

    held = names.select("name", F.explode(parts("name")).alias("word")).join(counts, "word") \
        .groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    return names.join(held, "name", "left").select("name", words("name", F.col("held.word"), F.col("held.n")).alias("words"))


def url_tokens(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(row, tokens): the words of host and path of each row that has any, marked h: and p:; numbers and unknown words
    are one token each."""
    def of(part, text):
        return F.transform(F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda x: F.struct(F.lit(part).alias("part"), x.alias("name")))

    names = [of("h:", F.col("host")), of("p:", F.lower("path"))]
    named = rows.select("row", F.explode(F.concat(*names)).alias("x")).select("row", "x.part", "x.name")
    number = F.col("name").rlike("^[0-9]")
    split = store(split_names(named.filter(~number).select("name").distinct(), counts, total), "url-names")
    words = F.when(number, F.array(F.lit("#"))).otherwise(F.col("words"))
    return named.withColumn("key", F.when(~number, F.col("name"))).join(split.withColumnRenamed("name", "key"), "key", "left") \
        .select("row", F.transform(words, lambda w: F.concat("part", w)).alias("tokens")) \
        .groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def naive_bayes(tokens: DataFrame) -> tuple[DataFrame, float]:
    """(token, odds), the log odds of each token, and those of the class; counts are added up before they are shuffled."""
    seed = F.coalesce(F.arrays_overlap("tokens", F.array(*[F.lit(f"h:{w}") for w in SEEDS])), F.lit(False))
    rows = tokens.select("tokens", seed.alias("unwanted"))
    n = {r["unwanted"]: r["n"] for r in rows.groupBy("unwanted").agg(F.count("*").alias("n")).collect()}
    counts = store(rows.select("unwanted", F.explode("tokens").alias("token")).groupBy("token")
                   .agg(F.sum(F.col("unwanted").cast("long")).alias("bad"), F.sum((~F.col("unwanted")).cast("long")).alias("good")), "url-odds")
    all_bad, all_good, distinct = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    odds = [F.log((F.col(c) + SMOOTHING) / F.lit(float(total + SMOOTHING * max(1, distinct)))) for c, total in (("bad", all_bad), ("good", all_good))]
    return counts.select("token", (odds[0] - odds[1]).alias("odds")), math.log((n.get(True, 0) + SMOOTHING) / (n.get(False, 0) + SMOOTHING))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every input row. The verdict is the rule's where one fits, else
    block where the classifier's log odds ``score`` are above 0.

    A url that is null or without :// has empty host and path, fits no rule and is judged by the prior alone.
    Null and repeated ids and repeated rows give their own rows; null html has no words; further columns
    are ignored; an empty table gives no row.
    """
    counts, total = word_counts(pages)
    rows = store(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                              F.monotonically_increasing_id().alias("row")), "url-rows")
    tokens = store(rows.join(url_tokens(rows, counts, total), "row", "left"), "url-tokens")
    odds, prior = naive_bayes(tokens)
    # summed in a fixed order, so that a score is the same in every run
    scores = tokens.select("row", F.explode("tokens").alias("token")).join(odds, "token").groupBy("row") \
        .agg(F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda x, y: x + y).alias("sum"))
    judged = tokens.select("row", "page_id", "host", "path").join(scores, "row", "left") \
        .withColumn("score", F.lit(prior) + F.coalesce("sum", F.lit(0.0))).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
