"""Groups of spelling variants by permuterm rotations.

Every word is marked by a terminator and rotated: ``word`` gives ``d#wor`` and so on. Rotated so that an
edited letter stands last, words that differ in that letter alone share all before it: for a replacement
both skip the last letter, for an insertion or a deletion only the longer word does. So each edit is a
prefix that skips the edited letter. Sorted by these prefixes, near words lie side by side, and one
scan of each group finds them. A word stands in a group once for each letter that may be skipped, so a group is never
larger than the alphabet plus one, however large the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import store

LETTER = "[A-Za-zÀ-ÿ]"
TERMINATOR = "\u0000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def garbled(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run without one of its code points where ``every`` divides crc32 of ``<doc_id>:<run>``, which
    also names the code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def corpus_words(docs: DataFrame, change=None, least_letters: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n) of all runs of letters of the whole texts, A-Z lower-cased and then put through
    ``change(doc_id, run)``, which may shorten it, if they have enough letters and occurrences."""
    # no change makes a run longer, so shorter runs are not even cut out
    runs = F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_letters},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    words = found.select((change(F.col("doc_id"), run) if change else run).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, skipped, indel): the rotations of the marked words, as a whole (``skipped`` is false) and
    without their last letter. ``indel`` is true at the first letter of a stretch of one letter only: taking
    any letter of the stretch away gives the same word, which counts once."""
    def letter(i):
        return F.substring("word", i, F.lit(1))

    def turned(i):
        """The rotation from code point i (from 0) on to the terminator."""
        return F.concat(F.substring("word", i + 1, F.length("word")), F.lit(TERMINATOR))

    whole = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(
        F.concat(turned(i), F.substring("word", F.lit(1), i)).alias("key"), F.lit(False).alias("skipped"), F.lit(False).alias("indel")))
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(
        F.concat(turned(i), F.substring("word", F.lit(1), i - 1)).alias("key"), F.lit(True).alias("skipped"),
        ((i == 1) | (letter(i) != letter(i - 1))).alias("indel")))
    return words.filter(F.length("word") > 0).select("word", "n", F.explode(F.concat(whole, less)).alias("r")) \
        .select("r.key", "word", "n", "r.skipped", "r.indel")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of those distinct words that have a near one: how many words differ by one inserted,
    deleted or replaced code point, and of these the one of largest n, then of least code points, as (minus_n, word)."""
    def bare(x):
        return F.when(x.isNotNull(), F.struct(x.minus_n.alias("minus_n"), x.word.alias("word")))

    def first(name, k=0):
        return bare(F.get(name, F.lit(k)))

    # spread and sorted by the rotations; a group has one member a letter at most, and most have a single one
    member = F.struct((-F.col("n")).alias("minus_n"), "word", "skipped", "indel")
    groups = rotations(words).repartitionByRange("key").groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("members")) \
        .filter(F.size("members") > 1).select(
            "members", F.filter("members", lambda x: x.skipped).alias("skipping"), F.filter("members", lambda x: x.indel).alias("longer"),
            F.filter("members", lambda x: ~x.skipped).alias("whole"))
    seen = groups.select(
        F.explode("members").alias("own"), F.size("skipping").alias("n_skipping"), F.size("longer").alias("n_longer"),
        first("skipping").alias("a"), first("skipping", 1).alias("b"), first("whole").alias("shorter"), first("longer").alias("longer"))
    indel = F.col("own.indel") & F.col("shorter").isNotNull()
    near = F.when(F.col("own.skipped"), F.col("n_skipping") - 1 + indel.cast("int")).otherwise(F.col("n_longer"))
    other = F.when(F.col("a.word") == F.col("own.word"), F.col("b")).otherwise(F.col("a"))
    best = F.when(F.col("own.skipped"), F.least(other, F.when(F.col("own.indel"), F.col("shorter")))).otherwise(F.col("longer"))
    return seen.select(F.col("own.word").alias("word"), near.cast("long").alias("near"), best.alias("best")).filter("near > 0") \
        .groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: every round doubles the steps followed. A form occurs at
    least ten times as often, so the rounds are few."""
    links = store(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while links.filter("moved").limit(1).count():
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = store(links.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
    return links.select("word", "root")


def group_spellings(words: DataFrame, times: int = 10) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n, of equal ones the least by code points, if it occurs ``times`` as
    often or more; ``root`` the last word reached by following forms, else the word itself. Rows with a null word or n, and
    the empty word, give no row; repeated words are one, their n added up; words must not hold U+0000, the terminator; further columns are ignored; an
    empty table gives no row.
    """
    words = store(words.filter(F.col("n").isNotNull() & (F.length("word") > 0)).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = store(words.join(near_words(words), "word", "left"), "near-words")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(-F.col("best.minus_n") >= times * F.col("n"), x).alias(a)
                                                for x, a in ((F.col("best.word"), "form"), (-F.col("best.minus_n"), "form_n"))])
    return near.join(_roots(near.filter("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, change=None) -> DataFrame:
    """``group_spellings`` of the words of whole texts. Null and empty texts have no words; ids may be null or
    repeat; repeated rows count again; further columns are ignored."""
    return group_spellings(corpus_words(docs, change))
