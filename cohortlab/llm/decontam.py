"""Benchmark decontamination by latent semantic retrieval.

Texts fall into passages of hashed words weighted by TF-IDF, the frequencies counted over all
documents. The SVD of the benchmark's passages gives the latent space: that of what is to be found, in
which unrelated text has next to no length. It is taken a block of items at a time, so that no block
has more passages than directions and none of what an item says is cut off.

A window of a text is a candidate for an item where it holds as many of the item's words as the least
leak has. Candidates' passages are folded in and looked at by falling cosine, and the longest common
subsequence of words with the item, with a check of the item's closing words for paraphrases, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import packed, small_batches, store, unpacked

WORDS = re.compile(r"\w+")
FEATURES = 1 << 16
#: A passage is two blocks of words; passages start at every block.
BLOCK = 16
#: Passages of a latent space; an item of more has a space of its own. All directions are kept.
RANK = 256
#: An item leaks when this share of its words stands in the text in order; or the lower share, when its
#: closing words do, too. Items of fewer words must stand there as they are.
COPIED, PARAPHRASED, CLOSING, SHORT = 0.6, 0.4, 5, 8
#: Benchmark words that one pass over the documents looks for.
QUERY_WORDS = 200_000
#: Words of texts, and words in windows, that are looked at in one step.
TEXT_WORDS, WINDOW_WORDS = 50_000, 100_000
#: Items whose words are counted in one step.
GROUP = 256
HIT = "array<struct<item_id:bigint,cosine:double,copied:double,answered:boolean>>"


def hashed(words: list[str]) -> np.ndarray:
    """The feature of each word."""
    return (pd.util.hash_array(np.array(words, object), categorize=False) % np.uint64(FEATURES)).astype(np.int64)


#: For each character of Latin-1 its lower-case form, or a space where no word has it.
LATIN = "".join(c if WORDS.fullmatch(c) else " " for c in map(str.lower, map(chr, range(256)))).encode("latin-1")


def words_of(text: str | None) -> list[str]:
    """The words of the lower-cased text; a text of Latin-1 is split by a table, character by character."""
    try:
        return (text or "").encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text.lower())


def passages_at(features: np.ndarray, starts: np.ndarray, length: int = 2 * BLOCK) -> np.ndarray:
    """The passages that start there, a row each, filled up by -1."""
    at = starts[:, None] + np.arange(length)
    return np.where(at < len(features), features[np.minimum(at, len(features) - 1)], -1)


def item_passages(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the passages of an item of ``n`` words; the last ends with the item."""
    if n <= 2 * BLOCK:
        return [(0, n)] if n else []
    starts = [*range(0, n - 2 * BLOCK, BLOCK), n - 2 * BLOCK]
    return [(a, a + 2 * BLOCK) for a in starts]


def _rows_by_feature(used: np.ndarray) -> np.ndarray:
    row = np.full(FEATURES, -1, np.int32)
    row[used] = np.arange(len(used))
    return row


def passage_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many passages (whole blocks of 32 words, not overlapping) each feature stands, over all
    documents; last the number of passages."""
    def count(batches):
        total, passages, words, ends = np.zeros(FEATURES, np.int64), 0, [], []

        def added():
            nonlocal total, passages
            if words:
                n = np.diff(ends, prepend=0)
                held = -(-n // (2 * BLOCK))                              # passages of each text
                of = np.repeat(np.arange(len(n)), held)
                first = (np.array(ends) - n)[of] + (np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)) * 2 * BLOCK
                at = np.minimum(first[:, None] + np.arange(2 * BLOCK), (np.array(ends) - 1)[of][:, None])
                code, distinct = pd.factorize(np.array(words, object))
                f = np.sort(hashed(distinct).astype(np.uint16)[code][at], axis=1)  # a short passage repeats its last word
                new = np.ones(f.shape, bool)
                new[:, 1:] = f[:, 1:] != f[:, :-1]
                passages += len(of)
                total += np.bincount(f[new], minlength=FEATURES)
                words.clear()
                ends.clear()

        for batch in batches:
            for text in batch["text"]:
                words += words_of(text)
                ends.append(len(words))
                if len(words) > 200_000:
                    added()
        added()
        yield pd.DataFrame({"counts": [total.tobytes()], "passages": [passages]})

    def add(key, group):
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return pd.DataFrame({"counts": [total.tobytes()], "passages": [group["passages"].sum()]})

    schema = "counts binary, passages long"
    per_task = docs.select("text").mapInPandas(count, schema)
    rooted = per_task.withColumn("g", F.spark_partition_id() % 64).groupBy("g").applyInPandas(add, schema)
    row = rooted.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(add, schema).first()
    if row is None:
        return np.zeros(FEATURES + 1, np.int64)
    return np.append(np.frombuffer(row["counts"], np.int64), row["passages"])


def latent_space(passages: list[list[str]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All right singular vectors of the TF-IDF matrix of the passages, as (features, rows x their rank)."""
    found = [hashed(words) for words in passages]
    used = np.unique(np.concatenate(found))
    row = _rows_by_feature(used)
    x = np.zeros((len(found), len(used)))
    for i, f in enumerate(found):
        np.add.at(x[i], row[f], 1.0)
    x *= idf[used]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, size, right = np.linalg.svd(x, full_matrices=False)
    return used, right[size > 1e-6 * size.max(initial=1e-30)].T.astype(np.float32)


def latent_spaces(items: list[tuple], idf: np.ndarray) -> list[tuple]:
    """The latent spaces of a block of queries, (items, features, rows) each, of RANK passages at most."""
    spaces, some, passages = [], [], []
    for i, words in [*((i, w) for i, w in items if w), (None, None)]:
        more = [words[a:b] for a, b in item_passages(len(words))] if words else []
        if some and (not words or len(passages) + len(more) > RANK):
            spaces.append((some, *latent_space(passages, idf)))
            some, passages = [], []
        some, passages = some + [(i, words)], passages + more
    return spaces


def places_of(item: list[str]) -> dict[str, int]:
    """For each word of an item the bits of its places."""
    where: dict[str, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | (1 << i)
    return where


def common_subsequence(item: list[str], text: list[str], where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time; ``where`` is ``places_of`` the item."""
    full = (1 << len(item)) - 1
    row = full
    for places in filter(None, map((where or places_of(item)).get, text)):
        match = row & places
        if match:
            row = ((row + match) | (row - match)) & full
    return len(item) - row.bit_count()


def leak(item: list[str], region: list[str], where: dict[str, int] | None = None) -> tuple[float, bool, bool]:
    """(share of the item's words found in order, closing words found, leak)."""
    n = len(item)
    if n < SHORT:
        found = any(region[i:i + n] == item for i in range(len(region) - n + 1))
        return float(found), found, found
    share = common_subsequence(item, region, where) / n
    answered = share >= PARAPHRASED and common_subsequence(item[-CLOSING:], region) >= CLOSING - 1
    return share, answered, share >= COPIED or (share >= PARAPHRASED and answered)


def least_words(item: list[str]) -> tuple[int, int]:
    """How many of the item's words a region with a leak holds at least, and how many when it also holds the closing ones."""
    n = len(item)
    if n < SHORT:
        return n, n
    return tuple(next(m for m in range(n + 1) if m / n >= share) for share in (COPIED, PARAPHRASED))


class _Group:
    """Items whose regions reach equally far, and the latent space of each."""

    def __init__(self, items, spaces, word_ids, idf):
        self.items, self.spaces, self.idf = items, spaces, idf
        known = sorted({word_ids[w] for _, words in items for w in words})
        self.row = np.full(len(word_ids), -1, np.int32)
        self.row[known] = np.arange(len(known))
        # columns: how often an item has the word, and how often among its closing words; no sum is above an item's
        # length, so eight or fewer columns are added at once as one number
        kind = np.min_scalar_type(max(len(words) for _, words in items))
        self.times = np.zeros((len(known), -(-2 * len(items) // 8) * 8), kind)
        for k, (_, words) in enumerate(items):
            np.add.at(self.times[:, k], self.row[[word_ids[w] for w in words]], 1)
            np.add.at(self.times[:, len(items) + k], self.row[[word_ids[w] for w in words[-CLOSING:]]], 1)
        self.least = np.array([least_words(words) for _, words in items], kind).T
        self.where = [places_of(words) for _, words in items]
        self.queries = []
        for k, (_, words) in enumerate(items):
            f, spans = hashed(words), item_passages(len(words))
            self.queries.append(self.folded(k, passages_at(f, np.array([a for a, _ in spans]), spans[0][1] - spans[0][0]))[0])

    def folded(self, k: int, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors of passages (rows of features, -1 after the last) in the latent space of item k, and the share of each
        passage's length that lies there."""
        feature_row, basis = self.spaces[k]
        there = passages >= 0
        at = np.where(there, feature_row[passages], -1)
        known = at >= 0
        n = known.sum(1)
        x = np.zeros((len(passages), basis.shape[1]), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            x[some] = np.add.reduceat(basis[at[known]], np.cumsum(n[some]) - n[some], axis=0)
        size = np.sqrt((x * x).sum(1, dtype=np.float64))
        # a feature said n times weighs n ** 2: each time it is said, n times
        times = ((passages[:, :, None] == passages[:, None, :]) & there[:, None, :]).sum(2)
        whole = np.sqrt((times * np.where(there, self.idf[passages], 0.0) ** 2).sum(1))
        return x / np.maximum(size, 1e-12)[:, None], size / np.maximum(whole, 1e-12)

    def cosines(self, k: int, passages: np.ndarray) -> np.ndarray:
        unit, share = self.folded(k, passages)
        return np.clip((unit @ self.queries[k].T).max(1) * share, 0.0, 1.0)

    def candidates(self, window: np.ndarray, word: np.ndarray):
        """(window, item) where a window holds enough words of an item; the pairs (window, word) are sorted, each once."""
        row = self.row[word]
        window, row = window[row >= 0], row[row >= 0]
        first = np.flatnonzero(np.diff(window, prepend=-1))
        ends = np.append(first[1:], len(row))
        k, at = len(self.items), 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, first[at] + WINDOW_WORDS, "right")))
            rows = self.times.view(np.uint64)[row[first[at]:ends[to - 1]]]
            held = np.add.reduceat(rows, first[at:to] - first[at], axis=0).view(self.times.dtype)
            enough = (held[:, :k] >= self.least[0]) | ((held[:, :k] >= self.least[1]) & (held[:, k:2 * k] >= CLOSING - 1))
            w, i = np.nonzero(enough)
            yield window[first[at + w]], i
            at = to


class _Search:
    """Finds the items of one block of queries in texts."""

    def __init__(self, spaces, idf):
        self.word_ids: dict[str, int] = {}
        for items, _, _ in spaces:
            for _, words in items:
                for w in words:
                    self.word_ids.setdefault(w, len(self.word_ids))
        by_reach: dict[int, list] = {}  # reach in blocks
        for items, used, rows in spaces:
            space = _rows_by_feature(used), rows * idf[used][:, None].astype(np.float32)
            for item in items:
                by_reach.setdefault(max(2, 1 << (-(-len(item[1]) // BLOCK) - 1).bit_length()), []).append((item, space))
        self.reaches = {reach: [_Group(*zip(*some[at:at + GROUP]), self.word_ids, idf) for at in range(0, len(some), GROUP)]
                        for reach, some in by_reach.items()}

    def near(self, texts: list[list[str]]):
        """(text, first block, blocks, group, item) of every window that may hold a leak. The regions of ``reach`` + 1
        passages, one after the other, lie in one window."""
        n = np.array([len(words) for words in texts])
        word = np.fromiter(map(self.word_ids.get, chain.from_iterable(texts), repeat(-1)), np.int64, n.sum())
        known = np.flatnonzero(word >= 0)
        word, of = word[known], np.repeat(np.arange(len(n)), n)[known]
        block = (known - (np.cumsum(n) - n)[of]) // BLOCK
        for reach, groups in self.reaches.items():
            step = reach + 1
            windows = -(-(-(-n // BLOCK)) // step)
            begin = np.cumsum(windows) - windows
            keys = []
            for back in range(3):
                j = (block + reach) // step - back
                here = (j >= 0) & (j < windows[of]) & (block < j * step + 2 * reach + 2)
                keys.append((begin[of[here]] + j[here]) * len(self.word_ids) + word[here])
            key = np.sort(np.concatenate(keys))
            key = key[np.diff(key, prepend=-1) > 0]
            window, at = np.divmod(key, max(len(self.word_ids), 1))
            for group in groups:
                for w, k in group.candidates(window, at):
                    text = np.searchsorted(begin, w, "right") - 1
                    for t, first, i in zip(text.tolist(), ((w - begin[text]) * step).tolist(), k.tolist()):
                        yield t, first, step, group, i

    def __call__(self, texts: list[list[str]]) -> list[list[tuple]]:
        places: dict[tuple, list] = {}
        for text, block, blocks, group, k in self.near(texts):
            item, words = group.items[k][1], texts[text]
            first, last = block * BLOCK, min((block + blocks) * BLOCK, len(words))
            # what no part of the window could have, the whole window has not
            if leak(item, words[max(0, first - len(item)):last + 2 * BLOCK + len(item)], group.where[k])[2]:
                places.setdefault((text, id(group), k), [group]).extend(range(first, last, BLOCK))
        hits: list[list[tuple]] = [[] for _ in texts]
        features: dict[int, np.ndarray] = {}
        for (text, _, k), (group, *starts) in places.items():
            words, (item_id, item) = texts[text], group.items[k]
            if text not in features:
                features[text] = hashed(words)
            near = sorted(zip((-group.cosines(k, passages_at(features[text], np.array(starts)))).tolist(), starts))
            for _, a in near:
                share, answered, found = leak(item, words[max(0, a - len(item)):a + 2 * BLOCK + len(item)], group.where[k])
                if found:
                    hits[text].append((item_id, -near[0][0], share, answered))
                    break
        return hits


def _finder(shared):
    @F.pandas_udf(HIT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = _Search(*shared.value)
        for texts in batches:
            out, some, size = [], [], 0
            for text in texts:
                some.append(words_of(text))
                size += len(some[-1])
                if size > TEXT_WORDS:
                    out, some, size = out + search(some), [], 0
            yield pd.Series(out + search(some) if some else out)

    return find


def _query_blocks(benchmark: DataFrame, query_words: int):
    """The items in blocks of about ``query_words`` words, (item_id, words) each; one block is on the driver at a time."""
    sized = benchmark.select("item_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = int(total) // query_words + 1
    stored = store(sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).drop("n"), "leak-queries")
    for b in range(blocks):
        rows = stored.filter(F.col("block") == b).select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        yield [(r["item_id"], words_of(r["text"])) for r in rows]


def _hits(docs: DataFrame, benchmark: DataFrame, query_words: int):
    """A column per block of queries with the hits in ``text``."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    with small_batches(docs.sparkSession):
        counts = passage_frequencies(docs)
    idf = np.log(1 + (1 + counts[-1]) / (1 + counts[:-1]))   # above 0 for every word, however common
    columns = []
    for items in _query_blocks(benchmark, query_words):
        columns.append(_finder(docs.sparkSession.sparkContext.broadcast((latent_spaces(items, idf), idf)))("text"))
    return columns


def find_leaks(docs: DataFrame, benchmark: DataFrame, query_words: int = QUERY_WORDS) -> DataFrame:
    """(doc_id, item_id, cosine, copied, answered): one row for each document row and benchmark item that
    leaks into it, ``copied`` being the share of the item's words found in order.

    Null and empty texts leak nothing, on either side; equal items are found once, items that share an id
    each; null and repeated doc_ids and repeated rows give their own rows; further columns are
    ignored; an empty table on either side gives no row.
    """
    hits = F.concat(*_hits(docs, benchmark, query_words))
    return docs.select("doc_id", "text").select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, query_words: int = QUERY_WORDS) -> DataFrame:
    """All input columns of the rows into which no benchmark item leaks."""
    hits = F.concat(*_hits(docs, benchmark, query_words))
    clean = packed(docs, "text").withColumn("hits", hits).filter(F.size("hits") == 0)
    return unpacked(clean.select("_doc"), docs.columns)
