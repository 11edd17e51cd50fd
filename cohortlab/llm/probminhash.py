"""Near duplicates by ProbMinHash.

A text's word shingles are weighted by their counts. Each shingle runs a Poisson process of that
rate; each arrival falls into one of the registers, which keep their earliest arrival. A shingle
stops once its next arrival comes after every register's, so only a few arrivals per shingle are
drawn. Two texts agree in a register with a probability equal to their probability Jaccard
similarity. Bands of registers give candidates, register agreement thins them, and the exact
similarity of the shingle weights decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import packed, small_batches, store, unpacked
from cohortlab.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity 0.8 agree in some band but once in 300,000 times.
BANDS, BAND_ROWS = 32, 5
REGISTERS = BANDS * BAND_ROWS
#: Texts that share buckets also get a sketch, one bit for each of so many registers.
SKETCH_BITS = 1024
#: Candidates go when their registers, or their sketches, agree by so much less than the limit: four
#: standard deviations of either estimate.
REGISTER_SLACK, SKETCH_SLACK = 0.13, 0.08
#: Texts are hashed in parts of about so many characters and texts; a longer text is a part of its own.
PART_CHARS, PART_TEXTS = 2_000_000, 1000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts together: text number, 64-bit shingle and count, each shingle of a text once.

    Words are maximal runs of non-space characters of the lower-cased text; a text of fewer words than
    a shingle has one shingle of all its words, one without words has none.
    """
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    # words apart by one space first: Arrow's split at white space reads beyond a text that ends in several
    split = pc.split_pattern(pc.utf8_lower(pa.array([" ".join(t.split()) for t in texts], pa.large_string())), " ")
    at, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    some = pc.not_equal(flat, "")
    at, flat = at.filter(some).to_numpy().astype(np.int64), flat.filter(some).dictionary_encode()
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    unique = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    word = unique[flat.indices.to_numpy()]
    ends = np.cumsum(np.bincount(at, minlength=len(texts)))
    end = ends[at]
    begin = np.concatenate([[0], ends[:-1]])[at]
    here = np.arange(len(at))
    starts = here[(here + length <= end) | (here == begin)]
    code = np.zeros(len(starts), np.uint64)
    for j in range(length):
        inside = starts + j < end[starts]
        code = np.where(inside, _mixed(code * _STEP + word[np.minimum(starts + j, len(word) - 1)]), code)
    of = at[starts]
    cuts = np.flatnonzero(np.diff(of)) + 1
    parts = [np.unique(x, return_counts=True) for x in np.split(code, cuts)]
    return (np.repeat(of[np.concatenate([[0], cuts])], [len(x) for x, _ in parts]),
            np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]))


def signatures(n_texts: int, of: np.ndarray, code: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of all texts (n_texts x registers): the shingle whose process arrives there first."""
    time = np.full(n_texts * registers, np.inf)
    owner = np.zeros(n_texts * registers, np.uint64)
    last = np.full(n_texts, np.inf)
    rate, clock, turn = weight.astype(np.float64), np.zeros(len(code)), 0
    while len(code):
        turn += 1
        x = _mixed(code + np.uint64(turn * int(_STEP) % 2 ** 64))
        clock = clock - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        live = clock < last[of]
        of, code, rate, clock, x = of[live], code[live], rate[live], clock[live], x[live]
        # the register comes of bits of its own, enough of them for any number of registers
        turned = _mixed(x ^ _MIX[0]) >> np.uint64(32)
        slot = of * registers + ((turned * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(time, slot, clock)
        won = time[slot] == clock
        owner[slot[won]] = code[won]
        touched = np.unique(of)
        last[touched] = time.reshape(n_texts, registers)[touched].max(axis=1)
    return owner.reshape(n_texts, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted codes, weights): the sum over common
    elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ca, wa), (cb, wb) = a, b
    if not len(ca) or not len(cb):
        return float(len(ca) == len(cb))
    _, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if wa.max() == wa.min() and wb.max() == wb.min():
        return len(ia) / (len(ca) + len(cb) - len(ia))
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = wa.sum() - x.sum() + np.cumsum(x[::-1])[::-1] - x  # of x with a greater ratio, and outside b
    upto = wb.sum() - y.sum() + np.cumsum(y)
    return float((1.0 / (above / x + upto / y)).sum())


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.lower("text"), F.lit(""))))


def _parts(texts: list[str]):
    """Ranges of texts with about PART_CHARS characters and PART_TEXTS texts at most."""
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= PART_CHARS or i + 1 - begin == PART_TEXTS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _hashed(batches):
    import pandas as pd

    for batch in batches:
        keys, texts = batch["key"].tolist(), batch["text"].fillna("").tolist()
        for a, b in _parts(texts):
            owner = signatures(b - a, *shingles(texts[a:b]))
            bands = np.zeros((b - a, BANDS), np.uint64)
            for j in range(BAND_ROWS):
                bands = _mixed(bands * _STEP + owner[:, j * BANDS:(j + 1) * BANDS])
            bands = _mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[1]).view(np.int64)
            low = np.ascontiguousarray((_mixed(owner) & np.uint64(0xFF)).astype(np.uint8)).view(np.int64)
            yield pd.DataFrame({"key": keys[a:b], "bands": list(bands), "sig": list(low)})


def _weighted(batches):
    import pandas as pd

    for batch in batches:
        nodes, texts = batch["node"].tolist(), batch["text"].fillna("").tolist()
        for a, b in _parts(texts):
            of, code, weight = shingles(texts[a:b])
            at = np.searchsorted(of, np.arange(b - a + 1))
            bit = (_mixed(signatures(b - a, of, code, weight, SKETCH_BITS)) & np.uint64(1)).astype(np.uint8)
            sketch = np.ascontiguousarray(np.packbits(bit, axis=1)).view(np.int64)
            out = []
            for i in range(b - a):
                short, where = np.unique((code[at[i]:at[i + 1]] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                out.append((nodes[a + i], sketch[i], short.tobytes(), np.bincount(where, weight[at[i]:at[i + 1]], len(short)).astype(np.uint32).tobytes()
                            if (weight[at[i]:at[i + 1]] > 1).any() else b""))
            yield pd.DataFrame(out, columns=["node", "sketch", "codes", "counts"])


def _verified(batches, least: float):
    def of(codes, counts):
        c = np.frombuffer(codes, np.uint32)
        return c, (np.frombuffer(counts, np.uint32) if counts else np.ones(len(c), np.uint32))

    for batch in batches:
        good = [similarity(of(*x), of(*y)) >= least for x, y in
                zip(zip(batch["codes_a"], batch["counts_a"]), zip(batch["codes_b"], batch["counts_b"]))]
        yield batch.loc[good, ["a", "b"]]


def _agreement(x: str, y: str) -> Column:
    """The share of registers, of which a byte each is kept in longs, that agree: a byte that differs
    folds to one bit."""
    differ = []
    for i in range(REGISTERS // 8):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(mask))
        differ.append(F.bit_count(d))
    agree = REGISTERS - reduce(lambda a, b: a + b, differ)
    return (agree / REGISTERS - 1 / 256) / (1 - 1 / 256)


def _sketched(x: str, y: str) -> Column:
    """Similarity estimated from sketches: registers that agree do so in their bit, and half of the others."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)])
    return 1 - 2 * differ / SKETCH_BITS


def _placed(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, key, root) for every row: key stands for its text, root for its class.

    Equal texts are one node, so copies cost a row each. In each band the node that shares most buckets is
    compared with the others; what this links becomes classes. Then, in buckets that still hold several
    classes, pairs of nodes of different classes whose sketches agree enough are compared as well, each pair in its
    least common bucket, so no
    candidate link is left out, while a class is never expanded into its pairs.
    """
    work = docs.select("doc_id", "text").withColumn("key", _key())
    hashed = work.select("key", "text").mapInPandas(_hashed, "key binary, bands array<long>, sig array<long>")
    nodes = store(hashed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
                  .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    slots = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = store(slots.join(shared, "bucket"), "near-members")
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    hub = members.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("top")) \
        .select("bucket", (-F.col("top.minus")).alias("a"))
    stars = members.join(hub, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    sig = nodes.select("node", "sig")
    stars = store(stars.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
                  .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
                  .filter(_agreement("sig_a", "sig_b") >= least - REGISTER_SLACK).select("a", "b"), "near-stars")

    keys = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = work.select("key", "text").join(keys, "key").dropDuplicates(["node"])
    weighted = store(texts.select("node", "text").mapInPandas(_weighted, "node long, sketch array<long>, codes binary, counts binary"), "near-shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        w = lambda s: weighted.select(F.col("node").alias(s), F.col("codes").alias(f"codes_{s}"), F.col("counts").alias(f"counts_{s}"))
        return pairs.select("a", "b").join(w("b"), "b").join(w("a"), "a").mapInPandas(lambda x: _verified(x, least), "a long, b long")

    links = store(verify(stars), "near-links")
    roots = store(members.select("node").distinct().join(components(links), "node", "left")
                  .select("node", F.coalesce("root", "node").alias("root")), "near-roots")
    rest = members.select("bucket", "node").join(roots, "node")
    mixed = rest.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("several")).filter("several").select("bucket")
    rest = rest.join(mixed, "bucket").join(weighted.select("node", "sketch"), "node").join(nodes.select("node", "bands"), "node")
    rest = store(rest, "near-rest")
    other = rest.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "sketch", "bands")])
    pairs = (rest.join(other, "bucket")
             .filter((F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b")) & (_sketched("sketch", "sketch_b") >= least - SKETCH_SLACK)
                     & (F.array_min(F.array_intersect("bands", "bands_b")) == F.col("bucket")))
             .select(F.col("node").alias("a"), F.col("node_b").alias("b")))
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = store(verify(pairs.join(known, ["a", "b"], "left_anti")), "near-links")
    roots = components(links.unionByName(found))

    return store(work.select("doc_id", "key").join(nodes.select("key", "node"), "key").join(roots, "node", "left")
                 .select("doc_id", "key", F.coalesce("root", "node").alias("root")), "near-placed")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for every input row. Texts of similarity ``least`` or more, and equal texts, are linked;
    linked rows form a class, and class_id is the least doc_id in it (null where all ids are null).

    Similarity is the probability Jaccard similarity of 5-word shingles weighted by their counts. Texts are
    compared in lower case; null and empty texts are equal to one another; repeated rows are copies. Further
    columns are ignored, an empty table gives no row.
    """
    with small_batches(docs.sparkSession):
        placed = _placed(docs, least)
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(classes, "root").select("doc_id", "class_id")


def _stay(placed: DataFrame) -> DataFrame:
    """(key, stay_id, n_rows) of the text and id that stay of each class."""
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    count = placed.groupBy("key", "doc_id").agg(F.count("*").alias("n_rows"))
    stay = best.select(F.col("best.key").alias("key"), F.col("best.doc_id").alias("stay_id"))
    return stay.join(count.withColumnRenamed("doc_id", "count_id").withColumnRenamed("key", "count_key"),
                     (F.col("key") == F.col("count_key")) & F.col("stay_id").eqNullSafe(F.col("count_id"))).select("key", "stay_id", "n_rows")


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """All input columns of one row per class of ``near_duplicates``: the row of its least id (of null id
    only where the class has no other), and of rows with that id the one whose text's digest, then whose
    JSON form sorts first."""
    with small_batches(docs.sparkSession):
        placed = _placed(docs, least)
        stay = store(_stay(placed), "near-stay")
    work = packed(docs, "doc_id", "text").withColumn("key", _key()).select("_doc", "doc_id", "key")
    rows = work.join(stay.withColumnRenamed("key", "stay_key"),
                     (F.col("key") == F.col("stay_key")) & F.col("doc_id").eqNullSafe(F.col("stay_id")))
    one = rows.filter("n_rows = 1").select("_doc")
    first = rows.filter("n_rows > 1").groupBy("key", "stay_id").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc")
    return unpacked(one.unionByName(first), docs.columns)
