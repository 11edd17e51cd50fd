"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source fall into blocks by a hash. A source's target is met by whole passes over
its blocks and a last pass over permuted blocks, whose last block is cut inside. The drawn blocks
give each source an exact quota; the tree halves the range of output shards again and again and
draws how many blocks of each source go left, so that every shard holds an exact share. A shard then
takes the next blocks of each source's permutation, disjoint from those of other shards, and orders
its documents by a hash of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.llm.common import WORD, packed, store, unpacked

#: No document is taken more often than this.
MOST_PASSES = 3


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce((F.lit(p) if isinstance(p, (int, str)) and not isinstance(p, Column) else p).cast("string"), F.lit("")) for p in parts]))


def _number(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("h", _digest(seed, F.col("doc_id"), F.col("size")))


def source_targets(sizes: DataFrame, block_words: int, max_blocks: int) -> DataFrame:
    """One row per source: its rank by code point (null last), size, target and number of blocks.

    Weights are 1, 2, 3, repeating. With the sources in order of size / weight, those that reach three
    times their size come first; the others share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy()
    ranked = (per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", (F.col("sid") - 1) % 3 + 1)
              .withColumn("total", F.sum("source_size").over(every))
              .withColumn("all_docs", F.sum("n_docs").over(every))
              .withColumn("full_at", (F.col("source_size") * (6 / F.col("weight")).cast("long"))))
    order = Window.orderBy("full_at", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (ranked.withColumn("spent", F.coalesce(F.sum(F.col("source_size") * MOST_PASSES).over(before), F.lit(0)))
             .withColumn("shares", F.sum("weight").over(after))
             .withColumn("capped", F.col("source_size") * MOST_PASSES * F.col("shares") <= (F.col("total") - F.col("spent")) * F.col("weight")))
    first = F.min_by(F.struct("spent", "shares"), F.when(~F.col("capped"), F.struct("full_at", "sid"))).over(every)
    target = (F.when(F.col("capped"), (F.col("source_size") * MOST_PASSES).cast("double"))
              .otherwise((F.col("total") - F.col("free.spent")).cast("double") * F.col("weight") / F.col("free.shares")))
    words = F.greatest(F.lit(block_words), F.ceil(F.col("total") / max_blocks))
    rows = F.greatest(F.lit(block_words), F.ceil(F.col("all_docs") / max_blocks))
    return (level.withColumn("free", first).withColumn("target", target)
            .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words), F.ceil(F.col("n_docs") / rows)).cast("long"))
            .withColumn("wanted", F.round("target").cast("long"))
            .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)).cast("long"))
            .withColumn("rest", F.when(F.col("source_size") > 0, F.col("wanted") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0)).cast("long"))
            .select("source", "sid", "source_size", "weight", "target", "n_blocks", "passes", "rest"))


def block_draws(blocks: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(sid, block, pass, position, left): every drawn block; ``left`` is null for a whole block, else
    the words still wanted from it."""
    joined = blocks.join(sources.select("sid", "n_blocks", "passes", "rest"), "sid")
    turn = joined.select("*", F.explode(F.expr("sequence(0L, passes)")).alias("pass"))
    order = Window.partitionBy("sid", "pass").orderBy(_digest(seed, F.col("pass"), F.col("sid"), F.col("block")), "block")
    taken = (turn.withColumn("position", F.row_number().over(order) - 1)
             .withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    last = F.col("pass") == F.col("passes")
    return (taken.filter(~last | (F.col("upto") - F.col("words") < F.col("rest")))
            .select("sid", "block", "pass", (F.col("pass") * F.col("n_blocks") + F.col("position")).alias("position"),
                    F.when(last & (F.col("upto") > F.col("rest")), F.col("rest") - (F.col("upto") - F.col("words"))).alias("left")))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, sid, quota) from (sid, quota): each node of the tree draws, by the multivariate
    hypergeometric law, how many blocks of each source go to its left half of the shards."""
    @F.pandas_udf("array<long>")
    def left_half(first: pd.Series, last: pd.Series, count: pd.Series, quota: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for a, b, n, q in zip(first, last, count, quota):
            rng = np.random.Generator(np.random.Philox(key=[seed, (int(a) << 32) | int(b)]))
            out.append(rng.multivariate_hypergeometric(np.asarray(q, np.int64), int(n), method="marginals"))
        return pd.Series(out)

    node = (quotas.agg(F.array_sort(F.collect_list(F.struct("sid", "quota"))).alias("q"))
            .select(F.lit(0).alias("first"), F.lit(shards).alias("last"), F.col("q.sid").alias("sids"), F.col("q.quota").alias("quota"))
            .withColumn("total", F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)))
    cut = lambda c: F.expr(f"{c} * total div {shards}")  # noqa: E731  blocks before shard c
    for _ in range(max(0, (shards - 1).bit_length())):
        node = node.withColumn("middle", F.expr("(first + last) div 2"))
        node = node.withColumn("left", left_half("first", "last", cut("middle") - cut("first"), "quota"))
        halves = [F.struct(F.col("first"), F.col("middle").alias("last"), F.col("left").alias("quota")),
                  F.struct(F.col("middle").alias("first"), F.col("last"), F.zip_with("quota", "left", lambda x, y: x - y).alias("quota"))]
        node = (node.select("sids", "total", F.explode(F.array(*halves)).alias("half")).select("sids", "total", "half.*")
                .filter("last > first"))
    return node.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("sids", "quota")).alias("x")) \
        .select("shard", F.col("x.sids").alias("sid"), F.col("x.quota").alias("quota"))


def plan_mix(docs: DataFrame, shards: int = 16, seed: int = 7, block_words: int = 20_000, max_blocks: int = 1_000_000):
    """The stored plan: (sources, draws). ``draws`` has a row per source and block with its draws
    (pass, shard, left); ``sources`` also holds where a source's cut block is cut.

    There are at most ``max_blocks`` blocks beside one per source, so what the windows order stays
    bounded, and a block holds about ``block_words`` words or that bound's share of all words.
    """
    sizes = store(_sized(docs.select("doc_id", "text", "source"), seed).select("source", "size", "h"), "mix-sizes")
    sources = store(source_targets(sizes, block_words, max_blocks), "mix-sources")
    dealt = sizes.join(sources.select(F.col("source").alias("s"), "sid", "n_blocks"), F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("block", _number(F.col("h")) % F.col("n_blocks"))
    blocks = dealt.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    drawn = store(block_draws(blocks, sources, seed), "mix-drawn")
    leaves = split_quotas(drawn.groupBy("sid").agg(F.count("*").alias("quota")), shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))
    slots = (leaves.withColumn("upto", upto).filter("quota > 0")
             .select("sid", "shard", F.explode(F.expr("sequence(upto - quota, upto - 1)")).alias("position")))
    cut = drawn.filter("left IS NOT NULL").select("sid", "block", "left")
    inside = dealt.join(cut, ["sid", "block"]).groupBy("sid", "left", "h").agg(F.sum("size").alias("words"))
    upto_h = F.sum("words").over(Window.partitionBy("sid").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = (inside.withColumn("upto", upto_h).filter(F.col("upto") * 2 - F.col("words") <= F.col("left") * 2)
            .groupBy("sid").agg(F.max("h").alias("cut_h")))
    draws = (drawn.join(slots, ["sid", "position"]).join(cuts, "sid", "left")
             .groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", F.when(
                 F.col("left").isNotNull(), F.coalesce("cut_h", F.lit(""))).alias("cut_h")))).alias("draws")))
    return sources, store(draws, "mix-draws")


def _taken(work: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    """``work`` (with source, size, h) with source_size, target and the draws of each row."""
    s = sources.select(F.col("source").alias("s"), "sid", "n_blocks", "source_size", "target")
    placed = work.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", _number(F.col("h")) % F.col("n_blocks"))
    empty = F.array().cast("array<struct<pass:bigint,shard:int,cut_h:string>>")
    return (placed.join(draws, ["sid", "block"], "left")
            .withColumn("draws", F.coalesce(F.filter("draws", lambda x: x["cut_h"].isNull() | (F.col("h") <= x["cut_h"])), empty)))


def mix_counts(docs: DataFrame, shards: int = 16, seed: int = 7, **options) -> DataFrame:
    """What the mix takes, one row per input row: doc_id, size, source_size, target, taken (words,
    repeats counted) and shards (the shard of each copy).

    Sources share all words by weights 1, 2, 3 in code point order, null last; none passes three times
    its size. Null or empty texts have size 0 and may be taken for 0 words. Rows of one source that agree in id
    and size are taken together; null and repeated ids are allowed. An empty table gives no row, further columns
    are ignored, and reruns agree.
    """
    sources, draws = plan_mix(docs, shards, seed, **options)
    work = _sized(docs.select("doc_id", "text", "source"), seed).drop("text")
    return _taken(work, sources, draws).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: all input columns once per copy taken, with ``copy``, ``shard`` and ``shard_order``, by which
    a shard's rows are shuffled. Cases as in ``mix_counts``."""
    sources, draws = plan_mix(docs, shards, seed, **options)
    work = _sized(packed(docs, "doc_id", "text", "source"), seed).drop("text")
    taken = _taken(work, sources, draws).select("_doc", "h", F.posexplode("draws").alias("copy", "draw"))
    taken = taken.withColumn("shard", F.col("draw.shard"))
    return unpacked(taken, docs.columns, "copy", "shard", _digest(seed, F.col("shard"), F.col("h"), F.col("copy")).alias("shard_order"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write the mix as one folder per shard, each sorted by its own shuffle order. A shard of many
    rows is dealt out over ranges of that order, so none is written by one task alone."""
    (mixed.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order")
     .write.partitionBy("shard").mode("overwrite").parquet(path))
