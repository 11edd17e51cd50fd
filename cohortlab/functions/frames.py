"""DataFrame-level helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.session import materialize


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int, key: str, buckets: int = 64,
                    rank_col: str = "rank") -> DataFrame:
    """Exact top-n rows per group without sorting a whole group in one task.

    Phase 1 ranks inside (group, hash(key) mod buckets) and keeps n per bucket; phase 2 ranks the
    <= buckets x n survivors per group. ``order`` must be a total order (end with a unique key).
    """
    b = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
    w1 = Window.partitionBy(*group, b).orderBy(*order)
    cand = df.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= n)


def numbered(df: DataFrame, by: list[str], name: str, first: int = 1) -> DataFrame:
    """The rows with their number in the order of ``by`` (a total order), without sorting them in one task: ranges are sorted and stored, and each is
    numbered from where the one before ends."""
    stored = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)                                              # the task, as Spark makes these ids
    held = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    start = held.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") + F.lit(first)).alias("_start"))      # a row per task
    place = F.col("_at") - F.shiftleft(part, 33) + F.col("_start")
    return stored.join(F.broadcast(start), part == F.col("_part")).select(*df.columns, place.cast("long").alias(name))
