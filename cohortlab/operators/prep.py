"""Feature preprocessing (M1, M2, M2b): column statistics are one global aggregate (a single
row per statistic set), joined back by broadcast; no data passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.fixed import FEATURE_NAMES

#: Rank error of the sketch that brackets a percentile: one part in this many.
SKETCH_ACCURACY = 10_000


def percentiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """One row with an array ``_q_<col>`` of exact percentiles (linear interpolation) per column.

    A sketch brackets each percentile within a few parts in ``SKETCH_ACCURACY`` of its rank. What lies
    below the bracket is counted, only the distinct values inside it are grouped and counted, and the
    wanted ranks are read off their running counts, so no reducer holds a column's values.
    """
    least = min(df.agg(*[F.count(c).alias(c) for c in cols]).first())          # one number per column
    slack = 2.0 / SKETCH_ACCURACY + 2.0 / max(1, least)
    edges = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(values.alias("x")).select("x.c", "x.v").filter(F.col("v").isNotNull())
    sketch = long.groupBy("c").agg(F.count(F.lit(1)).alias("n"),
                                   F.percentile_approx("v", F.array(*map(F.lit, edges)), SKETCH_ACCURACY).alias("e"))
    bracket = sketch.select("c", F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at"), F.col("e")[2 * i].alias("lo"), F.col("e")[2 * i + 1].alias("hi"))
        for i, p in enumerate(probs)])).alias("b")).select("c", "b.*")
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    near = (long.join(F.broadcast(bracket), "c").filter(F.col("v") <= F.col("hi"))
            .groupBy("c", "i", "at", inside.alias("v")).agg(F.count(F.lit(1)).alias("k")))
    upto = F.sum("k").over(Window.partitionBy("c", "i").orderBy(F.col("v").asc_nulls_first()))
    found = near.withColumn("upto", upto).groupBy("c", "i", "at").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    part = F.col("at") - F.floor("at")
    value = F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    pick = lambda c, i: F.max(F.when((F.col("c") == c) & (F.col("i") == i), value))
    return found.agg(*[F.array(*[pick(c, i) for i in range(len(probs))]).alias(f"_q_{c}") for c in cols])


def winsorize(df: DataFrame, cols: list[str] = FEATURE_NAMES, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip each column to its [lo, hi] quantiles (linear interpolation) (M1)."""
    q = percentiles(df, cols, [lo, hi])
    x = df.crossJoin(F.broadcast(q))
    out = [F.least(F.greatest(F.col(c).cast("double"), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1]).alias(c)
           if c in cols else F.col(c) for c in df.columns]
    return x.select(*out)


def standardize(df: DataFrame, cols: list[str] = FEATURE_NAMES) -> DataFrame:
    """(x − mean) / population std; a zero std divides by 1 (M2). Spark ML's StandardScaler
    uses the sample std, so the statistics are computed here."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(st))
    sd = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    return x.select(*[((F.col(c) - F.col(f"_m_{c}")) / sd(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, cols: list[str] = FEATURE_NAMES) -> DataFrame:
    """(x − median) / IQR; a zero IQR divides by 1."""
    q = percentiles(df, cols, [0.25, 0.5, 0.75])
    x = df.crossJoin(F.broadcast(q))
    iqr = lambda c: F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
    return x.select(*[((F.col(c) - F.col(f"_q_{c}")[1]) / F.when(iqr(c) != 0, iqr(c)).otherwise(F.lit(1.0))).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def minmax_scale(df: DataFrame, cols: list[str] = FEATURE_NAMES) -> DataFrame:
    """(x − min) / (max − min); a zero range divides by 1."""
    st = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(st))
    rng = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    return x.select(*[((F.col(c) - F.col(f"_lo_{c}")) / F.when(rng(c) != 0, rng(c)).otherwise(F.lit(1.0))).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


SCALERS = {"standard": standardize, "robust": robust_scale, "minmax": minmax_scale}


def scaled_features(features: DataFrame, cols: list[str] = FEATURE_NAMES, scaler: str = "standard") -> DataFrame:
    """customer_id + winsorized, scaled model columns (the model input)."""
    w = winsorize(features.select("customer_id", *cols), cols)
    return SCALERS[scaler](w, cols)
