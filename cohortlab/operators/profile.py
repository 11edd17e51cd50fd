"""Segment aggregates (G1-G10). Input: features with any integer ``seg`` label.

Line-grain inputs are pre-aggregated to (customer, X) *before* they meet the customer -> seg
map, so the join sees one row per customer and key, not one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.functions.columns import year_month

PROFILE_METRICS = [
    ("avg_spend", "total_spend"), ("avg_aov", "aov"), ("avg_recency", "recency"), ("avg_orders", "order_count"),
    ("avg_discount", "avg_discount"), ("avg_active_months", "active_months"), ("avg_return_rate", "return_rate"),
    ("avg_refund_ratio", "refund_ratio"), ("avg_diversity", "diversity"), ("avg_sp30", "spend_30"),
    ("avg_sp90", "spend_90"), ("avg_sp365", "spend_365"), ("avg_ord30", "orders_30"), ("avg_ord90", "orders_90"),
    ("avg_ord365", "orders_365"), ("avg_spend_velocity", "spend_velocity"), ("avg_clv_slope", "clv_slope"),
    ("avg_lifespan", "lifespan"), ("avg_spend_momentum", "spend_momentum"), ("avg_net_revenue", "net_revenue"),
    ("avg_projected_annual", "projected_annual_value"),
]
#: What ``segment_profile`` reads of the features.
PROFILE_FEATURES = [*dict.fromkeys([src for _, src in PROFILE_METRICS] + ["ipt"])]


def profile_features(metrics) -> list[str]:
    """What ``segment_profile`` reads of the features for these metrics."""
    source = dict(PROFILE_METRICS) | {"avg_ipt": "ipt", "clv_growing_pct": "clv_slope", "clv_declining_pct": "clv_slope"}
    return [*dict.fromkeys(source[m] for m in metrics)]


def seg_map(segf: DataFrame, seg: str = "seg") -> DataFrame:
    return segf.select("customer_id", F.col(seg).alias("seg"))


def segment_counts(segf: DataFrame, seg: str = "seg") -> DataFrame:
    """Customers per segment and the total (G1)."""
    c = segf.groupBy(F.col(seg).alias("seg")).agg(F.count(F.lit(1)).alias("customers"))
    return c.withColumn("total_customers", F.sum("customers").over(Window.partitionBy()))


def segment_profile(segf: DataFrame, seg: str = "seg", metrics=None) -> DataFrame:
    """n and the mean of every feature per segment, mean ipt over known values, and the share of
    customers with a rising / falling monthly-spend trend (G2, G2a, G2b); or n and only ``metrics`` of them."""
    aggs = {name: F.avg(src) for name, src in PROFILE_METRICS}
    aggs |= {"avg_ipt": F.coalesce(F.avg("ipt"), F.lit(0.0)),
             "clv_growing_pct": F.sum((F.col("clv_slope") > 0).cast("int")) * 100.0 / F.count(F.lit(1)),
             "clv_declining_pct": F.sum((F.col("clv_slope") < 0).cast("int")) * 100.0 / F.count(F.lit(1))}
    return segf.groupBy(F.col(seg).alias("seg")).agg(F.count(F.lit(1)).alias("n"),
                                                     *[aggs[m].alias(m) for m in (aggs if metrics is None else metrics)])


def _customer_month(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id", year_month("order_date").alias("ym")).agg(F.sum("net_amount").alias("spend"))


def segment_monthly_spend(lines: DataFrame, segf: DataFrame, seg: str = "seg") -> DataFrame:
    """Per segment and month: mean over the segment's buyers of that month of their spend."""
    cm = _customer_month(lines).join(seg_map(segf, seg), "customer_id")
    return cm.groupBy("seg", "ym").agg((F.sum("spend").cast("double") / F.count(F.lit(1))).alias("avg_spend"))


def segment_monthly_active_pct(lines: DataFrame, segf: DataFrame, seg: str = "seg") -> DataFrame:
    """% of a segment's customers who ordered in each month."""
    cm = _customer_month(lines).join(seg_map(segf, seg), "customer_id")
    sizes = segment_counts(segf, seg).select("seg", "customers")
    act = cm.groupBy("seg", "ym").agg(F.count(F.lit(1)).alias("active"))
    return act.join(F.broadcast(sizes), "seg") \
        .select("seg", "ym", "active", (F.col("active") * 100.0 / F.col("customers")).alias("active_pct"))


def segment_category_share(lines: DataFrame, segf: DataFrame, seg: str = "seg",
                           top: int = FX.TOP_CATEGORIES_PER_SEGMENT) -> DataFrame:
    """Top-N categories by line count per segment; share of the top-N total."""
    cc = lines.groupBy("customer_id", "category").agg(F.count(F.lit(1)).alias("n"))
    sc = cc.join(seg_map(segf, seg), "customer_id").groupBy("seg", "category").agg(F.sum("n").alias("lines"))
    w = Window.partitionBy("seg").orderBy(F.desc("lines"), F.asc("category"))
    t = sc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return t.withColumn("share", F.col("lines") * 100.0 / F.sum("lines").over(Window.partitionBy("seg")))


def segment_net_revenue(lines: DataFrame, returns: DataFrame, segf: DataFrame, seg: str = "seg") -> DataFrame:
    """Gross − refunds per segment."""
    sm = seg_map(segf, seg)
    gross = lines.groupBy("customer_id").agg(F.sum("net_amount").alias("g")).join(sm, "customer_id") \
        .groupBy("seg").agg(F.sum("g").alias("gross"))
    ref = returns.groupBy("customer_id").agg(F.sum("refund_amount").alias("r")).join(sm, "customer_id") \
        .groupBy("seg").agg(F.sum("r").alias("refunds"))
    segs = sm.select("seg").distinct()
    out = segs.join(gross, "seg", "left").join(ref, "seg", "left")
    g = F.coalesce("gross", F.lit(0)).cast("decimal(20,3)")
    r = F.coalesce("refunds", F.lit(0)).cast("decimal(20,3)")
    return out.select("seg", g.cast("double").alias("gross"), r.cast("double").alias("refunds"),
                      (g - r).cast("double").alias("net_revenue"))


def redistribute_unassigned(lines: DataFrame, returns: DataFrame, segf: DataFrame, seg: str = "seg") -> DataFrame:
    """Net revenue of buyers without a segment spread over segments pro rata (G7). Lines and returns are added up per
    customer before anything is joined."""
    lines = lines.groupBy("customer_id").agg(F.sum("net_amount").alias("net_amount"))
    returns = returns.groupBy("customer_id").agg(F.sum("refund_amount").alias("refund_amount"))
    base = segment_net_revenue(lines, returns, segf, seg)
    un_cust = lines.join(seg_map(segf, seg), "customer_id", "left_anti")
    ug = un_cust.agg(F.sum("net_amount").alias("ug"))
    ur = returns.join(un_cust.select("customer_id"), "customer_id", "left_semi").agg(F.sum("refund_amount").alias("ur"))
    u = ug.crossJoin(ur).select((F.coalesce("ug", F.lit(0)) - F.coalesce("ur", F.lit(0))).cast("double").alias("u"))
    tot = F.sum("net_revenue").over(Window.partitionBy())
    x = base.crossJoin(F.broadcast(u)).withColumn("_tot", tot)
    adj = F.when((F.col("_tot") > 0) & (F.col("u") != 0),
                 F.col("net_revenue") + F.col("u") * (F.col("net_revenue") / F.col("_tot"))).otherwise(F.col("net_revenue"))
    return x.select("seg", adj.alias("net_revenue"))


def scale_to_total(seg_rev: DataFrame, total: DataFrame, value: str = "net_revenue",
                   total_col: str = "total_revenue") -> DataFrame:
    """Segment values rounded to cents, then rescaled so they sum to an authoritative total
    (when it is positive), rounded to cents again (G8)."""
    x = seg_rev.withColumn("_v", F.round(F.col(value), 2)) \
        .crossJoin(F.broadcast(total.select(F.col(total_col).cast("double").alias("_t"))))
    s = F.sum("_v").over(Window.partitionBy())
    scale = F.col("_t") / F.when(s != 0, s).otherwise(F.lit(1.0))
    return x.select("seg", F.when(F.col("_t") > 0, F.round(F.col("_v") * scale, 2)).otherwise(F.col("_v")).alias("revenue"),
                    F.col("_t").alias("target_total"))


def fix_rounding_drift(seg_rev: DataFrame) -> DataFrame:
    """Put the cent difference between the target total and Σ segments on the largest segment."""
    w_all = Window.partitionBy()
    x = seg_rev.withColumn("_diff", F.round(F.round(F.col("target_total"), 2) - F.sum("revenue").over(w_all), 2)) \
        .withColumn("_rk", F.row_number().over(Window.partitionBy().orderBy(F.desc("revenue"), F.asc("seg"))))
    return x.select("seg", F.when(F.col("_rk") == 1, F.round(F.col("revenue") + F.col("_diff"), 2))
                    .otherwise(F.col("revenue")).alias("revenue"))


def segment_revenue(lines: DataFrame, returns: DataFrame, segf: DataFrame, total: DataFrame | None = None,
                    seg: str = "seg") -> DataFrame:
    """G6 -> G7 -> (G8 if an authoritative total is given) -> G9."""
    r = redistribute_unassigned(lines, returns, segf, seg)
    if total is None:
        total = r.agg(F.sum("net_revenue").alias("total_revenue"))
    return fix_rounding_drift(scale_to_total(r, total))


def segment_actions(spark, segf: DataFrame, seg: str = "seg") -> DataFrame:
    """Recommended actions per segment id joined to each segment's audience size."""
    rows = [(sid, i + 1, a) for sid, acts in FX.SEGMENT_ACTIONS.items() for i, a in enumerate(acts)]
    acts = spark.createDataFrame(rows, "seg int, action_rank int, action string")
    return acts.join(segment_counts(segf, seg).select("seg", "customers"), "seg")
