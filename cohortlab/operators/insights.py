"""Derived analytics (D1-D31): ratios, ranks and classes over the segment / KPI aggregates.

Each operator takes the *big-table* aggregate it needs (segment profile G2, monthly revenue K4,
category shares G5, ...) as a DataFrame and adds the ratio / rank / class step in the same plan;
the inputs are small (segments x metrics, months), so windows over the whole input are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX


def _all():
    return Window.partitionBy()


def _long(profile: DataFrame, metrics: list[str]) -> DataFrame:
    """(seg, n, metric, value) from the wide segment profile."""
    stack = "stack({}, {}) AS (metric, value)".format(len(metrics), ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics))
    return profile.select("seg", "n", F.expr(stack))


# D1 ---------------------------------------------------------------------------------------
def segment_share(profile: DataFrame, seg_revenue: DataFrame) -> DataFrame:
    """Customer % and revenue % per segment."""
    x = profile.select("seg", "n").join(seg_revenue.select("seg", "revenue"), "seg", "left")
    return x.select("seg", (F.col("n") * 100.0 / F.sum("n").over(_all())).alias("customers_pct"),
                    (F.col("revenue") * 100.0 / F.sum("revenue").over(_all())).alias("revenue_pct"))


# D2 / D3 ----------------------------------------------------------------------------------
def category_share(category_revenue: DataFrame, top: int = 8) -> DataFrame:
    """Category revenue % of the total, top ``top`` by revenue."""
    x = category_revenue.withColumn("pct", F.col("revenue") * 100.0 / F.sum("revenue").over(_all()))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("category")))) \
        .filter(F.col("rank") <= top)


def channel_share(lines: DataFrame) -> DataFrame:
    """Line % per channel and bar length relative to the largest channel."""
    c = lines.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return c.select("channel", "n", (F.col("n") * 100.0 / F.sum("n").over(_all())).alias("pct"),
                    (F.col("n") * 100.0 / F.max("n").over(_all())).alias("bar_pct"))


# D4 / D5 / D6 -----------------------------------------------------------------------------
WEIGHTED = ["avg_recency", "avg_active_months", "avg_ipt", "avg_projected_annual", "avg_lifespan", "avg_net_revenue",
            "avg_discount", "avg_aov", "avg_sp365", "avg_sp90", "avg_ord30", "avg_ord90"]


def weighted_means(profile: DataFrame, metrics: list[str] = WEIGHTED) -> DataFrame:
    """Customer-weighted mean over segments: Σ(x·n)/Σn per metric (lifespan also in months)."""
    lg = _long(profile, metrics)
    out = lg.groupBy("metric").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    months = out.filter(F.col("metric") == "avg_lifespan").select(F.lit("avg_lifespan_months").alias("metric"),
                                                                  (F.col("value") / 30.0).alias("value"))
    return out.unionByName(months)


def unweighted_segment_means(profile: DataFrame,
                             metrics: list[str] = ("avg_return_rate", "avg_refund_ratio", "avg_diversity")) -> DataFrame:
    """Plain mean over segments."""
    return _long(profile, list(metrics)).groupBy("metric").agg(F.avg("value").alias("value"))


# (metric, lower_is_better)
BEST_METRICS = [("avg_orders", False), ("avg_spend_velocity", False), ("clv_growing_pct", False), ("avg_spend", False),
                ("avg_ipt", True), ("avg_projected_annual", False), ("avg_lifespan", False), ("avg_net_revenue", False),
                ("avg_aov", False)]


def best_segment(profile: DataFrame, metrics=BEST_METRICS) -> DataFrame:
    """Arg-best segment per metric (ties -> lowest seg); ipt only over segments with ipt > 0.
    Also the worst-AOV segment."""
    parts = []
    for m, low in metrics:
        p = profile.filter(F.col(m) > 0) if m == "avg_ipt" else profile
        o = F.asc(m) if low else F.desc(m)
        r = p.withColumn("_r", F.row_number().over(Window.orderBy(o, F.asc("seg")))).filter("_r = 1")
        parts.append(r.select(F.lit(m).alias("metric"), F.lit("best").alias("kind"), "seg", F.col(m).cast("double").alias("value")))
    w = profile.withColumn("_r", F.row_number().over(Window.orderBy(F.asc("avg_aov"), F.asc("seg")))).filter("_r = 1")
    parts.append(w.select(F.lit("avg_aov").alias("metric"), F.lit("worst").alias("kind"), "seg",
                          F.col("avg_aov").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


# D7 / D10 / D11 / D12 / D13 / D14 (month series) -------------------------------------------
def _pos(monthly: DataFrame) -> DataFrame:
    return monthly.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ym")))) \
        .withColumn("n_months", F.count(F.lit(1)).over(_all()))


def aov_trend(monthly_aov: DataFrame) -> DataFrame:
    """Mean AOV of the last 3 months vs the 3 before, in % (needs 6 months; 0 when the base is 0)."""
    p = _pos(monthly_aov).agg(F.max("n_months").alias("n"),
                              (F.sum(F.when(F.col("pos") <= 3, F.col("aov"))) / 3.0).alias("curr3"),
                              (F.sum(F.when((F.col("pos") > 3) & (F.col("pos") <= 6), F.col("aov"))) / 3.0).alias("prev3"))
    pct = F.when(F.col("prev3") > 0, (F.col("curr3") - F.col("prev3")) / F.col("prev3") * 100.0).otherwise(F.lit(0.0))
    return p.select("curr3", "prev3", F.when(F.col("n") >= 6, pct).alias("aov_trend_pct"))


def half_year_trend(monthly_revenue: DataFrame) -> DataFrame:
    """Last 6 vs previous 6 months of revenue, in % (needs 12 months)."""
    p = _pos(monthly_revenue).agg(F.max("n_months").alias("n"),
                                  F.sum(F.when(F.col("pos") <= 6, F.col("revenue"))).alias("curr6"),
                                  F.sum(F.when((F.col("pos") > 6) & (F.col("pos") <= 12), F.col("revenue"))).alias("prev6"))
    return p.select("curr6", "prev6", F.when((F.col("n") >= 12) & (F.col("prev6") != 0),
                                             (F.col("curr6") - F.col("prev6")) / F.col("prev6") * 100.0).alias("half_year_pct"))


def current_vs_peak_month(monthly_revenue: DataFrame) -> DataFrame:
    """Latest month's revenue as % of the best month."""
    return monthly_revenue.agg(F.max_by("revenue", "ym").alias("current"), F.max("revenue").alias("peak")) \
        .select("current", "peak", F.when(F.col("peak") > 0, F.col("current") / F.col("peak") * 100.0).otherwise(F.lit(0.0))
                .alias("current_pct_of_peak"))


def whole(x) -> F.Column:
    """Rounded to a whole number, halves up."""
    return F.floor(x + 0.5)


def monthly_yoy_delta(monthly_revenue: DataFrame, last: int = 12) -> DataFrame:
    """Whole % change of each of the last ``last`` months vs the month 12 positions earlier; 0 when that
    had no revenue. No rows below 24 months of history."""
    w = Window.orderBy("ym")
    x = _pos(monthly_revenue.withColumn("prev", F.lag("revenue", 12).over(w))).filter((F.col("pos") <= last) & (F.col("n_months") >= 24))
    delta = F.when(F.col("prev") > 0, whole((F.col("revenue") - F.col("prev")) / F.col("prev") * 100.0)).otherwise(F.lit(0))
    return x.select("ym", "revenue", "prev", delta.cast("long").alias("yoy_delta_pct"))


def quarter_share(monthly_revenue: DataFrame) -> DataFrame:
    """Last 12 present months by calendar quarter, all of Q1 to Q4: revenue, whole % of all, and the best quarter
    (the first with the largest %). No rows without any month."""
    x = _pos(monthly_revenue).filter(F.col("pos") <= 12)
    number = ((F.substring("ym", 6, 2).cast("int") - 1) / 3 + 1).cast("int")
    q = x.agg(F.count(F.lit(1)).alias("k"), *[F.coalesce(F.sum(F.when(number == i, F.col("revenue"))), F.lit(0.0)).alias(f"Q{i}") for i in range(1, 5)])
    q = q.filter("k > 0").select(F.expr("stack(4, 'Q1', Q1, 'Q2', Q2, 'Q3', Q3, 'Q4', Q4) AS (quarter, revenue)"))
    total = F.sum("revenue").over(_all())
    q = q.withColumn("pct", whole(F.col("revenue") / F.when(total != 0, total).otherwise(F.lit(1.0)) * 100.0).cast("long"))
    return q.withColumn("is_best", F.row_number().over(Window.orderBy(F.desc("pct"), F.asc("quarter"))) == 1)


def peak_month(monthly_revenue: DataFrame) -> DataFrame:
    """Best month, first and last month, number of months."""
    best = monthly_revenue.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("ym")))).filter("_r = 1")
    rng = monthly_revenue.agg(F.min("ym").alias("first_month"), F.max("ym").alias("last_month"),
                              F.count(F.lit(1)).alias("n_months"))
    return best.select(F.col("ym").alias("peak_month"), F.col("revenue").alias("peak_revenue")).crossJoin(rng)


def recent_months(monthly_revenue: DataFrame, n: int = 14) -> DataFrame:
    """The last ``n`` present months of the revenue series."""
    return monthly_revenue.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ym")))).filter(F.col("pos") <= n)


# D15 / D16 --------------------------------------------------------------------------------
def segment_peak_trough(seg_monthly: DataFrame) -> DataFrame:
    """Per segment: best month and the lowest month with positive spend."""
    best = seg_monthly.withColumn("_r", F.row_number().over(Window.partitionBy("seg").orderBy(F.desc("avg_spend"), F.asc("ym")))) \
        .filter("_r = 1").select("seg", F.col("ym").alias("peak_month"), F.col("avg_spend").alias("peak_value"))
    low = seg_monthly.filter(F.col("avg_spend") > 0) \
        .withColumn("_r", F.row_number().over(Window.partitionBy("seg").orderBy(F.asc("avg_spend"), F.asc("ym")))) \
        .filter("_r = 1").select("seg", F.col("ym").alias("trough_month"), F.col("avg_spend").alias("trough_value"))
    return best.join(low, "seg", "left")


def seasonality_class(seg_monthly: DataFrame) -> DataFrame:
    """Population CV of positive months: < .3 Stable, < .6 Moderate, else High var.; < 2 months -> null."""
    s = seg_monthly.filter(F.col("avg_spend") > 0).groupBy("seg").agg(
        F.count(F.lit(1)).alias("months"), F.avg("avg_spend").alias("m"), F.stddev_pop("avg_spend").alias("sd"))
    cv = F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(F.lit(0.0))
    return s.select("seg", cv.alias("cv"), F.when(F.col("months") < 2, F.lit(None))
                    .when(cv < 0.3, F.lit("Stable")).when(cv < 0.6, F.lit("Moderate")).otherwise(F.lit("High var."))
                    .alias("seasonality"))


# D17 --------------------------------------------------------------------------------------
Z_METRICS = ["avg_recency", "avg_orders", "avg_spend", "avg_aov", "avg_return_rate"]


def segment_zscores(profile: DataFrame, metrics: list[str] = Z_METRICS) -> DataFrame:
    """Population z-score of each metric across segments (sd 0 -> 1) and its heat band."""
    lg = _long(profile, metrics)
    w = Window.partitionBy("metric")
    sd = F.stddev_pop("value").over(w)
    z = (F.col("value") - F.avg("value").over(w)) / F.when(sd > 0, sd).otherwise(F.lit(1.0))
    x = lg.withColumn("z", z)
    band = F.when(F.col("z") > 0.6, F.lit("very_high")).when(F.col("z") > 0.2, F.lit("high")) \
        .when(F.col("z") < -0.6, F.lit("very_low")).when(F.col("z") < -0.2, F.lit("low")).otherwise(F.lit("neutral"))
    return x.select("seg", "metric", "z", band.alias("band"))


# D18 / D19 / D20 / D21 / D27 (category affinity) ------------------------------------------
def diversity_class(profile: DataFrame) -> DataFrame:
    pct = whole(F.col("avg_diversity") * 100.0).cast("long")      # rounded before it is classed
    return profile.select("seg", pct.alias("diversity_pct"),
                          F.when(pct >= 60, F.lit("Generalist")).when(pct >= 35, F.lit("Moderate"))
                          .otherwise(F.lit("Specialist")).alias("diversity_class"))


def segment_top_categories(cat_share: DataFrame, n: int = 3) -> DataFrame:
    """Top-n category shares per segment (shares of the top-6 total)."""
    return cat_share.filter(F.col("rank") <= n).select("seg", "rank", "category", "share")


def affinity_profile(cat_share: DataFrame) -> DataFrame:
    """Σ of the top-3 shares: >= 85 Specialist, >= 65 Focused, else Diverse."""
    t = segment_top_categories(cat_share, 3).groupBy("seg").agg(F.sum("share").alias("top3_share"))
    return t.select("seg", "top3_share", F.when(F.col("top3_share") >= 85, F.lit("Specialist"))
                    .when(F.col("top3_share") >= 65, F.lit("Focused")).otherwise(F.lit("Diverse")).alias("affinity"))


def segment_category_matrix(cat_share: DataFrame) -> DataFrame:
    """Category x segment share (missing = 0), mean over segments, intensity = share / best
    segment's share, and the category order by total share."""
    rng = cat_share.agg(F.min("seg").alias("_lo"), F.max("seg").alias("_hi"))      # 1 row
    grid = cat_share.select("category").distinct().join(F.broadcast(rng), how="inner") \
        .select("category", F.explode(F.sequence("_lo", "_hi")).alias("seg"))     # segment ids 0..K-1
    m = grid.join(cat_share.select("seg", "category", "share"), ["seg", "category"], "left").fillna(0.0, ["share"])
    w = Window.partitionBy("category")
    mx = F.max("share").over(w)
    return m.select("category", "seg", "share", F.avg("share").over(w).alias("mean_share"),
                    F.when(mx > 0, F.col("share") / mx).otherwise(F.lit(0.0)).alias("intensity"),
                    F.sum("share").over(w).alias("total_share"))


def dominant_category(cat_share: DataFrame) -> DataFrame:
    """Category with the largest sum of shares over segments."""
    t = cat_share.groupBy("category").agg(F.sum("share").alias("total_share"))
    return t.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("total_share"), F.asc("category")))) \
        .filter("_r = 1").drop("_r")


# D22 / D23 / D24 / D26 / D30 (segment value) ----------------------------------------------
def spend_band_share(bands: DataFrame, profile: DataFrame) -> DataFrame:
    """Customers and whole % per spend band. When the bands count nobody, each segment's customers go to the band of
    its mean spend (``profile``: seg, n, avg_spend)."""
    spend = F.coalesce(F.col("avg_spend"), F.lit(0.0))
    lo, hi = FX.SPEND_BANDS
    named = F.when(spend >= hi, F.lit("high")).when(spend >= lo, F.lit("mid")).otherwise(F.lit("low"))
    by_mean = profile.groupBy(named.alias("band")).agg(F.sum("n").cast("long").alias("_by_mean"))
    x = bands.join(by_mean, "band", "left").withColumn("_counted", F.sum("n").over(_all()))
    x = x.select("band", F.when(F.col("_counted") > 0, F.col("n")).otherwise(F.coalesce("_by_mean", F.lit(0))).cast("long").alias("n"))
    total = F.greatest(F.sum("n").over(_all()), F.lit(1))
    return x.select("band", "n", whole(F.col("n") / total * 100.0).cast("long").alias("pct"))


def net_aov(profile: DataFrame) -> DataFrame:
    """AOV after discount and discount cost per order; whole % bars of AOV, net AOV and discount relative to the largest
    segment's (a largest value of 0 counts as 1)."""
    aov, discount = F.coalesce(F.col("avg_aov"), F.lit(0.0)), F.coalesce(F.col("avg_discount"), F.lit(0.0))
    x = profile.select("seg", aov.alias("aov"), discount.alias("discount"), (aov * (F.lit(1.0) - discount)).alias("net_aov"),
                       (aov * discount).alias("discount_cost"))

    def bar(c):
        top = F.max(c).over(_all())
        return whole(F.col(c) / F.when(top == 0, F.lit(1.0)).otherwise(top) * 100.0).cast("long")

    return x.select("seg", "net_aov", "discount_cost", bar("aov").alias("aov_bar"), bar("net_aov").alias("net_aov_bar"),
                    bar("discount").alias("discount_bar"))


def discount_efficiency(profile: DataFrame) -> DataFrame:
    d = F.col("avg_discount")
    return profile.select("seg", "avg_discount", F.when(d < 0.05, F.lit("Efficient")).when(d < 0.15, F.lit("Moderate"))
                          .otherwise(F.lit("Costly")).alias("discount_efficiency"))


def segment_kpis(profile: DataFrame) -> DataFrame:
    """AOV as a ratio of means and companion KPIs per segment."""
    return profile.select("seg", "n", "avg_spend", "avg_orders",
                          F.when(F.col("avg_orders") > 0, F.col("avg_spend") / F.col("avg_orders")).otherwise(F.lit(0.0)).alias("aov"),
                          "avg_recency", "avg_return_rate", "avg_clv_slope")


def relative_bars(profile: DataFrame, overall_aov: DataFrame) -> DataFrame:
    """One row of whole bar percentages, 100 at most: mean recency and shortest gap inverted against the
    longest, spread of orders, mean active months, overall AOV against the best segment, spread of spend."""
    best = lambda c: F.when(F.max(c) != 0, F.max(c)).otherwise(F.lit(1.0))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    gap = F.when(F.col("avg_ipt") > 0, F.col("avg_ipt"))
    spread = F.max("avg_spend") - F.min("avg_spend")
    bars = {"recency_bar": (1 - mean("avg_recency") / best("avg_recency")) * 100.0,
            "ipt_bar": F.coalesce((1 - F.min(gap) / F.max(gap)) * 100.0, F.lit(0.0)),
            "orders_bar": (F.max("avg_orders") - F.min("avg_orders")) / best("avg_orders") * 100.0,
            "active_months_bar": mean("avg_active_months") / best("avg_active_months") * 100.0,
            "spend_bar": spread / (best("avg_spend") * 1.1 - F.min("avg_spend")) * 100.0 + 40.0}
    x = profile.agg(best("avg_aov").alias("_aov"), *[v.alias(k) for k, v in bars.items()])
    x = x.crossJoin(F.broadcast(overall_aov.select(F.col("true_aov").alias("_overall")))).withColumn("aov_bar", F.col("_overall") / F.col("_aov") * 100.0)
    return x.select(*[F.least(whole(F.col(c)), F.lit(100)).cast("long").alias(c) for c in (*bars, "aov_bar")])


# D8 / D9 ----------------------------------------------------------------------------------
def annual_spend_momentum(profile: DataFrame) -> DataFrame:
    """4 x weighted spend_90 vs weighted spend_365, in %."""
    a = profile.agg((F.sum(F.col("avg_sp365") * F.col("n")) / F.sum("n")).alias("annual"),
                    (F.sum(F.col("avg_sp90") * F.col("n")) / F.sum("n")).alias("sp90"))
    return a.select("annual", (F.col("sp90") * 4.0).alias("annualised_sp90"),
                    F.when(F.col("annual") > 0, (F.col("sp90") * 4.0 - F.col("annual")) / F.col("annual") * 100.0)
                    .alias("annual_trend_pct"))


def order_momentum(profile: DataFrame) -> DataFrame:
    """3 x weighted orders_30 vs weighted orders_90, in %."""
    a = profile.agg((F.sum(F.col("avg_ord30") * F.col("n")) / F.sum("n") * 3.0).alias("annualised_ord30"),
                    (F.sum(F.col("avg_ord90") * F.col("n")) / F.sum("n")).alias("ord90"))
    return a.select("annualised_ord30", "ord90", F.when(F.col("ord90") > 0,
                    (F.col("annualised_ord30") - F.col("ord90")) / F.col("ord90") * 100.0).alias("order_trend_pct"))


# D25 / D28 / D29 / D31 --------------------------------------------------------------------
def return_status_share(returns: DataFrame) -> DataFrame:
    a = returns.agg(F.count(F.lit(1)).alias("n"),
                    F.sum((F.col("return_status") == "Returned").cast("int")).alias("returned"),
                    F.sum((F.col("return_status") == "Canceled").cast("int")).alias("canceled"))
    return a.select(F.when(F.col("n") > 0, F.col("returned") * 100.0 / F.col("n")).otherwise(F.lit(0.0)).alias("returned_pct"),
                    F.when(F.col("n") > 0, F.col("canceled") * 100.0 / F.col("n")).otherwise(F.lit(0.0)).alias("canceled_pct"))


def report_ratios(summary: DataFrame) -> DataFrame:
    """Active share, fulfilled share and true-AOV vs gross AOV, each capped at 100."""
    gross_aov = F.when(F.col("total_orders") > 0, F.col("gross_revenue") / F.col("total_orders"))
    return summary.select(
        F.least(F.lit(100.0), F.col("active_customers_90") * 100.0 / F.col("total_customers")).alias("active_pct"),
        F.least(F.lit(100.0), F.col("fulfilled_orders") * 100.0 / F.col("total_orders")).alias("fulfilled_pct"),
        F.least(F.lit(100.0), F.col("true_aov") * 100.0 / gross_aov).alias("true_aov_pct"))


def aov_proxy_series(monthly_revenue: DataFrame, summary: DataFrame, total: DataFrame) -> DataFrame:
    """Month revenue / authoritative total revenue x true AOV (a total of 0 counts as 1)."""
    tot = total.select(F.when(F.col("total_revenue") != 0, F.col("total_revenue")).otherwise(F.lit(1.0)).alias("_tot"))
    return monthly_revenue.crossJoin(F.broadcast(tot)).crossJoin(F.broadcast(summary.select("true_aov"))) \
        .select("ym", (F.col("revenue") / F.col("_tot") * F.col("true_aov")).alias("aov_proxy"))


def rev_share_scaled(seg_revenue: DataFrame, total: DataFrame) -> DataFrame:
    """Segment revenue scaled so that all segments make the authoritative total, and its whole % of that."""
    part = F.col("revenue") / F.when(F.sum("revenue").over(_all()) != 0, F.sum("revenue").over(_all())).otherwise(F.lit(1.0))
    return seg_revenue.crossJoin(F.broadcast(total.select("total_revenue"))) \
        .select("seg", (part * F.col("total_revenue")).alias("scaled_revenue"), whole(part * 100.0).cast("long").alias("revenue_share_pct"))
