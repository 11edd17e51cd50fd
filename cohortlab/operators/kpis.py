"""Global KPIs (K1-K20). Inputs: feature-ready order lines, returns, features, customers.

Every KPI is a global or low-cardinality aggregate (months, quarters, categories, bands), so
results are small; the work is one partial aggregate over the big input each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.functions.columns import quarter_label, year_month
from cohortlab.functions.frames import top_n_per_group
from cohortlab.operators.features import with_ref_date


def _all():
    """Window over the whole (small: months, bands, segments) result."""
    return Window.partitionBy()


def revenue_totals(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Gross sales, refunds, net, distinct orders, returns (K1)."""
    g = lines.agg(F.coalesce(F.sum("net_amount"), F.lit(0)).alias("_g"),
                  F.count_distinct("order_id").alias("total_orders"))
    r = returns.agg(F.coalesce(F.sum("refund_amount"), F.lit(0)).alias("_r"), F.count(F.lit(1)).alias("total_returns"))
    return g.crossJoin(r).select(
        F.col("_g").cast("double").alias("gross_revenue"), F.col("_r").cast("double").alias("total_refund_amount"),
        (F.col("_g") - F.col("_r")).cast("double").alias("net_revenue"), "total_orders", "total_returns")


def fulfilled_lines(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Lines whose order is not a return (anti join on order id = return id)."""
    return lines.join(returns.select(F.col("return_id").alias("order_id")), "order_id", "left_anti")


def fulfilled_orders(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Count and revenue of fulfilled orders, and the true AOV (K2, K3)."""
    f = fulfilled_lines(lines, returns).agg(F.count_distinct("order_id").alias("fulfilled_orders"),
                                            F.coalesce(F.sum("net_amount"), F.lit(0)).alias("_rev"))
    rev = F.col("_rev").cast("double")
    return f.select("fulfilled_orders", rev.alias("fulfilled_revenue"),
                    F.when(F.col("fulfilled_orders") > 0, rev / F.col("fulfilled_orders")).otherwise(F.lit(0.0))
                    .alias("true_aov"))


def monthly_revenue(lines: DataFrame) -> DataFrame:
    """Σ net per yyyy-MM (K4)."""
    return lines.groupBy(year_month("order_date").alias("ym")).agg(F.sum("net_amount").cast("double").alias("revenue"))


def monthly_aov(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Mean fulfilled order total per month (K5)."""
    o = fulfilled_lines(lines, returns).groupBy("order_id", year_month("order_date").alias("ym")) \
        .agg(F.sum("net_amount").alias("t"))
    return o.groupBy("ym").agg((F.sum("t").cast("double") / F.count(F.lit(1))).alias("aov"))


def yoy_growth(lines: DataFrame) -> DataFrame:
    """Last 12 present months vs the 12 before (needs >= 13 months; prior only with >= 24) (K6)."""
    m = lines.groupBy(year_month("order_date").alias("ym")).agg(F.sum("net_amount").alias("rev"))
    m = m.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ym")))) \
        .withColumn("n_months", F.count(F.lit(1)).over(_all()))
    a = m.agg(F.max("n_months").alias("n"),
              F.sum(F.when(F.col("pos") <= 12, F.col("rev"))).alias("l12"),
              F.sum(F.when((F.col("pos") > 12) & (F.col("pos") <= 24), F.col("rev"))).alias("p12"))
    l12 = F.when(F.col("n") >= 13, F.col("l12")).otherwise(F.lit(0)).cast("double")
    p12 = F.when(F.col("n") >= 24, F.col("p12")).otherwise(F.lit(0)).cast("double")
    return a.select(F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_months"),
                    l12.alias("yoy_last12"), p12.alias("yoy_prev12"),
                    F.when((F.col("n") >= 13) & (p12 > 0), (l12 - p12) / p12 * 100.0).alias("yoy_pct"))


def category_revenue(lines: DataFrame) -> DataFrame:
    """Σ net per category (K7)."""
    return lines.groupBy("category").agg(F.sum("net_amount").cast("double").alias("revenue"))


def _last12(lines: DataFrame, ref: DataFrame) -> DataFrame:
    """Lines in (ref − 12 calendar months, ref]. ``ref`` is a line's own date, so some are."""
    return with_ref_date(lines, ref).filter(
        (F.col("order_date") > F.col("ref_date") - F.expr("INTERVAL 12 MONTHS")) & (F.col("order_date") <= F.col("ref_date"))) \
        .withColumn("quarter", quarter_label("order_date"))


def quarterly_top_products(lines: DataFrame, ref: DataFrame, products: DataFrame,
                           top: int = FX.TOP_PRODUCTS_PER_QUARTER) -> DataFrame:
    """Trailing-year top products per calendar quarter with their share of the quarter's revenue
    (the denominator counts every line; the ranking only products with a known name) (K8)."""
    q = _last12(lines, ref)
    qt = q.groupBy("quarter").agg(F.sum("net_amount").alias("q_total"))
    named = products.select("product_id", "name")
    pr = q.groupBy("quarter", "product_id").agg(F.sum("net_amount").alias("rev")).join(named, "product_id")
    t = top_n_per_group(pr, ["quarter"], [F.desc("rev"), F.asc("product_id")], top, "product_id") \
        .join(F.broadcast(qt), "quarter")
    qtot = F.when(F.col("q_total") != 0, F.col("q_total").cast("double")).otherwise(F.lit(1.0))
    return t.select("quarter", "rank", "product_id", "name", F.col("rev").cast("double").alias("revenue"),
                    (F.col("rev").cast("double") / qtot * 100.0).alias("share"))


def quarterly_top_categories(lines: DataFrame, ref: DataFrame, top: int = FX.TOP_PRODUCTS_PER_QUARTER) -> DataFrame:
    """Same for categories (K9)."""
    q = _last12(lines, ref)
    cr = q.groupBy("quarter", "category").agg(F.sum("net_amount").alias("rev"))
    w = Window.partitionBy("quarter").orderBy(F.desc("rev"), F.asc("category"))
    x = cr.withColumn("q_total", F.sum("rev").over(Window.partitionBy("quarter"))) \
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    qtot = F.when(F.col("q_total") != 0, F.col("q_total").cast("double")).otherwise(F.lit(1.0))
    return x.select("quarter", "rank", F.col("category").alias("name"), F.col("rev").cast("double").alias("revenue"),
                    (F.col("rev").cast("double") / qtot * 100.0).alias("share"))


def distributions(lines: DataFrame, customers: DataFrame, top_regions: int = 10) -> DataFrame:
    """Long table (dimension, value, n): line counts by channel; customers by region (top 10),
    gender and acquisition channel (K10)."""
    ch = lines.filter(F.col("channel").isNotNull()).groupBy(F.col("channel").alias("value")).count() \
        .withColumn("dimension", F.lit("channel"))
    rg = customers.filter(F.col("region").isNotNull()).groupBy(F.col("region").alias("value")).count()
    rg = rg.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("value")))) \
        .filter(F.col("_r") <= top_regions).drop("_r").withColumn("dimension", F.lit("region"))
    gd = customers.filter(F.col("gender").isNotNull()).groupBy(F.col("gender").alias("value")).count() \
        .withColumn("dimension", F.lit("gender"))
    ac = customers.filter(F.col("acquisition_channel").isNotNull()) \
        .groupBy(F.col("acquisition_channel").alias("value")).count().withColumn("dimension", F.lit("acquisition_channel"))
    return ch.unionByName(rg).unionByName(gd).unionByName(ac).select("dimension", "value", F.col("count").alias("n"))


def return_breakdown(returns: DataFrame) -> DataFrame:
    """Return counts by reason and by status."""
    a = returns.filter(F.col("return_reason").isNotNull()).groupBy(F.col("return_reason").alias("value")).count() \
        .withColumn("dimension", F.lit("reason"))
    b = returns.filter(F.col("return_status").isNotNull()).groupBy(F.col("return_status").alias("value")).count() \
        .withColumn("dimension", F.lit("status"))
    return a.unionByName(b).select("dimension", "value", F.col("count").alias("n"))


def _bands(features: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    c = F.col(col)
    a = features.agg(F.sum((c >= hi).cast("int")).alias("high"),
                     F.sum(((c >= lo) & (c < hi)).cast("int")).alias("mid"),
                     F.sum((c < lo).cast("int")).alias("low"))
    return a.select(F.expr("stack(3, 'high', high, 'mid', mid, 'low', low) AS (band, n)")) \
        .select("band", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def spend_bands(features: DataFrame) -> DataFrame:
    """Customers by total spend: >= 500 high, 100-500 mid, < 100 low."""
    return _bands(features, "total_spend", *FX.SPEND_BANDS)


def velocity_bands(features: DataFrame) -> DataFrame:
    """Customers by spend per active month: >= 100 / 30-100 / < 30."""
    return _bands(features, "spend_velocity", *FX.VELOCITY_BANDS)


def clv_growing_pct(features: DataFrame) -> DataFrame:
    """% customers whose monthly spend trend rises."""
    return features.agg((F.sum((F.col("clv_slope") > 0).cast("int")) * 100.0 / F.count(F.lit(1))).alias("clv_growing_pct"))


def activity_flags(lines: DataFrame, ref: DataFrame, days: int = FX.ACTIVE_DAYS) -> DataFrame:
    """Per customer: bought in the last ``days`` / bought before that (one pass, partial agg)."""
    x = with_ref_date(lines, ref)
    cutoff = F.col("ref_date") - F.make_dt_interval(F.lit(days))
    return x.groupBy("customer_id").agg(F.max((F.col("order_date") >= cutoff).cast("int")).alias("active"),
                                        F.max((F.col("order_date") < cutoff).cast("int")).alias("prior"))


def active_customers_90(lines: DataFrame, ref: DataFrame) -> DataFrame:
    """Distinct buyers in the last 90 days."""
    return activity_flags(lines, ref).agg(F.sum("active").cast("long").alias("active_customers_90"))


def retention_rate(lines: DataFrame, ref: DataFrame) -> DataFrame:
    """(active in last 90 d ∩ bought before) / bought before, in %."""
    a = activity_flags(lines, ref).agg(F.sum(F.col("active") * F.col("prior")).alias("retained"),
                                       F.sum("prior").alias("prior"), F.sum("active").alias("active"))
    return a.select(F.coalesce("active", F.lit(0)).cast("long").alias("active_customers_90"),
                    F.coalesce("retained", F.lit(0)).cast("long").alias("retained"),
                    F.coalesce("prior", F.lit(0)).cast("long").alias("prior_buyers"),
                    F.when(F.col("prior") > 0, F.col("retained") * 100.0 / F.col("prior")).otherwise(F.lit(0.0))
                    .alias("retention_rate"))


def overall_return_rate(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns / distinct orders."""
    t = revenue_totals(lines, returns)
    return t.select(F.when(F.col("total_orders") > 0, F.col("total_returns") / F.col("total_orders"))
                    .otherwise(F.lit(0.0)).alias("return_rate"))


def category_list(lines: DataFrame) -> DataFrame:
    """Distinct categories."""
    return lines.filter(F.col("category").isNotNull()).select("category").distinct()


def summary_sections(**sections: DataFrame) -> DataFrame:
    """The keyed parts of the summary as one table (section, key, value): each table's columns but the
    last make the key, joined by /, the last is the value (K20)."""
    parts = [df.select(F.lit(name).alias("section"), F.concat_ws("/", *[F.col(c).cast("string") for c in df.columns[:-1]]).alias("key"),
                       F.col(df.columns[-1]).cast("double").alias("value")) for name, df in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def global_summary(lines: DataFrame, returns: DataFrame, features: DataFrame, ref: DataFrame) -> DataFrame:
    """All scalar KPIs as one row (K20); the keyed KPI groups are their own tables."""
    parts = [revenue_totals(lines, returns), fulfilled_orders(lines, returns),
             yoy_growth(lines).drop("n_months"), clv_growing_pct(features), retention_rate(lines, ref),
             features.agg(F.count(F.lit(1)).alias("total_customers")),
             ref.select(F.date_format("ref_date", "yyyy-MM-dd").alias("ref_date"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.select("*", F.when(F.col("total_orders") > 0, F.col("total_returns") / F.col("total_orders"))
                      .otherwise(F.lit(0.0)).alias("return_rate"),
                      F.col("true_aov").alias("avg_order_value"))
