"""Per-customer features.

Plan shape (all keyed on ``customer_id``, all skew-safe):
  * one global ``max(order_date)`` -> a 1-row frame joined by broadcast (no collect);
  * order grain  : lines -> (customer, order) partial aggregate -> customer aggregate. Month,
                   day and channel facts are order attributes, so they derive from this
                   small order-grain frame instead of re-reading lines;
  * category grain and product grain: lines -> (customer, X) counts -> customer aggregate;
  * returns      : pre-aggregated per customer before the join.
Every first-level aggregate is partial (map-side combine), so a customer holding a third of all
lines is reduced before it reaches a single reducer, and no group is ever collected.
Money is summed as DECIMAL (exact, order-independent) and exposed as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.functions.columns import div_or_zero, floor_days, month_index
from cohortlab.operators.cleaning import coerce_lines, drop_ghost_customers
from cohortlab.session import materialize

WINDOWS = [(30, "30"), (90, "90"), (365, "365")]


def reference_date(lines: DataFrame) -> DataFrame:
    """Rolling windows anchor on the data: one row ``ref_date = max(order_date)``."""
    return lines.agg(F.max("order_date").alias("ref_date"))


def with_ref_date(df: DataFrame, ref: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(ref))


def prepared_lines(lines: DataFrame) -> DataFrame:
    return coerce_lines(drop_ghost_customers(lines))


class needs:  # noqa: N801
    """What a choice of features (all by default) needs: branches, line columns and how often the
    lines and the order grain are read."""

    def __init__(self, columns=None):
        w = None if columns is None else set(columns)
        has = lambda *names: w is None or bool(w & set(names))
        self.windows = has("spend_30", "spend_90", "spend_365", "orders_30", "orders_90", "orders_365", "spend_momentum")
        self.ref = self.windows or has("recency")
        self.slope = has("active_months", "clv_slope", "spend_velocity", "projected_annual_value")
        self.categories = has("unique_cats", "top_cat", "diversity")
        self.products = has("unique_prods")
        self.channels = has("top_channel")
        self.gaps = has("ipt")
        self.returns = has("return_rate", "refund_ratio", "net_revenue")
        self.profile = has("gender", "region", "acquisition_channel", "phone")
        self.line_columns = ["customer_id", "order_id", "order_date", "net_amount", "discount_pct", *["channel"] * self.channels,
                             *["category"] * self.categories, *["product_id"] * self.products]
        self.line_reads = 1 + self.ref + self.categories + self.products
        self.grain_reads = 1 + self.slope + self.channels + self.gaps


def order_grain(lines: DataFrame, ref: DataFrame | None, channel: bool = True) -> DataFrame:
    """(customer, order) facts, with window flags where there is a reference date; the only order-grain
    pass over lines. Without the ``channel``, a text, the lines are aggregated by hash and not sorted."""
    x = lines if ref is None else with_ref_date(lines, ref)
    aggs = [F.sum("net_amount").alias("o_net"),
            F.count(F.lit(1)).alias("o_lines"),
            F.sum(F.col("discount_pct").cast("decimal(12,2)")).alias("o_disc"),
            F.min("order_date").alias("o_first"),
            F.max("order_date").alias("o_last"),
            *[F.min(c).alias(c) for c in ["channel"] if channel]]
    for days, sfx in WINDOWS if ref is not None else []:
        inwin = F.col("order_date") >= F.col("ref_date") - F.make_dt_interval(F.lit(days))
        aggs.append(F.sum(F.when(inwin, F.col("net_amount"))).alias(f"o_spend_{sfx}"))
        aggs.append(F.max(inwin.cast("int")).alias(f"o_in_{sfx}"))
    return x.groupBy("customer_id", "order_id").agg(*aggs)


def clv_slope_frame(orders: DataFrame) -> DataFrame:
    """Least-squares slope of monthly spend on month number (F14) and active months.

    Closed form over exact sums: slope = (nΣxy − ΣxΣy) / (nΣx² − (Σx)²); the slope is
    invariant to shifting x, so x = months since January 2000 keeps the exact
    integer sums small. Fewer than two months -> 0. One (customer, month) row per active
    month, then one customer aggregate.
    """
    m = orders.groupBy("customer_id", month_index("o_first").alias("mi")) \
        .agg(F.sum("o_net").alias("y"))
    m = m.withColumn("mi", F.col("mi") - month_index(F.lit("2000-01-01").cast("timestamp")))
    d38 = "decimal(38,0)"
    y = (F.col("y") * 1000).cast(d38)        # exact: net has 3 decimals
    x = F.col("mi").cast(d38)
    s = m.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("active_months"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    n = F.col("active_months").cast(d38)
    num = n * F.col("sxy") - F.col("sx") * F.col("sy")
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("active_months") >= 2) & (den != 0),
                   num.cast("double") / (den.cast("double") * F.lit(1000.0))).otherwise(F.lit(0.0))
    return s.select("customer_id", "active_months", slope.alias("clv_slope"))


def inter_purchase_time(orders: DataFrame) -> DataFrame:
    """Mean floor-day gap between consecutive lines of a customer (F21); < 2 lines -> null.

    Gaps inside one calendar day floor to 0 days, so only the gap between the last line of an
    active day and the first line of the next active day can count. The lag runs over one row
    per (customer, active day) — bounded by the calendar, not by the customer's volume.
    """
    days = orders.groupBy("customer_id", F.to_date("o_first").alias("day")) \
        .agg(F.sum("o_lines").alias("n"), F.min("o_first").alias("t0"), F.max("o_last").alias("t1"))
    w = Window.partitionBy("customer_id").orderBy("day")
    gaps = days.withColumn("gap", floor_days(F.col("t0"), F.lag("t1").over(w)))
    return gaps.groupBy("customer_id").agg(
        F.when(F.sum("n") >= 2, F.coalesce(F.sum("gap"), F.lit(0)) / (F.sum("n") - 1)).alias("ipt"))


def top_per_customer(lines: DataFrame, value: str, distinct_name: str, top_name: str | None,
                     weight: str | None = None) -> DataFrame:
    """Distinct count of ``value`` per customer and its most frequent value (ties -> smallest)."""
    cnt = F.sum(weight) if weight else F.count(F.lit(1))
    c = lines.groupBy("customer_id", value).agg(cnt.alias("_n"))
    aggs = [F.count(F.col(value)).alias(distinct_name)]
    if top_name:
        known = F.when(F.col(value).isNotNull(), F.struct(-F.col("_n"), F.col(value)))   # a null never wins
        aggs.append(F.min_by(F.col(value), known).alias(top_name))
    return c.groupBy("customer_id").agg(*aggs)


def returns_per_customer(returns: DataFrame) -> DataFrame:
    return returns.groupBy("customer_id").agg(F.count(F.lit(1)).alias("ret_cnt"),
                                              F.sum("refund_amount").alias("ret_amt"))


def customer_features(lines: DataFrame, returns: DataFrame, customers: DataFrame | None = None,
                      ref: DataFrame | None = None, keep_order_grain: bool = True,
                      columns: list[str] | None = None, zero_fill: bool = False) -> DataFrame:
    """One row per buying customer with F1-F21 (F22), or only ``columns`` of them, built from the
    branches that these need. ``zero_fill`` gives 0 for a spend momentum that is undefined.

    ``keep_order_grain`` writes the (customer, order) frame once to the shared checkpoint folder:
    four branches (totals, slope, channel, gaps) read it, and it is several times smaller than
    the lines."""
    need = needs(columns)
    lines = prepared_lines(lines)
    ref = (ref if ref is not None else reference_date(lines)) if need.ref else None
    o = order_grain(lines, ref if need.windows else None, need.channels)
    if keep_order_grain:
        o = materialize(o, "order_grain")
    base = o.groupBy("customer_id").agg(
        F.sum("o_net").alias("_spend"),
        F.count(F.lit(1)).alias("order_count"),
        F.sum("o_lines").alias("_lines"),
        F.sum("o_disc").alias("_disc"),
        F.min("o_first").alias("_first"),
        F.max("o_last").alias("_last"),
        *[F.sum(f"o_spend_{s}").alias(f"_sp{s}") for _, s in WINDOWS if need.windows],
        *[F.sum(f"o_in_{s}").alias(f"orders_{s}") for _, s in WINDOWS if need.windows],
    )
    branches = [(need.slope, lambda: clv_slope_frame(o)),
                (need.categories, lambda: top_per_customer(lines, "category", "unique_cats", "top_cat")),
                (need.products, lambda: top_per_customer(lines, "product_id", "unique_prods", None)),
                (need.channels, lambda: top_per_customer(o, "channel", "_n_channels", "top_channel", weight="o_lines")),
                (need.gaps, lambda: inter_purchase_time(o)),
                (need.returns, lambda: returns_per_customer(returns))]
    feat = base
    for wanted, branch in branches:
        if wanted:
            feat = feat.join(branch(), "customer_id", "left")
    if need.ref:
        feat = with_ref_date(feat, ref)
    have = set(feat.columns)
    for missing in {"active_months", "clv_slope", "unique_cats", "top_cat", "unique_prods", "top_channel", "ipt", "ret_cnt", "ret_amt",
                    "ref_date", *[f"_sp{s}" for _, s in WINDOWS], *[f"orders_{s}" for _, s in WINDOWS]} - have:
        feat = feat.withColumn(missing, F.lit(None).cast("timestamp" if missing == "ref_date" else "string" if missing.startswith("top") else "double"))
    spend = F.col("_spend").cast("double")
    sp = {s: F.coalesce(F.col(f"_sp{s}"), F.lit(0)).cast("double") for _, s in WINDOWS}
    old = F.coalesce(F.col("_sp365"), F.lit(0)) - F.coalesce(F.col("_sp90"), F.lit(0))
    recent_minus_old = F.coalesce(F.col("_sp90"), F.lit(0)) - old
    momentum = F.when(old != 0, recent_minus_old.cast("double") / old.cast("double")) \
        .when(recent_minus_old == 0, F.lit(0.0)).otherwise(F.lit(0.0 if zero_fill else None).cast("double"))
    refund_ratio = div_or_zero(F.coalesce(F.col("ret_amt"), F.lit(0)).cast("double"), spend)
    velocity = div_or_zero(spend, F.col("active_months"))
    out = feat.select(
        "customer_id",
        spend.alias("total_spend"),
        F.col("order_count").cast("long").alias("order_count"),
        floor_days(F.col("ref_date"), F.col("_last")).alias("recency"),
        div_or_zero(spend, F.col("order_count")).alias("aov"),
        ((F.col("_disc").cast("double") / F.col("_lines")) / F.lit(100.0)).alias("avg_discount"),
        F.col("unique_cats").cast("long").alias("unique_cats"),
        F.col("unique_prods").cast("long").alias("unique_prods"),
        F.col("active_months").cast("long").alias("active_months"),
        sp["30"].alias("spend_30"), sp["90"].alias("spend_90"), sp["365"].alias("spend_365"),
        *[F.col(f"orders_{s}").cast("long").alias(f"orders_{s}") for _, s in WINDOWS],
        div_or_zero(F.coalesce(F.col("ret_cnt"), F.lit(0)), F.col("order_count")).alias("return_rate"),
        refund_ratio.alias("refund_ratio"),
        div_or_zero(F.col("unique_cats"), F.col("order_count")).alias("diversity"),
        velocity.alias("spend_velocity"),
        F.col("clv_slope"),
        floor_days(F.col("_last"), F.col("_first")).alias("lifespan"),
        momentum.alias("spend_momentum"),
        (spend * (F.lit(1.0) - refund_ratio)).alias("net_revenue"),
        (velocity * F.lit(12.0)).alias("projected_annual_value"),
        "top_cat", "top_channel",
        F.col("ipt").cast("double").alias("ipt"),
    )
    if customers is not None:
        out = customer_profile(out, customers)
    return out if columns is None else out.select("customer_id", *columns)


def customer_profile(feat: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join of the customer attributes with defaults."""
    c = customers.select("customer_id", "gender", "region", "acquisition_channel", "phone")
    return feat.join(c, "customer_id", "left") \
        .withColumn("gender", F.coalesce("gender", F.lit(FX.DEFAULT_GENDER))) \
        .withColumn("region", F.coalesce("region", F.lit(FX.DEFAULT_REGION))) \
        .withColumn("acquisition_channel", F.coalesce("acquisition_channel", F.lit(FX.DEFAULT_ACQUISITION)))
