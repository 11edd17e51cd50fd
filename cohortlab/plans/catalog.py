"""Query catalog: one entry per operator, each a ``(spark, sf_dir) -> DataFrame``
over the given tables, with its DuckDB twin where the operator is SQL-expressible.

Label-agnostic segment operators run with the deterministic stand-in ``seg = customer_id % 4``
(``Inputs.segf``) so they can be checked against SQL; the model's own labels are exercised by
the ``kmeans_*`` / model queries (rows-only checks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions import fixed as FX
from cohortlab.operators import cleaning as C
from cohortlab.operators import kpis as K
from cohortlab.operators import profile as G
from cohortlab.plans import oracle as O
from cohortlab.plans import pipeline
from cohortlab.sources import adapters as A
from cohortlab.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_INPUTS: list[dict[str, pipeline.Inputs]] = []


def Inputs(spark: SparkSession, d: str) -> pipeline.Inputs:  # noqa: N802
    """The entities of a folder, built once per query."""
    if not _INPUTS:
        return pipeline.Inputs(spark, d)
    return _INPUTS[-1].setdefault(d, pipeline.Inputs(spark, d))


def q(name: str, sql_text: str | None = None):
    def deco(fn):
        def run(spark, d):
            _INPUTS.append(_INPUTS[-1] if _INPUTS else {})        # a query made of queries shares their inputs
            try:
                return fn(spark, d)
            finally:
                _INPUTS.pop()

        QUERIES[name] = run
        if sql_text is not None:
            ORACLE[name] = sql_text
        return fn
    return deco


def _by_segment(fn, s, d, *columns):
    """``fn`` over the stored lines of these columns and the stand-in segments of their customers."""
    lines = Inputs(s, d).lines_for(*columns, keep=True)
    return fn(lines, pipeline.Inputs.seg_map_of(lines))


def _with_returns(fn, s, d):
    """``fn`` over the lines, the returns and the stand-in segments."""
    return _by_segment(lambda lines, segments: fn(lines, Inputs(s, d).returns, segments), s, d, "customer_id", "net_amount")


def _profile(s, d, *metrics):
    """The profile of the stand-in segments; with ``metrics`` only these, of lines and features that hold no more than they need."""
    from cohortlab.operators.features import needs
    if not metrics:
        return G.segment_profile(_stand_in(Inputs(s, d).kept_features(*G.PROFILE_FEATURES)))
    I, columns = Inputs(s, d), G.profile_features(metrics)
    I.lines_for(*needs(columns).line_columns, keep=True)
    return G.segment_profile(_stand_in(I.kept_features(*columns)), metrics=metrics)


def _with_ref(fn, s, d, columns, *more):
    """``fn`` over the stored lines of these columns and their reference date."""
    from cohortlab.operators.features import reference_date
    lines = Inputs(s, d).lines_for(*columns, keep=True)
    return fn(lines, reference_date(lines), *more)


D = "CAST(100 AS DOUBLE)"   # a DOUBLE literal 100 in DuckDB (plain 100.0 is DECIMAL there)

# ---- S: scans and sinks -----------------------------------------------------------------
q("read_table", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")(
    lambda s, d: S.read_table(s, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity"]))
q("read_table_pattern", "SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")(
    lambda s, d: S.read_table(s, f"{d}/orders.parquet", pattern=r"o_order(key|date|priority|status)$"))
q("read_optional", "SELECT r_regionkey, r_name FROM region")(
    lambda s, d: S.read_optional(s, f"{d}/region.parquet", "r_regionkey int, r_name string"))
q("to_output_types", O.sql("""SELECT return_id, customer_id, strftime(return_date, '%Y-%m-%dT%H:%M:%S') AS return_date,
       refund_amount, return_status, return_reason FROM returns""", "returns"))(
    lambda s, d: S.to_output_types(Inputs(s, d).returns))
q("spend_momentum_zero_filled", O.sql("SELECT customer_id, coalesce(spend_momentum, CAST(0 AS DOUBLE)) AS spend_momentum FROM features", "features"))(
    lambda s, d: Inputs(s, d).features_of("spend_momentum", zero_fill=True).select("customer_id", "spend_momentum"))
q("sanitize_non_finite", O.sql("SELECT customer_id, spend_momentum, clv_slope, ipt FROM features", "features"))(
    lambda s, d: S.sanitize_non_finite(Inputs(s, d).features_of("spend_momentum", "clv_slope", "ipt")))

# ---- C: cleaning and look-ups -----------------------------------------------------------
q("country_lookup", O.sql("SELECT code, country_name FROM country_lu", "country_lu"))(
    lambda s, d: C.country_lookup(A.raw_countries(s, d)))
q("gateway_by_promo", O.sql("SELECT promotion_code, payment_gateway FROM gateway_lu", "gateway_lu"))(
    lambda s, d: C.gateway_by_promo(A.raw_payment_log(s, d)))
q("offer_lookup", O.sql("SELECT * FROM offer_lu", "offer_lu"))(lambda s, d: C.offer_lookup(A.raw_offers(s, d)))
q("ingredients_by_product", O.sql("SELECT product_id, ingredients, ingredient_count FROM ingredients_lu", "ingredients_lu"))(
    lambda s, d: C.ingredients_by_product(A.raw_ingredients(s, d)).drop("ingredient_list"))
q("collection_by_product", O.sql("SELECT product_id, collection FROM collection_lu", "collection_lu"))(
    lambda s, d: C.collection_by_product(A.raw_collections(s, d), A.raw_product_for_collection(s, d)))
q("clean_customers", O.sql("SELECT * FROM customers", "customers"))(lambda s, d: Inputs(s, d).customers)
q("first_region", O.sql("""SELECT user_id AS customer_id, arg_min(government, seq) AS region_addr FROM raw_addresses
    WHERE user_id IS NOT NULL AND government IS NOT NULL GROUP BY 1""", "raw_addresses"))(
    lambda s, d: C.first_region(A.raw_addresses(s, d)))
q("customer_age", O.sql("SELECT customer_id, age FROM customers", "customers"))(
    lambda s, d: Inputs(s, d).customers.select("customer_id", "age"))
q("clean_products", O.sql("SELECT * FROM products", "products"))(lambda s, d: Inputs(s, d).products)
q("first_category", O.sql("SELECT product_id, category FROM products", "products"))(
    lambda s, d: Inputs(s, d).products.select("product_id", "category"))
q("clean_orders_wide", O.sql("SELECT * FROM lines", "lines"))(lambda s, d: C.clean_orders(
    A.raw_purchases(s, d), C.unpivot_items(A.wide_purchases(s, d)), Inputs(s, d).product_category, A.raw_countries(s, d),
    A.raw_payment_log(s, d), A.raw_offers(s, d)))
q("unpivot_items", O.sql("""SELECT * FROM (SELECT CAST(l_orderkey AS VARCHAR) AS purchase_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice,
                                l_discount) - 1 AS INTEGER) AS slot,
       CAST(l_partkey AS VARCHAR) AS product_id, l_extendedprice / l_quantity AS price,
       (l_extendedprice / l_quantity) * (1.0 - l_discount) AS sale_price, l_discount > 0.05 AS in_sale,
       greatest(l_quantity, 1.0) AS qty, l_discount AS discount_value
FROM lineitem) WHERE product_id NOT IN ('', 'nan', '0', 'None')"""))(lambda s, d: C.unpivot_items(A.wide_purchases(s, d)))
q("paid_orders", O.sql(f"""SELECT * FROM raw_purchases
    WHERE status IN (1) AND NOT (user_id IS NULL OR lower(trim(user_id)) IN {O.GUEST})""", "raw_purchases"))(
    lambda s, d: C.paid_orders(A.raw_purchases(s, d)))
q("drop_ghost_customers", O.sql(f"SELECT * FROM lines WHERE trim(customer_id) NOT IN {O.GHOST}", "lines"))(
    lambda s, d: C.drop_ghost_customers(Inputs(s, d).lines))

_MAP_CODES = """SELECT purchase_id,
       CASE WHEN pm IS NULL THEN 'Other' WHEN pm = 0 THEN 'Cash' WHEN pm = 1 THEN 'KNET' WHEN pm = 2 THEN 'Credit Card'
            WHEN pm = 3 THEN 'Online' ELSE 'Other' END AS channel,
       CASE WHEN sc = 1 THEN 'Mobile App' ELSE 'Web' END AS source_name,
       COALESCE(cl.country_name, upper(cc)) AS country
FROM (SELECT purchase_id, CAST(trunc(TRY_CAST(trim(payment_method) AS DOUBLE)) AS INTEGER) AS pm,
             CAST(trunc(TRY_CAST(trim(source) AS DOUBLE)) AS INTEGER) AS sc,
             CASE WHEN lower(trim(COALESCE(country_id, 'kw'))) = '' THEN 'kw'
                  ELSE lower(trim(COALESCE(country_id, 'kw'))) END AS cc
      FROM raw_purchases) p LEFT JOIN country_lu cl ON cl.code = p.cc"""
q("map_codes", O.sql(_MAP_CODES, "raw_purchases", "country_lu"))(
    lambda s, d: C.map_codes(A.raw_purchases(s, d), A.raw_countries(s, d)).select("purchase_id", "channel", "source_name",
                                                                                 "country"))
q("enrich_promo", O.sql("""SELECT p.purchase_id, p.promo_code, COALESCE(g.payment_gateway, '') AS payment_gateway,
       COALESCE(o.offer_name, '') AS offer_name, COALESCE(o.reduction_type, '') AS reduction_type,
       COALESCE(o.reduction_value, 0.0) AS reduction_value, COALESCE(o.is_auto_offer, false) AS is_auto_offer
FROM (SELECT purchase_id, COALESCE(trim(promotion_code), '') AS promo_code FROM raw_purchases) p
LEFT JOIN offer_lu o ON o.promotion_code = p.promo_code LEFT JOIN gateway_lu g ON g.promotion_code = p.promo_code""",
                        "raw_purchases", "offer_lu", "gateway_lu"))(
    lambda s, d: C.enrich_promo(A.raw_purchases(s, d), A.raw_offers(s, d), A.raw_payment_log(s, d))
    .select("purchase_id", "promo_code", "payment_gateway", "offer_name", "reduction_type", "reduction_value",
            "is_auto_offer"))


def _alloc(s, d):
    I = Inputs(s, d)
    o = C.paid_orders(I.purchases).select(F.col("purchase_id").alias("order_id"),
                                          F.coalesce(F.col("full_amount"), F.lit(0.0)).alias("full_amount"))
    it = I.items.filter(C.valid_item("product_id")) \
        .select(F.col("purchase_id").alias("order_id"), "product_id", "price", "sale_price", "in_sale", "qty")
    return C.allocate_order_total(o.join(it, "order_id", "left")) \
        .select("order_id", "product_id", "net_amount", "discount_pct", "item_gross")


q("allocate_order_total", O.sql("""SELECT order_id, COALESCE(product_id, 'unknown') AS product_id, net AS net_amount,
       CASE WHEN product_id IS NULL OR NOT (item_gross > 0) THEN 0.0
            ELSE greatest(0.0, round((1.0 - net / item_gross) * 100, 2)) END AS discount_pct, item_gross
FROM alloc""", "alloc"))(_alloc)
q("finalize_lines", O.sql("SELECT * FROM lines", "lines"))(lambda s, d: Inputs(s, d).lines)
q("clean_returns", O.sql("SELECT * FROM returns", "returns"))(lambda s, d: Inputs(s, d).returns)
O.cte("dedup_rev", ["raw_payment_log"], """
SELECT CAST(COALESCE(sum(v), 0) AS DOUBLE) AS total_revenue
FROM (SELECT invoice_id, arg_min(v, seq) AS v
      FROM (SELECT invoice_id, seq,
                   CAST(COALESCE(TRY_CAST(CAST(transaction_value AS VARCHAR) AS DOUBLE), 0.0) AS DECIMAL(18, 2)) AS v
            FROM raw_payment_log WHERE trim(status) = 'Paid') GROUP BY 1)""")
_PAYSTATS = O.sql(f"""SELECT count(*) AS total_payment_logs,
       CASE WHEN count(*) > 0 THEN round(sum(CASE WHEN status = 'Payment Failure' THEN 1 ELSE 0 END) * {D} / count(*), 2)
            ELSE 0.0 END AS payment_failure_rate,
       (SELECT total_revenue FROM dedup_rev) AS total_revenue
FROM raw_payment_log""", "raw_payment_log", "dedup_rev")
q("payment_stats", _PAYSTATS)(lambda s, d: C.payment_stats(A.raw_payment_log(s, d)))
q("deduped_paid_revenue", O.sql("SELECT total_revenue FROM dedup_rev", "dedup_rev"))(
    lambda s, d: C.deduped_paid_revenue(A.raw_payment_log(s, d)))
q("gateway_distribution", O.sql("""SELECT payment_gateway, count(*) AS n FROM raw_payment_log
    WHERE payment_gateway IS NOT NULL GROUP BY 1 ORDER BY n DESC, payment_gateway LIMIT 10""", "raw_payment_log"))(
    lambda s, d: C.gateway_distribution(A.raw_payment_log(s, d)))
q("status_distribution", O.sql("SELECT status, count(*) AS n FROM raw_payment_log WHERE status IS NOT NULL GROUP BY 1",
                               "raw_payment_log"))(lambda s, d: C.status_distribution(A.raw_payment_log(s, d)))
q("coerce_lines", O.sql("SELECT * FROM flines", "flines"))(lambda s, d: Inputs(s, d).lines_for(*C.LINE_COLUMNS))
q("order_lines", O.sql("SELECT * FROM lines", "lines"))(lambda s, d: Inputs(s, d).lines)

# ---- F: per-customer features -----------------------------------------------------------
FEATURE_QUERIES = {
    "total_spend": ["total_spend"], "order_count": ["order_count"], "recency": ["recency"], "aov": ["aov"],
    "avg_discount": ["avg_discount"], "unique_cats_prods": ["unique_cats", "unique_prods"],
    "active_months": ["active_months"], "spend_windows": ["spend_30", "spend_90", "spend_365"],
    "order_windows": ["orders_30", "orders_90", "orders_365"], "return_rate": ["return_rate"],
    "refund_ratio": ["refund_ratio"], "diversity": ["diversity"], "spend_velocity": ["spend_velocity"],
    "clv_slope": ["clv_slope"], "lifespan": ["lifespan"], "spend_momentum": ["spend_momentum"],
    "net_revenue": ["net_revenue"], "projected_annual_value": ["projected_annual_value"],
    "top_cat_channel": ["top_cat", "top_channel"],
    "customer_profile": ["gender", "region", "acquisition_channel", "phone"], "ipt": ["ipt"],
}
for _name, _cols in FEATURE_QUERIES.items():
    q(_name, O.sql(f"SELECT customer_id, {', '.join(_cols)} FROM features", "features"))(
        (lambda cols: lambda s, d: Inputs(s, d).features_of(*cols))(_cols))
q("customer_features", O.sql("SELECT * FROM features", "features"))(lambda s, d: Inputs(s, d).features)

# ---- G: segment aggregates (stand-in labels) --------------------------------------------
q("segment_counts", O.sql("SELECT seg, count(*) AS customers, sum(count(*)) OVER () AS total_customers FROM segf GROUP BY seg",
                          "segf"))(lambda s, d: G.segment_counts(pipeline.Inputs.seg_map_of(Inputs(s, d).lines_for("customer_id"))))
_prof = ", ".join(f"avg({src}) AS {name}" for name, src in G.PROFILE_METRICS)
_SEGPROF = f"""SELECT seg, count(*) AS n, {_prof}, COALESCE(avg(ipt), 0.0) AS avg_ipt,
       sum(CASE WHEN clv_slope > 0 THEN 1 ELSE 0 END) * {D} / count(*) AS clv_growing_pct,
       sum(CASE WHEN clv_slope < 0 THEN 1 ELSE 0 END) * {D} / count(*) AS clv_declining_pct
FROM segf GROUP BY seg"""
q("segment_profile", O.sql(_SEGPROF, "segf"))(lambda s, d: _profile(s, d))
q("clv_trend_share", O.sql(f"SELECT seg, clv_growing_pct, clv_declining_pct FROM ({_SEGPROF})", "segf"))(
    lambda s, d: _profile(s, d, "clv_growing_pct", "clv_declining_pct").drop("n"))
q("segment_ipt", O.sql(f"SELECT seg, avg_ipt FROM ({_SEGPROF})", "segf"))(
    lambda s, d: _profile(s, d, "avg_ipt").drop("n"))
O.cte("cust_month", ["flines"], """
SELECT customer_id, strftime(order_date, '%Y-%m') AS ym, sum(net_amount) AS spend FROM flines GROUP BY 1, 2""")
q("segment_monthly_spend", O.sql("""SELECT seg, ym, CAST(sum(spend) AS DOUBLE) / count(*) AS avg_spend
FROM cust_month JOIN segf USING (customer_id) GROUP BY 1, 2""", "cust_month", "segf"))(
    lambda s, d: _by_segment(G.segment_monthly_spend, s, d, "customer_id", "order_date", "net_amount"))


def _mact(s, d):
    I = Inputs(s, d)
    return G.segment_monthly_active_pct(I.flines, I.seg_map)


q("segment_monthly_active_pct", O.sql(f"""SELECT a.seg, a.ym, a.active, a.active * {D} / c.customers AS active_pct
FROM (SELECT seg, ym, count(*) AS active FROM cust_month JOIN segf USING (customer_id) GROUP BY 1, 2) a
JOIN (SELECT seg, count(*) AS customers FROM segf GROUP BY 1) c USING (seg)""", "cust_month", "segf"))(_mact)
q("segment_category_share", O.sql(f"""SELECT seg, category, lines, rank, lines * {D} / sum(lines) OVER (PARTITION BY seg) AS share
FROM (SELECT seg, category, lines, CAST(row_number() OVER (PARTITION BY seg ORDER BY lines DESC, category) AS INTEGER) AS rank
      FROM (SELECT seg, category, count(*) AS lines FROM flines JOIN segf USING (customer_id) GROUP BY 1, 2))
WHERE rank <= 6""", "flines", "segf"))(lambda s, d: _by_segment(G.segment_category_share, s, d, "customer_id", "category", "net_amount"))
O.cte("seg_net", ["flines", "returns", "segf"], """
SELECT s.seg, CAST(COALESCE(g.gross, 0) AS DOUBLE) AS gross, CAST(COALESCE(r.refunds, 0) AS DOUBLE) AS refunds,
       CAST(COALESCE(g.gross, 0) - COALESCE(r.refunds, 0) AS DOUBLE) AS net_revenue
FROM (SELECT DISTINCT seg FROM segf) s
LEFT JOIN (SELECT seg, sum(net_amount) AS gross FROM flines JOIN segf USING (customer_id) GROUP BY 1) g USING (seg)
LEFT JOIN (SELECT seg, sum(refund_amount) AS refunds FROM returns JOIN segf USING (customer_id) GROUP BY 1) r USING (seg)""")
q("segment_net_revenue", O.sql("SELECT * FROM seg_net", "seg_net"))(
    lambda s, d: _with_returns(G.segment_net_revenue, s, d))
O.cte("seg_redis", ["seg_net", "flines", "returns", "segf"], """
SELECT seg, CASE WHEN tot > 0 AND u <> 0 THEN net_revenue + u * (net_revenue / tot) ELSE net_revenue END AS net_revenue
FROM (SELECT seg, net_revenue, sum(net_revenue) OVER () AS tot FROM seg_net),
     (SELECT CAST(COALESCE((SELECT sum(net_amount) FROM flines WHERE customer_id NOT IN (SELECT customer_id FROM segf)), 0)
                - COALESCE((SELECT sum(refund_amount) FROM returns WHERE customer_id IN
                            (SELECT customer_id FROM flines WHERE customer_id NOT IN (SELECT customer_id FROM segf))), 0)
             AS DOUBLE) AS u)""")
q("redistribute_unassigned", O.sql("SELECT * FROM seg_redis", "seg_redis"))(
    lambda s, d: _with_returns(G.redistribute_unassigned, s, d))
O.cte("seg_scaled", ["seg_redis", "dedup_rev"], """
SELECT seg, CASE WHEN t > 0 THEN round(v * (t / CASE WHEN sum(v) OVER () <> 0 THEN sum(v) OVER () ELSE 1.0 END), 2)
                 ELSE v END AS revenue, t AS target_total
FROM (SELECT seg, round(net_revenue, 2) AS v FROM seg_redis), (SELECT total_revenue AS t FROM dedup_rev)""")


def _seg_scaled(s, d):
    return G.scale_to_total(_with_returns(G.redistribute_unassigned, s, d), C.deduped_paid_revenue(Inputs(s, d).payment_log))


q("scale_to_total", O.sql("SELECT * FROM seg_scaled", "seg_scaled"))(_seg_scaled)
q("fix_rounding_drift", O.sql("""SELECT seg, CASE WHEN rk = 1 THEN round(revenue + diff, 2) ELSE revenue END AS revenue
FROM (SELECT seg, revenue, round(round(target_total, 2) - sum(revenue) OVER (), 2) AS diff,
             row_number() OVER (ORDER BY revenue DESC, seg) AS rk FROM seg_scaled)""", "seg_scaled"))(
    lambda s, d: G.fix_rounding_drift(_seg_scaled(s, d)))
q("segment_actions", O.sql("""SELECT a.seg, a.action_rank, a.action, c.customers
FROM (SELECT seg, CAST(action_rank AS INTEGER) AS action_rank, action FROM (VALUES """ + ", ".join(
    f"({sid}, {i + 1}, '{a}')" for sid, acts in FX.SEGMENT_ACTIONS.items()
    for i, a in enumerate(acts)) + """) t(seg, action_rank, action)) a
JOIN (SELECT seg, count(*) AS customers FROM segf GROUP BY 1) c USING (seg)""", "segf"))(
    lambda s, d: G.segment_actions(s, Inputs(s, d).segf))

# ---- K: global KPIs ---------------------------------------------------------------------
_TOTALS = """SELECT CAST(g AS DOUBLE) AS gross_revenue, CAST(r AS DOUBLE) AS total_refund_amount,
       CAST(g - r AS DOUBLE) AS net_revenue, total_orders, total_returns
FROM (SELECT COALESCE(sum(net_amount), 0) AS g, count(DISTINCT order_id) AS total_orders FROM flines),
     (SELECT COALESCE(sum(refund_amount), 0) AS r, count(*) AS total_returns FROM returns)"""
q("revenue_totals", O.sql(_TOTALS, "flines", "returns"))(
    lambda s, d: K.revenue_totals(Inputs(s, d).lines_for("order_id", "net_amount"), Inputs(s, d).returns))
O.cte("fulfilled", ["flines", "returns"], "SELECT * FROM flines WHERE order_id NOT IN (SELECT return_id FROM returns)")
_FULFILLED = """SELECT fulfilled_orders, CAST(rev AS DOUBLE) AS fulfilled_revenue,
       CASE WHEN fulfilled_orders > 0 THEN CAST(rev AS DOUBLE) / fulfilled_orders ELSE 0.0 END AS true_aov
FROM (SELECT count(DISTINCT order_id) AS fulfilled_orders, COALESCE(sum(net_amount), 0) AS rev FROM fulfilled)"""
q("fulfilled_orders", O.sql(_FULFILLED, "fulfilled"))(lambda s, d: K.fulfilled_orders(Inputs(s, d).lines_for("order_id", "net_amount"), Inputs(s, d).returns))
q("true_aov", O.sql(f"SELECT true_aov FROM ({_FULFILLED})", "fulfilled"))(
    lambda s, d: K.fulfilled_orders(Inputs(s, d).lines_for("order_id", "net_amount"), Inputs(s, d).returns).select("true_aov"))
q("monthly_revenue", O.sql("SELECT strftime(order_date, '%Y-%m') AS ym, CAST(sum(net_amount) AS DOUBLE) AS revenue FROM flines GROUP BY 1",
                           "flines"))(lambda s, d: K.monthly_revenue(Inputs(s, d).lines_for("order_date", "net_amount")))
q("monthly_aov", O.sql("""SELECT ym, CAST(sum(t) AS DOUBLE) / count(*) AS aov
FROM (SELECT order_id, strftime(order_date, '%Y-%m') AS ym, sum(net_amount) AS t FROM fulfilled GROUP BY 1, 2) GROUP BY 1""",
                       "fulfilled"))(lambda s, d: K.monthly_aov(Inputs(s, d).lines_for("order_id", "order_date", "net_amount"), Inputs(s, d).returns))
O.cte("yoy", ["flines"], """
SELECT CAST(n AS BIGINT) AS n_months,
       CAST(CASE WHEN n >= 13 THEN l12 ELSE 0 END AS DOUBLE) AS yoy_last12,
       CAST(CASE WHEN n >= 24 THEN p12 ELSE 0 END AS DOUBLE) AS yoy_prev12,
       CASE WHEN n >= 13 AND CAST(CASE WHEN n >= 24 THEN p12 ELSE 0 END AS DOUBLE) > 0
            THEN (CAST(l12 AS DOUBLE) - CAST(p12 AS DOUBLE)) / CAST(p12 AS DOUBLE) * CAST(100 AS DOUBLE) END AS yoy_pct
FROM (SELECT max(n) AS n, sum(CASE WHEN pos <= 12 THEN rev END) AS l12, sum(CASE WHEN pos > 12 AND pos <= 24 THEN rev END) AS p12
      FROM (SELECT rev, row_number() OVER (ORDER BY ym DESC) AS pos, count(*) OVER () AS n
            FROM (SELECT strftime(order_date, '%Y-%m') AS ym, sum(net_amount) AS rev FROM flines GROUP BY 1)))""")
q("yoy_growth", O.sql("SELECT * FROM yoy", "yoy"))(lambda s, d: K.yoy_growth(Inputs(s, d).lines_for("order_date", "net_amount")))
q("category_revenue", O.sql("SELECT category, CAST(sum(net_amount) AS DOUBLE) AS revenue FROM flines GROUP BY 1", "flines"))(
    lambda s, d: K.category_revenue(Inputs(s, d).lines_for("category", "net_amount")))
O.cte("last12", ["flines", "refdate"], """
SELECT *, 'Q' || CAST(quarter(order_date) AS VARCHAR) AS qtr
FROM (SELECT *, max(CASE WHEN inwin THEN 1 ELSE 0 END) OVER () AS any_in
      FROM (SELECT f.*, (f.order_date > r.ref_date - INTERVAL 12 MONTH AND f.order_date <= r.ref_date) AS inwin
            FROM flines f, refdate r))
WHERE inwin OR any_in = 0""")
q("quarterly_top_products", O.sql(f"""SELECT p.qtr AS quarter, CAST(p.rank AS INTEGER) AS rank, p.product_id, p.name,
       CAST(p.rev AS DOUBLE) AS revenue,
       CAST(p.rev AS DOUBLE) / CASE WHEN t.q_total <> 0 THEN CAST(t.q_total AS DOUBLE) ELSE 1.0 END * {D} AS share
FROM (SELECT *, row_number() OVER (PARTITION BY qtr ORDER BY rev DESC, product_id) AS rank
      FROM (SELECT qtr, product_id, sum(net_amount) AS rev FROM last12 GROUP BY 1, 2) JOIN products pr USING (product_id)) p
JOIN (SELECT qtr, sum(net_amount) AS q_total FROM last12 GROUP BY 1) t USING (qtr)
WHERE p.rank <= 3""", "last12", "products"))(
    lambda s, d: _with_ref(K.quarterly_top_products, s, d, ("order_date", "product_id", "net_amount"), Inputs(s, d).product_names))
q("quarterly_top_categories", O.sql(f"""SELECT qtr AS quarter, CAST(rank AS INTEGER) AS rank, category AS name,
       CAST(rev AS DOUBLE) AS revenue,
       CAST(rev AS DOUBLE) / CASE WHEN q_total <> 0 THEN CAST(q_total AS DOUBLE) ELSE 1.0 END * {D} AS share
FROM (SELECT *, row_number() OVER (PARTITION BY qtr ORDER BY rev DESC, category) AS rank,
             sum(rev) OVER (PARTITION BY qtr) AS q_total
      FROM (SELECT qtr, category, sum(net_amount) AS rev FROM last12 GROUP BY 1, 2))
WHERE rank <= 3""", "last12"))(lambda s, d: _with_ref(K.quarterly_top_categories, s, d, ("order_date", "category", "net_amount")))
q("distributions", O.sql("""
SELECT 'channel' AS dimension, channel AS value, count(*) AS n FROM flines WHERE channel IS NOT NULL GROUP BY 2
UNION ALL SELECT 'region', value, n FROM (SELECT region AS value, count(*) AS n FROM customers WHERE region IS NOT NULL
                                          GROUP BY 1 ORDER BY n DESC, value LIMIT 10)
UNION ALL SELECT 'gender', gender, count(*) FROM customers WHERE gender IS NOT NULL GROUP BY 2
UNION ALL SELECT 'acquisition_channel', acquisition_channel, count(*) FROM customers
          WHERE acquisition_channel IS NOT NULL GROUP BY 2""", "flines", "customers"))(
    lambda s, d: K.distributions(Inputs(s, d).lines_for("channel"), Inputs(s, d).customers))
q("return_breakdown", O.sql("""
SELECT 'reason' AS dimension, return_reason AS value, count(*) AS n FROM returns WHERE return_reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'status', return_status, count(*) FROM returns WHERE return_status IS NOT NULL GROUP BY 2""", "returns"))(
    lambda s, d: K.return_breakdown(Inputs(s, d).returns))


def _bands_sql(col, lo, hi):
    return f"""SELECT band, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM (
  SELECT 'high' AS band, sum(CASE WHEN {col} >= {hi} THEN 1 ELSE 0 END) AS n FROM features
  UNION ALL SELECT 'mid', sum(CASE WHEN {col} >= {lo} AND {col} < {hi} THEN 1 ELSE 0 END) FROM features
  UNION ALL SELECT 'low', sum(CASE WHEN {col} < {lo} THEN 1 ELSE 0 END) FROM features)"""


q("spend_bands", O.sql(_bands_sql("total_spend", 100, 500), "features"))(lambda s, d: K.spend_bands(Inputs(s, d).features_of("total_spend")))
q("velocity_bands", O.sql(_bands_sql("spend_velocity", 30, 100), "features"))(
    lambda s, d: K.velocity_bands(Inputs(s, d).features_of("spend_velocity")))
q("clv_growing_pct", O.sql(f"SELECT sum(CASE WHEN clv_slope > 0 THEN 1 ELSE 0 END) * {D} / count(*) AS clv_growing_pct FROM features",
                           "features"))(lambda s, d: K.clv_growing_pct(Inputs(s, d).features_of("clv_slope")))
O.cte("activity", ["flines", "refdate"], """
SELECT customer_id, max(CASE WHEN order_date >= ref_date - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS active,
       max(CASE WHEN order_date < ref_date - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS prior
FROM flines, refdate GROUP BY 1""")
q("active_customers_90", O.sql("SELECT CAST(sum(active) AS BIGINT) AS active_customers_90 FROM activity", "activity"))(
    lambda s, d: _with_ref(K.active_customers_90, s, d, ("customer_id", "order_date")))
_RET = f"""SELECT CAST(COALESCE(sum(active), 0) AS BIGINT) AS active_customers_90,
       CAST(COALESCE(sum(active * prior), 0) AS BIGINT) AS retained, CAST(COALESCE(sum(prior), 0) AS BIGINT) AS prior_buyers,
       CASE WHEN sum(prior) > 0 THEN sum(active * prior) * {D} / sum(prior) ELSE 0.0 END AS retention_rate
FROM activity"""
q("retention_rate", O.sql(_RET, "activity"))(lambda s, d: _with_ref(K.retention_rate, s, d, ("customer_id", "order_date")))
q("overall_return_rate", O.sql(f"""SELECT CASE WHEN total_orders > 0 THEN total_returns / total_orders ELSE 0.0 END AS return_rate
FROM ({_TOTALS})""", "flines", "returns"))(lambda s, d: K.overall_return_rate(Inputs(s, d).lines_for("order_id", "net_amount"), Inputs(s, d).returns))
q("category_list", O.sql("SELECT DISTINCT category FROM flines WHERE category IS NOT NULL", "flines"))(
    lambda s, d: K.category_list(Inputs(s, d).lines_for("category")))
q("global_summary", O.sql(f"""SELECT t.*, f.*, y.yoy_last12, y.yoy_prev12, y.yoy_pct, c.clv_growing_pct, r.*, n.total_customers,
       strftime(rd.ref_date, '%Y-%m-%d') AS ref_date,
       CASE WHEN t.total_orders > 0 THEN t.total_returns / t.total_orders ELSE 0.0 END AS return_rate,
       f.true_aov AS avg_order_value
FROM ({_TOTALS}) t, ({_FULFILLED}) f, yoy y,
     (SELECT sum(CASE WHEN clv_slope > 0 THEN 1 ELSE 0 END) * {D} / count(*) AS clv_growing_pct FROM features) c,
     ({_RET}) r, (SELECT count(*) AS total_customers FROM features) n, refdate rd""",
                          "flines", "returns", "fulfilled", "yoy", "features", "activity", "refdate"))(
    lambda s, d: K.global_summary(Inputs(s, d).flines, Inputs(s, d).returns, Inputs(s, d).features, Inputs(s, d).ref))

# ---- M: preprocessing, model, scores ----------------------------------------------------
from cohortlab.functions.fixed import FEATURE_NAMES as _FN  # noqa: E402
from cohortlab.operators import cluster as M  # noqa: E402
from cohortlab.operators import density as DB  # noqa: E402
from cohortlab.operators import linkage as LI  # noqa: E402
from cohortlab.operators import prep as P  # noqa: E402
from cohortlab.operators import scores as SC  # noqa: E402


def _scaled(s, d, scaler="standard"):
    return P.scaled_features(Inputs(s, d).kept_features(*_FN), scaler=scaler)


def _stand_in(df: DataFrame, name: str = "seg") -> DataFrame:
    return df.withColumn(name, (F.col("customer_id").cast("long") % 4).cast("int"))


q("winsorize", O.sql("SELECT * FROM wins", "wins"))(
    lambda s, d: P.winsorize(Inputs(s, d).kept_features(*_FN)))
q("standardize", O.sql("SELECT * FROM scaled", "scaled"))(_scaled)
q("robust_scale", O.sql("SELECT customer_id, " + ", ".join(
    f"({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] <> 0 THEN q_{c}[3] - q_{c}[1] ELSE 1.0 END AS {c}" for c in _FN)
    + " FROM wins, (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _FN) + " FROM wins)",
    "wins"))(lambda s, d: _scaled(s, d, "robust"))
q("minmax_scale", O.sql("SELECT customer_id, " + ", ".join(
    f"({c} - lo_{c}) / CASE WHEN hi_{c} - lo_{c} <> 0 THEN hi_{c} - lo_{c} ELSE 1.0 END AS {c}" for c in _FN)
    + " FROM wins, (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _FN) + " FROM wins)",
    "wins"))(lambda s, d: _scaled(s, d, "minmax"))


def _kmeans(s, d, k=4):
    features = Inputs(s, d).kept_features(*_FN, "spend_365")
    cl = M.kmeans_segments(P.scaled_features(features), k=k)
    return M.segment_customers(features, cl, k).select("customer_id", "cluster", "seg", "segment")


q("kmeans_segments")(_kmeans)
q("k_sweep")(lambda s, d: M.k_sweep(_scaled(s, d)))
_RANK = """SELECT cluster, CAST(row_number() OVER (ORDER BY score DESC, cluster) - 1 AS INTEGER) AS seg, score
FROM (SELECT cluster,
        0.4 * CASE WHEN max(avg_spend) OVER () - min(avg_spend) OVER () > 0
                   THEN (avg_spend - min(avg_spend) OVER ()) / (max(avg_spend) OVER () - min(avg_spend) OVER ()) ELSE 0.0 END
      + 0.3 * CASE WHEN max(avg_orders) OVER () - min(avg_orders) OVER () > 0
                   THEN (avg_orders - min(avg_orders) OVER ()) / (max(avg_orders) OVER () - min(avg_orders) OVER ()) ELSE 0.0 END
      + 0.3 * CASE WHEN max(avg_recency) OVER () - min(avg_recency) OVER () > 0
                   THEN 1.0 - (avg_recency - min(avg_recency) OVER ()) / (max(avg_recency) OVER () - min(avg_recency) OVER ())
                   ELSE 0.0 END AS score
      FROM (SELECT seg AS cluster, avg(spend_365) AS avg_spend, avg(order_count) AS avg_orders, avg(recency) AS avg_recency
            FROM segf GROUP BY 1))"""
q("rank_clusters", O.sql(_RANK, "segf"))(lambda s, d: M.rank_clusters(_stand_in(Inputs(s, d).features_of("spend_365", "order_count", "recency"), "cluster")))
_T4 = FX.SEGMENT_TEMPLATES[4]
q("name_segments", O.sql("""SELECT r.seg, CAST(r.name_rank AS INTEGER) AS name_rank, t.name, t.icon, t.color, t.color_bg, t.description
FROM (SELECT seg, row_number() OVER (ORDER BY avg(spend_365) DESC, avg(recency), seg) - 1 AS name_rank FROM segf GROUP BY seg) r
LEFT JOIN (VALUES """ + ", ".join("({}, '{}', '{}', '{}', '{}', '{}')".format(i, *[v.replace("'", "''") for v in row])
                                  for i, row in enumerate(_T4)) + """) t(name_rank, name, icon, color, color_bg, description)
  USING (name_rank)""", "segf"))(lambda s, d: M.name_segments(_segments_of(s, d, "spend_365", "recency"), 4))
q("pca_2d")(lambda s, d: M.pca_2d(_scaled(s, d)))
q("pca_meta")(lambda s, d: M.pca_meta(_scaled(s, d)))
q("pca_loadings")(lambda s, d: M.pca_loadings(_scaled(s, d)))
q("dominant_feature")(lambda s, d: M.dominant_feature(M.pca_loadings(_scaled(s, d))))
_STACK = " UNION ALL ".join(f"SELECT seg, '{c}' AS feature, avg({c}) AS v FROM segsc GROUP BY seg" for c in _FN)
q("feature_importance", O.sql(f"""SELECT feature, sd / CASE WHEN max(sd) OVER () > 0 THEN max(sd) OVER () ELSE 1.0 END AS value
FROM (SELECT feature, stddev_pop(v) AS sd FROM ({_STACK}) GROUP BY feature)""", "segsc"))(
    lambda s, d: SC.feature_importance(_stand_in(_scaled(s, d))))
q("gmm_segments")(lambda s, d: M.gmm_segments(_scaled(s, d)).select("customer_id", "cluster"))
q("hierarchical_segments")(lambda s, d: M.hierarchical_segments(_scaled(s, d)).select("customer_id", "cluster"))
q("ward_segments")(lambda s, d: LI.ward_segments(_scaled(s, d)).select("customer_id", "cluster"))
q("ward_dendrogram")(lambda s, d: LI.dendrogram(_scaled(s, d)))
_DIST = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _FN)
O.cte("dbscan_near", ["scaled"], f"SELECT a.customer_id AS a, b.customer_id AS b, {_DIST} AS square FROM scaled a JOIN scaled b ON {_DIST} <= CAST(0.8 AS DOUBLE) * CAST(0.8 AS DOUBLE)")
O.cte("dbscan_points", ["dbscan_near"], "SELECT a AS customer_id, count(*) AS n FROM dbscan_near GROUP BY a")
O.cte("dbscan_core", ["dbscan_points"], "SELECT customer_id FROM dbscan_points WHERE n >= 10")
O.cte("dbscan_links", ["dbscan_near", "dbscan_core"], "SELECT a, b FROM dbscan_near WHERE a IN (SELECT customer_id FROM dbscan_core) AND b IN (SELECT customer_id FROM dbscan_core)")
O.cte("dbscan_spread", ["dbscan_links"], """SELECT 0 AS step, customer_id AS id, customer_id AS label FROM dbscan_core
  UNION ALL SELECT s.step + 1, l.a, min(s.label) FROM dbscan_spread s JOIN dbscan_links l ON l.b = s.id WHERE s.step < 60 GROUP BY s.step, l.a""")
O.cte("dbscan_labels", ["dbscan_spread", "dbscan_near"], """SELECT id AS customer_id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM dbscan_spread WHERE step = 60
  UNION ALL SELECT f.a, r.cluster FROM (SELECT a, arg_min(b, {'d': square, 'b': b}) AS b FROM dbscan_near
    WHERE a NOT IN (SELECT customer_id FROM dbscan_core) AND b IN (SELECT customer_id FROM dbscan_core) GROUP BY a) f
  JOIN (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM dbscan_spread WHERE step = 60) r ON r.id = f.b""")
q("silhouette", O.sql(f"""SELECT avg(sv) AS silhouette FROM (
  SELECT customer_id, CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS sv
  FROM (SELECT customer_id, max(n_own) AS n_own, max(CASE WHEN other = own THEN sd / greatest(n_own - 1, 1) END) AS a,
               min(CASE WHEN other <> own THEN sd / n_other END) AS b
        FROM (SELECT p.*, c1.n AS n_own, c2.n AS n_other
              FROM (SELECT a.customer_id, a.seg AS own, b.seg AS other, sum({_DIST}) AS sd
                    FROM segsc a JOIN segsc b ON a.customer_id <> b.customer_id GROUP BY 1, 2, 3) p
              JOIN (SELECT seg, count(*) AS n FROM segsc GROUP BY 1) c1 ON c1.seg = p.own
              JOIN (SELECT seg, count(*) AS n FROM segsc GROUP BY 1) c2 ON c2.seg = p.other)
        GROUP BY 1))""", "segsc"))(lambda s, d: SC.silhouette(_stand_in(_scaled(s, d)), "seg"))
# labels of core points spread to their neighbours; 60 rounds are more than any chain of core points on the tables checked
q("dbscan_segments", O.sql(f"""SELECT p.customer_id, CAST(coalesce(c.cluster, -1) AS INTEGER) AS cluster, p.n AS n_near, p.n >= 10 AS is_core
FROM dbscan_points p LEFT JOIN dbscan_labels c USING (customer_id)""", "dbscan_points", "dbscan_labels").replace("WITH", "WITH RECURSIVE", 1))(lambda s, d: DB.dbscan(_scaled(s, d)))
q("silhouette_euclidean", O.sql(f"""SELECT avg(sv) AS silhouette, CAST(0 AS DOUBLE) AS bound FROM (
  SELECT customer_id, CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS sv
  FROM (SELECT customer_id, max(n_own) AS n_own, max(CASE WHEN other = own THEN sd / greatest(n_own - 1, 1) END) AS a,
               min(CASE WHEN other <> own THEN sd / n_other END) AS b
        FROM (SELECT p.*, c1.n AS n_own, c2.n AS n_other
              FROM (SELECT a.customer_id, a.seg AS own, b.seg AS other, sum(sqrt({_DIST})) AS sd
                    FROM segsc a JOIN segsc b ON a.customer_id <> b.customer_id GROUP BY 1, 2, 3) p
              JOIN (SELECT seg, count(*) AS n FROM segsc GROUP BY 1) c1 ON c1.seg = p.own
              JOIN (SELECT seg, count(*) AS n FROM segsc GROUP BY 1) c2 ON c2.seg = p.other)
        GROUP BY 1))""", "segsc"))(lambda s, d: SC.silhouette_euclidean(_stand_in(_scaled(s, d)), "seg"))
_CEN = "SELECT seg, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}" for c in _FN) + " FROM segsc GROUP BY seg"
_PD = " + ".join(f"(x.{c} - c.m_{c}) * (x.{c} - c.m_{c})" for c in _FN)
_CD = " + ".join(f"(a.m_{c} - b.m_{c}) * (a.m_{c} - b.m_{c})" for c in _FN)
q("davies_bouldin", O.sql(f"""SELECT avg(r) AS davies_bouldin FROM (
  SELECT a.seg, max((a.s + b.s) / sqrt({_CD})) AS r
  FROM (SELECT c.*, s.s FROM ({_CEN}) c JOIN (SELECT x.seg, avg(sqrt({_PD})) AS s FROM segsc x JOIN ({_CEN}) c USING (seg)
                                               GROUP BY 1) s USING (seg)) a
  JOIN (SELECT c.*, s.s FROM ({_CEN}) c JOIN (SELECT x.seg, avg(sqrt({_PD})) AS s FROM segsc x JOIN ({_CEN}) c USING (seg)
                                               GROUP BY 1) s USING (seg)) b ON a.seg <> b.seg
  GROUP BY a.seg)""", "segsc"))(lambda s, d: SC.davies_bouldin(_stand_in(_scaled(s, d)), "seg"))
_GB = " + ".join(f"(c.m_{c} - g.g_{c}) * (c.m_{c} - g.g_{c})" for c in _FN)
q("calinski_harabasz", O.sql(f"""SELECT CASE WHEN k > 1 AND w > 0 THEN (b / (k - 1)) / (w / (n_all - k)) END AS calinski_harabasz
FROM (SELECT sum(c.n * ({_GB})) AS b, count(*) AS k, max(g.n_all) AS n_all
      FROM ({_CEN}) c, (SELECT count(*) AS n_all, {", ".join(f"avg({c}) AS g_{c}" for c in _FN)} FROM segsc) g),
     (SELECT sum({_PD}) AS w FROM segsc x JOIN ({_CEN}) c USING (seg))""", "segsc"))(
    lambda s, d: SC.calinski_harabasz(_stand_in(_scaled(s, d)), "seg"))
q("compare_algorithms")(lambda s, d: SC.compare_algorithms(_scaled(s, d)))
q("sample_customers", O.sql("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY md5(customer_id || '#42')) AS rn
FROM features) WHERE rn <= 1000""", "features"))(lambda s, d: M.sample_customers(Inputs(s, d).features))

# ---- Q: look-ups over scored features (stand-in labels + names) -------------------------
from cohortlab.operators import insights as DI  # noqa: E402
from cohortlab.operators import lookup as L  # noqa: E402

O.cte("seg_names", ["segf"], """
SELECT r.seg, t.name AS segment FROM (SELECT seg, row_number() OVER (ORDER BY avg(spend_365) DESC, avg(recency), seg) - 1 AS name_rank
                                      FROM segf GROUP BY seg) r
LEFT JOIN (VALUES """ + ", ".join(f"({i}, '{row[0]}')" for i, row in enumerate(_T4)) + """) t(name_rank, name) USING (name_rank)""")
O.cte("scored", ["segf", "seg_names"], "SELECT * FROM segf JOIN seg_names USING (seg)")


def _segments_of(s, d, *columns):
    """customer_id, these features and the stand-in segment, from the branches that they need."""
    return Inputs(s, d).features_of(*columns).withColumn("seg", (F.col("customer_id").cast("long") % 4).cast("int"))


def _scored(s, d, *columns):
    """Features, or only these, with the stand-in segments and their names."""
    segf = _stand_in(Inputs(s, d).kept_features(*columns, "spend_365", "recency")) if columns else Inputs(s, d).segf
    names = M.name_segments(segf, 4).select("seg", F.col("name").alias("segment"))
    return segf.join(F.broadcast(names), "seg")


_SEARCH = "SELECT * FROM scored WHERE regexp_matches(region, 'a', 'i') AND regexp_matches(gender, '^(household|building)$', 'i')"
q("search_customers", O.sql(_SEARCH, "scored"))(
    lambda s, d: L.search_customers(_scored(s, d), region="a", gender="^(household|building)$"))
q("search_customers_text", O.sql("""SELECT * FROM scored WHERE (regexp_matches(customer_id, '12', 'i')
    OR COALESCE(regexp_matches(phone, '12', 'i'), false)) AND regexp_matches(top_channel, 'cash|knet', 'i') AND seg = 1""",
                                  "scored"))(
    lambda s, d: L.search_customers(_scored(s, d), channel="cash|knet", q="12", seg=1))
q("page", O.sql(f"""SELECT * FROM (SELECT * FROM ({_SEARCH}) ORDER BY recency ASC, customer_id ASC LIMIT 50 OFFSET 10),
    (SELECT count(*) AS total FROM ({_SEARCH}))""", "scored"))(
    lambda s, d: L.page(L.search_customers(_scored(s, d), region="a", gender="^(household|building)$"), "recency", 10, 50))
q("random_customers", O.sql(f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY md5(customer_id || '#42')) AS rn
    FROM ({_SEARCH})) WHERE rn <= 100""", "scored"))(
    lambda s, d: L.random_customers(L.search_customers(_scored(s, d), region="a", gender="^(household|building)$"), 100))
q("customer_profile_by_id", O.sql("SELECT * FROM scored WHERE customer_id = '7'", "scored"))(
    lambda s, d: L.customer_profile_by_id(_scored(s, d), "7"))
q("top_per_segment", O.sql("""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seg ORDER BY total_spend DESC, customer_id)
    AS INTEGER) AS rank FROM scored) WHERE rank <= 300""", "scored"))(lambda s, d: L.top_per_segment(_scored(s, d)))
O.cte("offers", ["offer_lu", "raw_offers"], """SELECT o.*, r.seq FROM offer_lu o JOIN
    (SELECT trim(promotion_code) AS promotion_code, max(seq) AS seq FROM raw_offers GROUP BY 1) r USING (promotion_code)""")


def _offers(s, d):
    raw = A.raw_offers(s, d)
    return C.offer_lookup(raw).join(raw.groupBy(F.trim("promotion_code").alias("promotion_code")).agg(F.max("seq").alias("seq")),
                                    "promotion_code")


q("offers_list", O.sql("SELECT * FROM offers ORDER BY seq, promotion_code LIMIT 10", "offers"))(
    lambda s, d: L.offers_list(_offers(s, d), 10))
q("offer_stats", O.sql("""SELECT count(*) AS total_offers, CAST(sum(CAST(is_auto_offer AS INTEGER)) AS BIGINT) AS auto_offers_count,
    count(*) - CAST(sum(CAST(is_auto_offer AS INTEGER)) AS BIGINT) AS manual_offers_count FROM offers""", "offers"))(
    lambda s, d: L.offer_stats(_offers(s, d)))
q("offer_type_distribution", O.sql("SELECT reduction_type, count(*) AS n FROM offers GROUP BY 1", "offers"))(
    lambda s, d: L.offer_type_distribution(_offers(s, d)))
q("top_offers", O.sql("""SELECT offer_name, reduction_type, reduction_value, offer_usage_count FROM offers
    ORDER BY offer_usage_count DESC, seq LIMIT 10""", "offers"))(lambda s, d: L.top_offers(_offers(s, d)))
q("countries_list", O.sql("SELECT code, country_name FROM country_lu", "country_lu"))(
    lambda s, d: C.country_lookup(A.raw_countries(s, d)))
q("custom_segment", O.sql("""SELECT count(*) AS count FROM scored WHERE seg = 2 AND regexp_matches(region, 'asia|europe', 'i')""",
                          "scored"))(lambda s, d: L.custom_segment(_scored(s, d, "region"), seg=2, region="asia|europe"))
_FILTERS = [("asia-any", None, "asia", None), ("seg0", 0, None, None), ("seg3-machinery", 3, None, "machinery"),
            ("all", None, None, None)]


def _custom_many(s, d):
    f = s.createDataFrame(_FILTERS, "label string, seg int, region string, gender string")
    return L.custom_segments(_scored(s, d, "region", "gender"), f)


q("custom_segments", O.sql("""SELECT f.label, CAST(count(x.customer_id) AS BIGINT) AS count
FROM (VALUES """ + ", ".join("('{}', {}, {}, {})".format(lb, "NULL" if sg is None else sg,
                                                            "NULL" if rg is None else f"'{rg}'", "NULL" if gd is None else f"'{gd}'")
                              for lb, sg, rg, gd in _FILTERS) + """) f(label, seg, region, gender)
LEFT JOIN scored x ON (f.seg IS NULL OR x.seg = f.seg) AND (f.region IS NULL OR regexp_matches(x.region, f.region, 'i'))
                  AND (f.gender IS NULL OR regexp_matches(x.gender, f.gender, 'i'))
GROUP BY f.label""", "scored"))(_custom_many)
q("segment_overview", O.sql("""SELECT n.seg, n.segment, c.customers, c.total_customers FROM seg_names n LEFT JOIN
    (SELECT seg, count(*) AS customers, sum(count(*)) OVER () AS total_customers FROM segf GROUP BY seg) c USING (seg)""",
                            "seg_names", "segf"))(
    lambda s, d: L.segment_overview(M.name_segments(_segments_of(s, d, "spend_365", "recency"), 4).select("seg", F.col("name").alias("segment")),
                                    G.segment_counts(pipeline.Inputs.seg_map_of(Inputs(s, d).lines_for("customer_id")))))
q("feature_importance_sorted", O.sql(f"""SELECT feature, value, CAST(row_number() OVER (ORDER BY value DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, sd / CASE WHEN max(sd) OVER () > 0 THEN max(sd) OVER () ELSE 1.0 END AS value
      FROM (SELECT feature, stddev_pop(v) AS sd FROM ({_STACK}) GROUP BY feature))""", "segsc"))(
    lambda s, d: L.feature_importance_sorted(SC.feature_importance(_stand_in(_scaled(s, d)))))
q("recency_labels", O.sql("""SELECT customer_id,
    CASE WHEN recency = 0 THEN 'Today' WHEN recency = 1 THEN 'Yesterday' WHEN recency < 7 THEN CAST(recency AS VARCHAR) || ' days ago'
         WHEN recency < 30 THEN CAST(CAST(round(recency / 7.0) AS BIGINT) AS VARCHAR) || 'w ago'
         WHEN recency < 365 THEN CAST(CAST(round(recency / 30.0) AS BIGINT) AS VARCHAR) || 'mo ago'
         ELSE CAST(CAST(round(recency / 365.0) AS BIGINT) AS VARCHAR) || 'y ago' END AS recency_label,
    CASE WHEN recency < 30 THEN '#059669' WHEN recency < 90 THEN '#d97706' ELSE '#dc2626' END AS recency_severity,
    CASE WHEN return_rate < 0.05 THEN '#059669' WHEN return_rate < 0.12 THEN '#d97706' ELSE '#dc2626' END AS return_severity
FROM features""", "features"))(
    lambda s, d: Inputs(s, d).features.select("customer_id", L.recency_label("recency").alias("recency_label"),
                                              L.recency_severity("recency").alias("recency_severity"),
                                              L.return_severity("return_rate").alias("return_severity")))

q("segment_return_severity", O.sql("""SELECT seg, CASE WHEN r < 0.05 THEN '#059669' WHEN r < 0.15 THEN '#e07820' ELSE '#dc2626' END AS severity
FROM (SELECT seg, avg(return_rate) AS r FROM segf GROUP BY 1)""", "segf"))(
    lambda s, d: Inputs(s, d).segf.groupBy("seg").agg(F.avg("return_rate").alias("r"))
    .select("seg", L.return_severity("r", segment_level=True).alias("severity")))

# ---- D: derived analytics ---------------------------------------------------------------
O.cte("prof", ["segf"], _SEGPROF)
O.cte("seg_rev", ["seg_scaled"], """SELECT seg, CASE WHEN rk = 1 THEN round(revenue + diff, 2) ELSE revenue END AS revenue
FROM (SELECT seg, revenue, round(round(target_total, 2) - sum(revenue) OVER (), 2) AS diff,
             row_number() OVER (ORDER BY revenue DESC, seg) AS rk FROM seg_scaled)""")
O.cte("mrev", ["flines"], "SELECT strftime(order_date, '%Y-%m') AS ym, CAST(sum(net_amount) AS DOUBLE) AS revenue FROM flines GROUP BY 1")
O.cte("maov", ["fulfilled"], """SELECT ym, CAST(sum(t) AS DOUBLE) / count(*) AS aov
FROM (SELECT order_id, strftime(order_date, '%Y-%m') AS ym, sum(net_amount) AS t FROM fulfilled GROUP BY 1, 2) GROUP BY 1""")
O.cte("catshare", ["flines", "segf"], f"""SELECT seg, category, lines, rank, lines * {D} / sum(lines) OVER (PARTITION BY seg) AS share
FROM (SELECT seg, category, lines, CAST(row_number() OVER (PARTITION BY seg ORDER BY lines DESC, category) AS INTEGER) AS rank
      FROM (SELECT seg, category, count(*) AS lines FROM flines JOIN segf USING (customer_id) GROUP BY 1, 2))
WHERE rank <= 6""")
O.cte("segmonthly", ["cust_month", "segf"], """SELECT seg, ym, CAST(sum(spend) AS DOUBLE) / count(*) AS avg_spend
FROM cust_month JOIN segf USING (customer_id) GROUP BY 1, 2""")


class _X:
    """Shared inputs of the D queries for one (spark, dir)."""

    def __init__(self, s, d):
        self.s, self.d, self.I = s, d, Inputs(s, d)

    @property
    def profile(self):
        return G.segment_profile(_stand_in(self.I.kept_features(*G.PROFILE_FEATURES)))

    def profile_of(self, *metrics):
        return _profile(self.s, self.d, *metrics)

    @property
    def seg_rev(self):
        return _seg_drift(self.I)

    @property
    def monthly(self):
        return K.monthly_revenue(self.I.flines)

    @property
    def cat_share(self):
        return G.segment_category_share(self.I.flines, self.I.seg_map)

    @property
    def seg_monthly(self):
        return G.segment_monthly_spend(self.I.flines, self.I.seg_map)


def _seg_drift(I):
    return G.fix_rounding_drift(G.scale_to_total(G.redistribute_unassigned(I.flines, I.returns, I.seg_map),
                                                 C.deduped_paid_revenue(I.payment_log)))


def dq(name, sql_text, ctes, fn):
    q(name, O.sql(sql_text, *ctes))(lambda s, d: fn(_X(s, d)))


dq("segment_share", f"""SELECT p.seg, p.n * {D} / sum(p.n) OVER () AS customers_pct, r.revenue * {D} / sum(r.revenue) OVER () AS revenue_pct
FROM prof p LEFT JOIN seg_rev r USING (seg)""", ["prof", "seg_rev"], lambda x: DI.segment_share(x.profile, x.seg_rev))
dq("category_share", f"""SELECT * FROM (SELECT category, revenue, revenue * {D} / sum(revenue) OVER () AS pct,
    CAST(row_number() OVER (ORDER BY revenue DESC, category) AS INTEGER) AS rank
    FROM (SELECT category, CAST(sum(net_amount) AS DOUBLE) AS revenue FROM flines GROUP BY 1)) WHERE rank <= 8""", ["flines"],
   lambda x: DI.category_share(K.category_revenue(x.I.flines)))
dq("channel_share", f"""SELECT channel, n, n * {D} / sum(n) OVER () AS pct, n * {D} / max(n) OVER () AS bar_pct
FROM (SELECT channel, count(*) AS n FROM flines GROUP BY 1)""", ["flines"], lambda x: DI.channel_share(x.I.flines))
_W = ", ".join(f"'{m}', {m}" for m in DI.WEIGHTED)
dq("weighted_means", """SELECT metric, value FROM (SELECT metric, sum(v * n) / sum(n) AS value FROM (
    SELECT n, unnest(map_keys(m)) AS metric, unnest(map_values(m)) AS v FROM (SELECT n, MAP {""" + ", ".join(
    f"'{m}': CAST({m} AS DOUBLE)" for m in DI.WEIGHTED) + """} AS m FROM prof)) GROUP BY metric)
UNION ALL SELECT 'avg_lifespan_months', sum(avg_lifespan * n) / sum(n) / 30.0 FROM prof""", ["prof"],
   lambda x: DI.weighted_means(x.profile))
dq("unweighted_segment_means", """SELECT 'avg_return_rate' AS metric, avg(avg_return_rate) AS value FROM prof
UNION ALL SELECT 'avg_refund_ratio', avg(avg_refund_ratio) FROM prof UNION ALL SELECT 'avg_diversity', avg(avg_diversity) FROM prof""",
   ["prof"], lambda x: DI.unweighted_segment_means(x.profile))
dq("best_segment", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS metric, 'best' AS kind, seg, CAST({m} AS DOUBLE) AS value FROM prof "
    f"{'WHERE avg_ipt > 0 ' if m == 'avg_ipt' else ''}ORDER BY {m} {'ASC' if low else 'DESC'}, seg LIMIT 1)"
    for m, low in DI.BEST_METRICS) + " UNION ALL SELECT * FROM (SELECT 'avg_aov', 'worst', seg, CAST(avg_aov AS DOUBLE) FROM prof "
    "ORDER BY avg_aov ASC, seg LIMIT 1)", ["prof"], lambda x: DI.best_segment(x.profile))
dq("aov_trend", """SELECT curr3, prev3, CASE WHEN n >= 6 THEN CASE WHEN prev3 > 0 THEN (curr3 - prev3) / prev3 * CAST(100 AS DOUBLE)
    ELSE 0.0 END END AS aov_trend_pct
FROM (SELECT max(n) AS n, sum(CASE WHEN pos <= 3 THEN aov END) / 3.0 AS curr3,
             sum(CASE WHEN pos > 3 AND pos <= 6 THEN aov END) / 3.0 AS prev3
      FROM (SELECT aov, row_number() OVER (ORDER BY ym DESC) AS pos, count(*) OVER () AS n FROM maov))""", ["maov"],
   lambda x: DI.aov_trend(K.monthly_aov(x.I.flines, x.I.returns)))
dq("annual_spend_momentum", """SELECT annual, sp90 * 4.0 AS annualised_sp90,
    CASE WHEN annual > 0 THEN (sp90 * 4.0 - annual) / annual * CAST(100 AS DOUBLE) END AS annual_trend_pct
FROM (SELECT sum(avg_sp365 * n) / sum(n) AS annual, sum(avg_sp90 * n) / sum(n) AS sp90 FROM prof)""", ["prof"],
   lambda x: DI.annual_spend_momentum(x.profile))
dq("order_momentum", """SELECT annualised_ord30, ord90,
    CASE WHEN ord90 > 0 THEN (annualised_ord30 - ord90) / ord90 * CAST(100 AS DOUBLE) END AS order_trend_pct
FROM (SELECT sum(avg_ord30 * n) / sum(n) * 3.0 AS annualised_ord30, sum(avg_ord90 * n) / sum(n) AS ord90 FROM prof)""", ["prof"],
   lambda x: DI.order_momentum(x.profile))
dq("half_year_trend", """SELECT curr6, prev6, CASE WHEN n >= 12 AND prev6 <> 0 THEN (curr6 - prev6) / prev6 * CAST(100 AS DOUBLE) END
    AS half_year_pct
FROM (SELECT max(n) AS n, sum(CASE WHEN pos <= 6 THEN revenue END) AS curr6, sum(CASE WHEN pos > 6 AND pos <= 12 THEN revenue END) AS prev6
      FROM (SELECT revenue, row_number() OVER (ORDER BY ym DESC) AS pos, count(*) OVER () AS n FROM mrev))""", ["mrev"],
   lambda x: DI.half_year_trend(x.monthly))
dq("current_vs_peak_month", """SELECT current, peak, CASE WHEN peak > 0 THEN current / peak * CAST(100 AS DOUBLE) ELSE 0.0 END
    AS current_pct_of_peak FROM (SELECT arg_max(revenue, ym) AS current, max(revenue) AS peak FROM mrev)""", ["mrev"],
   lambda x: DI.current_vs_peak_month(x.monthly))
dq("monthly_yoy_delta", """SELECT ym, revenue, prev,
    CAST(CASE WHEN prev > 0 THEN floor((revenue - prev) / prev * CAST(100 AS DOUBLE) + 0.5) ELSE 0 END AS BIGINT) AS yoy_delta_pct
FROM (SELECT ym, revenue, lag(revenue, 12) OVER (ORDER BY ym) AS prev, row_number() OVER (ORDER BY ym DESC) AS pos, count(*) OVER () AS n FROM mrev)
WHERE pos <= 12 AND n >= 24""", ["mrev"], lambda x: DI.monthly_yoy_delta(x.monthly))
dq("quarter_share", f"""SELECT quarter, revenue, pct, row_number() OVER (ORDER BY pct DESC, quarter) = 1 AS is_best
FROM (SELECT quarter, revenue, CAST(floor(revenue / CASE WHEN sum(revenue) OVER () <> 0 THEN sum(revenue) OVER () ELSE 1.0 END * {D} + 0.5) AS BIGINT) AS pct
      FROM (SELECT d.quarter, coalesce(sum(revenue), CAST(0 AS DOUBLE)) AS revenue
            FROM (VALUES ('Q1', '01', '03'), ('Q2', '04', '06'), ('Q3', '07', '09'), ('Q4', '10', '12')) d(quarter, a, b)
            LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ym DESC) AS pos FROM mrev) WHERE pos <= 12) m
              ON substr(ym, 6, 2) BETWEEN d.a AND d.b GROUP BY 1))
WHERE (SELECT count(*) FROM mrev) > 0""", ["mrev"], lambda x: DI.quarter_share(x.monthly))
dq("peak_month", """SELECT b.ym AS peak_month, b.revenue AS peak_revenue, r.* FROM
    (SELECT * FROM mrev ORDER BY revenue DESC, ym LIMIT 1) b,
    (SELECT min(ym) AS first_month, max(ym) AS last_month, count(*) AS n_months FROM mrev) r""", ["mrev"],
   lambda x: DI.peak_month(x.monthly))
dq("segment_peak_trough", """SELECT b.seg, b.ym AS peak_month, b.avg_spend AS peak_value, l.ym AS trough_month, l.avg_spend AS trough_value
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY avg_spend DESC, ym) AS r FROM segmonthly) WHERE r = 1) b
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY avg_spend ASC, ym) AS r FROM segmonthly
                          WHERE avg_spend > 0) WHERE r = 1) l USING (seg)""", ["segmonthly"],
   lambda x: DI.segment_peak_trough(x.seg_monthly))
dq("seasonality_class", """SELECT seg, cv, CASE WHEN months < 2 THEN NULL WHEN cv < 0.3 THEN 'Stable' WHEN cv < 0.6 THEN 'Moderate'
    ELSE 'High var.' END AS seasonality
FROM (SELECT seg, count(*) AS months, CASE WHEN avg(avg_spend) > 0 THEN stddev_pop(avg_spend) / avg(avg_spend) ELSE 0.0 END AS cv
      FROM segmonthly WHERE avg_spend > 0 GROUP BY seg)""", ["segmonthly"], lambda x: DI.seasonality_class(x.seg_monthly))
_ZU = " UNION ALL ".join(f"SELECT seg, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM prof" for m in DI.Z_METRICS)
dq("segment_zscores", f"""SELECT seg, metric, z, CASE WHEN z > 0.6 THEN 'very_high' WHEN z > 0.2 THEN 'high' WHEN z < -0.6 THEN 'very_low'
    WHEN z < -0.2 THEN 'low' ELSE 'neutral' END AS band
FROM (SELECT seg, metric, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1.0 END AS z
      FROM ({_ZU}) WINDOW w AS (PARTITION BY metric))""", ["prof"], lambda x: DI.segment_zscores(x.profile_of(*DI.Z_METRICS)))
dq("diversity_class", f"""SELECT seg, diversity_pct, CASE WHEN diversity_pct >= 60 THEN 'Generalist'
    WHEN diversity_pct >= 35 THEN 'Moderate' ELSE 'Specialist' END AS diversity_class
FROM (SELECT seg, CAST(floor(avg_diversity * {D} + 0.5) AS BIGINT) AS diversity_pct FROM prof)""", ["prof"],
   lambda x: DI.diversity_class(x.profile_of("avg_diversity")))
dq("affinity_profile", """SELECT seg, top3_share, CASE WHEN top3_share >= 85 THEN 'Specialist' WHEN top3_share >= 65 THEN 'Focused'
    ELSE 'Diverse' END AS affinity FROM (SELECT seg, sum(share) AS top3_share FROM catshare WHERE rank <= 3 GROUP BY seg)""",
   ["catshare"], lambda x: DI.affinity_profile(x.cat_share))
dq("segment_category_matrix", """SELECT category, seg, share, avg(share) OVER w AS mean_share,
    CASE WHEN max(share) OVER w > 0 THEN share / max(share) OVER w ELSE 0.0 END AS intensity, sum(share) OVER w AS total_share
FROM (SELECT g.category, g.seg, COALESCE(c.share, 0.0) AS share
      FROM (SELECT DISTINCT category FROM catshare) cc, LATERAL (SELECT cc.category,
            unnest(range((SELECT min(seg) FROM catshare), (SELECT max(seg) FROM catshare) + 1)) AS seg) g
      LEFT JOIN catshare c ON c.seg = g.seg AND c.category = g.category)
WINDOW w AS (PARTITION BY category)""", ["catshare"], lambda x: DI.segment_category_matrix(x.cat_share))
dq("dominant_category", """SELECT category, total_share FROM (SELECT category, sum(share) AS total_share FROM catshare GROUP BY 1)
ORDER BY total_share DESC, category LIMIT 1""", ["catshare"], lambda x: DI.dominant_category(x.cat_share))
dq("recent_months", """SELECT ym, revenue, CAST(pos AS INTEGER) AS pos FROM (SELECT ym, revenue, row_number() OVER (ORDER BY ym DESC) AS pos
FROM mrev) WHERE pos <= 14""", ["mrev"], lambda x: DI.recent_months(x.monthly, 14))
dq("segment_top5_categories", "SELECT seg, rank, category, share FROM catshare WHERE rank <= 5", ["catshare"],
   lambda x: DI.segment_top_categories(x.cat_share, 5))
dq("segment_top_categories", "SELECT seg, rank, category, share FROM catshare WHERE rank <= 3", ["catshare"],
   lambda x: DI.segment_top_categories(x.cat_share, 3))
dq("spend_band_share", f"""SELECT band, n, CAST(floor(CAST(n AS DOUBLE) / sum(n) OVER () * {D} + 0.5) AS BIGINT) AS pct FROM ({_bands_sql("total_spend", 100, 500)})""",
   ["features"], lambda x: DI.spend_band_share(K.spend_bands(x.I.features), x.profile))
# the fallback, as for a summary without bands
dq("spend_band_share_by_mean", f"""SELECT band, n, CAST(floor(CAST(n AS DOUBLE) / sum(n) OVER () * {D} + 0.5) AS BIGINT) AS pct
FROM (SELECT b.band, CAST(COALESCE(sum(p.n), 0) AS BIGINT) AS n FROM (VALUES ('high'), ('mid'), ('low')) b(band)
      LEFT JOIN prof p ON b.band = CASE WHEN p.avg_spend >= 500 THEN 'high' WHEN p.avg_spend >= 100 THEN 'mid' ELSE 'low' END GROUP BY 1)""",
   ["prof"], lambda x: DI.spend_band_share(K.spend_bands(x.I.features.limit(0)), x.profile))
dq("net_aov", f"""SELECT seg, net_aov, discount_cost, CAST(floor(avg_aov / max(avg_aov) OVER () * {D} + 0.5) AS BIGINT) AS aov_bar,
    CAST(floor(net_aov / max(net_aov) OVER () * {D} + 0.5) AS BIGINT) AS net_aov_bar,
    CAST(floor(avg_discount / CASE WHEN max(avg_discount) OVER () = 0 THEN 1.0 ELSE max(avg_discount) OVER () END * {D} + 0.5) AS BIGINT) AS discount_bar
FROM (SELECT seg, avg_aov, avg_discount, avg_aov * (1.0 - avg_discount) AS net_aov, avg_aov * avg_discount AS discount_cost FROM prof)""", ["prof"],
   lambda x: DI.net_aov(x.profile))
dq("discount_efficiency", """SELECT seg, avg_discount, CASE WHEN avg_discount < 0.05 THEN 'Efficient' WHEN avg_discount < 0.15
    THEN 'Moderate' ELSE 'Costly' END AS discount_efficiency FROM prof""", ["prof"], lambda x: DI.discount_efficiency(x.profile))
dq("return_status_share", f"""SELECT CASE WHEN n > 0 THEN returned * {D} / n ELSE 0.0 END AS returned_pct,
    CASE WHEN n > 0 THEN canceled * {D} / n ELSE 0.0 END AS canceled_pct
FROM (SELECT count(*) AS n, sum(CASE WHEN return_status = 'Returned' THEN 1 ELSE 0 END) AS returned,
             sum(CASE WHEN return_status = 'Canceled' THEN 1 ELSE 0 END) AS canceled FROM returns)""", ["returns"],
   lambda x: DI.return_status_share(x.I.returns))
dq("segment_kpis", """SELECT seg, n, avg_spend, avg_orders, CASE WHEN avg_orders > 0 THEN avg_spend / avg_orders ELSE 0.0 END AS aov,
    avg_recency, avg_return_rate, avg_clv_slope FROM prof""", ["prof"], lambda x: DI.segment_kpis(x.profile))
_BARS = {"recency_bar": "(1 - sum(avg_recency * n) / sum(n) / CASE WHEN max(avg_recency) <> 0 THEN max(avg_recency) ELSE 1.0 END)",
         "ipt_bar": "coalesce(1 - min(avg_ipt) FILTER (avg_ipt > 0) / max(avg_ipt) FILTER (avg_ipt > 0), 0.0)",
         "orders_bar": "(max(avg_orders) - min(avg_orders)) / CASE WHEN max(avg_orders) <> 0 THEN max(avg_orders) ELSE 1.0 END",
         "active_months_bar": "sum(avg_active_months * n) / sum(n) / CASE WHEN max(avg_active_months) <> 0 THEN max(avg_active_months) ELSE 1.0 END",
         "spend_bar": "((max(avg_spend) - min(avg_spend)) / (CASE WHEN max(avg_spend) <> 0 THEN max(avg_spend) ELSE 1.0 END * CAST(1.1 AS DOUBLE) - min(avg_spend)) + 0.4)",
         "aov_bar": "any_value(true_aov) / CASE WHEN max(avg_aov) <> 0 THEN max(avg_aov) ELSE 1.0 END"}
dq("relative_bars", "SELECT " + ", ".join(f"CAST(least(floor(({v}) * {D} + 0.5), 100) AS BIGINT) AS {k}" for k, v in _BARS.items())
   + f" FROM prof, (SELECT true_aov FROM ({_FULFILLED}))", ["prof", "fulfilled"],
   lambda x: DI.relative_bars(x.profile, K.fulfilled_orders(x.I.flines, x.I.returns)))
dq("rev_share_scaled", f"""SELECT seg, revenue / s * total_revenue AS scaled_revenue, CAST(floor(revenue / s * {D} + 0.5) AS BIGINT) AS revenue_share_pct
FROM seg_rev, dedup_rev, (SELECT CASE WHEN sum(revenue) <> 0 THEN sum(revenue) ELSE 1.0 END AS s FROM seg_rev)""", ["seg_rev", "dedup_rev"],
   lambda x: DI.rev_share_scaled(x.seg_rev, C.deduped_paid_revenue(x.I.payment_log)))
_GS_BODY = f"""SELECT t.*, f.*, r.*, n.total_customers FROM ({_TOTALS}) t, ({_FULFILLED}) f, ({_RET}) r,
    (SELECT count(*) AS total_customers FROM features) n"""
_GS_CTES = ["flines", "returns", "fulfilled", "features", "activity"]
dq("report_ratios", f"""SELECT least(CAST(100 AS DOUBLE), active_customers_90 * {D} / total_customers) AS active_pct,
    least(CAST(100 AS DOUBLE), fulfilled_orders * {D} / total_orders) AS fulfilled_pct,
    least(CAST(100 AS DOUBLE), true_aov * {D} / CASE WHEN total_orders > 0 THEN gross_revenue / total_orders END) AS true_aov_pct
FROM ({_GS_BODY})""", _GS_CTES,
   lambda x: DI.report_ratios(K.global_summary(x.I.flines, x.I.returns, x.I.features, x.I.ref)))
dq("aov_proxy_series", f"""SELECT ym, revenue / CASE WHEN total_revenue <> 0 THEN total_revenue ELSE 1.0 END * true_aov AS aov_proxy FROM mrev, dedup_rev,
    (SELECT true_aov FROM ({_FULFILLED}))""", ["mrev", "fulfilled", "dedup_rev"],
   lambda x: DI.aov_proxy_series(x.monthly, K.fulfilled_orders(x.I.flines, x.I.returns), C.deduped_paid_revenue(x.I.payment_log)))

# ---- P: rules, alerts, campaigns --------------------------------------------------------
from cohortlab.functions.fixed import INTENT_RULES as _RULES  # noqa: E402
from cohortlab.operators import campaigns as CP  # noqa: E402
from cohortlab.operators import text as TX  # noqa: E402
from cohortlab.streaming import lockout as LK  # noqa: E402


def _counts_named(s, d):
    f = _segments_of(s, d, "spend_365", "recency")
    names = M.name_segments(f, 4).select("seg", F.col("name").alias("segment"))
    return G.segment_counts(f).select("seg", "customers").join(names, "seg")


O.cte("counts_named", ["segf", "seg_names"], """SELECT seg, customers, segment FROM
    (SELECT seg, count(*) AS customers FROM segf GROUP BY seg) JOIN seg_names USING (seg)""")
O.cte("raw_campaigns", [], """SELECT 'c' || CAST(k AS VARCHAR) AS id,
    (['VIP', 'Loyal', 'At Risk', 'Lost', 'All Customers'])[k % 5 + 1] AS segment,
    (['Email', 'WhatsApp', 'Email + WhatsApp', 'SMS'])[k % 4 + 1] AS channel,
    CASE WHEN k % 6 = 0 THEN NULL ELSE 'Offer ' || CAST(k AS VARCHAR) END AS subject,
    CASE WHEN k % 4 = 1 THEN NULL ELSE 'Hello ' || CAST(k AS VARCHAR) END AS body,
    CAST(k % 30 AS DOUBLE) AS discount, (['pending', 'sent', 'cancelled'])[k % 3 + 1] AS status,
    created_at, 'admin' AS created_by, n * 10 AS recipients
FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, min(ts) AS created_at, count(*) AS n FROM events GROUP BY 1)""")
O.cte("raw_sends", [], """SELECT CASE WHEN email THEN 'e' ELSE 'w' END || CAST(event_id AS VARCHAR) AS id,
    CASE WHEN email THEN 'email' ELSE 'whatsapp' END AS kind,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE cid END AS campaign_id, segment,
    CASE WHEN email THEN COALESCE(subject, cid) END AS subject,
    CASE WHEN NOT email THEN COALESCE(body, subject, '') END AS message,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'queued' ELSE 'sent' END AS status,
    ts AS created_at, 1 AS recipients
FROM (SELECT event_id, ts, event_type, event_id % 2 = 0 AS email, 'c' || CAST(k AS VARCHAR) AS cid,
             (['VIP', 'Loyal', 'At Risk', 'Lost', 'All Customers'])[k % 5 + 1] AS segment,
             CASE WHEN k % 6 = 0 THEN NULL ELSE 'Offer ' || CAST(k AS VARCHAR) END AS subject,
             CASE WHEN k % 4 = 1 THEN NULL ELSE 'Hello ' || CAST(k AS VARCHAR) END AS body
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""")


def _open_alerts(s):
    return s.createDataFrame([], "type string, segment string, current_pct double, baseline_pct double, delta double, "
                                 "severity string, acknowledged boolean")


q("segment_alerts", O.sql(f"""SELECT type, segment, pct AS current_pct, pct - delta AS baseline_pct, delta, severity
FROM (SELECT *, customers * {D} / sum(customers) OVER () AS pct FROM counts_named) c
JOIN (VALUES """ + ", ".join(f"('{t}', '{n}', {th}, '{sv}', {dl})" for t, n, th, sv, dl in CP.ALERT_RULES) + """)
     r(type, name_lc, threshold, severity, delta) ON lower(c.segment) = r.name_lc
WHERE pct > threshold""", "counts_named"))(lambda s, d: CP.segment_alerts(_counts_named(s, d), _open_alerts(s)))


def _alert_history(s, d):
    """Snapshots: a day's customers by label; acknowledgements: the days of some orders."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("at"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("VIP", "Loyal", "At Risk", "Lost")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    snapshots = o.groupBy("at", name.alias("segment")).agg(F.count_distinct("o_custkey").alias("customers"))
    acks = o.filter("o_orderkey % 50 = 0").select(F.lit("at_risk_high").alias("type"), "at") \
        .union(o.filter("o_orderkey % 70 = 0").select(F.lit("lost_high").alias("type"), "at"))
    return CP.alert_history(snapshots, acks)


O.cte("alert_spans", [], """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS t FROM orders),
n AS (SELECT t, c % 4 AS seg, count(DISTINCT c) AS customers FROM o GROUP BY 1, 2),
p AS (SELECT *, customers * CAST(100 AS DOUBLE) / sum(customers) OVER (PARTITION BY t) AS pct FROM n),
b AS (SELECT 'at_risk_high' AS type, 'At Risk' AS segment, 'warning' AS severity, CAST(5 AS DOUBLE) AS delta, t, pct FROM p WHERE seg = 2 AND pct > 35
      UNION ALL SELECT 'lost_high', 'Lost', 'error', CAST(8 AS DOUBLE), t, pct FROM p WHERE seg = 3 AND pct > 40),
a AS (SELECT DISTINCT 'at_risk_high' AS type, t FROM o WHERE k % 50 = 0 UNION SELECT DISTINCT 'lost_high', t FROM o WHERE k % 70 = 0),
e AS (SELECT b.*, (SELECT max(a.t) FROM a WHERE a.type = b.type AND a.t < b.t) AS since FROM b),
g AS (SELECT type, segment, severity, delta, since, min(t) AS opened_at, arg_min(pct, t) AS current_pct, count(*) AS breaches FROM e GROUP BY ALL)
SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY opened_at) AS INTEGER) AS opening, segment, severity, current_pct,
       current_pct - delta AS baseline_pct, delta, opened_at, (SELECT min(a.t) FROM a WHERE a.type = g.type AND a.t >= g.opened_at) AS closed_at, breaches FROM g""")
q("alert_history", O.sql("SELECT * FROM alert_spans", "alert_spans"))(_alert_history)
q("live_alerts", O.sql("""SELECT type, segment, current_pct, baseline_pct, delta, severity, false AS acknowledged FROM alert_spans
WHERE closed_at IS NULL""", "alert_spans"))(lambda s, d: CP.open_alerts(_alert_history(s, d)))


def _notif(s, d):
    I = Inputs(s, d)
    cs = DI.category_share(K.category_revenue(I.flines))
    return CP.smart_notifications(_counts_named(s, d), _seg_drift(I), K.yoy_growth(I.flines), cs)


q("smart_notifications", O.sql(f"""SELECT *, CAST(row_number() OVER (ORDER BY CAST(read AS INTEGER),
        CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, age_s) AS INTEGER) AS position
FROM (
  SELECT 'at-risk-high' AS id, 'alert' AS category, CASE WHEN pct_r >= 25 THEN 'high' ELSE 'medium' END AS priority,
         false AS read, 300 AS age_s, CAST(pct_r AS DOUBLE) AS value
  FROM (SELECT * FROM cn WHERE lower(segment) LIKE '%at risk%' ORDER BY seg LIMIT 1) WHERE customers > 0 AND pct_r >= 15
  UNION ALL SELECT 'lost-seg', 'action', 'high', false, 720, pct_r
  FROM (SELECT * FROM cn WHERE lower(segment) LIKE '%lost%' ORDER BY seg LIMIT 1) WHERE customers > 0 AND pct_r >= 10
  UNION ALL SELECT 'vip-revenue', 'insight', 'medium', false, 1800, share
  FROM (SELECT * FROM cn WHERE lower(segment) LIKE '%vip%' ORDER BY seg LIMIT 1) v
  JOIN (SELECT seg, floor(revenue * {D} / sum(revenue) OVER () + 0.5) AS share FROM seg_rev) r USING (seg) WHERE share >= 40
  UNION ALL SELECT 'yoy-negative', 'alert', 'high', false, 3600, yoy_pct FROM yoy WHERE yoy_pct IS NOT NULL AND yoy_pct < 0
  UNION ALL SELECT 'yoy-strong', 'insight', 'low', false, 7200, yoy_pct FROM yoy WHERE yoy_pct IS NOT NULL AND yoy_pct > 100
  UNION ALL SELECT 'category-concentration', 'insight', 'low', true, 14400, pct FROM (
      SELECT floor(revenue * {D} / sum(revenue) OVER () + 0.5) AS pct, row_number() OVER (ORDER BY revenue DESC, category) AS rank
      FROM (SELECT category, CAST(sum(net_amount) AS DOUBLE) AS revenue FROM flines GROUP BY 1)) WHERE rank = 1 AND pct >= 50
  UNION ALL SELECT 'data-loaded', 'system', 'low', true, 10, CAST(sum(customers) AS DOUBLE) FROM cn)""".replace(
    "FROM cn", "FROM (SELECT *, round(customers * CAST(100 AS DOUBLE) / sum(customers) OVER ()) AS pct_r FROM counts_named)"),
    "counts_named", "seg_rev", "yoy", "flines"))(_notif)
O.cte("camp_aud", ["raw_campaigns", "counts_named"], """SELECT c.id, c.segment,
    CASE WHEN c.segment IS NULL OR c.segment = 'All Customers' THEN (CASE WHEN t.total > 0 THEN t.total END)
         ELSE (CASE WHEN n.customers > 0 THEN n.customers END) END AS audience
FROM raw_campaigns c LEFT JOIN counts_named n ON n.segment = c.segment, (SELECT sum(customers) AS total FROM counts_named) t""")
q("campaign_audience", O.sql("SELECT * FROM camp_aud", "camp_aud"))(
    lambda s, d: CP.campaign_audience(A.raw_campaigns(s, d), _counts_named(s, d)))
q("cap_recipients", O.sql("""SELECT c.id, greatest(0, CASE WHEN a.audience IS NOT NULL AND c.recipients > a.audience THEN a.audience
    ELSE c.recipients END) AS recipients FROM raw_campaigns c JOIN camp_aud a USING (id)""", "raw_campaigns", "camp_aud"))(
    lambda s, d: CP.campaign_audience(A.raw_campaigns(s, d), _counts_named(s, d)).join(A.raw_campaigns(s, d).select("id", "recipients"), "id")
    .select("id", CP.cap_recipients("recipients", "audience").alias("recipients")))
O.cte("links", ["raw_campaigns", "raw_sends"], """
SELECT s.campaign_id AS campaign, s.id AS send_id, s.kind, s.status FROM raw_sends s JOIN raw_campaigns c ON c.id = s.campaign_id
UNION ALL
SELECT c.id, s.id, s.kind, s.status FROM raw_sends s JOIN raw_campaigns c
  ON s.campaign_id IS NULL AND s.segment = c.segment
 AND ((s.kind = 'email' AND s.subject = COALESCE(c.subject, c.id)) OR (s.kind = 'whatsapp' AND s.message = COALESCE(c.body, c.subject, '')))""")
q("link_sends", O.sql("SELECT * FROM links", "links"))(lambda s, d: CP.link_sends(A.raw_campaigns(s, d), A.raw_sends(s, d)))
q("campaign_status_rollup", O.sql("""SELECT c.id, c.segment, c.status AS old_status,
    CASE WHEN r.all_sent IS NULL THEN c.status WHEN r.all_sent THEN 'sent' WHEN r.all_failed THEN 'cancelled' ELSE 'pending' END AS status
FROM raw_campaigns c LEFT JOIN (SELECT campaign_id AS id, bool_and(status = 'sent') AS all_sent, bool_and(status = 'failed') AS all_failed
                                FROM raw_sends WHERE campaign_id IS NOT NULL GROUP BY 1) r USING (id)""", "raw_campaigns", "raw_sends"))(
    lambda s, d: CP.campaign_status_rollup(A.raw_campaigns(s, d), A.raw_sends(s, d)))
q("active_campaigns", O.sql("""SELECT c.* FROM raw_campaigns c LEFT JOIN (SELECT DISTINCT segment AS s FROM seg_names) a ON a.s = c.segment
WHERE c.status <> 'pending' OR a.s IS NOT NULL OR c.segment = 'All Customers' OR coalesce(c.segment, '') = ''""", "raw_campaigns", "seg_names"))(
    lambda s, d: CP.active_campaigns(A.raw_campaigns(s, d), M.name_segments(_segments_of(s, d, "spend_365", "recency"), 4).select(F.col("name").alias("segment"))))
q("clean_campaigns", O.sql("""SELECT c.* FROM raw_campaigns c LEFT JOIN (SELECT DISTINCT segment AS s FROM seg_names) a ON a.s = c.segment
WHERE c.status = 'sent' OR a.s IS NOT NULL OR c.segment = 'All Customers' OR coalesce(c.segment, '') = ''""", "raw_campaigns", "seg_names"))(
    lambda s, d: CP.clean_campaigns(A.raw_campaigns(s, d), M.name_segments(_segments_of(s, d, "spend_365", "recency"), 4).select(F.col("name").alias("segment"))))
q("removed_segments", O.sql("""SELECT DISTINCT name AS segment FROM (VALUES """ + ", ".join(
    f"('{r[0]}')" for r in FX.SEGMENT_TEMPLATES[7]) + """) t(name)
WHERE name NOT IN (SELECT segment FROM seg_names)""", "seg_names"))(
    lambda s, d: CP.removed_segments(M.templates(s, 7).select(F.col("name").alias("segment")),
                                     M.name_segments(_segments_of(s, d, "spend_365", "recency"), 4).select(F.col("name").alias("segment"))))
q("search_campaigns", O.sql("""SELECT * FROM raw_campaigns WHERE status = 'sent' AND (COALESCE(contains(lower(segment), 'offer 1'), false)
    OR COALESCE(contains(lower(channel), 'offer 1'), false) OR COALESCE(contains(lower(subject), 'offer 1'), false))""", "raw_campaigns"))(
    lambda s, d: CP.search_campaigns(A.raw_campaigns(s, d), q="Offer 1", status="sent"))
q("campaign_counts", O.sql("SELECT status, count(*) AS n FROM raw_campaigns GROUP BY 1", "raw_campaigns"))(
    lambda s, d: CP.campaign_counts(A.raw_campaigns(s, d)))
q("normalize_channel", O.sql("""SELECT id, CASE WHEN contains(c, 'whatsapp') AND contains(c, 'email') THEN 'email-whatsapp'
    WHEN contains(c, 'whatsapp') THEN 'whatsapp' WHEN contains(c, 'email') THEN 'email' WHEN contains(c, 'sms') THEN 'sms'
    WHEN contains(c, 'push') THEN 'push' ELSE 'default' END AS channel_kind
FROM (SELECT id, regexp_replace(regexp_replace(lower(COALESCE(channel, '')), '\\s+', '', 'g'), '\\+', '-', 'g') AS c FROM raw_campaigns)""",
                            "raw_campaigns"))(
    lambda s, d: A.raw_campaigns(s, d).select("id", CP.normalize_channel("channel").alias("channel_kind")))
q("build_send_list", O.sql("""SELECT c.id AS campaign_id, x.customer_id, x.phone FROM raw_campaigns c JOIN
    (SELECT customer_id, phone, segment FROM scored UNION ALL SELECT customer_id, phone, 'All Customers' FROM scored) x
    ON x.segment = c.segment""", "raw_campaigns", "scored"))(
    lambda s, d: CP.build_send_list(_scored(s, d), A.raw_campaigns(s, d)))
q("expand_campaign_sends", O.sql("""SELECT id AS campaign_id, 'email' AS kind, segment, COALESCE(subject, id) AS subject,
    CAST(NULL AS VARCHAR) AS message, body, discount, COALESCE(recipients, 0) AS recipients, 'queued' AS status, created_at, created_by
FROM raw_campaigns WHERE contains(lower(COALESCE(channel, '')), 'email')
UNION ALL SELECT id, 'whatsapp', segment, NULL, COALESCE(body, subject, ''), NULL, NULL, COALESCE(recipients, 0), 'queued', created_at, created_by
FROM raw_campaigns WHERE contains(lower(COALESCE(channel, '')), 'whatsapp')""", "raw_campaigns"))(
    lambda s, d: CP.expand_campaign_sends(A.raw_campaigns(s, d)))
q("propagate_campaign_status", O.sql("""SELECT l.send_id, l.campaign, l.kind, l.status AS old_status,
    CASE WHEN c.status = 'sent' THEN 'sent' WHEN c.status = 'cancelled' THEN 'failed' ELSE 'queued' END AS status
FROM links l JOIN raw_campaigns c ON c.id = l.campaign""", "links", "raw_campaigns"))(
    lambda s, d: CP.propagate_campaign_status(A.raw_campaigns(s, d), A.raw_sends(s, d)))
q("merge_new_campaigns", O.sql("""SELECT * FROM raw_campaigns WHERE status = 'sent'
UNION ALL SELECT * FROM raw_campaigns WHERE id NOT IN (SELECT id FROM raw_campaigns WHERE status = 'sent')""", "raw_campaigns"))(
    lambda s, d: CP.merge_new_campaigns(A.raw_campaigns(s, d).filter(F.col("status") == "sent"), A.raw_campaigns(s, d)))

q("replace_campaigns", O.sql("""SELECT * REPLACE (CASE WHEN status = 'sent' THEN 'cancelled' ELSE status END AS status) FROM raw_campaigns""",
                             "raw_campaigns"))(
    lambda s, d: CP.replace_campaigns(A.raw_campaigns(s, d), A.raw_campaigns(s, d).filter(F.col("status") == "sent").withColumn("status", F.lit("cancelled"))))
q("search_sends", O.sql("""SELECT * FROM raw_sends WHERE status = 'sent' AND (COALESCE(contains(lower(segment), 'hello 1'), false)
    OR COALESCE(contains(lower(CASE WHEN kind = 'email' THEN subject ELSE message END), 'hello 1'), false))""", "raw_sends"))(
    lambda s, d: CP.search_sends(A.raw_sends(s, d), q="Hello 1", status="sent"))
q("drop_deleted_sends", O.sql("""SELECT s.* FROM raw_sends s WHERE s.id NOT IN (SELECT send_id FROM links l JOIN raw_campaigns c ON c.id = l.campaign
    WHERE c.status = 'cancelled')""", "raw_sends", "raw_campaigns", "links"))(
    lambda s, d: CP.drop_deleted_sends(A.raw_campaigns(s, d).filter(F.col("status") == "cancelled"), A.raw_sends(s, d)))
q("sync_sends", O.sql("""SELECT s.* REPLACE (
    CASE WHEN l.campaign IS NOT NULL AND s.kind = 'email' THEN 'New ' || l.campaign ELSE s.subject END AS subject,
    CASE WHEN l.campaign IS NOT NULL AND s.kind <> 'email' THEN COALESCE(NULLIF(c.body, ''), 'New ' || l.campaign) ELSE s.message END AS message,
    CASE WHEN l.campaign IS NOT NULL THEN COALESCE(c.recipients, s.recipients) ELSE s.recipients END AS recipients),
    CASE WHEN l.campaign IS NOT NULL AND s.kind = 'email' THEN c.body ELSE 'old' END AS body,
    CASE WHEN l.campaign IS NOT NULL AND s.kind = 'email' THEN c.discount ELSE CAST(-1 AS DOUBLE) END AS discount
FROM raw_sends s LEFT JOIN (SELECT send_id, min(campaign) AS campaign FROM links WHERE campaign IN (SELECT id FROM raw_campaigns WHERE status = 'pending')
                            GROUP BY 1) l ON l.send_id = s.id LEFT JOIN raw_campaigns c ON c.id = l.campaign""", "raw_sends", "raw_campaigns", "links"))(
    lambda s, d: CP.sync_sends(A.raw_campaigns(s, d).filter(F.col("status") == "pending").withColumn("subject", F.concat(F.lit("New "), F.col("id"))),
                               A.raw_campaigns(s, d), A.raw_sends(s, d).withColumns({"body": F.lit("old"), "discount": F.lit(-1.0)})))



def _campaign_log(s, d):
    """Every send as an edit of its campaign; failed ones are tombstones."""
    return A.raw_sends(s, d).select(
        F.col("campaign_id").alias("id"), "segment", F.col("kind").alias("channel"), F.concat(F.lit("Edit "), "id").alias("subject"),
        F.col("message").alias("body"), F.lit(7.0).alias("discount"), "status", "created_at", F.lit("log").alias("created_by"),
        (F.col("recipients") * 3).cast("long").alias("recipients"), F.col("created_at").alias("changed_at"), F.col("id").alias("seq"),
        (F.col("status") == "failed").alias("deleted"))


def _campaigns_before(s, d):
    return A.raw_campaigns(s, d).filter("status <> 'cancelled'")


O.cte("campaign_log", ["raw_sends"], """
SELECT * FROM (SELECT campaign_id AS id, segment, kind AS channel, 'Edit ' || id AS subject, message AS body, CAST(7 AS DOUBLE) AS discount, status,
                      created_at, 'log' AS created_by, CAST(3 * recipients AS BIGINT) AS recipients, status = 'failed' AS deleted,
                      row_number() OVER (PARTITION BY campaign_id ORDER BY created_at DESC, id DESC) AS r FROM raw_sends WHERE campaign_id IS NOT NULL)
WHERE r = 1""")
q("fold_campaign_log", O.sql("""SELECT * EXCLUDE (deleted, r) FROM campaign_log WHERE NOT deleted
UNION ALL SELECT * FROM raw_campaigns WHERE status <> 'cancelled' AND id NOT IN (SELECT id FROM campaign_log)""", "campaign_log", "raw_campaigns"))(
    lambda s, d: CP.fold_changes(_campaigns_before(s, d), _campaign_log(s, d), ("changed_at", "seq")))
q("fold_campaign_log_sends", O.sql("""SELECT s.* REPLACE (
    CASE WHEN g.id IS NOT NULL AND s.kind = 'email' THEN g.subject ELSE s.subject END AS subject,
    CASE WHEN g.id IS NOT NULL AND s.kind <> 'email' THEN COALESCE(NULLIF(g.body, ''), g.subject) ELSE s.message END AS message,
    CASE WHEN g.id IS NOT NULL THEN g.recipients ELSE s.recipients END AS recipients,
    CASE WHEN g.status <> c.status THEN (CASE g.status WHEN 'sent' THEN 'sent' WHEN 'cancelled' THEN 'failed' ELSE 'queued' END) ELSE s.status END AS status)
FROM raw_sends s
LEFT JOIN (SELECT l.send_id, min(l.campaign) AS campaign FROM links l JOIN campaign_log x ON x.id = l.campaign JOIN raw_campaigns o ON o.id = l.campaign
           WHERE NOT x.deleted AND o.status <> 'cancelled' GROUP BY 1) l ON l.send_id = s.id
LEFT JOIN campaign_log g ON g.id = l.campaign LEFT JOIN raw_campaigns c ON c.id = l.campaign
WHERE s.id NOT IN (SELECT l.send_id FROM links l JOIN campaign_log x ON x.id = l.campaign JOIN raw_campaigns o ON o.id = l.campaign
                   WHERE x.deleted AND o.status <> 'cancelled')""", "raw_sends", "campaign_log", "links", "raw_campaigns"))(
    lambda s, d: CP.fold_changes_into_sends(_campaigns_before(s, d), _campaign_log(s, d), A.raw_sends(s, d), ("changed_at", "seq")))

# ---- T: text over the conversations table -----------------------------------------------
from cohortlab.functions.columns import ACCENTS_FROM as _AF, ACCENTS_TO as _AT  # noqa: E402


def _norm_sql(col):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({col}), '{_AF}', '{_AT}'), "
            f"'[\\x{{0300}}-\\x{{036F}}]', '', 'g'), '[^A-Za-z0-9_\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))")


def _esc(x):
    return x.replace("'", "''")


def _intent_sql(n):
    parts = []
    for intent, kws, excl in _RULES:
        has = " OR ".join(f"contains({n}, '{_esc(k)}')" for k in kws)
        cond = f"({has})" + (f" AND NOT ({' OR '.join(f'contains({n}, {chr(39)}{_esc(k)}{chr(39)})' for k in excl)})" if excl else "")
        parts.append(f"WHEN {cond} THEN '{intent}'")
    return "CASE " + " ".join(parts) + " END"


def _conv(s, d):
    return A.table(s, d, "conversations", "conv_id", "turn", "role", "text")


q("normalize_text", O.sql(f"SELECT conv_id, turn, {_norm_sql('text')} AS normalized FROM conversations"))(
    lambda s, d: TX.normalized_messages(_conv(s, d)).select("conv_id", "turn", "normalized"))
q("tag_intents", O.sql(f"SELECT conv_id, turn, {_intent_sql('n')} AS intent FROM (SELECT conv_id, turn, {_norm_sql('text')} AS n "
                       "FROM conversations WHERE role = 'user')"))(
    lambda s, d: TX.tag_intents(_conv(s, d).filter(F.col("role") == "user")).select("conv_id", "turn", "intent"))
q("intent_coverage", O.sql(f"""SELECT count(*) AS total, count(intent) AS answered_locally, count(*) - count(intent) AS not_answered
FROM (SELECT {_intent_sql('n')} AS intent FROM (SELECT {_norm_sql('text')} AS n FROM conversations WHERE role = 'user'))"""))(
    lambda s, d: TX.intent_coverage(TX.tag_intents(_conv(s, d).filter(F.col("role") == "user"))))
q("extract_structured_reply", O.sql("""SELECT conv_id, turn,
    COALESCE(CASE WHEN starts_with(trim(cl), '{') AND json_valid(cl) THEN json_extract_string(cl, '$.response') END,
             CASE WHEN emb <> '' AND json_valid(emb) THEN json_extract_string(emb, '$.response') END, text) AS response,
    CASE WHEN starts_with(trim(cl), '{') AND json_valid(cl) AND json_extract_string(cl, '$.response') IS NOT NULL
              THEN json_extract_string(cl, '$.action')
         WHEN emb <> '' AND json_valid(emb) AND json_extract_string(emb, '$.response') IS NOT NULL
              THEN json_extract_string(emb, '$.action') END AS action
FROM (SELECT conv_id, turn, text,
             regexp_replace(trim(regexp_replace(trim(text), '(?m)^```(?:json)?\\s*', '', 'g')), '(?m)\\s*```$', '', 'g') AS cl,
             regexp_extract(text, '(\\{[\\s\\S]*"response"[\\s\\S]*\\})', 1) AS emb
      FROM conversations WHERE role = 'assistant')"""))(
    lambda s, d: TX.extract_structured_reply(_conv(s, d).filter(F.col("role") == "assistant")).select("conv_id", "turn", "response", "action"))
# replies with fenced action blocks, derived from the events: some without a type, some without a label
_REPLIES = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Plain reply ' || event_type
    WHEN event_id % 3 = 1 THEN 'Done. ```json {"action": {"type": "' || event_type || '", "params": ' || props || '}} ```'
    ELSE '```json {"action": {"label": "Go"}} ``` bye' END AS text FROM events"""


def _replies(s, d):
    e = A.table(s, d, "events", "event_id", "event_type", "props")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Plain reply "), F.col("event_type")))
                    .when(F.col("event_id") % 3 == 1, F.concat(F.lit('Done. ```json {"action": {"type": "'), F.col("event_type"),
                                                             F.lit('", "params": '), F.col("props"), F.lit("}} ```")))
                    .otherwise(F.lit('```json {"action": {"label": "Go"}} ``` bye')).alias("text"))


q("extract_action_block", f"""SELECT event_id, CASE WHEN event_id % 3 = 1 THEN json_extract_string(b, '$.action.type') END AS action_type,
    CASE WHEN event_id % 3 = 1 THEN 'Execute action' END AS action_label,
    CASE WHEN event_id % 3 = 1 THEN 'Done.' ELSE text END AS clean_text
FROM (SELECT *, regexp_extract(text, '(?s)```json\\s*(.*?)\\s*```', 1) AS b FROM ({_REPLIES}))""")(
    lambda s, d: TX.extract_action_block(_replies(s, d)).select("event_id", "action_type", "action_label", "clean_text"))
q("intent_answer_facts", O.sql(f"""SELECT p.seg, n.segment, p.n AS count, p.n * {D} / sum(p.n) OVER () AS pct, p.avg_spend, p.avg_aov,
    p.avg_orders, p.avg_recency FROM prof p LEFT JOIN seg_names n USING (seg)""", "prof", "seg_names"))(
    lambda s, d: TX.intent_answer_facts(_profile(s, d),
                                        M.name_segments(_segments_of(s, d, "spend_365", "recency"), 4).select("seg", F.col("name").alias("segment"))))
q("recent_turns", O.sql("""SELECT * FROM (SELECT conv_id, turn, role, text,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS position FROM conversations) WHERE position <= 14"""))(
    lambda s, d: TX.recent_turns(_conv(s, d)))
q("recent_context", O.sql("""SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position FROM conversations)
WHERE position <= 14 GROUP BY 1"""))(
    lambda s, d: TX.recent_context(_conv(s, d)).select("conv_id", F.size("context").cast("long").alias("turns"), F.array_join(
        F.transform("context", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("context")))

# ---- X: stateful lockout; days instead of seconds, so that locks do happen on the given events ----
_DAY = 86_400
_LOCKS = {"max_attempts": 2, "window": 20 * _DAY, "lockout": 5 * _DAY}
O.cte("lock_in", [], """SELECT user_id AS key, ts, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS kind,
  epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
FROM events WHERE event_type IN ('error', 'purchase')""")
_LOCK = """WITH RECURSIVE lock_in AS (""" + O.CTES["lock_in"][1] + """),
f AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ts, '' AS kind, '' AS outcome, 0 AS fail_count,
         CAST(0 AS DOUBLE) AS started, CAST(0 AS DOUBLE) AS locked FROM lock_in
  UNION ALL
  SELECT f.key, a.rn, a.ts, a.kind,
    CASE WHEN a.t < f.locked THEN 'rejected' WHEN a.kind = 'success' THEN 'success'
         WHEN CASE WHEN a.t - f.started > 1728000 THEN 0 ELSE f.fail_count END + 1 >= 2 THEN 'locked' ELSE 'failure' END,
    CASE WHEN a.t < f.locked THEN f.fail_count WHEN a.kind = 'success' THEN 0
         WHEN CASE WHEN a.t - f.started > 1728000 THEN 0 ELSE f.fail_count END + 1 >= 2 THEN 0
         ELSE CASE WHEN a.t - f.started > 1728000 THEN 0 ELSE f.fail_count END + 1 END,
    CASE WHEN a.t < f.locked THEN f.started WHEN a.kind = 'success' THEN 0 WHEN a.t - f.started > 1728000 THEN a.t ELSE f.started END,
    CASE WHEN a.t < f.locked THEN f.locked WHEN a.kind = 'success' THEN 0
         WHEN CASE WHEN a.t - f.started > 1728000 THEN 0 ELSE f.fail_count END + 1 >= 2 THEN a.t + 432000 ELSE 0 END
  FROM f JOIN lock_in a ON a.key = f.key AND a.rn = f.rn + 1)
"""
_EVENTS = ("event_id", "ts", "user_id", "event_type")
q("failed_attempt_lockout", _LOCK + """SELECT key, ts, kind, outcome, fail_count,
    CASE WHEN locked > 0 THEN make_timestamp(CAST(round(locked * 1000000) AS BIGINT)) END AS locked_until FROM f WHERE rn > 0""")(
    lambda s, d: LK.failed_attempt_lockout(A.table(s, d, "events", *_EVENTS), **_LOCKS))
q("lockout_summary", _LOCK + """SELECT key, count(*) AS attempts, sum(CAST(kind = 'failure' AS INTEGER))::BIGINT AS failures,
    sum(CAST(outcome = 'locked' AS INTEGER))::BIGINT AS lockouts, sum(CAST(outcome = 'rejected' AS INTEGER))::BIGINT AS rejected
FROM f WHERE rn > 0 GROUP BY key""")(
    lambda s, d: LK.lockout_summary(LK.failed_attempt_lockout(A.table(s, d, "events", *_EVENTS), **_LOCKS)))

# ---- K20: the keyed parts of the summary, from the queries that give them -------------------
_SECTIONS = {"total_revenue": ("deduped_paid_revenue", ["total_revenue"]), "monthly_revenue": ("monthly_revenue", ["ym", "revenue"]),
             "monthly_aov": ("monthly_aov", ["ym", "aov"]), "category_revenue": ("category_revenue", ["category", "revenue"]),
             "distributions": ("distributions", ["dimension", "value", "n"]), "returns": ("return_breakdown", ["dimension", "value", "n"]),
             "spend_bands": ("spend_bands", ["band", "n"]), "velocity_bands": ("velocity_bands", ["band", "n"]),
             "top_products": ("quarterly_top_products", ["quarter", "rank", "name", "revenue"]),
             "top_categories": ("quarterly_top_categories", ["quarter", "rank", "name", "revenue"]),
             "revenue_by_segment": ("fix_rounding_drift", ["seg", "revenue"]),
             "gateways": ("gateway_distribution", ["payment_gateway", "n"]), "payment_status": ("status_distribution", ["status", "n"])}
q("summary_sections", " UNION ALL ".join(
    f"SELECT '{name}' AS section, concat_ws('/', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols[:-1])}) AS key, CAST({cols[-1]} AS DOUBLE) AS value FROM ({ORACLE[src]})"
    if cols[:-1] else f"SELECT '{name}' AS section, '' AS key, CAST({cols[-1]} AS DOUBLE) AS value FROM ({ORACLE[src]})"
    for name, (src, cols) in _SECTIONS.items()))(
    lambda s, d: _sections(s, d))


def _sections(s, d):
    """Every section reads the lines that are stored first, rather than lines of its own."""
    Inputs(s, d).lines_for("customer_id", "order_id", "order_date", "net_amount", "discount_pct", "product_id", "category", "channel", keep=True)
    return K.summary_sections(**{name: QUERIES[src](s, d).select(*cols) for name, (src, cols) in _SECTIONS.items()})


# Totals and failure share beside the gateways and statuses
q("payment_overview", " UNION ALL ".join(
    [f"SELECT '{c}' AS section, '' AS key, CAST({c} AS DOUBLE) AS value FROM ({ORACLE['payment_stats']})" for c in ("total_payment_logs", "payment_failure_rate", "total_revenue")]
    + [f"SELECT '{n}' AS section, {k} AS key, CAST(n AS DOUBLE) AS value FROM ({ORACLE[src]})" for n, src, k in
       (("gateways", "gateway_distribution", "payment_gateway"), ("statuses", "status_distribution", "status"))]))(
    lambda s, d: K.summary_sections(**{c: C.payment_stats(A.raw_payment_log(s, d)).select(c) for c in ("total_payment_logs", "payment_failure_rate", "total_revenue")},
                                    gateways=C.gateway_distribution(A.raw_payment_log(s, d)), statuses=C.status_distribution(A.raw_payment_log(s, d))))


# ---- S4, S7: written and read back -----------------------------------------------------------
def _csv_round_trip(s, d):
    from cohortlab.session import ensure_checkpoint_dir
    import uuid
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/cohortlab-tables/export-{uuid.uuid4().hex}"
    S.export_csv(S.read_table(s, f"{d}/customer.parquet", columns=["c_custkey", "c_name", "c_mktsegment"]), path)
    return S.read_table(s, path, fmt="csv").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


def _table_round_trip(s, d):
    from cohortlab.session import ensure_checkpoint_dir
    import uuid
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/cohortlab-tables/written-{uuid.uuid4().hex}"
    S.write_table(S.read_table(s, f"{d}/nation.parquet", columns=["n_nationkey", "n_name", "n_regionkey"]), path, partition_by=["n_regionkey"])
    return S.read_table(s, path).select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _result_set(s, d):
    """Two sets published one after the other, the second made of the first; then a third that is never published."""
    from cohortlab.session import ensure_checkpoint_dir
    from cohortlab.sources import result_sets as R
    import uuid
    root = f"{ensure_checkpoint_dir(s).rstrip('/')}/cohortlab-tables/sets-{uuid.uuid4().hex}"
    R.write_set(s, root, {"campaigns": A.raw_campaigns(s, d), "sends": A.raw_sends(s, d)})
    R.write_set(s, root, {"campaigns": R.read_result(s, root, "campaigns").filter("status = 'sent'"), "sends": R.read_result(s, root, "sends")})
    S.write_table(A.raw_campaigns(s, d), f"{R.new_set(root)}/campaigns")
    sends = R.read_result(s, root, "sends").groupBy(F.col("campaign_id").alias("id")).agg(F.count(F.lit(1)).alias("sends"))
    return R.read_result(s, root, "campaigns").select("id", "segment").join(sends, "id", "left")


q("result_set", O.sql("""SELECT id, segment, sends FROM raw_campaigns LEFT JOIN
    (SELECT campaign_id AS id, count(*) AS sends FROM raw_sends GROUP BY 1) USING (id) WHERE status = 'sent'""", "raw_campaigns", "raw_sends"))(_result_set)
q("export_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")(_csv_round_trip)
q("write_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(_table_round_trip)
