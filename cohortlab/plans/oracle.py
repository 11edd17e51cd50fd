"""DuckDB SQL twins of the Spark operators, for the oracle check.

Each canonical entity and operator is a named CTE with its dependencies; ``sql(body, *ctes)``
assembles a self-contained statement over the pre-registered test tables. The SQL is written
independently of the DataFrame code (same semantics, different engine), with the same exact
arithmetic conventions: money summed as DECIMAL, ratios as DOUBLE of exact sums, explicit
tie-breaks in every ranking.
"""

from __future__ import annotations

GUEST = "('', '0', 'none', 'nan', '000000000000000000000000')"
GHOST = "('__unattributed__', '000000000000000000000000', '0', '')"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *names: str) -> str:
    order = _order(names)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


# ---- adapters ---------------------------------------------------------------------------
cte("raw_purchases", [], """
SELECT CAST(o_orderkey AS VARCHAR) AS purchase_id, CAST(o_custkey AS VARCHAR) AS user_id,
       o_orderdate AS creation_date, o_orderdate + INTERVAL 7 DAY AS updated_date,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 WHEN o_orderkey % 2 = 0 THEN 3 ELSE 4 END AS status,
       o_totalprice AS full_amount,
       CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS VARCHAR) AS payment_method,
       CAST(o_orderkey % 2 AS VARCHAR) AS source, CAST(o_custkey % 26 AS VARCHAR) AS country_id,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Brand#' || CAST(o_orderkey % 25 + 1 AS VARCHAR) END AS promotion_code,
       o_orderpriority AS note
FROM orders""")

cte("raw_items", [], """
SELECT CAST(l_orderkey AS VARCHAR) AS purchase_id, CAST(l_partkey AS VARCHAR) AS product_id,
       l_extendedprice / l_quantity AS price, (l_extendedprice / l_quantity) * (1.0 - l_discount) AS sale_price,
       l_discount > 0.05 AS in_sale, l_quantity AS qty, l_discount AS discount_value
FROM lineitem""")

cte("raw_users", [], """
SELECT CAST(c_custkey AS VARCHAR) AS user_id,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS gender, c_name AS phone,
       CASE WHEN c_custkey % 13 = 0 THEN NULL
            ELSE CAST(DATE '1950-01-01' + CAST((c_custkey * 97) % 18000 AS INTEGER) AS TIMESTAMP) END AS birthday,
       c_custkey AS seq
FROM customer""")

cte("raw_addresses", [], """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, r_name AS government, c_custkey AS seq
FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey
WHERE c_custkey % 9 <> 0""")

cte("raw_products", [], """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS title,
       CASE WHEN p_size % 7 = 0 THEN '0' ELSE p_type END AS category_0,
       CASE WHEN p_size = 49 THEN NULL ELSE p_type END AS category_1,
       p_retailprice AS price, p_retailprice * 0.9 AS sale_price,
       CASE WHEN p_size > 40 THEN 'true' ELSE 'false' END AS in_sale, CAST(p_size * 10 AS DOUBLE) AS stock,
       p_partkey AS seq
FROM part""")

cte("raw_categories", [], """
SELECT DISTINCT p_type AS category_id, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2, 100)) AS name
FROM part WHERE p_type <> 'PROMO'""")

cte("raw_ingredients", [], """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, u.ingredient, p_partkey * 100 + u.pos - 1 AS seq
FROM part, LATERAL (SELECT unnest(string_split(p_name, ' ')) AS ingredient,
                           generate_subscripts(string_split(p_name, ' '), 1) AS pos) u""")

cte("raw_collections", [], """
SELECT DISTINCT p_brand AS collection_id, 'Collection ' || substr(p_brand, 7, 10) AS name,
       CASE WHEN p_brand = 'Brand#13' THEN 'true' ELSE 'false' END AS is_deleted
FROM part""")

cte("raw_pfc", [], """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS collection_id,
       CASE WHEN p_size = 1 THEN 'True' ELSE 'False' END AS is_deleted, p_partkey AS seq
FROM part""")

cte("raw_payment_log", [], """
SELECT CASE WHEN event_type = 'purchase' THEN 'Paid' WHEN event_type = 'error' THEN 'Payment Failure'
            ELSE 'Pending' END AS status,
       CASE WHEN k % 10 = 9 THEN NULL ELSE (['KNET', 'Visa', 'MasterCard', 'Apple Pay'])[k % 4 + 1] END AS payment_gateway,
       CASE WHEN k % 20 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) END AS invoice_id,
       value AS transaction_value,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'Brand#' || CAST(k % 25 + 1 AS VARCHAR) END AS promotion_code,
       event_id AS seq
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")

cte("raw_offers", [], """
SELECT p_brand AS promotion_code, 'Offer ' || p_brand AS name, CAST(count(*) % 5 AS INTEGER) AS reduction_type,
       avg(p_size) AS reduction_value, count(*) % 2 = 0 AS is_auto, count(*) AS usage_count,
       CAST(substr(p_brand, 7, 10) AS INTEGER) AS seq
FROM part GROUP BY p_brand""")

cte("raw_countries", [], """
SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name,
       CASE WHEN n_nationkey = 24 THEN 'true' ELSE 'false' END AS is_deleted, n_nationkey AS seq
FROM nation""")

# ---- look-ups (C1-C5, C7) ---------------------------------------------------------------
cte("country_lu", ["raw_countries"], """
SELECT lower(trim(code)) AS code, arg_max(trim(name), seq) AS country_name
FROM raw_countries
WHERE lower(is_deleted) <> 'true' AND name IS NOT NULL AND lower(name) NOT IN ('test', 'vfds', 'ar')
  AND NOT (trim(code) IS NULL OR trim(code) = '' OR lower(trim(code)) = 'nan')
GROUP BY 1""")

cte("gateway_lu", ["raw_payment_log"], """
SELECT promotion_code, first(payment_gateway ORDER BY n DESC, payment_gateway) AS payment_gateway
FROM (SELECT promotion_code, payment_gateway, count(*) AS n FROM raw_payment_log
      WHERE status = 'Paid' AND promotion_code IS NOT NULL AND trim(promotion_code) <> ''
        AND payment_gateway IS NOT NULL
      GROUP BY 1, 2)
GROUP BY 1""")

cte("offer_lu", ["raw_offers"], """
SELECT promotion_code,
       arg_max(COALESCE(trim(name), ''), seq) AS offer_name,
       arg_max(CASE COALESCE(CAST(reduction_type AS INTEGER), -1) WHEN 0 THEN 'Percentage' WHEN 1 THEN 'Fixed'
               WHEN 2 THEN 'Free Shipping' WHEN 3 THEN 'Buy X Get Y' ELSE 'Unknown' END, seq) AS reduction_type,
       arg_max(COALESCE(CAST(reduction_value AS DOUBLE), 0.0), seq) AS reduction_value,
       arg_max(COALESCE(CAST(is_auto AS BOOLEAN), false), seq) AS is_auto_offer,
       arg_max(COALESCE(CAST(usage_count AS BIGINT), 0), seq) AS offer_usage_count
FROM (SELECT trim(CAST(promotion_code AS VARCHAR)) AS promotion_code, name, reduction_type, reduction_value,
             is_auto, usage_count, seq
      FROM raw_offers WHERE promotion_code IS NOT NULL)
WHERE promotion_code <> ''
GROUP BY 1""")

cte("ingredients_lu", ["raw_ingredients"], """
SELECT product_id, list(ingredient ORDER BY seq) AS ingredient_list,
       string_agg(ingredient, ', ' ORDER BY seq) AS ingredients, CAST(count(*) AS INTEGER) AS ingredient_count
FROM (SELECT trim(product_id) AS product_id, trim(ingredient) AS ingredient, seq FROM raw_ingredients
      WHERE product_id IS NOT NULL AND ingredient IS NOT NULL)
GROUP BY 1""")

cte("collection_lu", ["raw_collections", "raw_pfc"], """
SELECT p.product_id, arg_min(c.collection, p.seq) AS collection
FROM (SELECT trim(product_id) AS product_id, trim(collection_id) AS cid, seq FROM raw_pfc
      WHERE lower(is_deleted) <> 'true' AND product_id IS NOT NULL AND collection_id IS NOT NULL) p
JOIN (SELECT CAST(collection_id AS VARCHAR) AS cid, CAST(name AS VARCHAR) AS collection FROM raw_collections
      WHERE lower(is_deleted) <> 'true') c ON p.cid = c.cid
WHERE c.collection IS NOT NULL
GROUP BY 1""")

cte("products", ["raw_products", "raw_categories", "ingredients_lu", "collection_lu"], """
SELECT p.product_id, arg_min(COALESCE(trim(p.sku), ''), p.seq) AS sku, arg_min(COALESCE(trim(p.title), ''), p.seq) AS name,
       arg_min(COALESCE(cat.name, p.cat_raw, 'Other'), p.seq) AS category,
       arg_min(COALESCE(CAST(p.price AS DOUBLE), 0.0), p.seq) AS price,
       arg_min(COALESCE(CAST(p.sale_price AS DOUBLE), 0.0), p.seq) AS sale_price,
       arg_min(COALESCE(lower(trim(p.in_sale)) = 'true', false), p.seq) AS in_sale,
       arg_min(COALESCE(CAST(p.stock AS DOUBLE), 0.0), p.seq) AS stock,
       arg_min(COALESCE(i.ingredients, ''), p.seq) AS ingredients,
       arg_min(COALESCE(i.ingredient_count, 0), p.seq) AS ingredient_count,
       arg_min(COALESCE(c.collection, ''), p.seq) AS collection
FROM (SELECT *, CASE WHEN trim(category_0) IS NOT NULL AND trim(category_0) NOT IN ('', 'nan', '0') THEN trim(category_0)
                     WHEN trim(category_1) IS NOT NULL AND trim(category_1) NOT IN ('', 'nan', '0') THEN trim(category_1)
                END AS cat_raw FROM raw_products) p
LEFT JOIN raw_categories cat ON cat.category_id = p.cat_raw
LEFT JOIN ingredients_lu i ON i.product_id = p.product_id
LEFT JOIN collection_lu c ON c.product_id = p.product_id
GROUP BY 1""")

cte("customers", ["raw_users", "raw_addresses"], """
SELECT u.customer_id, arg_min(u.gender, u.seq) AS gender, arg_min(u.acquisition_channel, u.seq) AS acquisition_channel,
       arg_min(u.phone, u.seq) AS phone, arg_min(u.age, u.seq) AS age,
       arg_min(trim(COALESCE(a.region_addr, 'Kuwait')), u.seq) AS region
FROM (SELECT CAST(user_id AS VARCHAR) AS customer_id,
             CASE WHEN trim(gender) IS NULL OR trim(gender) = '' OR lower(trim(gender)) = 'nan' THEN 'Unknown'
                  ELSE trim(gender) END AS gender,
             'App/Web' AS acquisition_channel, COALESCE(trim(phone), '') AS phone,
             CAST(round_even(floor((epoch(TIMESTAMP '2024-01-01') - epoch(birthday)) / 86400) / 365.25, 0) AS INTEGER) AS age,
             seq
      FROM raw_users) u
LEFT JOIN (SELECT user_id AS customer_id, arg_min(government, seq) AS region_addr FROM raw_addresses
           WHERE user_id IS NOT NULL AND government IS NOT NULL GROUP BY 1) a ON a.customer_id = u.customer_id
GROUP BY 1""")

# ---- order lines (C10-C16) --------------------------------------------------------------
cte("paid", ["raw_purchases"], f"""
SELECT CAST(purchase_id AS VARCHAR) AS order_id, CAST(user_id AS VARCHAR) AS customer_id, creation_date AS order_date,
       COALESCE(CAST(full_amount AS DOUBLE), 0.0) AS full_amount, payment_method, source, country_id, promotion_code
FROM raw_purchases
WHERE status IN (1) AND NOT (user_id IS NULL OR lower(trim(CAST(user_id AS VARCHAR))) IN {GUEST})""")

cte("alloc", ["paid", "raw_items"], """
SELECT *, CASE WHEN product_id IS NULL THEN full_amount
               WHEN og > 0 THEN round(full_amount * (CAST(gd AS DOUBLE) / og), 3)
               ELSE round(full_amount / ni, 3) END AS net
FROM (SELECT *, CAST(item_gross AS DECIMAL(20, 4)) AS gd,
             CAST(sum(CAST(item_gross AS DECIMAL(20, 4))) OVER (PARTITION BY order_id) AS DOUBLE) AS og,
             count(product_id) OVER (PARTITION BY order_id) AS ni
      FROM (SELECT p.*, i.product_id, i.price, i.sale_price, i.in_sale, i.qty,
                   (CASE WHEN i.in_sale AND i.sale_price > 0 THEN i.sale_price ELSE i.price END) * i.qty AS item_gross
            FROM paid p LEFT JOIN (SELECT purchase_id, trim(product_id) AS product_id, price, sale_price, in_sale, qty
                                   FROM raw_items WHERE trim(product_id) NOT IN ('', 'nan', '0', 'None')) i
              ON p.order_id = i.purchase_id))""")

cte("dedup_lines", ["alloc"], """
SELECT DISTINCT * FROM (
  SELECT order_id, customer_id, order_date, CAST(net AS DECIMAL(18, 3)) AS net_amount,
         CASE WHEN product_id IS NULL OR NOT (item_gross > 0) THEN 0.0
              ELSE greatest(0.0, round((1.0 - net / item_gross) * 100, 2)) END AS discount_pct,
         COALESCE(product_id, 'unknown') AS product_id, payment_method, source, country_id, promotion_code
  FROM alloc) WHERE net_amount > 0""")

cte("lines", ["dedup_lines", "products", "country_lu", "offer_lu", "gateway_lu"], """
SELECT d.order_id, d.customer_id, d.order_date, d.net_amount, d.discount_pct, d.product_id,
       COALESCE(pr.category, 'Other') AS category,
       CASE WHEN d.pm IS NULL THEN 'Other' WHEN d.pm = 0 THEN 'Cash' WHEN d.pm = 1 THEN 'KNET'
            WHEN d.pm = 2 THEN 'Credit Card' WHEN d.pm = 3 THEN 'Online' ELSE 'Other' END AS channel,
       CASE WHEN d.sc = 1 THEN 'Mobile App' ELSE 'Web' END AS source,
       COALESCE(cl.country_name, upper(d.cc)) AS country,
       d.promo_code, COALESCE(g.payment_gateway, '') AS payment_gateway,
       COALESCE(o.offer_name, '') AS offer_name, COALESCE(o.reduction_type, '') AS reduction_type,
       COALESCE(o.reduction_value, 0.0) AS reduction_value, COALESCE(o.is_auto_offer, false) AS is_auto_offer
FROM (SELECT *, CAST(trunc(TRY_CAST(trim(CAST(payment_method AS VARCHAR)) AS DOUBLE)) AS INTEGER) AS pm,
             CAST(trunc(TRY_CAST(trim(CAST(source AS VARCHAR)) AS DOUBLE)) AS INTEGER) AS sc,
             CASE WHEN lower(trim(COALESCE(CAST(country_id AS VARCHAR), 'kw'))) = '' THEN 'kw'
                  ELSE lower(trim(COALESCE(CAST(country_id AS VARCHAR), 'kw'))) END AS cc,
             COALESCE(trim(promotion_code), '') AS promo_code
      FROM dedup_lines) d
LEFT JOIN products pr ON pr.product_id = d.product_id
LEFT JOIN country_lu cl ON cl.code = d.cc
LEFT JOIN offer_lu o ON o.promotion_code = d.promo_code
LEFT JOIN gateway_lu g ON g.promotion_code = d.promo_code""")

cte("returns", ["raw_purchases"], f"""
SELECT return_id, arg_min(customer_id, (return_date, customer_id)) AS customer_id,
       arg_min(return_date, (return_date, customer_id)) AS return_date,
       arg_min(refund_amount, (return_date, customer_id)) AS refund_amount,
       arg_min(return_status, (return_date, customer_id)) AS return_status,
       arg_min(return_reason, (return_date, customer_id)) AS return_reason
FROM (SELECT CAST(purchase_id AS VARCHAR) AS return_id,
             CASE WHEN lower(trim(CAST(user_id AS VARCHAR))) IN {GUEST} THEN '__unattributed__'
                  ELSE CAST(user_id AS VARCHAR) END AS customer_id,
             updated_date AS return_date,
             CAST(COALESCE(CAST(full_amount AS DOUBLE), 0.0) AS DECIMAL(18, 2)) AS refund_amount,
             CASE status WHEN 3 THEN 'Returned' WHEN 4 THEN 'Canceled' ELSE 'Unknown' END AS return_status,
             COALESCE(CAST(note AS VARCHAR), 'Not specified') AS return_reason
      FROM raw_purchases WHERE status IN (3, 4) AND user_id IS NOT NULL)
GROUP BY 1""")

# ---- features (F1-F22) ------------------------------------------------------------------
cte("flines", ["lines"], f"""
SELECT * FROM lines WHERE trim(customer_id) NOT IN {GHOST} AND order_date IS NOT NULL""")

cte("refdate", ["flines"], "SELECT max(order_date) AS ref_date FROM flines")

_win = ",\n".join(
    f"sum(CASE WHEN order_date >= ref_date - INTERVAL {d} DAY THEN net_amount END) AS o_spend_{d}, "
    f"max(CASE WHEN order_date >= ref_date - INTERVAL {d} DAY THEN 1 ELSE 0 END) AS o_in_{d}"
    for d in (30, 90, 365))
cte("order_grain", ["flines", "refdate"], f"""
SELECT customer_id, order_id, sum(net_amount) AS o_net, count(*) AS o_lines,
       sum(CAST(discount_pct AS DECIMAL(12, 2))) AS o_disc, min(order_date) AS o_first, max(order_date) AS o_last,
       min(channel) AS channel, {_win}
FROM flines, refdate GROUP BY 1, 2""")

cte("clv", ["order_grain", "refdate"], """
SELECT customer_id, active_months,
       CASE WHEN active_months >= 2 AND den <> 0 THEN CAST(num AS DOUBLE) / (CAST(den AS DOUBLE) * 1000.0)
            ELSE 0.0 END AS clv_slope
FROM (SELECT customer_id, count(*) AS active_months,
             count(*) * sum(x * y) - sum(x) * sum(y) AS num, count(*) * sum(x * x) - sum(x) * sum(x) AS den
      FROM (SELECT customer_id, CAST(mi - (year(ref_date) * 12 + month(ref_date)) AS HUGEINT) AS x,
                   CAST(y * 1000 AS HUGEINT) AS y
            FROM (SELECT customer_id, year(o_first) * 12 + month(o_first) AS mi, sum(o_net) AS y
                  FROM order_grain GROUP BY 1, 2), refdate)
      GROUP BY 1)""")

cte("ipt", ["order_grain"], """
SELECT customer_id, CASE WHEN sum(n) >= 2 THEN COALESCE(sum(gap), 0) / (sum(n) - 1) END AS ipt
FROM (SELECT *, floor((epoch(t0) - epoch(lag(t1) OVER (PARTITION BY customer_id ORDER BY day))) / 86400) AS gap
      FROM (SELECT customer_id, CAST(o_first AS DATE) AS day, sum(o_lines) AS n, min(o_first) AS t0,
                   max(o_last) AS t1
            FROM order_grain GROUP BY 1, 2))
GROUP BY 1""")

cte("cat_top", ["flines"], """
SELECT customer_id, count(*) AS unique_cats, first(category ORDER BY n DESC, category) AS top_cat
FROM (SELECT customer_id, category, count(*) AS n FROM flines WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")

cte("prod_cnt", ["flines"], """
SELECT customer_id, count(*) AS unique_prods
FROM (SELECT DISTINCT customer_id, product_id FROM flines WHERE product_id IS NOT NULL) GROUP BY 1""")

cte("chan_top", ["order_grain"], """
SELECT customer_id, first(channel ORDER BY n DESC, channel) AS top_channel
FROM (SELECT customer_id, channel, sum(o_lines) AS n FROM order_grain WHERE channel IS NOT NULL GROUP BY 1, 2)
GROUP BY 1""")

cte("ret_cust", ["returns"], """
SELECT customer_id, count(*) AS ret_cnt, sum(refund_amount) AS ret_amt FROM returns GROUP BY 1""")

cte("features_raw", ["order_grain", "clv", "ipt", "cat_top", "prod_cnt", "chan_top", "ret_cust", "refdate"], """
SELECT b.*, c.active_months, c.clv_slope, ct.unique_cats, ct.top_cat, pc.unique_prods, ch.top_channel, i.ipt,
       COALESCE(r.ret_cnt, 0) AS ret_cnt, CAST(COALESCE(r.ret_amt, 0) AS DOUBLE) AS ret_amt, refdate.ref_date
FROM (SELECT customer_id, CAST(sum(o_net) AS DOUBLE) AS spend, count(*) AS order_count, sum(o_lines) AS n_lines,
             sum(o_disc) AS disc, min(o_first) AS first_d, max(o_last) AS last_d,
             CAST(COALESCE(sum(o_spend_30), 0) AS DOUBLE) AS sp30, CAST(COALESCE(sum(o_spend_90), 0) AS DOUBLE) AS sp90,
             CAST(COALESCE(sum(o_spend_365), 0) AS DOUBLE) AS sp365,
             COALESCE(sum(o_spend_90), 0) AS sp90d, COALESCE(sum(o_spend_365), 0) AS sp365d,
             sum(o_in_30) AS orders_30, sum(o_in_90) AS orders_90, sum(o_in_365) AS orders_365
      FROM order_grain GROUP BY 1) b
LEFT JOIN clv c ON c.customer_id = b.customer_id
LEFT JOIN cat_top ct ON ct.customer_id = b.customer_id
LEFT JOIN prod_cnt pc ON pc.customer_id = b.customer_id
LEFT JOIN chan_top ch ON ch.customer_id = b.customer_id
LEFT JOIN ipt i ON i.customer_id = b.customer_id
LEFT JOIN ret_cust r ON r.customer_id = b.customer_id, refdate""")


def _dz(a: str, b: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


cte("features", ["features_raw", "customers"], f"""
SELECT f.customer_id, f.spend AS total_spend, CAST(f.order_count AS BIGINT) AS order_count,
       CAST(floor((epoch(f.ref_date) - epoch(f.last_d)) / 86400) AS BIGINT) AS recency,
       {_dz('f.spend', 'f.order_count')} AS aov,
       (CAST(f.disc AS DOUBLE) / f.n_lines) / 100.0 AS avg_discount,
       CAST(f.unique_cats AS BIGINT) AS unique_cats, CAST(f.unique_prods AS BIGINT) AS unique_prods,
       CAST(f.active_months AS BIGINT) AS active_months,
       f.sp30 AS spend_30, f.sp90 AS spend_90, f.sp365 AS spend_365,
       CAST(f.orders_30 AS BIGINT) AS orders_30, CAST(f.orders_90 AS BIGINT) AS orders_90,
       CAST(f.orders_365 AS BIGINT) AS orders_365,
       {_dz('f.ret_cnt', 'f.order_count')} AS return_rate,
       {_dz('f.ret_amt', 'f.spend')} AS refund_ratio,
       {_dz('f.unique_cats', 'f.order_count')} AS diversity,
       {_dz('f.spend', 'f.active_months')} AS spend_velocity,
       f.clv_slope,
       CAST(floor((epoch(f.last_d) - epoch(f.first_d)) / 86400) AS BIGINT) AS lifespan,
       CASE WHEN (f.sp365d - f.sp90d) <> 0
                 THEN CAST(f.sp90d - (f.sp365d - f.sp90d) AS DOUBLE) / CAST(f.sp365d - f.sp90d AS DOUBLE)
            WHEN f.sp90d - (f.sp365d - f.sp90d) = 0 THEN 0.0 END AS spend_momentum,
       f.spend * (1.0 - {_dz('f.ret_amt', 'f.spend')}) AS net_revenue,
       {_dz('f.spend', 'f.active_months')} * 12.0 AS projected_annual_value,
       f.top_cat, f.top_channel, CAST(f.ipt AS DOUBLE) AS ipt,
       COALESCE(c.gender, 'Unknown') AS gender, COALESCE(c.region, 'Kuwait') AS region,
       COALESCE(c.acquisition_channel, 'App/Web') AS acquisition_channel, c.phone
FROM features_raw f LEFT JOIN customers c ON c.customer_id = f.customer_id""")

# Deterministic segment stand-in for label-agnostic operators (the model's labels are not SQL).
cte("segf", ["features"], "SELECT *, CAST(CAST(customer_id AS BIGINT) % 4 AS INTEGER) AS seg FROM features")

# ---- model inputs (M1, M2, M2b) ---------------------------------------------------------
FEATS = ["total_spend", "order_count", "recency", "aov", "avg_discount", "active_months", "return_rate",
         "diversity", "spend_velocity", "clv_slope"]
cte("wq", ["features"], "SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi_{c}"
    for c in FEATS) + " FROM features")
cte("wins", ["features", "wq"], "SELECT customer_id, " + ", ".join(
    f"least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}) AS {c}" for c in FEATS) + " FROM features, wq")
cte("wst", ["wins"], "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)
    + " FROM wins")
cte("scaled", ["wins", "wst"], "SELECT customer_id, " + ", ".join(
    f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END AS {c}" for c in FEATS) + " FROM wins, wst")
cte("segsc", ["scaled"], "SELECT *, CAST(CAST(customer_id AS BIGINT) % 4 AS INTEGER) AS seg FROM scaled")
