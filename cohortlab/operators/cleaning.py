"""Cleaning, look-ups and the order-line build.

Only the country list is broadcast by a hint, being a fixed list. Offers, gateways, categories,
products and customers grow with the data and are joined plainly, so that their measured sizes
decide how.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import fixed as FX
from cohortlab.functions.columns import (blank_to_null, col_, is_blank, is_guest, money,
                                         text_true)


def _map_expr(code: F.Column, mapping: dict, default: str) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def top_value(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent non-null ``value`` per key; ties -> smallest value.

    Two-level aggregation (counts per (key, value), then the arg-max per key), so a hot key
    is reduced map-side before the second shuffle — no group is ever collected.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(out))


# ---- C1 ---------------------------------------------------------------------------------
def country_lookup(countries: DataFrame) -> DataFrame:
    """Not-deleted countries with a real name; code lower-cased; the last duplicate wins."""
    c = countries.filter(F.lower(F.col("is_deleted").cast("string")) != "true") \
        .filter(F.col("name").isNotNull() & ~F.lower(F.col("name")).isin(*FX.JUNK_COUNTRY_NAMES)) \
        .withColumn("code", F.lower(F.trim(F.col("code").cast("string")))) \
        .filter(~is_blank("code"))
    return c.groupBy("code").agg(F.max_by(F.trim("name"), F.col("seq")).alias("country_name"))


# ---- C2 ---------------------------------------------------------------------------------
def gateway_by_promo(payment_log: DataFrame) -> DataFrame:
    """Among ``Paid`` logs with a promo code, the most frequent gateway per code."""
    paid = payment_log.filter((F.col("status") == "Paid") & F.col("promotion_code").isNotNull()
                              & (F.trim("promotion_code") != ""))
    return top_value(paid, ["promotion_code"], "payment_gateway", "payment_gateway")


# ---- C3 ---------------------------------------------------------------------------------
def offer_lookup(offers: DataFrame) -> DataFrame:
    """Promo code -> offer facts; unknown type code -> ``Unknown``; the last row per code wins."""
    rt = F.col("reduction_type").cast("int")
    o = offers.filter(F.col("promotion_code").isNotNull()) \
        .withColumn("promotion_code", F.trim(F.col("promotion_code").cast("string"))) \
        .filter(F.col("promotion_code") != "")
    rec = F.struct(
        F.coalesce(F.trim("name"), F.lit("")).alias("offer_name"),
        _map_expr(F.coalesce(rt, F.lit(-1)), FX.REDUCTION_TYPE_MAP, "Unknown").alias("reduction_type"),
        F.coalesce(F.col("reduction_value").cast("double"), F.lit(0.0)).alias("reduction_value"),
        F.coalesce(F.col("is_auto").cast("boolean"), F.lit(False)).alias("is_auto_offer"),
        F.coalesce(F.col("usage_count").cast("long"), F.lit(0)).alias("offer_usage_count"),
    )
    return o.groupBy("promotion_code").agg(F.max_by(rec, F.col("seq")).alias("r")).select("promotion_code", "r.*")


# ---- C4 ---------------------------------------------------------------------------------
def ingredients_by_product(ingredients: DataFrame) -> DataFrame:
    """Ingredient list per product in source order, joined text and count."""
    i = ingredients.filter(F.col("product_id").isNotNull() & F.col("ingredient").isNotNull()) \
        .select(F.trim("product_id").alias("product_id"), F.trim("ingredient").alias("ingredient"), "seq")
    g = i.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ingredient"))).alias("_l"))
    lst = F.transform("_l", lambda x: x["ingredient"])
    return g.select("product_id", lst.alias("ingredient_list"),
                    F.array_join(lst, ", ").alias("ingredients"), F.size(lst).alias("ingredient_count"))


# ---- C5 ---------------------------------------------------------------------------------
def collection_by_product(collections: DataFrame, product_for_collection: DataFrame) -> DataFrame:
    """Bridge-table join (not deleted on both sides); first collection per product."""
    col = collections.filter(F.lower(F.col("is_deleted").cast("string")) != "true") \
        .select(F.col("collection_id").cast("string").alias("cid"), F.col("name").cast("string").alias("collection"))
    pfc = product_for_collection.filter(F.lower(F.col("is_deleted").cast("string")) != "true") \
        .filter(F.col("product_id").isNotNull() & F.col("collection_id").isNotNull()) \
        .select(F.trim("product_id").alias("product_id"), F.trim("collection_id").alias("cid"), "seq")
    j = pfc.join(col, "cid").filter(F.col("collection").isNotNull())
    return j.groupBy("product_id").agg(F.min_by("collection", "seq").alias("collection"))


# ---- C6 ---------------------------------------------------------------------------------
def first_region(addresses: DataFrame) -> DataFrame:
    """First address with a government name per user."""
    a = addresses.filter(F.col("user_id").isNotNull() & F.col("government").isNotNull())
    return a.groupBy(F.col("user_id").alias("customer_id")).agg(F.min_by("government", "seq").alias("region_addr"))


def customer_age(birthday, ref: str = FX.AGE_REFERENCE_DATE) -> F.Column:
    """Days to a fixed reference / 365.25, rounded half-to-even; null birthday -> null."""
    days = F.floor(F.timestamp_diff("SECOND", col_(birthday), F.lit(ref).cast("timestamp_ntz")) / 86400)
    return F.bround(days / 365.25, 0).cast("int")


def clean_customers(users: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    u = users.select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(is_blank("gender"), F.lit(FX.DEFAULT_GENDER)).otherwise(F.trim("gender")).alias("gender"),
        F.lit(FX.DEFAULT_ACQUISITION).alias("acquisition_channel"),
        F.coalesce(F.trim("phone"), F.lit("")).alias("phone"),
        customer_age("birthday").alias("age"),
        "seq",
    )
    if addresses is not None:
        u = u.join(first_region(addresses), "customer_id", "left")
    else:
        u = u.withColumn("region_addr", F.lit(None).cast("string"))
    u = u.withColumn("region", F.trim(F.coalesce("region_addr", F.lit(FX.DEFAULT_REGION))))
    rec = F.struct("gender", "acquisition_channel", "phone", "age", "region")
    return u.groupBy("customer_id").agg(F.min_by(rec, "seq").alias("r")).select("customer_id", "r.*")


# ---- C7 ---------------------------------------------------------------------------------
def first_category(products: DataFrame, categories: DataFrame | None, slot_cols: list[str]) -> DataFrame:
    """First valid category slot (not null, blank, ``nan`` or ``0``) mapped to its name, else
    the raw value, else ``Other`` (C7a). Adds column ``category``."""
    slots = F.array(*[F.trim(F.col(c).cast("string")) for c in slot_cols])
    valid = F.filter(slots, lambda v: v.isNotNull() & (v != "") & (v != "nan") & (v != "0"))
    p = products.withColumn("_cat_raw", F.try_element_at(valid, F.lit(1)))
    if categories is not None:
        cats = categories.select(F.col("category_id").cast("string").alias("_cat_raw"), F.col("name").alias("_cat_name"))
        p = p.join(cats, "_cat_raw", "left")
    else:
        p = p.withColumn("_cat_name", F.lit(None).cast("string"))
    return p.withColumn("category", F.coalesce("_cat_name", "_cat_raw", F.lit(FX.DEFAULT_CATEGORY))) \
        .drop("_cat_raw", "_cat_name")


def product_category(products: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """product_id -> category only (the look-up the order lines need), first row per product."""
    slot_cols = sorted([c for c in products.columns if c.startswith("category_")], key=lambda c: int(c.split("_")[1]))
    p = first_category(products, categories, slot_cols)
    return p.groupBy(F.col("product_id").cast("string").alias("product_id")).agg(F.min_by("category", "seq").alias("category"))


def product_names(products: DataFrame) -> DataFrame:
    """product_id -> cleaned display name, first row per product (the look-up K8 needs)."""
    return products.groupBy(F.col("product_id").cast("string").alias("product_id")) \
        .agg(F.min_by(F.coalesce(F.trim("title"), F.lit("")), "seq").alias("name"))


def clean_products(products: DataFrame, categories: DataFrame | None = None,
                   ingredients: DataFrame | None = None, collections: DataFrame | None = None,
                   product_for_collection: DataFrame | None = None) -> DataFrame:
    slot_cols = sorted([c for c in products.columns if c.startswith("category_")],
                       key=lambda c: int(c.split("_")[1]))
    p = first_category(products, categories, slot_cols)
    p = p.select(
        F.col("product_id").cast("string").alias("product_id"),
        F.coalesce(F.trim("sku"), F.lit("")).alias("sku"),
        F.coalesce(F.trim("title"), F.lit("")).alias("name"),
        "category",
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("sale_price").cast("double"), F.lit(0.0)).alias("sale_price"),
        text_true("in_sale").alias("in_sale"),
        F.coalesce(F.col("stock").cast("double"), F.lit(0.0)).alias("stock"),
        "seq",
    )
    if ingredients is not None:
        p = p.join(ingredients_by_product(ingredients).drop("ingredient_list"), "product_id", "left")
    else:
        p = p.withColumn("ingredients", F.lit(None).cast("string")).withColumn("ingredient_count", F.lit(None).cast("int"))
    p = p.withColumn("ingredients", F.coalesce("ingredients", F.lit(""))) \
         .withColumn("ingredient_count", F.coalesce("ingredient_count", F.lit(0)))
    if collections is not None and product_for_collection is not None:
        p = p.join(collection_by_product(collections, product_for_collection), "product_id", "left")
    else:
        p = p.withColumn("collection", F.lit(None).cast("string"))
    p = p.withColumn("collection", F.coalesce("collection", F.lit("")))
    rec = F.struct("sku", "name", "category", "price", "sale_price", "in_sale", "stock", "ingredients",
                   "ingredient_count", "collection")
    return p.groupBy("product_id").agg(F.min_by(rec, "seq").alias("r")).select("product_id", "r.*")


# ---- C9 ---------------------------------------------------------------------------------
INVALID_ITEM_IDS = ["", "nan", "0", "None"]


def valid_item(product_id) -> F.Column:
    """An item slot holds a product when its id is present and not a placeholder."""
    return col_(product_id).isNotNull() & ~col_(product_id).isin(*INVALID_ITEM_IDS)


def _num(c, default: float, number: bool = False) -> F.Column:
    """A number or the default; a column that is a ``number`` already is not written out as text to be read again."""
    v = col_(c).cast("double") if number else F.trim(col_(c).cast("string")).try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def item_fields(f, numbers=()) -> list[F.Column]:
    """The typed fields of an item; ``f(name, default)`` gives the raw column, ``numbers`` the names of those that are doubles
    or whole numbers. A missing, unreadable or smaller quantity than 1 counts as 1, as the export has it."""
    num = lambda name, default, missing: _num(f(name, missing), default, name in numbers)
    return [F.trim(f("product_id", None).cast("string")).alias("product_id"),
            num("price", 0.0, None).alias("price"), num("sale_price", 0.0, None).alias("sale_price"),
            text_true(f("in_sale", "False")).alias("in_sale"),
            F.greatest(num("qty", 1.0, "1"), F.lit(1.0)).alias("qty"),
            num("discount_value", 0.0, None).alias("discount_value")]


def clean_items(items: DataFrame) -> DataFrame:
    """The long form of the items, typed as ``unpivot_items`` types the wide one; invalid items go."""
    f = lambda name, default: F.col(name) if name in items.columns else F.lit(default)
    numbers = [name for name, kind in items.dtypes if kind in ("double", "int", "bigint")]
    return items.select("purchase_id", *item_fields(f, numbers)).filter(valid_item("product_id"))


def unpivot_items(wide: DataFrame, prefix: str = "item") -> DataFrame:
    """Item slots flattened in columns -> one row per valid item (holes skipped), one narrow stage. The
    slots are those whose columns are present, however many.

    Output: purchase_id, slot, product_id, price, sale_price, in_sale, qty, discount_value.
    """
    present = set(wide.columns)
    raw = {"product_id": "type_id", "qty": "quantity"}
    slots = sorted(int(m.group(1)) for m in (re.fullmatch(rf"{re.escape(prefix)}(\d+)_type_id", c) for c in present) if m)

    def f(i):
        def column(name, default):
            c = f"{prefix}{i}_{raw.get(name, name)}"
            return F.col(c) if c in present else F.lit(default)
        return column

    def item(i):
        # an empty slot is passed over before its numbers are read
        return F.when(valid_item(F.trim(f(i)("product_id", None).cast("string"))), F.struct(F.lit(i).alias("slot"), *item_fields(f(i))))

    return wide.select("purchase_id", F.inline(F.filter(F.array(*[item(i) for i in slots]), lambda s: s.isNotNull())))


# ---- C10 / C10a -------------------------------------------------------------------------
def paid_orders(purchases: DataFrame) -> DataFrame:
    """Status paid and a real (non-guest) user id."""
    return purchases.filter(F.col("status").isin(*FX.STATUS_PAID) & ~is_guest("user_id"))


def drop_ghost_customers(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.trim(F.col("customer_id").cast("string")).isin(*FX.GHOST_IDS))


# ---- C11 / C12 --------------------------------------------------------------------------
def map_codes(orders: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Payment method code -> channel, source code -> source, country code -> name (or upper code)."""
    pm = F.trim(F.col("payment_method").cast("string")).try_cast("double").cast("int")
    src = F.trim(F.col("source").cast("string")).try_cast("double").cast("int")
    o = orders.withColumn("channel", F.when(pm.isNull(), F.lit("Other")).otherwise(_map_expr(pm, FX.CHANNEL_MAP, "Other"))) \
        .withColumn("source_name", F.when(src.isNull(), F.lit("Web")).otherwise(_map_expr(src, FX.SOURCE_MAP, "Web")))
    raw_country = F.lower(F.trim(F.coalesce(F.col("country_id").cast("string"), F.lit("kw"))))
    o = o.withColumn("_cc", F.when(raw_country == "", F.lit("kw")).otherwise(raw_country))
    if countries is not None:
        o = o.join(F.broadcast(country_lookup(countries)).withColumnRenamed("code", "_cc"), "_cc", "left") \
            .withColumn("country", F.coalesce("country_name", F.upper("_cc"))).drop("country_name")
    else:
        o = o.withColumn("country", F.col("_cc"))
    return o.drop("_cc")


def enrich_promo(orders: DataFrame, offers: DataFrame | None = None, payment_log: DataFrame | None = None) -> DataFrame:
    """Promo code -> offer facts and most-used gateway, with empty defaults. The look-ups grow with the
    data, so their sizes decide how they are joined; orders without a code keep a null key, which
    no join shuffles to one place."""
    o = orders.withColumn("_code", F.when(F.trim("promotion_code") != "", F.trim("promotion_code")))
    if offers is not None:
        o = o.join(offer_lookup(offers).drop("offer_usage_count").withColumnRenamed("promotion_code", "_code"), "_code", "left")
    else:
        for c, t in [("offer_name", "string"), ("reduction_type", "string"), ("reduction_value", "double"),
                     ("is_auto_offer", "boolean")]:
            o = o.withColumn(c, F.lit(None).cast(t))
    if payment_log is not None:
        o = o.join(gateway_by_promo(payment_log).withColumnRenamed("promotion_code", "_code"), "_code", "left")
    else:
        o = o.withColumn("payment_gateway", F.lit(None).cast("string"))
    return o.select(*[c for c in o.columns if c not in ("offer_name", "reduction_type", "reduction_value",
                                                        "is_auto_offer", "payment_gateway", "_code")],
                    F.coalesce("_code", F.lit("")).alias("promo_code"),
                    F.coalesce("payment_gateway", F.lit("")).alias("payment_gateway"),
                    F.coalesce("offer_name", F.lit("")).alias("offer_name"),
                    F.coalesce("reduction_type", F.lit("")).alias("reduction_type"),
                    F.coalesce("reduction_value", F.lit(0.0)).alias("reduction_value"),
                    F.coalesce("is_auto_offer", F.lit(False)).alias("is_auto_offer"))


# ---- C13 / C14 / C15 --------------------------------------------------------------------
def item_gross() -> F.Column:
    """What an item costs before its share of the order's total: the unit price that holds, times the quantity."""
    return F.when(F.col("in_sale") & (F.col("sale_price") > 0), F.col("sale_price")).otherwise(F.col("price")) * F.col("qty")


def once(df: DataFrame, **columns: F.Column) -> DataFrame:
    """Adds columns that are computed once per row. A filter on such a column stays above it and what uses it reads it,
    where a plain column's expression would be written out, and computed, in every place."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def allocate_order_total(order_items: DataFrame) -> DataFrame:
    """Split each order's full amount over its items by gross weight (C13), line discount (C14),
    and one fallback line for orders without items (C15).

    Input: one row per (order, item) from a left join of orders to items; item columns null
    for item-less orders, and ``item_gross`` in place of its parts where that is known. The window is
    partitioned by order id — the same key the join shuffled on, so it adds no exchange, and an order
    holds at most 36 items.
    """
    w = Window.partitionBy("order_id")
    x = order_items if "item_gross" in order_items.columns else order_items.withColumn("item_gross", item_gross())
    x = x.withColumn("_gross_dec", F.col("item_gross").cast("decimal(20,4)")) \
        .withColumn("_order_gross", F.sum("_gross_dec").over(w).cast("double")) \
        .withColumn("_n_items", F.count("product_id").over(w))
    full = F.coalesce(F.col("full_amount").cast("double"), F.lit(0.0))
    net = F.when(F.col("product_id").isNull(), full) \
        .when(F.col("_order_gross") > 0, F.round(full * (F.col("_gross_dec").cast("double") / F.col("_order_gross")), 3)) \
        .otherwise(F.round(full / F.col("_n_items"), 3))
    disc = F.when(F.col("product_id").isNull() | ~(F.col("item_gross") > 0), F.lit(0.0)) \
        .otherwise(F.greatest(F.lit(0.0), F.round((F.lit(1.0) - F.col("net_amount") / F.col("item_gross")) * 100, 2)))
    return once(x, net_amount=net).withColumn("discount_pct", disc) \
        .withColumn("product_id", F.coalesce("product_id", F.lit("unknown"))) \
        .drop("_gross_dec", "_order_gross", "_n_items")


def line_discount_pct(net, gross) -> F.Column:
    """max(0, round((1 - net/gross)*100, 2)); 0 when gross <= 0 (C14, as a column function)."""
    return F.when(~(col_(gross) > 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.round((F.lit(1.0) - col_(net) / col_(gross)) * 100, 2)))


# ---- C16 / C20 --------------------------------------------------------------------------
def finalize_lines(lines: DataFrame) -> DataFrame:
    """Numeric coercion, drop net <= 0, full-row de-duplication."""
    x = lines.withColumn("net_amount", F.coalesce(F.col("net_amount").cast("double"), F.lit(0.0))) \
        .withColumn("discount_pct", F.coalesce(F.col("discount_pct").cast("double"), F.lit(0.0)))
    return x.filter(F.col("net_amount") > 0).dropDuplicates()


def coerce_lines(lines: DataFrame) -> DataFrame:
    """Date / number coercion before features; rows without a date are dropped (C20)."""
    return lines.withColumn("net_amount", F.coalesce(F.col("net_amount").cast("decimal(18,3)"), F.lit(0).cast("decimal(18,3)"))) \
        .withColumn("discount_pct", F.coalesce(F.col("discount_pct").cast("double"), F.lit(0.0))) \
        .filter(F.col("order_date").isNotNull())


LINE_COLUMNS = ["order_id", "customer_id", "order_date", "net_amount", "discount_pct", "product_id", "category",
                "channel", "source", "country", "promo_code", "payment_gateway", "offer_name", "reduction_type",
                "reduction_value", "is_auto_offer"]


PROMO_COLUMNS = {"payment_gateway", "offer_name", "reduction_type", "reduction_value", "is_auto_offer"}


def clean_orders(purchases: DataFrame, items: DataFrame, products: DataFrame | None = None,
                 countries: DataFrame | None = None, payment_log: DataFrame | None = None,
                 offers: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Paid purchases + their items -> one cleaned row per order line.

    Plan: filter -> shuffle join orders⋈items on order id -> window allocation on the same
    partitioning -> drop net <= 0 -> de-duplicate inside that partitioning (the dedup key contains
    the order id, so no new exchange) -> attach the per-order look-ups and the product category.
    ``columns`` names the output columns wanted; look-ups that none of them needs are not joined.
    """
    wanted = list(LINE_COLUMNS) if columns is None else list(columns)
    o = paid_orders(purchases).select(
        F.col("purchase_id").cast("string").alias("order_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("creation_date").alias("order_date"),
        F.coalesce(F.col("full_amount").cast("double"), F.lit(0.0)).alias("full_amount"),
        "payment_method", "source", "country_id", "promotion_code")
    # of an item's numbers only their product is shuffled
    it = clean_items(items).select(F.col("purchase_id").cast("string").alias("order_id"), "product_id", item_gross().alias("item_gross"))
    x = allocate_order_total(o.join(it, "order_id", "left"))
    x = x.withColumn("net_amount", money("net_amount")).filter(F.col("net_amount") > 0) \
        .select("order_id", "customer_id", "order_date", "net_amount", "discount_pct", "product_id",
                "payment_method", "source", "country_id", "promotion_code").dropDuplicates()
    x = map_codes(x, countries if "country" in wanted else None)
    promo = PROMO_COLUMNS & set(wanted)
    x = enrich_promo(x, offers if promo - {"payment_gateway"} else None, payment_log if "payment_gateway" in promo else None)
    if products is not None and "category" in wanted:
        x = x.join(products.select("product_id", "category"), "product_id", "left")
    else:
        x = x.withColumn("category", F.lit(None).cast("string"))
    x = x.withColumn("category", F.coalesce("category", F.lit(FX.DEFAULT_CATEGORY))) \
        .withColumn("source", F.col("source_name"))
    return x.select(*wanted)


# ---- C17 --------------------------------------------------------------------------------
def clean_returns(purchases: DataFrame) -> DataFrame:
    """Returned (3) / canceled (4) purchases; guest ids kept as ``__unattributed__``."""
    r = purchases.filter(F.col("status").isin(*FX.STATUS_RETURNED.keys()) & F.col("user_id").isNotNull())
    status = _map_expr(F.col("status"), FX.STATUS_RETURNED, "Unknown")
    out = r.select(
        F.col("purchase_id").cast("string").alias("return_id"),
        F.when(is_guest("user_id"), F.lit(FX.UNATTRIBUTED)).otherwise(F.col("user_id").cast("string")).alias("customer_id"),
        F.col("updated_date").alias("return_date"),
        money(F.coalesce(F.col("full_amount").cast("double"), F.lit(0.0)), 2).alias("refund_amount"),
        status.alias("return_status"),
        F.coalesce(F.col("note").cast("string"), F.lit(FX.DEFAULT_REASON)).alias("return_reason"),
    )
    rec = F.struct("customer_id", "return_date", "refund_amount", "return_status", "return_reason")
    return out.groupBy("return_id").agg(F.min_by(rec, F.struct("return_date", "customer_id")).alias("r")) \
        .select("return_id", "r.*")


# ---- C18 / C19 --------------------------------------------------------------------------
def deduped_paid_revenue(payment_log: DataFrame) -> DataFrame:
    """Σ value of Paid logs, one row per invoice (first by log order; null invoices are one key)."""
    paid = payment_log.filter(F.trim("status") == "Paid") \
        .withColumn("v", money(F.coalesce(F.col("transaction_value").cast("string").try_cast("double"), F.lit(0.0)), 2))
    first = paid.groupBy("invoice_id").agg(F.min_by("v", "seq").alias("v"))
    return first.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("total_revenue"))


def payment_stats(payment_log: DataFrame) -> DataFrame:
    """One row: total logs, failure %, dedup revenue; plus gateway top-10 and status counts as
    arrays of (name, count) — the long forms are ``gateway_distribution`` / ``status_distribution``."""
    tot = payment_log.agg(F.count(F.lit(1)).alias("total_payment_logs"),
                          F.sum(F.when(F.col("status") == "Payment Failure", 1).otherwise(0)).alias("_fail"))
    tot = tot.select("total_payment_logs",
                     F.when(F.col("total_payment_logs") > 0,
                            F.round(F.col("_fail") * 100.0 / F.col("total_payment_logs"), 2))
                     .otherwise(F.lit(0.0)).alias("payment_failure_rate"))
    return tot.crossJoin(deduped_paid_revenue(payment_log))


def gateway_distribution(payment_log: DataFrame, top: int = 10) -> DataFrame:
    g = payment_log.filter(F.col("payment_gateway").isNotNull()).groupBy("payment_gateway") \
        .agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "payment_gateway").limit(top)


def status_distribution(payment_log: DataFrame) -> DataFrame:
    return payment_log.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
