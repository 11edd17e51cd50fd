"""Adapters: the given test tables -> the raw entities the cleaning operators expect.

The source application reads CSV exports of an e-commerce database (users, addresses,
products, purchases, payment log, offers, countries, ...). The test data is a TPC-H-like star
schema, so each raw entity is *derived* from it by Spark. Every adapter is a narrow
projection of one table (plus, where stated, a join to a bounded dimension), so the work grows
with the given tables and the scans prune to the named columns.

The SQL twins used by the DuckDB oracle are in ``cohortlab.plans.oracle`` (``RAW_*``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.fixed import MAX_ITEM_SLOTS

# Adapter constants (not from the source application: they shape the derived test inputs).
GATEWAYS = ["KNET", "Visa", "MasterCard", "Apple Pay"]


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def raw_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Purchase header rows, all statuses (1 paid; 3 returned, 4 canceled)."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
              "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("purchase_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderdate").alias("creation_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("updated_date"),
        F.when(F.col("o_orderstatus").isin("F", "O"), F.lit(1))
         .when(k % 2 == 0, F.lit(3)).otherwise(F.lit(4)).alias("status"),
        F.col("o_totalprice").alias("full_amount"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string").alias("payment_method"),
        (k % 2).cast("string").alias("source"),
        (F.col("o_custkey") % 26).cast("string").alias("country_id"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("promotion_code"),
        F.col("o_orderpriority").alias("note"),
    )


def raw_purchase_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per purchased item (the long form of the 36 item slots)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").cast("string").alias("purchase_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        unit.alias("price"),
        (unit * (F.lit(1.0) - F.col("l_discount"))).alias("sale_price"),
        (F.col("l_discount") > 0.05).alias("in_sale"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("discount_value"),
    )


def wide_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Purchases in the export's wide layout: item slots flattened into columns, 36 or as many
    as the largest order has.

    Slot = position of the line inside its order under a total order of the line's columns
    (exact duplicate lines are interchangeable). Fields are text, as in the CSV export.
    """
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
               "l_extendedprice", "l_discount")
    widest = li.groupBy("l_orderkey").count().agg(F.max("count")).first()[0]       # the layout has as many slots as the largest order
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = li.groupBy(F.col("l_orderkey").cast("string").alias("purchase_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def text(x):
        unit = x["l_extendedprice"] / x["l_quantity"]
        return F.struct(x["l_partkey"].cast("string").alias("type_id"), unit.cast("string").alias("price"),
                        (unit * (F.lit(1.0) - x["l_discount"])).cast("string").alias("sale_price"),
                        F.when(x["l_discount"] > 0.05, F.lit("True")).otherwise(F.lit("False")).alias("in_sale"),
                        x["l_quantity"].cast("string").alias("quantity"), x["l_discount"].cast("string").alias("discount_value"))

    fields = ["type_id", "price", "sale_price", "in_sale", "quantity", "discount_value"]
    slots = orders.select("purchase_id", F.transform("lines", text).alias("lines")).select("purchase_id", *[
        F.get("lines", F.lit(i))[f].alias(f"item{i}_{f}") for i in range(max(MAX_ITEM_SLOTS, widest or 0)) for f in fields])
    return raw_purchases(spark, d).join(slots, "purchase_id", "left")


def raw_users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    bday = F.date_add(F.lit("1950-01-01").cast("date"), ((k * 97) % 18000).cast("int"))
    return c.select(
        k.cast("string").alias("user_id"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("gender"),
        F.col("c_name").alias("phone"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(bday.cast("timestamp_ntz")).alias("birthday"),
        k.alias("seq"),
    )


def raw_addresses(spark: SparkSession, d: str) -> DataFrame:
    """One address per customer except every 9th; government = the nation's region name."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    geo = (table(spark, d, "nation", "n_nationkey", "n_regionkey")
           .join(table(spark, d, "region", "r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey")))
    return (c.filter(F.col("c_custkey") % 9 != 0)
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("c_custkey").cast("string").alias("user_id"),
                    F.col("r_name").alias("government"),
                    F.col("c_custkey").alias("seq")))


def raw_products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    s = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("title"),
        F.when(s % 7 == 0, F.lit("0")).otherwise(F.col("p_type")).alias("category_0"),
        F.when(s == 49, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("category_1"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") * 0.9).alias("sale_price"),
        F.when(s > 40, F.lit("true")).otherwise(F.lit("false")).alias("in_sale"),
        (s * 10).cast("double").alias("stock"),
        F.col("p_partkey").alias("seq"),
    )


def raw_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category id -> display name; PROMO is absent so its raw id is kept."""
    t = F.col("p_type")
    return (table(spark, d, "part", "p_type").filter(t != "PROMO").distinct()
            .select(t.alias("category_id"),
                    F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 100))).alias("name")))


def raw_ingredients(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name")
    return p.select(F.col("p_partkey").cast("string").alias("product_id"),
                    F.posexplode(F.split("p_name", " ")).alias("pos", "ingredient"),
                    F.col("p_partkey").alias("pk")) \
        .select("product_id", "ingredient", (F.col("pk") * 100 + F.col("pos")).alias("seq"))


def raw_collections(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    return (table(spark, d, "part", "p_brand").distinct()
            .select(b.alias("collection_id"),
                    F.concat(F.lit("Collection "), F.substring(b, 7, 10)).alias("name"),
                    F.when(b == "Brand#13", F.lit("true")).otherwise(F.lit("false")).alias("is_deleted")))


def raw_product_for_collection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    return p.select(F.col("p_partkey").cast("string").alias("product_id"),
                    F.col("p_brand").alias("collection_id"),
                    F.when(F.col("p_size") == 1, F.lit("True")).otherwise(F.lit("False")).alias("is_deleted"),
                    F.col("p_partkey").alias("seq"))


def raw_payment_log(spark: SparkSession, d: str) -> DataFrame:
    """Payment log rows from the event stream (purchase -> Paid, error -> Payment Failure)."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    gw = F.element_at(F.array(*[F.lit(g) for g in GATEWAYS]), (k % 4 + 1).cast("int"))
    return e.select(
        F.when(F.col("event_type") == "purchase", F.lit("Paid"))
         .when(F.col("event_type") == "error", F.lit("Payment Failure"))
         .otherwise(F.lit("Pending")).alias("status"),
        F.when(k % 10 == 9, F.lit(None).cast("string")).otherwise(gw).alias("payment_gateway"),
        F.when(k % 20 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("user_id").cast("string"), F.lit("-"), k.cast("string"))).alias("invoice_id"),
        F.col("value").alias("transaction_value"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("promotion_code"),
        F.col("event_id").alias("seq"),
    )


def raw_offers(spark: SparkSession, d: str) -> DataFrame:
    """One offer per brand; its promotion code is the brand."""
    p = table(spark, d, "part", "p_brand", "p_size")
    g = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("cnt"), F.avg("p_size").alias("avg_size"))
    return g.select(
        F.col("p_brand").alias("promotion_code"),
        F.concat(F.lit("Offer "), F.col("p_brand")).alias("name"),
        (F.col("cnt") % 5).cast("int").alias("reduction_type"),
        F.col("avg_size").alias("reduction_value"),
        (F.col("cnt") % 2 == 0).alias("is_auto"),
        F.col("cnt").alias("usage_count"),
        F.substring("p_brand", 7, 10).cast("int").alias("seq"),      # source order = brand number
    )


def raw_countries(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    return n.select(F.col("n_nationkey").cast("string").alias("code"),
                    F.col("n_name").alias("name"),
                    F.when(F.col("n_nationkey") == 24, F.lit("true")).otherwise(F.lit("false")).alias("is_deleted"),
                    F.col("n_nationkey").alias("seq"))


# ---- campaigns and sends (derived from the event stream: one campaign per props key k) ----
SEGMENT_CHOICES = ["VIP", "Loyal", "At Risk", "Lost", "All Customers"]
CHANNEL_CHOICES = ["Email", "WhatsApp", "Email + WhatsApp", "SMS"]
CAMPAIGN_STATUS = ["pending", "sent", "cancelled"]


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _campaign_cols(k):
    return {
        "segment": _pick(SEGMENT_CHOICES, k % 5),
        "subject": F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Offer "), k.cast("string"))),
        "body": F.when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Hello "), k.cast("string"))),
    }


def raw_campaigns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    g = e.groupBy(k.alias("k")).agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n"))
    kk = F.col("k")
    c = _campaign_cols(kk)
    return g.select(F.concat(F.lit("c"), kk.cast("string")).alias("id"), c["segment"].alias("segment"),
                    _pick(CHANNEL_CHOICES, kk % 4).alias("channel"), c["subject"].alias("subject"), c["body"].alias("body"),
                    (kk % 30).cast("double").alias("discount"), _pick(CAMPAIGN_STATUS, kk % 3).alias("status"),
                    "created_at", F.lit("admin").alias("created_by"), (F.col("n") * 10).alias("recipients"))


def raw_sends(spark: SparkSession, d: str) -> DataFrame:
    """Email (even event id) and WhatsApp (odd) sends; every 7th has no campaign id."""
    e = table(spark, d, "events", "event_id", "ts", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    c = _campaign_cols(k)
    cid = F.concat(F.lit("c"), k.cast("string"))
    email = F.col("event_id") % 2 == 0
    return e.select(
        F.concat(F.when(email, F.lit("e")).otherwise(F.lit("w")), F.col("event_id").cast("string")).alias("id"),
        F.when(email, F.lit("email")).otherwise(F.lit("whatsapp")).alias("kind"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise(cid).alias("campaign_id"),
        c["segment"].alias("segment"),
        F.when(email, F.coalesce(c["subject"], cid)).alias("subject"),
        F.when(~email, F.coalesce(c["body"], c["subject"], F.lit(""))).alias("message"),
        F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "signup", F.lit("queued"))
         .otherwise(F.lit("sent")).alias("status"),
        F.col("ts").alias("created_at"), F.lit(1).alias("recipients"))
