"""Customer and reference look-ups as batch operators (Q1-Q12).

The source served these as REST reads over a document store; here each is a DataFrame query
over the scored-features table. Sorted pages use a total order (value, then customer id) so a
page is deterministic; ``orderBy(...).limit(n)`` plans as a distributed top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.columns import col_
from cohortlab.functions.frames import top_n_per_group

# FIXED VALUES: sortable fields and their direction.
SORT_MAP = {"total_spend": ("total_spend", False), "recency": ("recency", True),
            "order_count": ("order_count", False), "aov": ("aov", False)}


def _ci(c: str, pattern: str) -> F.Column:
    return F.col(c).rlike("(?i)" + pattern)


def search_customers(scored: DataFrame, region: str | None = None, gender: str | None = None,
                     channel: str | None = None, q: str | None = None, seg: int | None = None) -> DataFrame:
    """Case-insensitive regex filters (region, gender, top channel), ``q`` on id or phone, seg
    equality (Q1). Predicates stay column expressions, so they reach the scan of a stored table."""
    f = scored
    if region:
        f = f.filter(_ci("region", region))
    if gender:
        f = f.filter(_ci("gender", gender))
    if channel:
        f = f.filter(_ci("top_channel", channel))
    if q:
        f = f.filter(_ci("customer_id", q) | F.coalesce(_ci("phone", q), F.lit(False)))
    if seg is not None:
        f = f.filter(F.col("seg") == seg)
    return f


def page(df: DataFrame, sort: str = "total_spend", offset: int = 0, limit: int = 500) -> DataFrame:
    """One page of a whitelisted sort (unknown -> total_spend desc) plus the match count (Q2)."""
    field, asc = SORT_MAP.get(sort, SORT_MAP["total_spend"])
    o = F.col(field).asc() if asc else F.col(field).desc()
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(o, F.col("customer_id").asc()).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))


def random_customers(df: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """A seeded random sample of the matches: the n smallest md5(id#seed) (Q3)."""
    key = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f"#{seed}")))
    return df.withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def customer_profile_by_id(scored: DataFrame, customer_id: str) -> DataFrame:
    """Point look-up (Q4)."""
    return scored.filter(F.col("customer_id") == F.lit(str(customer_id)))


def top_per_segment(scored: DataFrame, n: int = 300) -> DataFrame:
    """Top-n customers by spend in every segment in one job (Q5); a two-phase top-n, so a
    segment holding a third of all customers is never sorted in one task."""
    return top_n_per_group(scored, ["seg"], [F.desc("total_spend"), F.asc("customer_id")], n, "customer_id")


def offers_list(offers: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` offers in source order (Q6)."""
    return offers.orderBy("seq", "promotion_code").limit(limit)


def offer_stats(offers: DataFrame) -> DataFrame:
    """Totals: offers, automatic, manual (Q7); the type distribution and top-10 by usage are
    ``offer_type_distribution`` / ``top_offers``."""
    return offers.agg(F.count(F.lit(1)).alias("total_offers"),
                      F.sum(F.col("is_auto_offer").cast("int")).cast("long").alias("auto_offers_count")) \
        .withColumn("manual_offers_count", F.col("total_offers") - F.col("auto_offers_count"))


def offer_type_distribution(offers: DataFrame) -> DataFrame:
    return offers.groupBy("reduction_type").agg(F.count(F.lit(1)).alias("n"))


def top_offers(offers: DataFrame, n: int = 10) -> DataFrame:
    """Largest usage first; ties keep source order (Q7)."""
    return offers.orderBy(F.desc("offer_usage_count"), F.asc("seq")).limit(n) \
        .select("offer_name", "reduction_type", "reduction_value", "offer_usage_count")


def custom_segment(scored: DataFrame, seg: int | None = None, region: str | None = None,
                   gender: str | None = None) -> DataFrame:
    """Audience size of a filter (Q9)."""
    return search_customers(scored, region=region, gender=gender, seg=seg).agg(F.count(F.lit(1)).alias("count"))


def custom_segments(scored: DataFrame, filters: DataFrame) -> DataFrame:
    """Many saved filters at once: each filter row (label, seg, region, gender) is matched with the few
    distinct (seg, region, gender) that customers have, whose counts are added up first (Q9)."""
    f = filters
    kinds = scored.groupBy("seg", "region", "gender").agg(F.count(F.lit(1)).alias("_n"))
    cond = ((f["seg"].isNull() | (kinds["seg"] == f["seg"]))
            & (f["region"].isNull() | F.regexp(kinds["region"], F.concat(F.lit("(?i)"), f["region"])))
            & (f["gender"].isNull() | F.regexp(kinds["gender"], F.concat(F.lit("(?i)"), f["gender"]))))
    hits = kinds.join(f, cond).groupBy("label").agg(F.sum("_n").alias("count"))
    return filters.select("label").join(hits, "label", "left").fillna(0, ["count"])


def segment_overview(names: DataFrame, counts: DataFrame) -> DataFrame:
    """Segment meta joined with counts (Q10)."""
    return names.join(counts, "seg", "left")


def feature_importance_sorted(importance: DataFrame) -> DataFrame:
    """Importance with its rank (value desc, feature) (Q11)."""
    return importance.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), F.asc("feature"))))


# FIXED VALUES: severity colours (good, watch, bad) and thresholds.
GOOD, WATCH, BAD = "#059669", "#d97706", "#dc2626"
SEGMENT_WATCH = "#e07820"


def recency_label(days) -> F.Column:
    """Today / Yesterday / n days ago / nw ago / nmo ago / ny ago (Q12)."""
    d = col_(days)
    r = lambda x: F.round(x, 0).cast("long").cast("string")  # noqa: E731  (half-up, as Math.round for x >= 0)
    return (F.when(d == 0, F.lit("Today")).when(d == 1, F.lit("Yesterday"))
            .when(d < 7, F.concat(d.cast("string"), F.lit(" days ago")))
            .when(d < 30, F.concat(r(d / 7.0), F.lit("w ago")))
            .when(d < 365, F.concat(r(d / 30.0), F.lit("mo ago")))
            .otherwise(F.concat(r(d / 365.0), F.lit("y ago"))))


def recency_severity(days) -> F.Column:
    d = col_(days)
    return F.when(d < 30, F.lit(GOOD)).when(d < 90, F.lit(WATCH)).otherwise(F.lit(BAD))


def return_severity(rate, segment_level: bool = False) -> F.Column:
    r = col_(rate)
    if segment_level:
        return F.when(r < 0.05, F.lit(GOOD)).when(r < 0.15, F.lit(SEGMENT_WATCH)).otherwise(F.lit(BAD))
    return F.when(r < 0.05, F.lit(GOOD)).when(r < 0.12, F.lit(WATCH)).otherwise(F.lit(BAD))
