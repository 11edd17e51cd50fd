"""Rules, alerts and campaign bookkeeping (P1-P14) as DataFrame operators.

Campaign and send tables are keyed by id; the disjunctive send linkage (id, or segment + text
when the id is missing) is split into two equi-joins so both sides hash-partition on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.columns import col_

# ---- FIXED VALUES: alert rules (segment name, threshold %, severity, baseline offset) ------
ALERT_RULES = [("at_risk_high", "at risk", 35.0, "warning", 5.0),
               ("lost_high", "lost", 40.0, "error", 8.0)]
ALL_CUSTOMERS = "All Customers"


def segment_pct(counts: DataFrame) -> DataFrame:
    """(seg, segment, customers) -> + pct of all customers."""
    return counts.withColumn("pct", F.col("customers") * 100.0 / F.sum("customers").over(Window.partitionBy()))


def segment_alerts(counts: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """Threshold alerts by segment share, suppressed while an unacknowledged alert of the same
    type is open; returned together with the still-open alerts (P1)."""
    spark = counts.sparkSession
    rules = spark.createDataFrame(ALERT_RULES, "type string, name_lc string, threshold double, severity string, delta double")
    p = segment_pct(counts).withColumn("name_lc", F.lower("segment"))
    new = p.join(F.broadcast(rules), "name_lc").filter(F.col("pct") > F.col("threshold")) \
        .select("type", "segment", F.col("pct").alias("current_pct"), (F.col("pct") - F.col("delta")).alias("baseline_pct"),
                "delta", "severity")
    still_open = open_alerts.filter(~F.col("acknowledged"))
    new = new.join(still_open.select("type"), "type", "left_anti")
    return new.unionByName(still_open.select("type", "segment", "current_pct", "baseline_pct", "delta", "severity"))


def alert_history(snapshots: DataFrame, acknowledgements: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Life cycle of the threshold alerts over successive snapshots (P1): one row per time an alert was open, ``closed_at``
    null while it still is.

    ``snapshots``: (at, segment, customers), a row per segment and time; ``acknowledgements``: (type, at). A share beyond its
    threshold opens an alert unless one of the type is open; an acknowledgement closes what was opened at or before its time and
    does nothing when nothing is open; a later breach opens the alert again (``opening`` counts from 1). ``breaches`` counts the
    snapshots that broke the rule meanwhile. Of several segments of a rule's name the largest share counts. Rows without a
    time or type are ignored. All is done apart for each value of ``by``; a rule's window holds a row per snapshot
    that breaks it, never one per customer.
    """
    by = list(by)
    rules = snapshots.sparkSession.createDataFrame(ALERT_RULES, "type string, name_lc string, threshold double, severity string, delta double")
    all_of = F.sum("customers").over(Window.partitionBy(*by, "at"))
    share = snapshots.filter(F.col("at").isNotNull()).withColumn("pct", F.col("customers") * 100.0 / all_of).withColumn("name_lc", F.lower("segment"))
    breach = (share.join(F.broadcast(rules), "name_lc").filter(F.col("pct") > F.col("threshold"))
              .groupBy(*by, "type", "severity", "delta", "at").agg(F.max(F.struct("pct", "segment")).alias("top"))
              .select(*by, "type", "severity", "delta", "at", "top", F.lit(0).alias("ack")))
    ack = (acknowledgements.filter(F.col("at").isNotNull() & F.col("type").isNotNull()).select(*by, "type", "at").distinct()
           .join(F.broadcast(rules.select("type", "severity", "delta")), "type").withColumn("ack", F.lit(1)))
    # acknowledgements so far part a type's breaches into groups, each closed by the acknowledgement that ends it
    so_far = Window.partitionBy(*by, "type").orderBy("at", "ack").rowsBetween(Window.unboundedPreceding, 0)
    told = breach.unionByName(ack, allowMissingColumns=True).withColumn("part", F.sum("ack").over(so_far) - F.col("ack"))
    breaks = F.col("ack") == 0
    spans = (told.groupBy(*by, "type", "severity", "delta", "part")
             .agg(F.min(F.when(breaks, F.struct("at", "top"))).alias("first"), F.sum((1 - F.col("ack")).cast("long")).alias("breaches"),
                  F.max(F.when(~breaks, F.col("at"))).alias("closed_at")).filter(F.col("first").isNotNull()))
    pct = F.col("first.top.pct")
    return spans.select(*by, "type", F.row_number().over(Window.partitionBy(*by, "type").orderBy("first.at")).alias("opening"),
                        F.col("first.top.segment").alias("segment"), "severity", pct.alias("current_pct"), (pct - F.col("delta")).alias("baseline_pct"),
                        "delta", F.col("first.at").alias("opened_at"), "closed_at", "breaches")


def open_alerts(history: DataFrame) -> DataFrame:
    """The alerts of ``alert_history`` not yet acknowledged, in the form that ``segment_alerts`` takes."""
    return history.filter(F.col("closed_at").isNull()).select("type", "segment", "current_pct", "baseline_pct", "delta", "severity",
                                                              F.lit(False).alias("acknowledged"))


def smart_notifications(counts: DataFrame, seg_revenue: DataFrame, yoy: DataFrame, category_share: DataFrame) -> DataFrame:
    """Rule notifications from the KPIs, ordered unread first, then priority, then recency.

    counts: (seg, segment, customers); seg_revenue: (seg, revenue); yoy: (yoy_pct);
    category_share: (category, pct, rank)."""
    p = segment_pct(counts).withColumn("pct_r", F.round("pct", 0)).withColumn("lc", F.lower("segment"))
    first = lambda cond: p.filter(cond).orderBy("seg").limit(1)  # noqa: E731  (first segment by id)
    at_risk = first(F.col("lc").contains("at risk")).filter((F.col("customers") > 0) & (F.col("pct_r") >= 15)) \
        .select(F.lit("at-risk-high").alias("id"), F.lit("alert").alias("category"),
                F.when(F.col("pct_r") >= 25, F.lit("high")).otherwise(F.lit("medium")).alias("priority"),
                F.lit(False).alias("read"), F.lit(5 * 60).alias("age_s"), F.col("pct_r").alias("value"))
    lost = first(F.col("lc").contains("lost")).filter((F.col("customers") > 0) & (F.col("pct_r") >= 10)) \
        .select(F.lit("lost-seg"), F.lit("action"), F.lit("high"), F.lit(False), F.lit(12 * 60), F.col("pct_r"))
    # FIXED VALUES: rule ids, thresholds on rounded shares, priorities and ages in seconds
    rs = seg_revenue.withColumn("share", F.floor(F.col("revenue") * 100.0 / F.sum("revenue").over(Window.partitionBy()) + 0.5))
    vip = first(F.col("lc").contains("vip")).join(rs.select("seg", "share"), "seg").filter(F.col("share") >= 40) \
        .select(F.lit("vip-revenue"), F.lit("insight"), F.lit("medium"), F.lit(False), F.lit(30 * 60), F.col("share"))
    y = yoy.filter(F.col("yoy_pct").isNotNull())
    yneg = y.filter(F.col("yoy_pct") < 0).select(F.lit("yoy-negative"), F.lit("alert"), F.lit("high"), F.lit(False),
                                                 F.lit(60 * 60), F.col("yoy_pct"))
    ypos = y.filter(F.col("yoy_pct") > 100).select(F.lit("yoy-strong"), F.lit("insight"), F.lit("low"), F.lit(False),
                                                   F.lit(2 * 3600), F.col("yoy_pct"))
    cat = category_share.withColumn("pct", F.floor(F.col("pct") + 0.5)).filter((F.col("rank") == 1) & (F.col("pct") >= 50)) \
        .select(F.lit("category-concentration"), F.lit("insight"), F.lit("low"), F.lit(True), F.lit(4 * 3600), F.col("pct"))
    loaded = counts.agg(F.sum("customers").cast("double").alias("v")) \
        .select(F.lit("data-loaded"), F.lit("system"), F.lit("low"), F.lit(True), F.lit(10), F.col("v"))
    parts = [at_risk, lost, vip, yneg, ypos, cat, loaded]
    parts = [x.toDF("id", "category", "priority", "read", "age_s", "value") for x in parts]
    allp = reduce(DataFrame.unionByName, [x.withColumn("value", F.col("value").cast("double")) for x in parts])
    prio = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return allp.withColumn("position", F.row_number().over(Window.orderBy(F.col("read").cast("int"), prio, F.col("age_s"))))


def campaign_audience(campaigns: DataFrame, counts: DataFrame) -> DataFrame:
    """Audience of each campaign's segment by name; ``All Customers`` = all (P3). Missing or
    empty segments -> null."""
    total = counts.agg(F.sum("customers").alias("_total"))
    c = campaigns.join(counts.select("segment", "customers"), "segment", "left").join(F.broadcast(total), how="inner")
    aud = F.when(F.col("segment").isNull() | (F.col("segment") == ALL_CUSTOMERS),
                 F.when(F.col("_total") > 0, F.col("_total"))).otherwise(F.when(F.col("customers") > 0, F.col("customers")))
    return c.select("id", "segment", aud.alias("audience"))


def cap_recipients(requested, audience) -> F.Column:
    """Requested recipients clamped to [0, audience] (no cap when the audience is unknown)."""
    r = col_(requested)
    a = col_(audience)
    return F.greatest(F.lit(0), F.when(a.isNotNull() & (r > a), a).otherwise(r))


def link_sends(campaigns: DataFrame, sends: DataFrame) -> DataFrame:
    """(campaign id, send id) links: by campaign id, or — for sends without one — by segment and
    text (email subject = subject or id; WhatsApp message = body, subject or '') (P5)."""
    by_id = sends.filter(F.col("campaign_id").isNotNull()) \
        .join(campaigns.select(F.col("id").alias("campaign_id")), "campaign_id") \
        .select(F.col("campaign_id").alias("campaign"), F.col("id").alias("send_id"), "kind", "status")
    keyed = campaigns.select(F.col("id").alias("campaign"), "segment",
                             F.coalesce("subject", "id").alias("email_text"),
                             F.coalesce("body", "subject", F.lit("")).alias("wa_text"))
    orphan = sends.filter(F.col("campaign_id").isNull()) \
        .withColumn("text", F.when(F.col("kind") == "email", F.col("subject")).otherwise(F.col("message")))
    em = orphan.filter(F.col("kind") == "email").join(keyed.select("campaign", "segment", F.col("email_text").alias("text")),
                                                      ["segment", "text"])
    wa = orphan.filter(F.col("kind") == "whatsapp").join(keyed.select("campaign", "segment", F.col("wa_text").alias("text")),
                                                         ["segment", "text"])
    fallback = em.unionByName(wa).select("campaign", F.col("id").alias("send_id"), "kind", "status")
    return by_id.unionByName(fallback)


def campaign_status_rollup(campaigns: DataFrame, sends: DataFrame) -> DataFrame:
    """All sends sent -> sent; all failed -> cancelled; otherwise pending; no sends -> unchanged.
    Only sends that carry the campaign id count."""
    s = sends.filter(F.col("campaign_id").isNotNull()).groupBy(F.col("campaign_id").alias("id")).agg(
        F.bool_and(F.col("status") == "sent").alias("all_sent"), F.bool_and(F.col("status") == "failed").alias("all_failed"))
    c = campaigns.join(s, "id", "left")
    new = F.when(F.col("all_sent").isNull(), F.col("status")).when(F.col("all_sent"), F.lit("sent")) \
        .when(F.col("all_failed"), F.lit("cancelled")).otherwise(F.lit("pending"))
    return c.select("id", "segment", F.col("status").alias("old_status"), new.alias("status"))


def active_campaigns(campaigns: DataFrame, active_names: DataFrame) -> DataFrame:
    """Hide pending campaigns whose segment is not an active segment name; those without one stay."""
    act = active_names.select(F.col("segment").alias("_seg")).distinct()
    c = campaigns.join(act, campaigns["segment"] == act["_seg"], "left")
    keep = (F.col("status") != "pending") | F.col("_seg").isNotNull() | (F.col("segment") == ALL_CUSTOMERS) \
        | (F.coalesce("segment", F.lit("")) == "")
    return c.filter(keep).drop("_seg")


def clean_campaigns(campaigns: DataFrame, active_names: DataFrame) -> DataFrame:
    """After a change of K: campaigns not yet sent whose segment is gone are removed."""
    act = active_names.select(F.col("segment").alias("_seg")).distinct()
    c = campaigns.join(act, campaigns["segment"] == act["_seg"], "left")
    keep = (F.col("status") == "sent") | F.col("_seg").isNotNull() | (F.col("segment") == ALL_CUSTOMERS) \
        | (F.coalesce("segment", F.lit("")) == "")
    return c.filter(keep).drop("_seg")


def removed_segments(old_names: DataFrame, new_names: DataFrame) -> DataFrame:
    """Segment names dropped by a smaller K."""
    return old_names.select("segment").distinct().join(new_names.select("segment"), "segment", "left_anti")


def search_campaigns(campaigns: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Status filter plus case-insensitive contains over segment, channel and subject."""
    c = campaigns
    if status and status != "all":
        c = c.filter(F.col("status") == status)
    if q:
        ql = F.lit(q.lower())
        c = c.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(x)), ql), F.lit(False))
                                                   for x in ("segment", "channel", "subject")]))
    return c


def campaign_counts(campaigns: DataFrame) -> DataFrame:
    """Campaigns by status."""
    return campaigns.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def normalize_channel(channel) -> F.Column:
    """Free channel text -> email-whatsapp / whatsapp / email / sms / push / default (P10)."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col_(channel), F.lit(""))), r"\s+", ""), r"\+", "-")
    has = lambda s: F.contains(c, F.lit(s))
    return (F.when(has("whatsapp") & has("email"), F.lit("email-whatsapp")).when(has("whatsapp"), F.lit("whatsapp"))
            .when(has("email"), F.lit("email")).when(has("sms"), F.lit("sms")).when(has("push"), F.lit("push"))
            .otherwise(F.lit("default")))


#: Parts of the customers of one segment name.
SALTS = 32


def build_send_list(scored: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Audience rows (customer id, phone) of every campaign's segment."""
    # a customer has two keys, its segment and all customers; salts spread the customers of a key, of which there are few,
    # over tasks, and the campaigns of a key are copied once a salt
    salt = F.pmod(F.xxhash64("customer_id"), F.lit(SALTS)).cast("int").alias("salt")
    keys = scored.select("customer_id", "phone", salt, F.explode(F.array_distinct(F.array("segment", F.lit(ALL_CUSTOMERS)))).alias("segment"))
    copies = campaigns.filter(F.col("segment").isNotNull()).select(F.col("id").alias("campaign_id"), "segment", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return keys.join(copies, ["segment", "salt"]).select("campaign_id", "customer_id", "phone")


def expand_campaign_sends(campaigns: DataFrame) -> DataFrame:
    """One queued email send and/or one WhatsApp send per campaign by its channel text (P12). An email carries the campaign's
    body and discount, a WhatsApp send its text; both carry who made the campaign."""
    ch = F.lower(F.coalesce("channel", F.lit("")))
    none = F.lit(None).cast("string")
    arr = F.array(
        F.struct(F.lit("email").alias("kind"), F.contains(ch, F.lit("email")).alias("on"), F.coalesce("subject", "id").alias("subject"),
                 none.alias("message"), F.col("body").alias("send_body"), F.col("discount").alias("send_discount")),
        F.struct(F.lit("whatsapp").alias("kind"), F.contains(ch, F.lit("whatsapp")).alias("on"), none.alias("subject"),
                 F.coalesce("body", "subject", F.lit("")).alias("message"), none.alias("send_body"),
                 F.lit(None).cast(campaigns.schema["discount"].dataType).alias("send_discount")))
    x = campaigns.select(F.col("id").alias("campaign_id"), "segment", "recipients", "created_at", "created_by",
                         F.inline(F.filter(arr, lambda s: s["on"])))
    return x.select("campaign_id", "kind", "segment", "subject", "message", F.col("send_body").alias("body"),
                    F.col("send_discount").alias("discount"), F.coalesce("recipients", F.lit(0)).alias("recipients"),
                    F.lit("queued").alias("status"), "created_at", "created_by")


def propagate_campaign_status(campaigns: DataFrame, sends: DataFrame) -> DataFrame:
    """Campaign status copied to its linked sends: sent -> sent, cancelled -> failed, pending
    (re-activated) -> queued (P13). Deleted campaigns (absent) drop their id-linked sends."""
    links = link_sends(campaigns, sends)
    st = campaigns.select(F.col("id").alias("campaign"), F.col("status").alias("c_status"))
    new = F.when(F.col("c_status") == "sent", F.lit("sent")).when(F.col("c_status") == "cancelled", F.lit("failed")) \
        .otherwise(F.lit("queued"))
    return links.join(st, "campaign").select("send_id", "campaign", "kind", F.col("status").alias("old_status"),
                                             new.alias("status"))


def latest_campaigns(rows: DataFrame) -> DataFrame:
    """One row per id: the one created last, of equally old ones the one whose JSON form sorts last."""
    row = F.struct(*rows.columns)
    kept = rows.groupBy("id").agg(F.max_by(row, F.struct("created_at", F.to_json(row))).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in rows.columns])


def merge_new_campaigns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append incoming campaigns whose id is not present yet, the latest row of each id."""
    return existing.unionByName(latest_campaigns(incoming).join(existing.select("id"), "id", "left_anti"))


def replace_campaigns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming campaigns, the latest row of each id, take the place of those with their id, and new ones are appended."""
    return existing.join(incoming.select("id"), "id", "left_anti").select(*existing.columns).unionByName(latest_campaigns(incoming))


def _last_change(rows: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """(row, deleted) of each id's last change; among equal ones a deletion, then the JSON form that sorts last."""
    row = F.struct(*columns)
    rank = F.struct(*order_by, "deleted", F.to_json(row))
    return rows.groupBy("id").agg(F.max_by(F.struct(row.alias("row"), "deleted"), rank).alias("last")).select("last.row", "last.deleted")


def fold_changes(existing: DataFrame, log: DataFrame, order_by: tuple[str, ...] = ("changed_at",)) -> DataFrame:
    """Campaigns after a log of edits: each id's last change counts, a tombstone removes it.

    ``log`` has the columns of ``existing``, ``deleted`` (null: false) and those of ``order_by``, by which the changes of an id follow
    one another. An id may have any number of changes: each task first reduces its own. Ids not in the log stay, new ones
    are added, equal ids in ``existing`` become one; campaigns without an id stay, changes without one are ignored.
    """
    columns, order = existing.columns, list(order_by)
    # a struct sorts nulls first, so a stored row comes before any change of it
    told = log.filter(F.col("id").isNotNull()).select(F.struct(*columns).alias("row"), F.struct(*order).alias("order"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    stored = existing.filter(F.col("id").isNotNull()).select(F.struct(*columns).alias("row"), F.lit(None).cast(told.schema["order"].dataType).alias("order"),
                                                            F.lit(False).alias("deleted"))
    every = stored.unionByName(told).select("row.*", "order", "deleted")
    last = _last_change(every, columns, ["order"]).filter(~F.col("deleted")).select("row.*")
    return last.unionByName(existing.filter(F.col("id").isNull()))


def fold_changes_into_sends(existing: DataFrame, log: DataFrame, sends: DataFrame, order_by: tuple[str, ...] = ("changed_at",)) -> DataFrame:
    """Sends after the same log (P13): those linked to a removed campaign go; those linked to an edited one take over its
    texts and recipients and, where the edit changed it, its status; all others stay."""
    told = log.filter(F.col("id").isNotNull()).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    last = _last_change(told, existing.columns, list(order_by))
    gone = existing.join(last.filter("deleted").select("row.id"), "id", "left_semi")
    edited = last.filter(~F.col("deleted")).select("row.*").join(existing.select("id"), "id", "left_semi")
    kept = drop_deleted_sends(gone, sends)
    new = F.when(F.col("status") == "sent", F.lit("sent")).when(F.col("status") == "cancelled", F.lit("failed")).otherwise(F.lit("queued"))
    turned = edited.select("id", "status").join(existing.select("id", F.col("status").alias("_old")), "id") \
        .filter(~F.col("status").eqNullSafe(F.col("_old"))).select(F.col("id").alias("campaign"), new.alias("_status"))
    was = existing.join(edited.select("id"), "id", "left_semi")
    moved = link_sends(was, kept).groupBy("send_id").agg(F.min("campaign").alias("campaign")).join(turned, "campaign") \
        .select(F.col("send_id").alias("id"), "_status")
    return sync_sends(edited, existing, kept).join(moved, "id", "left") \
        .select(*[F.coalesce("_status", "status").alias("status") if c == "status" else F.col(c) for c in sends.columns])


def search_sends(sends: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Status filter plus case-insensitive contains over segment and subject (email) or message (WhatsApp)."""
    s = sends if not status or status == "all" else sends.filter(F.col("status") == status)
    if not q:
        return s
    said = F.when(F.col("kind") == "email", F.col("subject")).otherwise(F.col("message"))
    return s.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(x), F.lit(q.lower())), F.lit(False)) for x in (F.col("segment"), said)]))


def drop_deleted_sends(deleted: DataFrame, sends: DataFrame) -> DataFrame:
    """Sends left when campaigns are deleted: those linked to one, by id or by text, go; all others stay."""
    return sends.join(link_sends(deleted, sends).select(F.col("send_id").alias("id")).distinct(), "id", "left_anti").select(*sends.columns)


def sync_sends(edited: DataFrame, before: DataFrame, sends: DataFrame) -> DataFrame:
    """Sends after campaigns are edited: those linked to the campaign as it was (``before``) take over its new
    subject or message and its recipients, emails also its body and discount where the sends have such columns; unlinked
    sends stay as they are (P13)."""
    new = edited.select(F.col("id").alias("_c"), F.col("subject").alias("_subject"),
                        F.coalesce(F.when(F.col("body") != "", F.col("body")), "subject").alias("_message"), F.col("recipients").alias("_recipients"),
                        F.col("body").alias("_body"), F.col("discount").alias("_discount"))
    links = link_sends(before.join(edited.select("id"), "id", "left_semi"), sends).groupBy(F.col("send_id").alias("id")).agg(F.min("campaign").alias("_c"))
    x = sends.join(links, "id", "left").join(new, "_c", "left")
    hit, email = F.col("_c").isNotNull(), F.col("kind") == "email"
    change = {"subject": F.when(hit & email, F.col("_subject")).otherwise(F.col("subject")),
              "message": F.when(hit & ~email, F.col("_message")).otherwise(F.col("message")),
              "recipients": F.when(hit, F.coalesce("_recipients", "recipients")).otherwise(F.col("recipients"))}
    change |= {c: F.when(hit & email, F.col("_" + c)).otherwise(F.col(c)) for c in ("body", "discount") if c in sends.columns}
    return x.select(*[change[c].alias(c) if c in change else F.col(c) for c in sends.columns])
