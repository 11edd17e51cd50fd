"""Hand-written micro-fixtures, one per rule."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import campaigns as CP
from cohortlab.operators import cleaning as C
from cohortlab.operators import cluster as M
from cohortlab.operators import features as FE
from cohortlab.operators import prep as P
from cohortlab.operators import scores as SC
from cohortlab.operators import text as TX
from cohortlab.streaming import lockout as LK

T0 = dt.datetime(2024, 3, 31, 12, 0, 0)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_allocation_split_equal_split_and_itemless(spark):
    oi = spark.createDataFrame([
        ("o1", 100.0, "p1", 10.0, 0.0, False, 1.0),
        ("o1", 100.0, "p2", 10.0, 5.0, True, 3.0),      # in sale: 5 x 3 = 15 gross
        ("o2", 9.0, "p1", 0.0, 0.0, False, 1.0),        # Σ gross = 0 -> equal split
        ("o2", 9.0, "p3", 0.0, 0.0, False, 2.0),
        ("o3", 7.5, None, None, None, None, None),      # no items -> fallback line
    ], "order_id string, full_amount double, product_id string, price double, sale_price double, in_sale boolean, qty double")
    out = C.allocate_order_total(oi)
    got = rows(out, "order_id", "product_id", "net_amount", "discount_pct")
    assert got == [("o1", "p1", 40.0, 0.0), ("o1", "p2", 60.0, 0.0), ("o2", "p1", 4.5, 0.0), ("o2", "p3", 4.5, 0.0),
                   ("o3", "unknown", 7.5, 0.0)]
    # a discount appears when the allocated net is below the item gross
    oi2 = spark.createDataFrame([("o", 20.0, "a", 10.0, 0.0, False, 1.0), ("o", 20.0, "b", 15.0, 0.0, False, 2.0)],
                                oi.schema)
    got2 = rows(C.allocate_order_total(oi2), "product_id", "net_amount", "discount_pct")
    assert got2 == [("a", 5.0, 50.0), ("b", 15.0, 50.0)]


def test_unpivot_items_holes_text_and_quantity(spark):
    wide = spark.createDataFrame([("o1", "p1", "2.5", "", "true", "0", "x", None, None, None, None, None, None,
                                   "p3", "1", "0.5", "False", "2", "0.1")],
                                 "purchase_id string, item0_type_id string, item0_price string, item0_sale_price string, "
                                 "item0_in_sale string, item0_quantity string, item0_discount_value string, "
                                 "item1_type_id string, item1_price string, item1_sale_price string, item1_in_sale string, "
                                 "item1_quantity string, item1_discount_value string, item2_type_id string, item2_price string, "
                                 "item2_sale_price string, item2_in_sale string, item2_quantity string, item2_discount_value string")
    got = rows(C.unpivot_items(wide), "slot", "product_id", "price", "sale_price", "in_sale", "qty", "discount_value")
    assert got == [(0, "p1", 2.5, 0.0, True, 1.0, 0.0), (2, "p3", 1.0, 0.5, False, 2.0, 0.1)]


def test_guest_ids_every_spelling(spark):
    ids = ["", "0", "None", "NAN", " 000000000000000000000000 ", None, "42"]
    p = spark.createDataFrame([(f"o{i}", u, 1) for i, u in enumerate(ids)], "purchase_id string, user_id string, status int")
    assert [r.user_id for r in C.paid_orders(p).collect()] == ["42"]
    r = spark.createDataFrame([(f"r{i}", u, 3, dt.datetime(2024, 1, 1), 1.0, None) for i, u in enumerate(ids)],
                              "purchase_id string, user_id string, status int, updated_date timestamp_ntz, "
                              "full_amount double, note string")
    got = rows(C.clean_returns(r), "customer_id", "return_reason")
    assert got == [("42", "Not specified")] + [("__unattributed__", "Not specified")] * 5


def test_finalize_drops_non_positive_and_duplicates(spark):
    df = spark.createDataFrame([("o", 1.0), ("o", 1.0), ("o", 0.0), ("o", -2.0), ("p", 3.0)], "order_id string, net_amount double")
    df = df.withColumn("discount_pct", F.lit(0.0))
    assert rows(C.finalize_lines(df), "order_id", "net_amount") == [("o", 1.0), ("p", 3.0)]


def test_mode_tie_smallest_value(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("k", None), ("k", None), ("k", None)],
                               "k string, v string")
    assert C.top_value(df, ["k"], "v", "top").collect()[0].top == "a"


def _line(c, o, ts, net, cat="X", prod="p", ch="Cash"):
    return (o, c, ts, net, 0.0, prod, cat, ch)


LINE_SCHEMA = ("order_id string, customer_id string, order_date timestamp_ntz, net_amount double, discount_pct double, "
               "product_id string, category string, channel string")


def test_features_windows_gaps_slope_and_momentum(spark):
    d = dt.timedelta
    L = [
        # customer a: one order with two lines at the reference date -> ipt 0, one month -> slope 0
        _line("a", "a1", T0, 10.0, prod="p1"), _line("a", "a1", T0, 5.0, prod="p2"),
        # customer b: 29d23h, 30d and 30d+1s before the reference date
        _line("b", "b1", T0 - d(days=29, hours=23), 1.0), _line("b", "b2", T0 - d(days=30), 2.0),
        _line("b", "b3", T0 - d(days=30, seconds=1), 4.0),
        # customer c: months 0 and 2 before -> slope over (x, y); old spend zero
        _line("c", "c1", T0 - d(days=61), 3.0), _line("c", "c2", T0 - d(days=1), 9.0),
        # customer d: older spend 4 (200 days back), recent spend 6
        _line("d", "d1", T0 - d(days=200), 4.0), _line("d", "d2", T0 - d(days=10), 6.0),
    ]
    lines = spark.createDataFrame(L, LINE_SCHEMA).withColumn("net_amount", F.col("net_amount").cast("decimal(18,3)"))
    returns = spark.createDataFrame([("r", "b", 2.0)], "return_id string, customer_id string, refund_amount double") \
        .withColumn("refund_amount", F.col("refund_amount").cast("decimal(18,2)"))
    f = {r.customer_id: r for r in FE.customer_features(lines, returns).collect()}
    a, b, c = f["a"], f["b"], f["c"]
    assert (a.order_count, a.unique_prods, a.active_months, a.clv_slope, a.ipt, a.recency) == (1, 2, 1, 0.0, 0.0, 0)
    assert (b.spend_30, b.orders_30, b.spend_90, b.recency, b.lifespan) == (3.0, 2, 7.0, 29, 0)
    assert b.return_rate == pytest.approx(1 / 3) and b.refund_ratio == pytest.approx(2 / 7)
    assert b.ipt == pytest.approx(0.0)            # gaps of 0 and 0 whole days
    assert c.active_months == 2 and c.clv_slope == pytest.approx((9.0 - 3.0) / 2)
    assert c.ipt == pytest.approx(60.0) and c.lifespan == 60
    assert c.spend_momentum is None               # old spend (365 - 90) is 0 while recent spend is not
    assert a.spend_momentum is None
    assert f["d"].spend_momentum == pytest.approx((6.0 - 4.0) / 4.0)


def test_segment_naming_and_ranking_can_disagree(spark):
    # cluster 0: high orders, low recent spend; cluster 1: high recent spend
    rowsf = [("x%d" % i, 0, 10.0, 9, 100) for i in range(3)] + [("y%d" % i, 1, 500.0, 1, 5) for i in range(3)]
    f = spark.createDataFrame(rowsf, "customer_id string, cluster int, spend_365 double, order_count long, recency long")
    rk = {r.cluster: r.seg for r in M.rank_clusters(f).collect()}
    assert rk == {1: 0, 0: 1}
    names = {r.seg: r.name for r in M.name_segments(f.withColumnRenamed("cluster", "seg"), 2).collect()}
    assert names == {1: "VIP", 0: "Lost"}


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(0, 0.3, (20, 2)), rng.normal(3, 0.3, (20, 2)), [[10.0, 10.0]]])
    lab = np.array([0] * 20 + [1] * 20 + [2])
    frame = spark.createDataFrame(pd.DataFrame({"customer_id": [str(i) for i in range(len(X))], "cluster": lab, "f1": X[:, 0], "f2": X[:, 1]}))
    square = ((X[:, None] - X[None]) ** 2).sum(-1)
    for D, got in ((square, SC.silhouette(frame, "cluster", ["f1", "f2"])), (np.sqrt(square), SC.silhouette_sampled(frame, 5000, "cluster", ["f1", "f2"]))):
        s = []
        for i in range(len(X)):
            own = lab == lab[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = D[i, own].sum() / (own.sum() - 1)
            b = min(D[i, lab == k].mean() for k in set(lab) if k != lab[i])
            s.append((b - a) / max(a, b))
        assert got.first()[0] == pytest.approx(float(np.mean(s)), rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30_000])
def test_percentiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).unionByName(spark.createDataFrame([(None, None)], "a double, b double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = P.percentiles(frame, ["a", "b"], probs)
    row = out.first()
    assert list(row["_q_a"]) == pytest.approx(list(np.quantile(a, probs))) and list(row["_q_b"]) == pytest.approx(list(np.quantile(b, probs)))
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()


def test_missing_zero_and_text_quantities_keep_their_lines(spark):
    orders = spark.createDataFrame([("o1", "7", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 1, 10.0, "0", "1", "kw", None, None)],
                                   "purchase_id string, user_id string, creation_date timestamp_ntz, updated_date timestamp_ntz, status int, full_amount double,"
                                   "payment_method string, source string, country_id string, promotion_code string, note string")
    items = spark.createDataFrame([("o1", "p1", 2.0, None), ("o1", "p2", 2.0, "0"), ("o1", "p3", 2.0, "1"), ("o1", "p4", 2.0, "many"), ("o1", "0", 2.0, "1")],
                                  "purchase_id string, product_id string, price double, qty string")
    got = {r.product_id: float(r.net_amount) for r in C.clean_orders(orders, items).collect()}
    assert got == {"p1": 2.5, "p2": 2.5, "p3": 2.5, "p4": 2.5}


def test_slots_beyond_the_usual_layout_are_kept(spark):
    wide = spark.createDataFrame([("o1", *[f"p{i}" for i in range(40)])], "purchase_id string, " + ", ".join(f"item{i}_type_id string" for i in range(40)))
    assert sorted(r.slot for r in C.unpivot_items(wide).collect()) == list(range(40))


def test_a_null_never_is_the_most_frequent_value(spark):
    lines = spark.createDataFrame([("a", None)] * 3 + [("a", "x"), ("b", None)], "customer_id string, category string")
    got = {r.customer_id: (r.n, r.top) for r in FE.top_per_customer(lines, "category", "n", "top").collect()}
    assert got == {"a": (1, "x"), "b": (0, None)}


def test_month_series_edges(spark):
    from cohortlab.operators import insights as DI
    months = lambda n, zero=(): spark.createDataFrame([(f"{2020 + i // 12}-{i % 12 + 1:02d}", 0.0 if i in zero else 100.0 + i) for i in range(n)], "ym string, revenue double")
    assert DI.monthly_yoy_delta(months(23)).count() == 0
    rows_ = {r.ym: r.yoy_delta_pct for r in DI.monthly_yoy_delta(months(24, zero=(3,))).collect()}
    assert len(rows_) == 12 and rows_["2021-04"] == 0 and rows_["2021-01"] == 12
    quarters = {r.quarter: (r.revenue, r.pct, r.is_best) for r in DI.quarter_share(months(2)).collect()}
    assert quarters == {"Q1": (201.0, 100, True), "Q2": (0.0, 0, False), "Q3": (0.0, 0, False), "Q4": (0.0, 0, False)}
    div = spark.createDataFrame([(0, 0.596), (1, 0.594), (2, 0.345)], "seg int, avg_diversity double")
    assert {r.seg: r.diversity_class for r in DI.diversity_class(div).collect()} == {0: "Generalist", 1: "Moderate", 2: "Moderate"}


def test_campaigns_without_a_segment_stay(spark):
    camps = spark.createDataFrame([("a", None, "pending"), ("b", "Gone", "pending"), ("c", "Gone", "sent"), ("d", "VIP", "pending"), ("e", "All Customers", "cancelled"),
                                   ("f", "Gone", "cancelled")], "id string, segment string, status string")
    names = spark.createDataFrame([("VIP",)], "segment string")
    assert sorted(r.id for r in CP.active_campaigns(camps, names).collect()) == ["a", "c", "d", "e", "f"]
    assert sorted(r.id for r in CP.clean_campaigns(camps, names).collect()) == ["a", "c", "d", "e"]


def test_send_list_without_a_shared_key(spark):
    scored = spark.createDataFrame([("1", "x", "VIP"), ("2", "y", "Lost"), ("3", "z", None)], "customer_id string, phone string, segment string")
    camps = spark.createDataFrame([("a", "VIP"), ("b", "All Customers"), ("c", "Gone"), ("d", None)], "id string, segment string")
    got = sorted((r.campaign_id, r.customer_id) for r in CP.build_send_list(scored, camps).collect())
    assert got == [("a", "1"), ("b", "1"), ("b", "2"), ("b", "3")]


def test_lockout_sessions_give_what_one_fold_gives(spark):
    rng = np.random.default_rng(3)
    n = 400
    ev = pd.DataFrame({"event_id": range(n), "user_id": rng.integers(0, 3, n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.choice([5, 20, 90, 900], n)), unit="s"),
                       "event_type": rng.choice(["error", "error", "error", "purchase", "view"], n)})
    got = LK.failed_attempt_lockout(spark.createDataFrame(ev).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 3, 60, 300).toPandas()
    want = []
    for key, g in ev[ev.event_type != "view"].groupby("user_id"):
        rows_, _ = LK.fold(g.assign(kind=g.event_type.map({"error": "failure", "purchase": "success"})), (0, 0.0, 0.0), 3, 60, 300)
        want += [(key, r[0], r[2], r[3]) for r in rows_]
    assert sorted(zip(got.key, got.ts, got.outcome, got.fail_count)) == sorted(want) and {"locked", "rejected"} <= set(got.outcome)


def test_lockout_fold():
    t = pd.Timestamp("2024-01-01 00:00:00")
    s = lambda x: t + pd.Timedelta(seconds=x)
    ev = pd.DataFrame({"ts": [s(0), s(10), s(20), s(30), s(40), s(50), s(400), s(401), s(500), s(600), s(700)],
                       "event_id": range(11),
                       "kind": ["failure"] * 6 + ["failure", "success", "failure", "failure", "failure"]})
    rows_, st = LK.fold(ev, (0, 0.0, 0.0), 5, 60, 300)
    outcomes = [r[2] for r in rows_]
    assert outcomes == ["failure", "failure", "failure", "failure", "locked", "rejected", "failure", "success",
                        "failure", "failure", "failure"]
    assert [r[3] for r in rows_][-3:] == [1, 1, 1]      # each failure > 60 s after its window start restarts the count


def test_intents_accents_exclusions_and_order(spark):
    msgs = spark.createDataFrame([(1, "Héllo there, what can you do?"), (2, "hello vip customers"), (3, "Merci beaucoup !"),
                                  (4, "thanks but no"), (5, "Réactiver les clients perdus"), (6, "nothing here"), (7, "What can you do?")],
                                 "id int, text string")
    got = dict(rows(TX.tag_intents(msgs), "id", "intent"))
    # 1: "hello" hits the greeting rule first (first match wins); 7: help
    assert got == {1: "greeting", 2: "vip_status", 3: "thanks", 4: None, 5: "lost_customers", 6: None, 7: "help"}


def test_structured_reply(spark):
    m = spark.createDataFrame([
        (1, '```json\n{"response": "Hi", "action": "go"}\n```'),
        (2, 'Sure! {"response": "Embedded"} done'),
        (3, "plain text"),
        (4, '{"response": broken'),
    ], "id int, text string")
    got = dict((r.id, (r.response, r.action)) for r in TX.extract_structured_reply(m).collect())
    assert got == {1: ("Hi", "go"), 2: ("Embedded", None), 3: ("plain text", None), 4: ('{"response": broken', None)}


def test_channel_normalisation_and_rollup(spark):
    ch = spark.createDataFrame([("Email + WhatsApp",), ("whats app",), ("SMS",), ("Push",), ("post",)], "c string")
    assert [r[0] for r in ch.select(CP.normalize_channel("c")).collect()] == ["email-whatsapp", "whatsapp", "sms", "push", "default"]
    camps = spark.createDataFrame([("a", "VIP", "pending"), ("b", "VIP", "pending"), ("c", "VIP", "pending"), ("d", "VIP", "sent")],
                                  "id string, segment string, status string")
    sends = spark.createDataFrame([("1", "a", "sent"), ("2", "a", "sent"), ("3", "b", "failed"), ("4", "c", "sent"),
                                   ("5", "c", "failed"), ("6", None, "failed")], "id string, campaign_id string, status string")
    got = dict(rows(CP.campaign_status_rollup(camps, sends), "id", "status"))
    assert got == {"a": "sent", "b": "cancelled", "c": "pending", "d": "sent"}


def test_sanitize_at_any_depth(spark):
    from cohortlab.sources.tables import sanitize_non_finite
    df = spark.sql("""SELECT 1 AS id, named_struct('a', double('NaN'), 'b', array(named_struct('x', double('Infinity'), 'y', 'k')),
                      'm', map('p', array(double('-Infinity'), 2.0D))) AS s, CAST(NULL AS STRUCT<v: DOUBLE>) AS n""")
    for fill in (None, 0.0):
        out = sanitize_non_finite(df, fill)
        assert out.dtypes == df.dtypes
        r = out.first()
        assert (r.s.a, r.s.b[0].x, r.s.b[0].y, r.s.m["p"], r.n) == (fill, fill, "k", [fill, 2.0], None)


def test_spend_bands_fall_back_on_means_and_bars_are_whole(spark):
    from cohortlab.operators import insights as DI
    prof = spark.createDataFrame([(0, 3, 700.0, 50.0, 0.2), (1, 4, 120.0, 25.1, 0.0), (2, 1, None, None, None)],
                                 "seg int, n long, avg_spend double, avg_aov double, avg_discount double")
    bands = spark.createDataFrame([("high", 0), ("mid", 0), ("low", 0)], "band string, n long")
    got = {r.band: (r.n, r.pct) for r in DI.spend_band_share(bands, prof).collect()}
    assert got == {"high": (3, 38), "mid": (4, 50), "low": (1, 13)}
    rows = {r.seg: (r.aov_bar, r.net_aov_bar, r.discount_bar) for r in DI.net_aov(prof).collect()}
    assert rows == {0: (100, 100, 100), 1: (50, 63, 0), 2: (0, 0, 0)}


def test_sends_carry_body_discount_and_author(spark):
    c = spark.createDataFrame([("c1", "VIP", "email-whatsapp", "Hi", "text", "-15%", 9, T0, "ann")],
                              "id string, segment string, channel string, subject string, body string, discount string, recipients int, "
                              "created_at timestamp_ntz, created_by string")
    rows = {r.kind: r for r in CP.expand_campaign_sends(c).collect()}
    assert (rows["email"].body, rows["email"].discount, rows["email"].created_by) == ("text", "-15%", "ann")
    assert (rows["whatsapp"].message, rows["whatsapp"].body, rows["whatsapp"].discount, rows["whatsapp"].created_by) == ("text", None, None, "ann")
    sends = CP.expand_campaign_sends(c).withColumn("id", F.col("kind"))
    edited = c.withColumn("body", F.lit("new")).withColumn("discount", F.lit("-5%"))
    got = {r.kind: r for r in CP.sync_sends(edited, c, sends).collect()}
    assert (got["email"].body, got["email"].discount) == ("new", "-5%")
    assert (got["whatsapp"].message, got["whatsapp"].body, got["whatsapp"].discount) == ("new", None, None)
