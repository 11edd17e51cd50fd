"""Plan-shape guards for the scale design (checked on the physical plan, not on timings)."""

import re

import pytest

import __spark_entry__ as E
from cohortlab.operators import features as FE
from cohortlab.plans.pipeline import Inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_features_stay_in_the_jvm(spark):
    I = Inputs(spark, SF, materialize=False)
    for df in (I.lines, FE.customer_features(I.flines, I.returns, I.customers)):
        p = plan(df)
        assert "EvalPython" not in p and "PythonUDF" not in p and "CartesianProduct" not in p
        for m in re.finditer(r"(\w*Aggregate)\(keys=\[[^\]]*\], functions=\[(?!partial_|\])[^\n]*\n[^\n]*Exchange[^\n]*\n([^\n]*)", p):
            assert "partial_" in m.group(2) or "Aggregate" not in m.group(1), m.group(0)   # map-side combine before a shuffle


def test_scans_read_only_needed_columns(spark):
    I = Inputs(spark, SF, materialize=False)
    p = plan(I.lines)
    li = [m for m in re.findall(r"FileScan parquet \[([^\]]*)\]", p) if "l_orderkey" in m]
    assert li and all("l_shipdate" not in m and "l_tax" not in m for m in li)


@pytest.mark.parametrize("name", ["top_per_segment", "segment_category_share", "quarterly_top_products", "build_send_list",
                                  "segment_category_matrix", "davies_bouldin"])
def test_no_cartesian_products(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin BuildRight, Inner, (" not in p


@pytest.mark.parametrize("name, most", [("monthly_revenue", 0), ("category_revenue", 0), ("total_spend", 0), ("customer_profile", 0), ("quarterly_top_products", 1),
                                        ("segment_category_share", 1), ("recency", 1), ("retention_rate", 1), ("ipt", 1)])
def test_tables_written_per_query(spark, name, most):
    """Single-pass queries write nothing; others at most the one table that they read again."""
    from cohortlab import session
    before = set(session.STORED)
    E.queries()[name](spark, SF)
    new = [p for p in session.STORED if p not in before]
    session.drop_stored(spark, new)
    assert len(new) <= most


def test_a_cluster_needs_a_shared_folder():
    from cohortlab.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)


def test_intents_bind_the_text_once(spark):
    """The chain that normalises a text stands in the plan once, not once per keyword."""
    p = plan(E.queries()["tag_intents"](spark, SF))
    assert p.count("regexp_replace") < 20


@pytest.mark.parametrize("name", ["segment_counts", "segment_overview", "campaign_audience"])
def test_segment_queries_build_no_whole_feature_table(spark, name):
    from cohortlab import session
    before = set(session.STORED)
    p = plan(E.queries()[name](spark, SF))
    new = [x for x in session.STORED if x not in before]
    session.drop_stored(spark, new)
    assert not any("features" in x for x in new) and len(new) <= 1 and "clv_slope" not in p


@pytest.mark.parametrize("name", ["silhouette", "davies_bouldin", "segment_ipt", "segment_zscores", "diversity_class", "custom_segment", "pca_loadings"])
def test_features_are_built_of_what_they_need(spark, name):
    """The lines stored for features hold no look-ups that these don't read, and what is stored of the features is not the whole table."""
    from cohortlab import session
    before = set(session.STORED)
    E.queries()[name](spark, SF)
    new = [x for x in session.STORED if x not in before]
    columns = {x.rsplit("/", 1)[1].rsplit("-", 1)[0]: set(spark.read.parquet(x).columns) for x in new}
    session.drop_stored(spark, new)
    assert not columns["order_lines"] & {"payment_gateway", "offer_name", "country", "source", "channel", "product_id"}
    assert "unique_prods" not in columns["features"] and "phone" not in columns["features"]


def test_order_grain_without_channel_is_not_sorted(spark):
    lines = Inputs(spark, SF, materialize=False).lines_for("customer_id", "order_id", "order_date", "net_amount", "discount_pct")
    assert "SortAggregate" in plan(FE.order_grain(lines.withColumn("channel", lines["order_id"]), None))
    assert "SortAggregate" not in plan(FE.order_grain(lines, None, channel=False))


def test_numbers_of_items_equal_their_text(spark):
    """Items whose numbers are doubles give what their text gives, without being written out as text."""
    from cohortlab.operators import cleaning as C
    rows = [("1", "p", 0.1 + 0.2, 1e-7, True, 3.0), ("2", "p", float("nan"), -0.0, False, 0.5), ("3", "p", None, float("inf"), None, None), ("4", "p", 1e22, 123456789.123, True, float("nan"))]
    items = spark.createDataFrame(rows, "purchase_id string, product_id string, price double, sale_price double, in_sale boolean, qty double")
    text = items.select("purchase_id", "product_id", *[items[c].cast("string") for c in ("price", "sale_price", "in_sale", "qty")])
    assert sorted(map(str, C.clean_items(items).collect())) == sorted(map(str, C.clean_items(text).collect()))
    assert "price#" in plan(C.clean_items(items)) and "try_cast" not in plan(C.clean_items(items)).lower() and "trycast" not in plan(C.clean_items(items)).lower()


def test_summary_sections_share_their_lines(spark):
    from cohortlab import session
    before = set(session.STORED)
    E.queries()["summary_sections"](spark, SF)
    new = [x for x in session.STORED if x not in before]
    session.drop_stored(spark, new)
    assert sum("order_lines" in x for x in new) == 1


def test_wide_layout_groups_an_order_once(spark):
    """One aggregate a line, no window and no expression a slot and line."""
    from cohortlab.sources import adapters as A
    p = plan(A.wide_purchases(spark, SF))
    assert "Window" not in p and "max(CASE" not in p and "SortAggregate" not in p


def test_lines_shuffle_one_number_per_item_and_split_the_total_once(spark):
    lines = Inputs(spark, SF, materialize=False).lines_for("customer_id", "order_id", "order_date", "net_amount", "discount_pct")
    p = lines._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("round((full_amount") == 2              # by weight, or in equal parts
    join = p[p.index("Join LeftOuter"):]
    item = next(x for x in join.splitlines() if "Project" in x and "qty" in x)
    assert "item_gross" in item and " AS price" not in item and " AS qty" not in item


@pytest.mark.parametrize("name", ["segment_ipt", "segment_zscores", "diversity_class"])
def test_a_profile_is_built_of_the_metrics_read(spark, name):
    from cohortlab import session
    before = set(session.STORED)
    E.queries()[name](spark, SF).collect()
    new = [p for p in session.STORED if p not in before]
    columns = {c for p in new for c in spark.read.parquet(p).columns}
    session.drop_stored(spark, new)
    assert not columns & {"clv_slope", "spend_momentum"}
