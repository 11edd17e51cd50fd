"""Canonical entities built from a folder of test tables (adapters + cleaning + features).

``Inputs`` builds each entity lazily once per instance. Nothing is collected: each property is a
DataFrame plan; the batch job (``plans.job``) materialises the three big ones (order lines,
features, scored features) as tables so downstream reads start from parquet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import cleaning as C
from cohortlab.operators import features as FE
from cohortlab.session import materialize
from cohortlab.sources import adapters as A


class Inputs:
    """``materialize``: cut lineage of the order lines and features with a reliable checkpoint
    (to ``spark.checkpoint.dir``) the first time they are used, so the several branches that read
    them (order grain, category grain, product grain, reference date, model fits) scan a stored
    copy instead of re-running the cleaning joins."""

    def __init__(self, spark: SparkSession, d: str, materialize: bool = True):
        self.spark, self.d, self.materialize = spark, d, materialize
        self._features: dict[tuple[str, ...], DataFrame] = {}
        self._lines: list[DataFrame] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.materialize else df

    # raw entities
    @cached_property
    def purchases(self) -> DataFrame:
        return A.raw_purchases(self.spark, self.d)

    @cached_property
    def items(self) -> DataFrame:
        return A.raw_purchase_items(self.spark, self.d)

    @cached_property
    def payment_log(self) -> DataFrame:
        return A.raw_payment_log(self.spark, self.d)

    @cached_property
    def offers_raw(self) -> DataFrame:
        return A.raw_offers(self.spark, self.d)

    @cached_property
    def countries_raw(self) -> DataFrame:
        return A.raw_countries(self.spark, self.d)

    # cleaned entities
    def lines_for(self, *columns: str, keep: bool = False) -> DataFrame:
        """Feature-ready order lines of these columns only; look-ups that they don't need are not joined.
        ``keep`` stores them, for queries that read them more than once. Lines that are stored already are read, if they have the columns."""
        for stored in self._lines:
            if set(columns) <= set(stored.columns):
                return stored.select(*columns)
        need = list(dict.fromkeys([*columns, "customer_id", "order_date", "net_amount", "discount_pct"]))
        lines = C.clean_orders(self.purchases, self.items, self.product_category if "category" in need else None,
                               self.countries_raw, self.payment_log, self.offers_raw, columns=need)
        lines = FE.prepared_lines(lines).select(*columns)
        return self._keep_lines(lines) if keep else lines

    def _keep_lines(self, lines: DataFrame) -> DataFrame:
        lines = self._keep(lines, "order_lines")
        self._lines.append(lines)
        return lines

    def features_of(self, *columns: str, zero_fill: bool = False) -> DataFrame:
        """customer_id and these features, built from the branches that they need; ``zero_fill`` as in ``customer_features``."""
        need = FE.needs(columns)
        lines = self.lines_for(*need.line_columns, keep=need.line_reads > 1)
        return FE.customer_features(lines, self.returns, self.customers if need.profile else None, columns=columns,
                                    keep_order_grain=need.grain_reads > 1 and self.materialize, zero_fill=zero_fill)

    def kept_features(self, *columns: str) -> DataFrame:
        """``features_of`` stored, once for each choice; from the whole feature table where that is there already."""
        if "features" in vars(self):
            return self.features.select("customer_id", *columns)
        if columns not in self._features:
            self._features[columns] = self._keep(self.features_of(*columns), "features")
        return self._features[columns]

    @cached_property
    def products(self) -> DataFrame:
        s, d = self.spark, self.d
        return C.clean_products(A.raw_products(s, d), A.raw_categories(s, d), A.raw_ingredients(s, d),
                                A.raw_collections(s, d), A.raw_product_for_collection(s, d))

    @cached_property
    def product_category(self) -> DataFrame:
        return C.product_category(A.raw_products(self.spark, self.d), A.raw_categories(self.spark, self.d))

    @cached_property
    def customers(self) -> DataFrame:
        return C.clean_customers(A.raw_users(self.spark, self.d), A.raw_addresses(self.spark, self.d))

    @cached_property
    def lines(self) -> DataFrame:
        return C.clean_orders(self.purchases, self.items, self.product_category, self.countries_raw,
                              self.payment_log, self.offers_raw)

    @cached_property
    def returns(self) -> DataFrame:
        return C.clean_returns(self.purchases)

    @cached_property
    def flines(self) -> DataFrame:
        """Order lines as the features see them (ghost ids dropped, coerced)."""
        return self._keep_lines(FE.prepared_lines(self.lines))

    @cached_property
    def feature_lines(self) -> DataFrame:
        """The stored lines with what features read of them; all their columns where those are stored already."""
        return self.lines_for(*FE.needs().line_columns, keep=True)

    @cached_property
    def ref(self) -> DataFrame:
        return FE.reference_date(self.feature_lines)

    @cached_property
    def features(self) -> DataFrame:
        return self._keep(FE.customer_features(self.feature_lines, self.returns, self.customers, ref=self.ref), "features")

    @cached_property
    def seg_map(self) -> DataFrame:
        """customer -> stand-in seg for every buying customer (the customers of the feature table,
        without computing the features)."""
        return self.seg_map_of(self.flines)

    @staticmethod
    def seg_map_of(lines: DataFrame) -> DataFrame:
        return lines.select("customer_id").distinct() \
            .withColumn("seg", (F.col("customer_id").cast("long") % 4).cast("int"))

    @cached_property
    def product_names(self) -> DataFrame:
        return C.product_names(A.raw_products(self.spark, self.d))

    @cached_property
    def segf(self) -> DataFrame:
        """Features with the deterministic segment stand-in ``seg = customer_id % 4``, so that
        label-agnostic operators can be checked against SQL."""
        return self.features.withColumn("seg", (F.col("customer_id").cast("long") % 4).cast("int"))
