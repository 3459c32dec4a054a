"""A small class holding the sales frame and parameters, whose methods
return the operator frames (the reference's class form, batch over all keys).

    a = Assortment(sales, n=5, tail=0.10)
    a.cluster_top()                         # every cluster, category, period
    a.report().where("property_code = 'SPICC'")
    a.report_for("SPICC", "Beverage: Soda", "2019-09")   # one request
    a.close()                               # or: with Assortment(sales) as a: ...

The store-level base is cached when it is first computed and released by
``close()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfsense.operators import pricing as P
from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S
from shelfsense.plans.materialize import Shared


class Assortment:
    def __init__(self, sales: DataFrame, n: int = 5, tail: float = 0.10,
                 properties: DataFrame | None = None):
        """``properties``: optional dimension (property_code, flag_name, city,
        state) for the report's headers; by default they come from the sales."""
        if not 1 <= n:
            raise ValueError("n must be >= 1")
        if not 0.0 < tail < 1.0:
            raise ValueError("tail must be in (0, 1)")
        self.sales = sales
        self.n = n
        self.tail = tail
        self._properties = sales if properties is None else properties
        self._shared = Shared()
        self._base: DataFrame | None = None

    def close(self) -> None:
        self._shared.close()
        self._base = None

    def __enter__(self) -> "Assortment":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    @property
    def base(self) -> DataFrame:
        """Store-level base, computed once and shared by every method."""
        if self._base is None:
            self._base = self._shared.keep(S.sales_base(self.sales))
        return self._base

    @property
    def descriptions(self) -> DataFrame:
        return S.described_properties(self._properties)

    # rankings (R1-R3)
    def store_ranking(self) -> DataFrame:
        return S.store_ranking(self.base)

    def store_top(self) -> DataFrame:
        return S.store_top(self.base, self.n)

    def cluster_top(self) -> DataFrame:
        return S.cluster_top(self.base, self.n)

    def national_top(self) -> DataFrame:
        return S.national_top(self.base, self.n)

    # suggestions
    def stocking_suggestions(self) -> DataFrame:
        return R.stocking_suggestions(self.base, self.n)

    def discontinue_suggestions(self) -> DataFrame:
        return R.discontinue_suggestions(self.base, self.n, self.tail)

    def already_stocking_top(self) -> DataFrame:
        return R.already_stocking_top(self.base, self.n)

    def no_sales_categories(self) -> DataFrame:
        return R.no_sales_categories(self.base)

    # report (R8)
    def report(self, requests: DataFrame | None = None) -> DataFrame:
        """``requests`` before the base was asked for reads only what they need."""
        if requests is None or self._base is not None:
            base = self.base
        else:
            base = self._shared.keep(R.needed_rows(S.sales_base(self.sales), requests))
        return R.recommendation_report(base, self.descriptions, self.n, self.tail, requests, self._shared.keep)

    def report_for(self, property_code: str, category: str, month: str) -> DataFrame:
        return R.recommendation_report_for(self.sales, self.descriptions, property_code, category, month,
                                           self.n, self.tail)

    # pricing (G1-G12); ``keys=("description", "cluster")`` answers every
    # product in every cluster, ``cluster=``/``month=`` filter to one value
    def price_points(self, keys=P.PRODUCT, **filters) -> DataFrame:
        return P.price_points(self.sales, keys=keys, **filters)

    def price_optimum(self, keys=P.PRODUCT, **filters) -> DataFrame:
        return P.price_optimum(self.price_points(keys, **filters), keys)

    def price_summary(self, keys=P.PRODUCT, **filters) -> DataFrame:
        return P.price_summary(self.price_points(keys, **filters), keys)
