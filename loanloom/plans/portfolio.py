"""All tables of one portfolio, each planned when first asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loanloom.plans import cleaning, features, mart, scoring
from loanloom.sources.fixtures import fixture_table
from loanloom.sources.layers import ANALYTICS, CLEANED, RAW, Layers
from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS


class Portfolio:
    """Lazy plans from the raw tables up to the scores. Nothing is read or stored until a result is used.

    A query on a table here is planned as a whole: Catalyst drops every column, join and branch it does not need.
    """

    def __init__(self, raw: Callable[[str], DataFrame]):
        self._raw = raw
        self._cleaned: dict[str, DataFrame] = {}

    @classmethod
    def from_fixture(cls, spark: SparkSession, directory: str) -> Portfolio:
        return cls(lambda table: fixture_table(spark, directory, table))

    def raw(self, table: str) -> DataFrame:
        return self._raw(table)

    def cleaned(self, table: str) -> DataFrame:
        if table not in self._cleaned:
            self._cleaned[table] = cleaning.CLEANERS[table](self.raw(table))
        return self._cleaned[table]

    @cached_property
    def dim_customer(self) -> DataFrame:
        return mart.dim_customer(self.cleaned(APPLICATION))

    @cached_property
    def dim_loan(self) -> DataFrame:
        return mart.dim_loan(self.cleaned(APPLICATION), self.cleaned(PREVIOUS))

    @cached_property
    def dim_credit_history(self) -> DataFrame:
        return mart.dim_credit_history(self.cleaned(BUREAU))

    @cached_property
    def fact_payment_history(self) -> DataFrame:
        return mart.fact_payment_history(self.cleaned(INSTALLMENTS), self.cleaned(POS))

    @cached_property
    def fact_loan_performance(self) -> DataFrame:
        return mart.fact_loan_performance(self.cleaned(APPLICATION), self.cleaned(CARD))

    @cached_property
    def customer_risk_features(self) -> DataFrame:
        return features.customer_risk_features(
            self.cleaned(APPLICATION), self.cleaned(PREVIOUS), self.dim_credit_history, self.fact_payment_history,
            self.cleaned(CARD))

    @cached_property
    def customer_risk_scores(self) -> DataFrame:
        return scoring.customer_risk_scores(self.customer_risk_features)


class StoredPortfolio(Portfolio):
    """The same tables read from where ``rebuild`` stored them."""

    def __init__(self, layers: Layers):
        super().__init__(lambda table: layers.table(RAW, table))
        self._layers = layers

    def cleaned(self, table: str) -> DataFrame:
        return self._layers.table(CLEANED, table)

    def _analytics(self, table: str) -> DataFrame:
        return self._layers.table(ANALYTICS, table)

    dim_customer = property(lambda self: self._analytics("dim_customer"))
    dim_loan = property(lambda self: self._analytics("dim_loan"))
    dim_credit_history = property(lambda self: self._analytics("dim_credit_history"))
    fact_payment_history = property(lambda self: self._analytics("fact_payment_history"))
    fact_loan_performance = property(lambda self: self._analytics("fact_loan_performance"))
    customer_risk_features = property(lambda self: self._analytics("customer_risk_features"))
    customer_risk_scores = property(lambda self: self._analytics("customer_risk_scores"))
