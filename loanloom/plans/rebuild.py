"""Full batch rebuild: load, clean, build the star schema, features and scores, storing every table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from loanloom.plans import cleaning, features, mart, scoring
from loanloom.plans.expectations import GENERAL, Expectation, ExpectationError, Range, checker, metrics_of
from loanloom.plans.portfolio import StoredPortfolio
from loanloom.sources.csv import REJECTED, checked_csv, read_raw_csv
from loanloom.sources.layers import ANALYTICS, CLEANED, LAYERS, RAW, Layers, Metrics, bucket_count
from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS, RAW_TABLES

CUSTOMER = "CUSTOMER_ID"
STAR = ("dim_customer", "dim_loan", "dim_credit_history", "fact_payment_history", "fact_loan_performance",
        "customer_risk_features", "customer_risk_scores")
STORED = {RAW: RAW_TABLES, CLEANED: RAW_TABLES, ANALYTICS: STAR}

Expectations = tuple[Expectation, ...]


def _store(layers: Layers, expectations: Expectations, layer: str, table: str, rows: DataFrame, unique_key: str | None = None,
           buckets: int = 1) -> DataFrame:
    return layers.replace(layer, table, rows, unique_key, buckets, metrics_of(layer, table),
                          checker(layers, layer, table, expectations))


def load_raw(layers: Layers, read: Callable[[str], DataFrame], expectations: Expectations = GENERAL,
             tables: Iterable[str] = RAW_TABLES) -> None:
    """Store the raw tables, read by table name with ``read``."""
    for table in tables:
        _store(layers, expectations, RAW, table, read(table))


def load_csv(layers: Layers, paths: dict[str, str], reject_limit: int = 0, expectations: Expectations = GENERAL) -> None:
    """Store the raw tables from CSV files, by table name.

    With a ``reject_limit`` up to so many records of a table may hold values that do not fit their types. They are left out
    and listed, value by value, in the raw table ``<table>_rejects``, which is written again with every load; with more
    of them the table keeps its old rows and the load ends, with the list written. Without one the first such value is an error.
    """
    if not reject_limit:
        return load_raw(layers, lambda table: read_raw_csv(layers.spark, paths[table], table), expectations, paths)
    for table in paths:
        read = checked_csv(layers.spark, paths[table], table)
        limit = Range((RAW, table), "rejected_rows", most=reject_limit)
        check = checker(layers, RAW, table, (limit, *expectations))

        def store_rejects(rejects: DataFrame = read.rejects, table: str = table) -> None:
            layers.replace(RAW, f"{table}_rejects", rejects)

        try:
            layers.replace(RAW, table, read.rows, observed=metrics_of(RAW, table), check=check, rejected=REJECTED)
        except ExpectationError:
            store_rejects()
            raise
        store_rejects(read.rejects if layers.metrics(RAW, table)["rejected_rows"] else read.rejects.limit(0))


def clean(layers: Layers, expectations: Expectations = GENERAL) -> None:
    """Raw to cleaned. The applications are unique per customer afterwards and are stored by customer, in as many buckets
    as their number asks for; all tables with one row per customer have as many."""
    buckets = bucket_count(layers.metrics(RAW, APPLICATION).get("row_count") or 0)
    for table, cleaner in cleaning.CLEANERS.items():
        _store(layers, expectations, CLEANED, table, cleaner(layers.table(RAW, table)),
               "SK_ID_CURR" if table == APPLICATION else None, buckets)


def build_analytics(layers: Layers, expectations: Expectations = GENERAL) -> None:
    """Cleaned to star schema, features and scores; each step reads the stored tables of the step before."""
    application, bureau, previous, installments, pos, card = (
        layers.table(CLEANED, table) for table in (APPLICATION, BUREAU, PREVIOUS, INSTALLMENTS, POS, CARD))
    buckets = layers.metrics(CLEANED, APPLICATION).get("buckets") or 1

    def store(table: str, rows: DataFrame, unique_key: str | None = CUSTOMER) -> DataFrame:
        return _store(layers, expectations, ANALYTICS, table, rows, unique_key, buckets)

    star = [
        store("dim_customer", mart.dim_customer(application)),
        store("dim_loan", mart.dim_loan(application, previous)),
        store("dim_credit_history", mart.dim_credit_history(bureau)),
        store("fact_payment_history", mart.fact_payment_history(installments, pos), None),
        store("fact_loan_performance", mart.fact_loan_performance(application, card)),
    ]
    stored = store("customer_risk_features", features.features_from_star(*star))
    store("customer_risk_scores", scoring.customer_risk_scores(stored))


def rebuild(layers: Layers, read: Callable[[str], DataFrame], expectations: Expectations = GENERAL) -> StoredPortfolio:
    """Replace every table. A table whose new rows do not meet an expectation keeps its old ones, and the rebuild ends."""
    load_raw(layers, read, expectations)
    return build(layers, expectations)


def build(layers: Layers, expectations: Expectations = GENERAL) -> StoredPortfolio:
    """Replace every table that is made of the raw ones."""
    clean(layers, expectations)
    build_analytics(layers, expectations)
    return StoredPortfolio(layers)


def stored_metrics(layers: Layers) -> dict[tuple[str, str], Metrics]:
    """The metrics of every stored table, from the catalog; reads no table."""
    return {(layer, table): layers.metrics(layer, table) for layer in LAYERS for table in STORED[layer]}
