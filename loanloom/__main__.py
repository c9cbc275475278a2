"""Command line: ``python -m loanloom rebuild --csv DIR`` and ``python -m loanloom report NAME``.

Run it with ``spark-submit`` or any configured PySpark; settings of the cluster (master, catalog, memory) come from
there. ``--root`` is the shared folder of the layers; without it they go to the warehouse folder of the session, and
``--prefix`` tells several portfolios in one catalog apart. The commands ``report`` and ``counts`` need a catalog that
outlives the session (e.g. a Hive metastore).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loanloom.plans import reports
from loanloom.plans.portfolio import StoredPortfolio
from loanloom.plans.expectations import GENERAL, PUBLISHED
from loanloom.plans.rebuild import build, load_csv, stored_metrics
from loanloom.sources.layers import Layers
from loanloom.sources.schemas import BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS, RAW_TABLES

REPORTS = {
    "load_raw_counts": lambda p: reports.row_counts({table: p.raw(table) for table in RAW_TABLES}),
    "bureau_minima": lambda p: reports.bureau_minima(p.cleaned(BUREAU)),
    "status_distribution": lambda p: reports.status_distribution(p.cleaned(PREVIOUS)),
    "late_payment_rate": lambda p: reports.late_payment_rate(p.cleaned(INSTALLMENTS)),
    "delinquency_rate": lambda p: reports.delinquency_rate(p.cleaned(POS)),
    "card_metrics": lambda p: reports.card_metrics(p.cleaned(CARD)),
    "credit_history_stats": lambda p: reports.credit_history_stats(p.dim_credit_history),
    "payment_stats": lambda p: reports.payment_stats(p.fact_payment_history),
    "default_distribution": lambda p: reports.default_distribution(p.fact_loan_performance),
    "feature_means": lambda p: reports.feature_means(p.customer_risk_features),
    "default_by_dti": lambda p: reports.default_by_dti(p.customer_risk_features),
    "default_by_employment": lambda p: reports.default_by_employment(p.customer_risk_features),
    "default_by_history": lambda p: reports.default_by_history(p.customer_risk_features),
    "risk_distribution": lambda p: reports.risk_distribution(p.customer_risk_scores),
    "portfolio_default_rate": lambda p: reports.portfolio_default_rate(p.customer_risk_scores),
    "risk_concentration": lambda p: reports.risk_concentration(p.customer_risk_scores),
    "risk_by_age": lambda p: reports.risk_by_age(p.customer_risk_scores),
    "risk_by_income": lambda p: reports.risk_by_income(p.customer_risk_scores),
    "risk_by_employment": lambda p: reports.risk_by_employment(p.customer_risk_scores),
    "top_high_risk": lambda p: reports.top_high_risk(p.customer_risk_scores),
}


def csv_paths(directory: str, suffixes: dict[str, str]) -> dict[str, str]:
    """Path of each raw table's file: ``<directory>/<table>.csv``, or ``.csv.gz`` where ``suffixes`` says so."""
    return {table: f"{directory.rstrip('/')}/{table}.csv{suffixes.get(table, '')}" for table in RAW_TABLES}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loanloom")
    parser.add_argument("--root", help="shared folder of the layers")
    parser.add_argument("--prefix", default="", help="put before the names of the layers")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("rebuild", help="load the raw CSV files and rebuild every table")
    command.add_argument("--csv", required=True, help="folder with one CSV file per raw table")
    command.add_argument("--gzip", nargs="*", default=[], choices=RAW_TABLES, help="tables stored as .csv.gz")
    command.add_argument("--rejects", type=int, default=0, help="records of a table that may hold values of a wrong type")
    command.add_argument("--published", action="store_true", help="expect the figures of the published data set")
    commands.add_parser("counts", help="print what was observed while the stored tables were written")
    show = commands.add_parser("report", help="print a report from the stored tables")
    show.add_argument("name", choices=sorted(REPORTS))
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("loanloom").getOrCreate()
    layers = Layers(spark, options.root, options.prefix)
    if options.command == "rebuild":
        expectations = (*GENERAL, *(PUBLISHED if options.published else ()))
        load_csv(layers, csv_paths(options.csv, {table: ".gz" for table in options.gzip}), options.rejects, expectations)
        REPORTS["risk_distribution"](build(layers, expectations)).show(truncate=False)
    if options.command == "report":
        REPORTS[options.name](StoredPortfolio(layers)).show(n=reports.TOP_CUSTOMERS, truncate=False)
    else:
        for (layer, table), metrics in stored_metrics(layers).items():
            print(f"{layer}.{table}: {', '.join(f'{name} {value}' for name, value in metrics.items())}")


if __name__ == "__main__":
    main()
