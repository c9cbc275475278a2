"""Loan-portfolio risk analytics as Spark DataFrame plans."""

from loanloom.plans.portfolio import Portfolio

__all__ = ["Portfolio"]
