"""Band labels. Bounds and labels are fixed values of the risk model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_band(age: Column) -> Column:
    """Bounds are whole years while ages are fractional: 34 < age < 35, 44 < age < 45, 54 < age < 55 and a missing age
    all belong to the last band."""
    return (F.when(age < 25, "Under 25")
            .when(age.between(25, 34), "25-34")
            .when(age.between(35, 44), "35-44")
            .when(age.between(45, 54), "45-54")
            .otherwise("55+"))


def employment_band(years: Column) -> Column:
    return (F.when(years.isNull(), "Unemployed")
            .when(years < 2, "Under 2 Years")
            .when(years <= 5, "2-5 Years")
            .when(years <= 10, "5-10 Years")
            .otherwise("10+ Years"))


def income_band(income: Column) -> Column:
    """A missing income falls into the last band."""
    return (F.when(income < 100_000, "Low (<100K)")
            .when(income <= 200_000, "Medium (100-200K)")
            .when(income <= 500_000, "High (200-500K)")
            .otherwise("Very High (500K+)"))


def dti_category(dti_pct: Column) -> Column:
    """A missing ratio counts as low."""
    return (F.when(dti_pct > 300, "High DTI")
            .when(dti_pct >= 150, "Medium DTI")
            .otherwise("Low DTI"))


def default_history(defaults: Column) -> Column:
    return (F.when(defaults == 0, "No Previous Defaults")
            .when(defaults == 1, "1 Previous Default")
            .when(defaults == 2, "2 Previous Defaults")
            .otherwise("3+ Previous Defaults"))
