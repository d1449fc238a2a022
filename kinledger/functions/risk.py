"""Jurisdiction, age and shell-company rules, and the ownership report's scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Jurisdiction lists.
TAX_HAVENS = [
    "Cayman Islands", "British Virgin Islands", "Bermuda", "Panama", "Bahamas", "Jersey", "Guernsey", "Isle of Man",
    "Seychelles", "Mauritius", "Luxembourg", "Switzerland", "Singapore", "Hong Kong", "Malta", "Cyprus",
    "Liechtenstein", "Monaco", "Andorra",
]
HIGH_RISK = ["North Korea", "Iran", "Syria", "Myanmar", "Afghanistan"]


def is_tax_haven(c: Column) -> Column:
    return F.coalesce(c.isin(TAX_HAVENS), F.lit(False))


def is_high_risk(c: Column) -> Column:
    return F.coalesce(c.isin(HIGH_RISK), F.lit(False))


def jurisdiction_risk(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), 0.5).when(is_high_risk(c), 1.0).when(is_tax_haven(c), 0.7).otherwise(F.lit(0.1))


def whole_days(since: Column, as_of: Column) -> Column:
    """Whole spans of 24 hours, downwards."""
    return F.floor(F.timestamp_diff("SECOND", since, as_of) / 86400)


def age_risk(incorporated: Column, as_of: Column) -> Column:
    days = whole_days(incorporated, as_of)
    return F.when(incorporated.isNull(), 0.5).when(days < 90, 0.8).when(days < 365, 0.5).when(days < 1095, 0.3).otherwise(F.lit(0.1))


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def shell_indicators(phones: Column, emails: Column, sites: Column, addresses: Column, jurisdiction: Column, incorporated: Column, as_of: Column) -> Column:
    box = F.exists(addresses, lambda a: F.upper(a).contains("P.O. BOX") | F.upper(a).contains("PO BOX"))
    return F.array_compact(F.array(
        F.when(_none(phones) & _none(emails), "No contact information"),
        F.when(_none(sites), "No website"),
        F.when(_none(addresses), "No registered address").when(box, "PO Box address"),
        F.when(is_tax_haven(jurisdiction), F.concat(F.lit("Tax haven jurisdiction: "), jurisdiction)),
        F.when(whole_days(incorporated, as_of) < 90, "Very new entity (< 3 months)"),
    ))


def _part(n: Column, full: float) -> Column:
    return F.least(n / F.lit(full), F.lit(1.0))


def complexity(owners: Column, cycles: Column, nominees: Column) -> Column:
    return F.least(_part(owners, 5.0) + 0.5 * _part(cycles, 3.0) + 0.3 * _part(nominees, 5.0), F.lit(1.0))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def transparency(owners: Column, score: Column, least_confidence: Column) -> Column:
    return (
        F.when(owners == 0, "OPAQUE").when((score < 0.3) & (least_confidence > 0.8), "TRANSPARENT")
        .when(score < 0.6, "PARTIALLY_TRANSPARENT").otherwise("OPAQUE")
    )


def ubo_confidence(pct: Column, length: Column) -> Column:
    decay = F.when(length > 3, F.pow(F.lit(0.9), length - 3)).otherwise(F.lit(1.0))
    small = F.when(pct < 50, pct / 50.0).otherwise(F.lit(1.0)) * F.when(pct < 25, F.lit(0.8)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), decay * small))
