"""Feature vectors of entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinledger.functions.risk import whole_days
from kinledger.schema import ENTITY_TYPES, RELATIONSHIP_TYPES


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _some(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def node_features(as_of: Column, padding: int = 146) -> Column:
    """Eighteen features of an entity row, and zeros up to the documented width of 164."""
    ids = F.map_keys("identifiers")
    words = F.size(F.filter(F.split(F.regexp_replace("name", r"^\s+|\s+$", ""), r"\s+"), lambda w: w != ""))
    born = F.col("incorporation_date")
    age = F.when(born.isNotNull(), F.least(whole_days(born, as_of) / 365.25 / 100, F.lit(1.0)))
    parts = [_flag(F.col("entity_type") == t) for t in ENTITY_TYPES]
    parts += [_flag(F.array_contains(ids, k)) for k in ("ein", "lei", "company_number", "ssn")] + [_flag(F.size(ids) > 0)]
    parts += [
        F.coalesce(age, F.lit(0.0)),
        F.col("dissolution_date").isNull().cast("double"),
        (_some("phone_numbers") | _some("email_addresses")).cast("double"),
        _some("websites").cast("double"),
        F.least(F.greatest(F.coalesce(F.size("addresses"), F.lit(0)), F.lit(0)) / 5.0, F.lit(1.0)),
        F.col("confidence"),
        F.least(F.coalesce(F.length("name"), F.lit(0)) / 100.0, F.lit(1.0)),
        F.least(F.coalesce(words, F.lit(0)) / 10.0, F.lit(1.0)),
        _some("roles").cast("double"),
    ]
    real = F.array(*[p.cast("float") for p in parts])
    return F.concat(real, F.array_repeat(F.lit(0).cast("float"), padding)) if padding else real


def edge_features(as_of: Column) -> Column:
    """Sixteen features of a relationship row; here a missing share counts as 0."""
    parts = [_flag(F.col("relationship_type") == t) for t in RELATIONSHIP_TYPES]
    since = F.col("temporal_valid_from")
    days = F.when(since.isNotNull(), F.least(whole_days(since, as_of) / 3650.0, F.lit(1.0)))
    parts += [
        F.coalesce("ownership_pct", F.lit(0.0)) / 100.0,
        F.col("confidence"),
        F.coalesce(days, F.lit(0.0)),
        F.col("temporal_valid_to").isNull().cast("double"),
    ]
    return F.array(*[p.cast("float") for p in parts])
