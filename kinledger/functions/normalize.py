"""Normalisation of names, addresses and identifiers: Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Removal and abbreviation tables; their order is part of the result.
LEGAL_SUFFIXES = [
    "LLC", "Ltd", "Limited", "Inc", "Incorporated", "Corp", "Corporation", "GmbH", "SA", "SRL", "BV",
    "Pte", "Pty", "AG", "NV", "PLC", "LP", "LLP", "Co", "Company", "Group", "Holdings",
]
BUSINESS_TERMS = ["THE", "COMPANY", "GROUP", "HOLDINGS", "INTERNATIONAL", "GLOBAL", "WORLDWIDE", "ENTERPRISES", "ASSOCIATES"]
STREETS = {
    "STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD", "LANE": "LN",
    "COURT": "CT", "CIRCLE": "CIR", "PLACE": "PL", "TERRACE": "TER", "PARKWAY": "PKY", "HIGHWAY": "HWY",
}
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO",
    "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA",
    "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD",
    "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "APARTMENT": "APT", "SUITE": "STE"}
DIGIT_KEYS, UPPER_KEYS, NUMBER_KEY = ("ein", "ssn", "duns"), ("lei", "vat", "isin"), "company_number"
ABBREVIATED = {"COMPANY": "CO", "CORPORATION": "CORP", "INCORPORATED": "INC", "LIMITED": "LTD"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _whole(word: str) -> str:
    """Pattern of a word between characters that aren't of a word; it begins with the word itself, which is quick to miss."""
    return rf"{word}(?<![\p{{L}}\p{{N}}_]{word})(?![\p{{L}}\p{{N}}_])"


def _swap(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.regexp_replace(x, _whole(kv[0]), kv[1]), table.items(), c)


def title_case(c: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def normalize_name(c: Column) -> Column:
    """One pass over the suffixes in their order, punctuation out, business terms out, title case."""
    x = reduce(lambda y, s: F.regexp_replace(y, rf"(?iu){_whole(s)}[.,]?\s*$", ""), LEGAL_SUFFIXES, stripped(_text(c)))
    x = stripped(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    kept = F.filter(F.split(x, " "), lambda w: ~F.upper(w).isin(BUSINESS_TERMS) & (w != ""))
    return title_case(F.array_join(kept, " "))


def normalize_address(c: Column) -> Column:
    x = _swap(_swap(F.upper(stripped(_text(c))), STREETS), STATES)
    x = F.regexp_replace(F.regexp_replace(x, r"[.,#]", " "), r"\s+", " ")
    return stripped(_swap(x, DIRECTIONS))


def standardize_street(c: Column) -> Column:
    return _swap(F.upper(_text(c)), STREETS)


def standardize_state(c: Column) -> Column:
    """An abbreviation stays, a full name is abbreviated, anything else is given back as it came."""
    up = F.upper(stripped(_text(c)))
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.when(up.isin(list(STATES.values())), up).otherwise(F.coalesce(F.element_at(names, up), c))


def normalize_identifier(key: Column, value: Column) -> Column:
    """Null for a value that is to be dropped; a known key with a null value stays null."""
    return (
        F.when(key.isin(*DIGIT_KEYS), F.regexp_replace(value, r"\D", ""))
        .when(key.isin(*UPPER_KEYS), stripped(F.upper(value)))
        .when(key == NUMBER_KEY, F.upper(F.regexp_replace(value, r"\s", "")))
        .when(value != "", stripped(value))
    )


def normalize_identifiers(m: Column) -> Column:
    """An empty map for null; unknown keys without a value are dropped."""
    known = [*DIGIT_KEYS, *UPPER_KEYS, NUMBER_KEY]
    kept = F.filter(F.map_entries(m), lambda e: e["key"].isin(known) | (F.coalesce(e["value"], F.lit("")) != ""))
    pairs = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), normalize_identifier(e["key"], e["value"]).alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def normalize_entity(df):
    """Name, addresses and identifiers of an entity table; every other column stays."""
    return df.withColumns({
        "name": normalize_name(F.col("name")),
        "addresses": F.transform(F.coalesce("addresses", F.array().cast("array<string>")), normalize_address),
        "identifiers": normalize_identifiers(F.col("identifiers")),
    })


def normalize_phone(c: Column) -> Column:
    digits = F.regexp_replace(_text(c), r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def normalize_email(c: Column) -> Column:
    """Dots go from the local part of mail.google names; addresses with several @ stay as they are."""
    x = stripped(F.lower(_text(c)))
    parts = F.split(x, "@")
    ours = (x.contains("@gmail.com") | x.contains("@googlemail.com")) & (F.size(parts) == 2)
    return F.when(ours, F.concat(F.replace(parts[0], F.lit("."), F.lit("")), F.lit("@"), parts[1])).otherwise(x)


def name_variations(c: Column) -> Column:
    """Distinct spellings in a fixed order."""
    x = _text(c)
    out = [x, F.upper(x), F.lower(x), title_case(x)] + [F.replace(x, F.lit(" "), F.lit(s)) for s in ("", "-", "_")]
    for full, short in ABBREVIATED.items():
        has = F.upper(x).contains(full)
        for a, b in ((full, short), (full.title(), short.title())):
            out.append(F.when(has, F.replace(x, F.lit(a), F.lit(b))).otherwise(x))
    return F.array_distinct(F.array(*out))


def comparable(c: Column) -> Column:
    """Lower case with single blanks, as similarity measures want it."""
    return stripped(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))
