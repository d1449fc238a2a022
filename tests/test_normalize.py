"""Literal cases and traps of the normalisers."""

import pytest
from pyspark.sql import functions as F

from kinledger.functions import normalize as n


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("ABC Corporation", "Abc"), ("XYZ Inc.", "Xyz"), ("DEF LLC", "Def"), ("A&B Company", "A B"), ("Test   Company   Inc", "Test"),
        ("Acme LLC Ltd", "Acme Llc"), ("Acme Ltd LLC", "Acme"), ("Limited", ""), ("Acme S.A.", "Acme S A"), ("", ""), (None, ""), ("Zoë Ltd", "Zoë"),
        ("Test Company, Inc.", "Test"), ("The Global Widgets", "Widgets"),
    ],
)
def test_name(spark, raw, want):
    assert one(spark, n.normalize_name, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("abc123def", "Abc123Def"), ("o_neil", "O_Neil"), ("3m", "3M"), ("", "")])
def test_title(spark, raw, want):
    assert one(spark, n.title_case, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("123 Main Street, New York, NY", "123 MAIN ST NY NY"), ("1 Elm Road, West Virginia", "1 ELM RD W VA"), ("9 Oak Court, Washington DC", "9 OAK CT WA DC"),
        ("Suite #5, North Lane", "STE 5 N LN"), (None, ""),
    ],
)
def test_address(spark, raw, want):
    assert one(spark, n.normalize_address, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("(555) 123-4567", "5551234567"), ("555.123.4567", "5551234567"), ("+1-555-123-4567", "5551234567"), ("", ""), (None, "")])
def test_phone(spark, raw, want):
    assert one(spark, n.normalize_phone, raw) == want


@pytest.mark.parametrize(("raw", "want"), [(" A.B+x@Gmail.com", "ab+x@gmail.com"), ("a.b@x.org", "a.b@x.org"), ("a@b@gmail.com", "a@b@gmail.com")])
def test_email(spark, raw, want):
    assert one(spark, n.normalize_email, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("ca", "CA"), ("west virginia", "WV"), ("Narnia", "Narnia"), (None, None)])
def test_state(spark, raw, want):
    assert one(spark, n.standardize_state, raw) == want


def test_identifiers(spark):
    raw = {"ein": "12-3456789", "lei": " 1234567890abcdefghij", "company_number": "ABC 123", "visa": "", "passport": " p1 "}
    got = spark.createDataFrame([(raw,), (None,)], "x map<string,string>").select(n.normalize_identifiers(F.col("x")).alias("y")).collect()
    assert got[0].y == {"ein": "123456789", "lei": "1234567890ABCDEFGHIJ", "company_number": "ABC123", "passport": "p1"}
    assert got[1].y == {}


def test_variations(spark):
    got = one(spark, n.name_variations, "My Company")
    assert got == ["My Company", "MY COMPANY", "my company", "MyCompany", "My-Company", "My_Company", "My Co"]


def test_entity(spark):
    row = spark.createDataFrame([("e", "Test Company, Inc.", ["123 Main Street"], {"ein": "12-3456789"})], "entity_id string, name string, addresses array<string>, identifiers map<string,string>")
    got = n.normalize_entity(row).first()
    assert (got.name, got.addresses, got.identifiers) == ("Test", ["123 MAIN ST"], {"ein": "123456789"})
    assert one(spark, n.comparable, "  A   b ") == "a b"
