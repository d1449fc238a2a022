"""Similarity measures against stdlib definitions and worked values."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinledger.functions import similarity as s

WORDS = st.text("abcdé ", max_size=12)


@given(WORDS, WORDS)
def test_jaro_winkler_symmetric(a, b):
    assert s.jaro_winkler(a, b) == pytest.approx(s.jaro_winkler(b, a)) and 0 <= s.jaro_winkler(a, b) <= 1 + 1e-12


@given(st.lists(st.tuples(WORDS, WORDS), max_size=20))
def test_jaro_winkler_of_many_pairs(pairs):
    pairs += [("a" * 300, "a" * 299 + "b"), ("", ""), ("x", "y"), ("x", "xy")]
    got = s.jaro_winkler_many([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([s.jaro_winkler(a, b) for a, b in pairs], abs=1e-12)
    assert s.jaro_winkler_many([], []).tolist() == []


def test_jaro_winkler_values():
    assert s.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert s.jaro_winkler("abc corporation", "abc corp") == pytest.approx(0.906667, abs=1e-6)
    assert s.jaro_winkler("123 main st, new york, ny", "123 main street, new york, ny") == pytest.approx(0.940414, abs=1e-6)


def pair(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("y")).first().y


@pytest.mark.parametrize(("a", "b", "metric", "want"), [
    ("ABC Corporation", "ABC Corp", "sm3", 0.574879), ("Smith John", "John Smith", "sm3", 0.833333), ("ABC Corporation", "ABC Corp", "jw4", 0.617797),
    (" Same", "same ", "jw4", 1.0), ("", "x", "jw4", 0.0), (None, "x", "sm3", 0.0),
])
def test_name_similarity(spark, a, b, metric, want):
    assert pair(spark, a, b, lambda x, y: s.name_similarity(x, y, metric)) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("a", "b"), [("tide", "diet"), ("diet", "tide"), ("x" * 250, "xy" * 150)])
def test_ratio_is_difflib(spark, a, b):
    assert pair(spark, a, b, s.ratio_col) == SequenceMatcher(None, a, b).ratio()


def test_token_sort_is_difflib(spark):
    want = SequenceMatcher(None, "a b c", "a c d").ratio()
    assert pair(spark, "c b a", "d a c", s.token_sort) == pytest.approx(want)


def test_substrings(spark):
    assert pair(spark, "ABC Corp X", "abc corp y", s.common_substrings) == ["ABC Corp "]
    assert pair(spark, "ABC Corp X", "zz CORP", s.longest_common_substring) == " Corp"
    assert pair(spark, "abc", "xyz", s.longest_common_substring) == ""


def test_phonetics(spark):
    assert pair(spark, "Robert", "Rupert", s.phonetic_match) is True
    assert pair(spark, "Pfister", "", lambda a, b: s.soundex_simple(a)) == "P123"
    assert pair(spark, "Thumb", "", lambda a, b: s.metaphone(a)) == "0M"
    assert pair(spark, "Knight", "", lambda a, b: s.metaphone(a)) == "NT"


def test_potential_match(spark):
    assert pair(spark, " Acme", "acme ", s.potential_match) is True
    assert pair(spark, "Acme", "Zzzz", s.potential_match) is False


@pytest.mark.parametrize(("a", "b", "want"), [
    ({"ein": "1"}, {"ein": "1"}, 1.0), ({"ein": "1"}, {"ein": "2"}, 0.0), ({"x": "1"}, {"x": "1"}, 0.5), ({"ein": None}, {"ein": None}, 1.0), ({}, {"ein": "1"}, 0.0), (None, None, 0.0),
    ({"ein": "1", "x": "2"}, {"ein": "3", "x": "2"}, 0.5),
])
def test_identifier_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>")
    assert df.select(s.identifier_match(F.col("a"), F.col("b")).alias("y")).first().y == want


def test_address_similarity(spark):
    df = spark.createDataFrame([(["1 A St", "x"], ["1  a st"]), ([], ["x"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r.y for r in df.select(s.address_similarity(F.col("a"), F.col("b")).alias("y")).collect()] == [1.0, 0.0, 0.0]


def test_address_lists(spark):
    rows = [(["12 oak st", "9 elm rd"], ["14 oak st", "7 fir ln"]), (["a"], [""]), (["b"], ["q", "b"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for metric, f in (("jw4", s.jaro_winkler), ("sm3", s.ratio)):
        got = [r.y for r in df.select(s.address_similarity(F.col("a"), F.col("b"), metric).alias("y")).collect()]
        assert got == pytest.approx([max(1.0 if x == y else f(x, y) for x in a for y in b) for a, b in rows])


def test_vectors(spark):
    zero = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert zero.select(s.cosine(F.col("a"), F.col("b")).alias("c")).first().c is None
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(s.cosine(F.col("a"), F.col("b")).alias("c"), s.distance(F.col("a"), F.col("b"), 0.0).alias("d")).first()
    assert got.c == 0.0 and got.d == pytest.approx(5**0.5)
