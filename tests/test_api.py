"""The service calls, end to end on two records and a small graph."""

import pytest
from pyspark.sql import functions as F

from kinledger.api import Engine
from kinledger.functions.registry import register
from kinledger.schema import ENTITY

EDGE = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, ownership_pct double"


@pytest.fixture
def engine(spark):
    people = spark.createDataFrame([{"entity_id": "P", "name": "Ann Lee", "entity_type": "INDIVIDUAL", "confidence": 1.0, "addresses": []}, {"entity_id": "A", "name": "Acme", "entity_type": "COMPANY", "confidence": 0.5, "addresses": ["x"]}], ENTITY)
    return Engine(spark, people, spark.createDataFrame([("1", "P", "A", "OWNS", 70.0)], EDGE))


def test_records(engine):
    engine.create_entities([{"entity_id": "B", "name": "Beta Company, Inc.", "addresses": ["1 Elm Road"]}, {"entity_id": "A", "name": "Other", "confidence": 0.9}])
    b, a = engine.get_entity("B").first(), engine.get_entity("A").first()
    assert (b.name, b.original_name, b.addresses, b.confidence) == ("Beta", "Beta Company, Inc.", ["1 ELM RD"], 1.0)
    assert (a.name, a.confidence, a.addresses) == ("Acme", 0.9, [])
    assert [r.entity_id for r in engine.search("e").collect()] == ["B", "P", "A"]
    assert {r.part: r.n for r in engine.health().collect()} == {"entities": 3, "edges": 1}
    with pytest.raises(ValueError):
        engine.create_entities([{"entity_id": "C", "entity_type": "ROBOT"}])


def test_resolution(engine):
    one, two = {"name": "ABC Corporation", "identifiers": {"ein": "12-3456789"}}, {"name": "ABC Corp", "identifiers": {"ein": "123456789"}}
    assert engine.resolve(one, two).first().decision == "NOT_MATCH"
    assert engine.resolve(one, two, normalize=True).first().decision == "DEFINITE_MATCH"


def test_ownership(engine):
    got = engine.beneficial_ownership(["A"], 3)
    assert [(r.owner_id, r.effective_pct) for r in got["owners"].collect()] == [("P", 70.0)]
    assert got["cycles"].count() == got["nominees"].count() == 0 and got["report"].first().n_owners == 1
    with pytest.raises(ValueError):
        engine.beneficial_ownership(["A"], 21)
    assert {r.n for r in engine.infer_relationships().collect()} == {0}


def test_extraction_and_sql_functions(engine, spark):
    docs = spark.createDataFrame([(1, "Acme LLC hired")], "doc_id long, text string")
    assert [r.name for r in engine.extract(docs).filter("entity_type = 'COMPANY'").collect()] == ["Acme"]
    register(spark)
    row = spark.sql("SELECT kl_jaro_winkler('martha', 'marhta') AS j, kl_sequence_ratio('tide', 'diet') AS r, kl_metaphone('Thumb') AS m").first()
    assert row.j == pytest.approx(0.961111, abs=1e-6) and row.r == 0.25 and row.m == "0M"
    assert engine.resolve_all(spark.createDataFrame([("P", "A")], "id1 string, id2 string")).select(F.col("decision")).first().decision == "NOT_MATCH"
