"""Company and person mentions in texts, and what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinledger.functions.normalize import normalize_address, normalize_identifiers, normalize_name, stripped
from kinledger.schema import EXTRACTED, EXTRACTED_LINKS

# Patterns and names that are no persons.
COMPANY = r"\b([A-Z][A-Za-z\s&]+(?:Inc\.?|LLC|Corp\.?|Corporation|Ltd\.?|Limited|GmbH|SA|AG))\b"
PERSON = r"\b([A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
ADDRESS = r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln)\b"
EIN = r"\b\d{2}-\d{7}\b"
NO_PERSONS = ["The Company", "This Agreement", "United States", "New York", "Los Angeles", "San Francisco", "Chief Executive", "Board Members"]


def first_match(c: Column, pattern: str) -> Column:
    """Null where there is none."""
    got = F.regexp_extract(c, f"({pattern})", 1)
    return F.when(got != "", got)


def attributes(docs: DataFrame) -> DataFrame:
    """The first email, phone, address and EIN of each text."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", first_match(t, EMAIL).alias("email"), first_match(t, PHONE).alias("phone"), first_match(t, ADDRESS).alias("address"), first_match(t, EIN).alias("ein"))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, pos, name, entity_type, confidence, and the document's attributes: companies, then persons, in text order."""
    t = F.coalesce("text", F.lit(""))
    companies = F.transform(F.regexp_extract_all(t, F.lit(COMPANY), 1), lambda n: F.struct(n.alias("name"), F.lit("COMPANY").alias("entity_type"), F.lit(0.6).alias("confidence")))
    persons = F.filter(F.regexp_extract_all(t, F.lit(PERSON), 1), lambda n: ~n.isin(NO_PERSONS))
    people = F.transform(persons, lambda n: F.struct(n.alias("name"), F.lit("INDIVIDUAL").alias("entity_type"), F.lit(0.5).alias("confidence")))
    one = lambda p: F.array_compact(F.array(first_match(t, p)))
    ein = first_match(t, EIN)
    return docs.select(
        "doc_id",
        F.posexplode(F.concat(companies, people)).alias("pos", "m"),
        one(EMAIL).alias("email_addresses"), one(PHONE).alias("phone_numbers"), one(ADDRESS).alias("addresses"),
        F.map_from_entries(F.array_compact(F.array(F.when(ein.isNotNull(), F.struct(F.lit("ein").alias("key"), ein.alias("value")))))).alias("identifiers"),
    ).select("doc_id", "pos", "m.name", "m.entity_type", "m.confidence", "email_addresses", "phone_numbers", "addresses", "identifiers", F.array(F.lit("rule_based")).alias("data_sources"))


def deduplicated(found: DataFrame) -> DataFrame:
    """One row per document and lower-cased name: the first mention, the largest confidence, all sources."""
    rest = [c for c in found.columns if c not in ("doc_id", "confidence", "data_sources")]
    key = F.lower(stripped(F.col("name")))
    return (
        found.groupBy("doc_id", key.alias("dedup_key"))
        .agg(F.min_by(F.struct(*rest), "pos").alias("r"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("data_sources")))).alias("data_sources"))
        .select("doc_id", "r.*", "confidence", "data_sources")
    )


def parse_answers(answers: DataFrame) -> DataFrame:
    """Entities that a model listed as JSON in column ``response``; unparsable answers give none."""
    e = F.posexplode(F.from_json("response", EXTRACTED)["entities"]).alias("pos", "e")
    share = F.when(F.col("e.ownership_pct") != 0, F.concat(F.lit("owner_"), F.regexp_replace(F.col("e.ownership_pct").cast("string"), r"\.0$", ""), F.lit("%")))
    empty = F.array().cast("array<string>")
    return answers.select("doc_id", e).select(
        "doc_id", "pos", F.coalesce("e.name", F.lit("")).alias("name"), F.coalesce("e.type", F.lit("COMPANY")).alias("entity_type"), F.lit(0.9).alias("confidence"),
        F.array_compact(F.concat(F.coalesce("e.roles", empty), F.array(share))).alias("roles"), F.coalesce("e.addresses", empty).alias("addresses"), "e.jurisdiction",
        F.try_to_timestamp("e.incorporation_date").cast("timestamp_ntz").alias("incorporation_date"), F.try_to_timestamp("e.dissolved_date").cast("timestamp_ntz").alias("dissolution_date"),
        F.coalesce("e.identifiers", F.expr("map()").cast("map<string,string>")).alias("identifiers"), F.array(F.lit("llm_extraction")).alias("data_sources"),
    )


def parse_links(answers: DataFrame) -> DataFrame:
    """Relationships that a model listed as JSON; those without an end are left out."""
    r = F.explode(F.from_json("response", EXTRACTED_LINKS)["relationships"]).alias("r")
    out = answers.select("doc_id", r).select("doc_id", "r.source", "r.target", F.coalesce("r.type", F.lit("RELATED_TO")).alias("relationship_type"), "r.ownership_pct", F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"))
    return out.filter("source IS NOT NULL AND target IS NOT NULL")


def extract_entities(docs: DataFrame, answers: DataFrame | None = None, recognised: DataFrame | None = None) -> DataFrame:
    """Entities of each document, deduplicated and normalised.

    ``answers`` (doc_id, response) and ``recognised`` (mention rows of a recogniser)
    come first; rules apply to the documents for which both gave nothing.
    """
    found = recognised
    if answers is not None:
        parsed = parse_answers(answers)
        found = parsed if found is None else found.unionByName(parsed, allowMissingColumns=True)
    left = docs if found is None else docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    ruled = mentions(left)
    every = ruled if found is None else ruled.unionByName(found, allowMissingColumns=True)
    out = deduplicated(every).withColumn("original_name", F.col("name"))
    return out.withColumns({
        "name": normalize_name(F.col("name")),
        "addresses": F.transform(F.coalesce("addresses", F.array().cast("array<string>")), normalize_address),
        "identifiers": normalize_identifiers(F.col("identifiers")),
    })
