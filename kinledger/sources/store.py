"""Entity and edge tables: reading, point and name look-up, upserts, serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinledger.schema import ENTITY
from kinledger.sources.scratch import sql_over

OVERWRITTEN = ("addresses", "jurisdiction", "identifiers", "phone_numbers", "email_addresses", "websites", "industry_codes", "roles", "data_sources")
KEPT = ("name", "original_name", "entity_type", "created_at")
EDGE_KEY = ("source_entity_id", "target_entity_id", "relationship_id")
_EMPTY = {"identifiers": "map()", "confidence": "1.0D", "entity_type": "'COMPANY'", "name": "''", "original_name": "''"}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of any format that Spark reads; give text formats a schema."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def execute_query(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with bound parameters over the given frames, evaluated lazily; the session's own views stay."""
    return sql_over(spark, text, args, **frames)


def flat_edges(edges: DataFrame) -> DataFrame:
    """Edges with their properties (a struct, or a map of texts) as columns too, as the graph operators read them."""
    if "properties" not in edges.columns or "ownership_pct" in edges.columns:
        return edges
    kind = edges.schema["properties"].dataType
    if isinstance(kind, StructType):
        return edges.withColumns({f: F.col(f"properties.{f}") for f in kind.names if f not in edges.columns})
    return edges.withColumn("ownership_pct", F.col("properties")["ownership_pct"].try_cast("double"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing properties get their defaults: empty lists and map, confidence 1, type COMPANY."""
    out = {}
    for name in df.columns:
        kind = df.schema[name].dataType.simpleString()
        if name in _EMPTY:
            out[name] = F.coalesce(F.col(name), F.expr(_EMPTY[name]).cast(kind))
        elif kind == "array<string>":
            out[name] = F.coalesce(F.col(name), F.expr("array()").cast(kind))
    return df.withColumns(out)


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.filter(F.col("entity_id") == entity_id)


def find_by_name(entities: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Case-sensitive substring of name or original name, most confident first."""
    hit = F.col("name").contains(text)
    if "original_name" in entities.columns:
        hit = hit | F.col("original_name").contains(text)
    return entities.filter(hit).orderBy(F.col("confidence").desc_nulls_first(), "entity_id").limit(limit)


def _reduced(updates: DataFrame, key: tuple[str, ...], order: str | None) -> DataFrame:
    """One row per key: the last of all but confidence, which is the largest, and the first of what is kept."""
    rank = F.col(order) if order else F.lit(0)
    rest = [c for c in updates.columns if c not in (*key, order)]
    agg = []
    for c in rest:
        if c == "confidence":
            agg.append(F.max(c).alias(c))
        elif c in KEPT or c == "relationship_type":
            agg.append(F.min_by(F.struct(c), rank)[c].alias(c))
        else:
            agg.append(F.max_by(F.struct(c), rank)[c].alias(c))
    return updates.groupBy(*key).agg(*agg) if agg else updates.select(*key).distinct()


def _merged(old: DataFrame, new: DataFrame, key: tuple[str, ...], kept: tuple[str, ...], now: Column | None) -> DataFrame:
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, list(key), "full")
    was, fresh = F.col("a.__here").isNotNull(), F.col("b.__here").isNotNull()
    out = [F.col(k) for k in key]
    for c in [x for x in old.columns if x not in (*key, "__here")]:
        if c not in new.columns:
            out.append(F.when(was & fresh, now).otherwise(F.col(f"a.{c}")).alias(c) if c == "last_updated" and now is not None else F.col(f"a.{c}").alias(c))
        elif c == "confidence":
            out.append(F.greatest(f"a.{c}", f"b.{c}").alias(c))
        elif c in kept:
            out.append(F.when(was, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return both.select(*out)


def upsert_entities(existing: DataFrame, updates: DataFrame, order: str | None = None, now: Column | None = None) -> DataFrame:
    """Names and type keep their old values, confidence is the larger, all else is the update's.

    Several updates of an id are reduced first, in ascending ``order``.
    """
    new = _reduced(updates.filter("entity_id IS NOT NULL"), ("entity_id",), order).withColumn("__here", F.lit(True))
    return _merged(existing.withColumn("__here", F.lit(True)), new, ("entity_id",), KEPT, now)


def upsert_edges(existing: DataFrame, updates: DataFrame, entities: DataFrame, order: str | None = None, now: Column | None = None) -> DataFrame:
    """Like entities, by (source, target, id); an update with an unknown end does nothing."""
    ids = entities.select("entity_id").distinct()
    for end in ("source_entity_id", "target_entity_id"):
        updates = updates.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    new = _reduced(updates, EDGE_KEY, order).withColumn("__here", F.lit(True))
    return _merged(existing.withColumn("__here", F.lit(True)), new, EDGE_KEY, ("relationship_type", "created_at"), now)


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, with ISO times and nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, schema: str | StructType = ENTITY) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def canonical_pairs(pairs: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """Each unordered pair once, smaller id first, without pairs of an id with itself."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).filter(F.col(a) != F.col(b)).distinct()


class PairCache:
    """Decisions by unordered pair of ids, for many small look-ups in one session."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], object] = {}

    def get(self, a: str, b: str) -> object | None:
        return self._held.get((min(a, b), max(a, b)))

    def put(self, a: str, b: str, decision: object) -> None:
        self._held[min(a, b), max(a, b)] = decision

    def clear(self) -> None:
        self._held.clear()

    def size(self) -> int:
        return len(self._held)
