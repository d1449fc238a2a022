"""The calls that a service would offer, over an entity and an edge table.

Each takes plain values and returns a DataFrame, so that one call serves one record or
millions; nothing is collected here.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinledger.config import DEFAULTS, EngineConfig
from kinledger.functions.normalize import normalize_entity
from kinledger.operators import extract, graph, ownership, resolve
from kinledger.schema import ENTITY, ENTITY_TYPES
from kinledger.session import ship
from kinledger.sources import store

_CHECKED_DEPTH = range(1, 21)


@dataclass
class Engine:
    spark: SparkSession
    entities: DataFrame
    edges: DataFrame
    config: EngineConfig = field(default=DEFAULTS)

    def __post_init__(self) -> None:
        ship(self.spark)

    def health(self) -> DataFrame:
        counts = [("entities", self.entities), ("edges", self.edges)]
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in counts]
        return rows[0].union(rows[1])

    def rows(self, records: list[dict]) -> DataFrame:
        """Records as an entity table; unknown types are refused."""
        for r in records:
            if r.get("entity_type", "COMPANY") not in ENTITY_TYPES:
                raise ValueError(f"unknown entity type {r['entity_type']!r}")
        return store.with_defaults(self.spark.createDataFrame(records, ENTITY))

    def create_entities(self, records: list[dict]) -> DataFrame:
        """The entity table with the records, normalised, merged in by id."""
        new = normalize_entity(self.rows(records).withColumn("original_name", F.coalesce(F.nullif("original_name", F.lit("")), F.col("name"))))
        self.entities = store.upsert_entities(self.entities, new.select(*[c for c in new.columns if c in self.entities.columns]))
        return self.entities

    def get_entity(self, entity_id: str) -> DataFrame:
        return store.with_defaults(store.entity_by_id(self.entities, entity_id))

    def search(self, text: str, limit: int = 10) -> DataFrame:
        return store.find_by_name(self.entities, text, limit)

    def resolve(self, first: dict, second: dict, normalize: bool = False) -> DataFrame:
        """Decision for two records that needn't be stored; as they are, unless ``normalize``."""
        both = self.rows([{"entity_id": "1", **first}, {"entity_id": "2", **second}])
        ids = both.agg(F.min("entity_id").alias("id1"), F.max("entity_id").alias("id2"))
        return resolve.resolve_entities(ids, both, config=self.config, normalize=normalize)

    def resolve_all(self, pairs: DataFrame | None = None, **more) -> DataFrame:
        """Decisions for stored entities: for the given pairs, or for all candidate pairs."""
        if pairs is None:
            pairs = resolve.blocks(normalize_entity(self.entities))
        return resolve.resolve_entities(pairs, self.entities, self.edges, config=self.config, **more)

    def clusters(self, decisions: DataFrame) -> DataFrame:
        """Each stored entity and the cluster that merge decisions put it in."""
        return resolve.clusters(decisions, self.entities)

    def _starts(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "start_id string")

    def beneficial_ownership(self, ids: list[str], max_depth: int | None = None) -> dict[str, DataFrame]:
        """Owners, cycles, nominees and the report of each id."""
        if max_depth is not None and max_depth not in _CHECKED_DEPTH:
            raise ValueError("max_depth is from 1 to 20")
        c = self.config if max_depth is None else replace(self.config, max_depth=max_depth)
        starts = self._starts(ids)
        return {
            "owners": ownership.beneficial_owners(self.edges, self.entities, starts, c),
            "cycles": ownership.circular_ownership(self.edges, starts, c.max_depth),
            "nominees": ownership.nominees(self.edges, self.entities, starts, c.nominee_threshold),
            "report": ownership.ownership_report(self.edges, self.entities, starts, c),
        }

    def extract(self, docs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        return extract.extract_entities(docs, answers)

    def infer_relationships(self) -> DataFrame:
        """How many edges the three inferences would add."""
        return graph.inferred_counts(self.entities, self.edges)
