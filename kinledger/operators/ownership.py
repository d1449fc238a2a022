"""Beneficial owners, cycles, nominees, layers and controllers, for many starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinledger.config import DEFAULTS, EngineConfig
from kinledger.functions import risk
from kinledger.operators.graph import cyclic_part, of_types, trails

UBO_TYPES = ("OWNS", "CONTROLS", "UBO_OF", "SHAREHOLDER_OF")
CYCLE_TYPES = ("OWNS", "CONTROLS", "SHAREHOLDER_OF")
LAYER_TYPES = ("OWNS", "CONTROLS")
CONTROL_TYPES = ("OWNS", "CONTROLS", "UBO_OF")
OWNER_KINDS = ("INDIVIDUAL", "GOVERNMENT")


def _top(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first rows of each start."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("start_id").orderBy(*order))).filter(F.col("rn") <= limit).drop("rn")


def beneficial_owners(edges: DataFrame, entities: DataFrame, starts: DataFrame | None = None, config: EngineConfig = DEFAULTS, method: str = "auto") -> DataFrame:
    """One row per start, owner and trail of the largest shares; trails to an owner aren't summed."""
    kinds = entities.filter(F.col("entity_type").isin(*OWNER_KINDS)).select(F.col("entity_id").alias("owner_id"), F.col("name").alias("owner_name"), F.col("entity_type").alias("owner_type"))
    walked = trails(of_types(edges, UBO_TYPES), starts, config.max_depth, least_pct=config.ubo_threshold, method=method).filter(F.col("pct") >= config.ubo_threshold)
    owned = walked.select("start_id", F.col("node").alias("owner_id"), F.col("pct").alias("effective_pct"), F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("edge_path"), F.col("hops").alias("chain_length"))
    found = owned.join(kinds, "owner_id").distinct()
    top = _top(found, config.ubo_limit, F.desc("effective_pct"), "owner_id", "edge_path")
    length = F.lit(1) if config.compat_chain_length else F.col("chain_length")
    return top.withColumn("confidence", risk.ubo_confidence(F.col("effective_pct"), length)).select("start_id", "owner_id", "owner_name", "owner_type", "effective_pct", "path", "edge_path", "chain_length", "confidence")


def circular_ownership(edges: DataFrame, starts: DataFrame | None = None, depth: int = 10, limit: int = 10) -> DataFrame:
    """Trails of two edges or more that lead back to their start, walked on the graph's cyclic part alone."""
    walked = trails(cyclic_part(of_types(edges, CYCLE_TYPES)), starts, depth, incoming=False).filter("node = start_id AND hops > 1")
    rows = walked.select("start_id", F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("edge_path"), F.col("hops").alias("cycle_length"))
    return _top(rows, limit, "cycle_length", "edge_path").withColumn("risk_level", F.lit("HIGH"))


def nominees(edges: DataFrame, entities: DataFrame, starts: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Persons tied to a start who direct or hold shares in ``least`` entities or more."""
    people = entities.filter("entity_type = 'INDIVIDUAL'").select(F.col("entity_id").alias("person_id"), F.col("name").alias("person_name"))
    ties = of_types(edges, ("DIRECTOR_OF", "SHAREHOLDER_OF")).select(F.col("source_entity_id").alias("person_id"), F.col("target_entity_id").alias("target")).distinct().join(people, "person_id")
    names = entities.select(F.col("entity_id").alias("target"), F.col("name").alias("target_name"))
    many = ties.join(names, "target").groupBy("person_id", "person_name").agg(F.countDistinct("target").alias("entity_count"), F.array_sort(F.collect_set("target_name")).alias("entities_involved")).filter(F.col("entity_count") >= least)
    at = ties.select("person_id", F.col("target").alias("start_id"))
    if starts is not None:
        at = at.join(starts, "start_id", "left_semi")
    rationale = F.concat(F.lit("Individual is director/shareholder of "), F.col("entity_count").cast("string"), F.lit(" entities"))
    return at.join(many, "person_id").select("start_id", "person_id", "person_name", "entity_count", "entities_involved", F.when(F.col("entity_count") > 10, "HIGH").otherwise("MEDIUM").alias("risk_level"), rationale.alias("rationale"))


def ownership_report(edges: DataFrame, entities: DataFrame, starts: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Owners, cycles and nominees of each start, and the scores made of their numbers."""
    u = beneficial_owners(edges, entities, starts, config).groupBy("start_id").agg(F.count("*").alias("n_owners"), F.min("confidence").alias("least"))
    c = circular_ownership(edges, starts, config.max_depth).groupBy("start_id").agg(F.count("*").alias("n_cycles"))
    n = nominees(edges, entities, starts, config.nominee_threshold).groupBy("start_id").agg(F.count("*").alias("n_nominees"))
    joined = starts.select("start_id").distinct().join(u, "start_id", "left").join(c, "start_id", "left").join(n, "start_id", "left").fillna(0, ["n_owners", "n_cycles", "n_nominees"])
    scored = joined.withColumn("complexity_score", risk.complexity(F.col("n_owners"), F.col("n_cycles"), F.col("n_nominees")))
    s = F.col("complexity_score")
    return scored.select("start_id", "n_owners", "n_cycles", "n_nominees", s, risk.risk_level(s).alias("risk_level"), risk.transparency(F.col("n_owners"), s, F.col("least")).alias("transparency"))


def layered_structures(edges: DataFrame, starts: DataFrame | None = None, least: int = 3, depth: int = 10, limit: int = 20) -> DataFrame:
    """Trails of ``least`` hops or more, of each start the first ``limit`` by hops and edges."""
    walked = trails(of_types(edges, LAYER_TYPES), starts, depth, enough=(least, limit)).filter(F.col("hops") >= least)
    rows = walked.select("start_id", F.col("node").alias("top_id"), F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("edge_path"), F.col("hops").alias("layers"))
    return _top(rows, limit, "layers", "edge_path")


def common_controllers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Sources of control over two or more of ``ids`` (entity_id)."""
    wanted = ids.select(F.col("entity_id").alias("target_entity_id")).distinct()
    hit = of_types(edges, CONTROL_TYPES).join(wanted, "target_entity_id", "left_semi")
    return hit.groupBy(F.col("source_entity_id").alias("controller_id")).agg(F.countDistinct("target_entity_id").alias("controlled_count")).filter("controlled_count >= 2").orderBy(F.desc("controlled_count"), "controller_id")
