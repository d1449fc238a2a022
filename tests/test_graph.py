"""Trails, inferred edges, owners and cycles on drawn graphs; both ways of walking."""

import pytest

from kinledger.config import EngineConfig
from kinledger.operators import graph, ownership

EDGE = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, ownership_pct double"
ENTITY = "entity_id string, name string, entity_type string, addresses array<string>"


def edges(spark, rows):
    return spark.createDataFrame([(f"e{k}", a, b, t, p) for k, (a, b, t, p) in enumerate(rows)], EDGE)


def entities(spark, people="P", others="ABC"):
    return spark.createDataFrame([(p, p.lower(), "INDIVIDUAL", []) for p in people] + [(c, c.lower(), "COMPANY", []) for c in others], ENTITY)


CHAIN = [("P", "A", "OWNS", 80.0), ("A", "B", "OWNS", 50.0)]


@pytest.mark.parametrize("method", ["cte", "loop"])
def test_chain(spark, method):
    got = {(r.start_id, r.owner_id, r.effective_pct, r.chain_length) for r in ownership.beneficial_owners(edges(spark, CHAIN), entities(spark), method=method).collect()}
    assert got == {("A", "P", 80.0, 1), ("B", "P", 40.0, 2)}
    derived = graph.transitive_ownership(edges(spark, CHAIN)).collect()
    assert [(r.source_entity_id, r.target_entity_id, r.ownership_pct) for r in derived] == [("P", "B", 40.0)]
    known = [*CHAIN, ("P", "B", "INDIRECT_OWNS", 40.0)]
    assert graph.transitive_ownership(edges(spark, known)).count() == 0


def test_diamond_gives_a_row_for_each_way(spark):
    e = edges(spark, [("P", "A", "OWNS", 60.0), ("P", "B", "OWNS", 60.0), ("A", "C", "OWNS", 50.0), ("B", "C", "OWNS", 50.0)])
    starts = spark.createDataFrame([("C",)], "start_id string")
    assert [(r.owner_id, r.effective_pct) for r in ownership.beneficial_owners(e, entities(spark), starts).collect()] == [("P", 30.0)] * 2


def test_null_share_and_threshold(spark):
    e = edges(spark, [("P", "A", "OWNS", 50.0), ("A", "B", "OWNS", 50.0), ("B", "C", "OWNS", None)])
    got = {r.start_id: (r.effective_pct, r.confidence) for r in ownership.beneficial_owners(e, entities(spark)).collect()}
    assert got["C"] == (25.0, 0.5) and got["B"] == (25.0, 0.5) and got["A"] == (50.0, 1.0)


def test_no_pruning_where_shares_can_grow(spark):
    e = edges(spark, [("P", "A", "OWNS", 200.0), ("A", "B", "OWNS", 20.0)])
    assert {(r.start_id, r.effective_pct) for r in ownership.beneficial_owners(e, entities(spark)).collect()} == {("A", 200.0), ("B", 40.0)}


def test_depth_and_pinned_length(spark):
    e = edges(spark, [("P", "A", "OWNS", None), ("A", "B", "OWNS", None), ("B", "C", "OWNS", None), ("C", "D", "OWNS", None)])
    ents = entities(spark, others="ABCD")
    assert ownership.beneficial_owners(e, ents, config=EngineConfig(max_depth=2)).count() == 2
    free = {r.start_id: r.confidence for r in ownership.beneficial_owners(e, ents).collect()}
    assert free["D"] == pytest.approx(0.9)
    assert {r.confidence for r in ownership.beneficial_owners(e, ents, config=EngineConfig(compat_chain_length=True)).collect()} == {1.0}


@pytest.mark.parametrize("method", ["cte", "loop"])
def test_cycles(spark, method):
    two = edges(spark, [("A", "B", "OWNS", None), ("B", "A", "OWNS", None), ("C", "C", "OWNS", None)])
    got = {(r.start_id, r.cycle_length) for r in ownership.circular_ownership(two).collect()}
    assert got == {("A", 2), ("B", 2)}
    eight = edges(spark, [("A", "B", "OWNS", None), ("B", "A", "OWNS", None), ("A", "C", "OWNS", None), ("C", "A", "OWNS", None)])
    assert sorted(r.cycle_length for r in ownership.circular_ownership(eight).collect() if r.start_id == "A") == [2, 2, 4, 4]
    walked = graph.trails(eight, None, 10, method=method)
    assert walked.count() == graph.trails(eight, None, 4).count()


def test_neighbors_and_controllers(spark):
    e = edges(spark, CHAIN)
    assert [(r.neighbor_id, r.hops) for r in graph.neighbors(e, "A").collect()] == [("B", 1), ("P", 1)]
    assert graph.neighbors(e, "A", types=("CONTROLS",)).count() == 0
    both = edges(spark, [("P", "A", "OWNS", None), ("P", "B", "CONTROLS", None)])
    ids = spark.createDataFrame([("A",), ("B",)], "entity_id string")
    assert [tuple(r) for r in ownership.common_controllers(both, ids).collect()] == [("P", 2)]


def test_shared_addresses_and_directors(spark):
    ents = spark.createDataFrame([("A", "a", "COMPANY", ["x", "y", "x"]), ("B", "b", "COMPANY", ["x"]), ("P", "p", "INDIVIDUAL", [])], ENTITY)
    none = edges(spark, [("P", "A", "DIRECTOR_OF", None), ("P", "B", "DIRECTOR_OF", None)])
    got = graph.shared_addresses(ents, none).collect()
    assert [(r.source_entity_id, r.target_entity_id, r.shared_addresses) for r in got] == [("A", "B", ["x", "x"])]
    assert [r.common_director for r in graph.common_directors(ents, none).collect()] == ["p"]
    known = edges(spark, [("P", "A", "DIRECTOR_OF", None), ("P", "B", "DIRECTOR_OF", None), ("A", "B", "SHARES_DIRECTOR", None), ("A", "B", "SHARES_ADDRESS", None)])
    assert graph.common_directors(ents, known).count() == 0 and graph.shared_addresses(ents, known).count() == 0
    assert {r.kind: r.n for r in graph.inferred_counts(ents, none).collect()} == {"transitive_ownership": 0, "shared_addresses": 1, "common_directors": 1}


def test_nominees_and_report(spark):
    names = "ABCDEF"
    e = edges(spark, [("P", c, "DIRECTOR_OF", None) for c in names] + [("P", "A", "OWNS", 60.0)])
    ents = entities(spark, others=names)
    n = ownership.nominees(e, ents).collect()
    assert len(n) == 6 and {(r.entity_count, r.risk_level) for r in n} == {(6, "MEDIUM")}
    starts = spark.createDataFrame([("A",), ("B",)], "start_id string")
    got = {r.start_id: r for r in ownership.ownership_report(e, ents, starts).collect()}
    assert got["A"].complexity_score == pytest.approx(0.2 + 0.3 * 0.2) and got["A"].transparency == "TRANSPARENT"
    assert got["B"].transparency == "OPAQUE" and got["B"].risk_level == "LOW"


def test_edges_with_properties(spark):
    from kinledger.schema import RELATIONSHIP
    from kinledger.sources.store import flat_edges

    rows = [{"relationship_id": f"e{k}", "source_entity_id": a, "target_entity_id": b, "relationship_type": t, "properties": {"ownership_pct": p}} for k, (a, b, t, p) in enumerate(CHAIN)]
    nested = spark.createDataFrame(rows, RELATIONSHIP)
    texts = edges(spark, CHAIN).selectExpr("* except (ownership_pct)", "map('ownership_pct', string(ownership_pct), 'x', 'y') AS properties")
    for e in (nested, texts):
        assert {(r.start_id, r.effective_pct) for r in ownership.beneficial_owners(e, entities(spark)).collect()} == {("A", 80.0), ("B", 40.0)}
        assert [r.ownership_pct for r in graph.transitive_ownership(e).collect()] == [40.0]
        assert [(r.neighbor_id, r.hops) for r in graph.neighbors(e, "A").collect()] == [("B", 1), ("P", 1)]
        assert ownership.circular_ownership(e).count() == ownership.layered_structures(e).count() == 0
    assert flat_edges(edges(spark, CHAIN)).columns == edges(spark, CHAIN).columns


def test_the_session_stays_as_it_is(spark):
    spark.range(3).createOrReplaceTempView("kl_hop")
    spark.range(4).createOrReplaceTempView("customer")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    ownership.beneficial_owners(edges(spark, CHAIN), entities(spark)).count()
    from kinledger.sources.store import execute_query

    held = execute_query(spark, "SELECT count(*) AS n FROM customer WHERE id < :m", {"m": 2}, customer=spark.range(9))
    assert held.first().n == 2 and spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert spark.table("kl_hop").count() == 3 and spark.table("customer").count() == 4
    assert spark.catalog.dropTempView("kl_hop") and spark.catalog.dropTempView("customer")
    assert not spark.catalog.tableExists("kl_first")


def test_layers_stop_where_there_are_enough(spark):
    rows = [(f"t{k}", "C", "OWNS", None) for k in range(6)] + [("C", "B", "OWNS", None), ("B", "A", "OWNS", None)] + [(f"u{k}", "t0", "OWNS", None) for k in range(4)]
    e = edges(spark, rows)
    walked = {m: {(r.start_id, r.node, r.hops) for r in graph.trails(e, None, 10, method=m, enough=(3, 5)).collect()} for m in ("cte", "loop")}
    gone = walked["cte"] - walked["loop"]
    assert gone == {("A", f"u{k}", 4) for k in range(4)} and walked["loop"] < walked["cte"]
    assert ownership.layered_structures(e, limit=5).filter("start_id = 'A'").count() == 5


def test_hot_addresses_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 4)
    ents = spark.createDataFrame([(f"c{k:02}", "n", "COMPANY", ["hot", f"p{k % 3}"]) for k in range(15)], ENTITY)
    none = edges(spark, [])
    got = {(r.source_entity_id, r.target_entity_id): r.shared_addresses for r in graph.shared_addresses(ents, none).collect()}
    assert len(got) == 105 and got["c00", "c03"] == ["hot", "p0"] and got["c00", "c01"] == ["hot"]
    groups = {r.address: (r.members, r.first_id) for r in graph.address_groups(ents).collect()}
    assert groups == {"hot": (15, "c00"), "p0": (5, "c00"), "p1": (5, "c01"), "p2": (5, "c02")}
    members = ents.selectExpr("entity_id", "'k' AS at")
    a, b = members.withColumnRenamed("entity_id", "a"), members.withColumnRenamed("entity_id", "b")
    assert graph.pairs_within(members, "at", a, b, most=4).count() == 225


def test_empty(spark):
    none = spark.createDataFrame([], EDGE)
    assert ownership.beneficial_owners(none, entities(spark)).count() == 0
    assert graph.transitive_ownership(none).count() == 0 and ownership.layered_structures(none).count() == 0
