"""Ownership graph: neighbours, trails, inferred edges.

Edges have relationship_id, source_entity_id, target_entity_id, relationship_type and
ownership_pct (null counts as 100), a column of its own or one of ``properties``. A trail uses no edge twice; entities may repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinledger.sources.scratch import sql_over, written
from kinledger.sources.store import flat_edges

HUNDRED = "CAST(100 AS DOUBLE)"
#: Edges in a first frontier up to which Spark's recursion walks, and members of an address or a director that a task pairs with others.
FRONTIER, MEMBERS = 1_000_000, 10_000


def _pct(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(100.0))


def of_types(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return flat_edges(edges).filter(F.col("relationship_type").isin(*types))


def cyclic_part(edges: DataFrame, rounds: int = 20, worth: float = 0.05) -> DataFrame:
    """Edges without most of those that lie on no cycle.

    An edge from an entity that nothing leads to, or to one that nothing leaves, is on no
    cycle. Such edges go in rounds, each written, while a round takes ``worth`` of them or more.
    """
    kept = written(edges, "edges")
    n = kept.count()
    for _ in range(rounds):
        leads = kept.select(F.col("source_entity_id").alias("target_entity_id")).distinct()
        led_to = kept.select(F.col("target_entity_id").alias("source_entity_id")).distinct()
        kept = written(kept.join(leads, "target_entity_id", "left_semi").join(led_to, "source_entity_id", "left_semi").select(*edges.columns), "edges")
        left = kept.count()
        if n - left < worth * n or not left:
            break
        n = left
    return kept


def trails(edges: DataFrame, starts: DataFrame | None, depth: int, incoming: bool = True, least_pct: float | None = None, method: str = "auto", enough: tuple[int, int] | None = None) -> DataFrame:
    """All trails of 1 to ``depth`` edges: start_id, node, pct, edges, nodes, hops.

    ``starts`` (start_id) restricts where they begin; None: everywhere. With
    ``least_pct``, trails whose product is under it are given up as soon as they are,
    if no share can lift it again. "cte" leaves the recursion to Spark; "loop" joins
    hop by hop and writes each frontier to spark.checkpoint.dir; "auto" takes the first for
    frontiers that begin with FRONTIER edges or fewer. ``enough`` (hops, n): a start that has n trails of
    so many hops or more need not be walked further, which "loop" makes use of.
    """
    near, far = ("target_entity_id", "source_entity_id") if incoming else ("source_entity_id", "target_entity_id")
    # written once, since each step reads it
    hop = written(flat_edges(edges).select(F.col(near).alias("near"), F.col(far).alias("far"), F.col("relationship_id").alias("edge"), _pct("ownership_pct").alias("share")), "hops")
    floor = least_pct if least_pct is not None and hop.filter(~F.col("share").between(0.0, 100.0)).isEmpty() else None
    spark = edges.sparkSession
    first = hop if starts is None else hop.join(starts.select(F.col("start_id").alias("near")).distinct(), "near", "left_semi")
    if method == "auto":
        method = "cte" if first.count() <= FRONTIER else "loop"
    if method == "cte":
        prune = "" if floor is None else f"AND w.pct * h.share / {HUNDRED} >= CAST({floor} AS DOUBLE)"
        start = "" if floor is None else f"WHERE {HUNDRED} * share / {HUNDRED} >= CAST({floor} AS DOUBLE)"
        text = f"""
            WITH RECURSIVE walk(start_id, node, pct, edges, nodes, hops) AS (
                SELECT near, far, {HUNDRED} * share / {HUNDRED}, array(edge), array(near, far), 1 FROM kl_first {start}
                UNION ALL
                SELECT w.start_id, h.far, w.pct * h.share / {HUNDRED}, array_append(w.edges, h.edge), array_append(w.nodes, h.far), w.hops + 1
                FROM walk w JOIN kl_hop h ON h.near = w.node
                WHERE w.hops < {int(depth)} AND NOT array_contains(w.edges, h.edge) {prune}
            ) SELECT * FROM walk"""
        # the limit is read while the recursion runs, so that it is run here and the session's value restored
        limit = "spark.sql.cteRecursionRowLimit"
        held = spark.conf.get(limit)
        spark.conf.set(limit, "-1")
        try:
            return written(sql_over(spark, text, kl_first=first, kl_hop=hop), "trails")
        finally:
            spark.conf.set(limit, held)
    keep = F.lit(True) if floor is None else F.col("pct") >= floor
    front = first.select(
        F.col("near").alias("start_id"), F.col("far").alias("node"), (F.lit(100.0) * F.col("share") / 100.0).alias("pct"), F.array("edge").alias("edges"), F.array("near", "far").alias("nodes"), F.lit(1).alias("hops")
    ).filter(keep)
    found = []
    for k in range(1, depth + 1):
        front = written(front, "frontier")
        found.append(front)
        if k == depth or front.isEmpty():
            break
        if enough and k >= enough[0]:
            met = reduce(DataFrame.union, found[enough[0] - 1 :]).groupBy("start_id").agg(F.count("*").alias("n")).filter(F.col("n") >= enough[1])
            front = front.join(met, "start_id", "left_anti")
        front = (
            front.join(hop, F.col("near") == F.col("node")).filter(~F.array_contains("edges", F.col("edge")))
            .select("start_id", F.col("far").alias("node"), (F.col("pct") * F.col("share") / 100.0).alias("pct"), F.array_append("edges", F.col("edge")).alias("edges"), F.array_append("nodes", F.col("far")).alias("nodes"), (F.col("hops") + 1).alias("hops"))
            .filter(keep)
        )
    return reduce(DataFrame.union, found)


def neighbors(edges: DataFrame, entity_id: str, depth: int = 1, types: tuple[str, ...] | None = None, limit: int = 100) -> DataFrame:
    """Entities on trails of up to ``depth`` edges, either way, and each trail's edges and types."""
    e = of_types(edges, types) if types else flat_edges(edges)
    turned = e.select("relationship_id", F.col("target_entity_id").alias("source_entity_id"), F.col("source_entity_id").alias("target_entity_id"), "relationship_type", "ownership_pct")
    loops = F.col("source_entity_id") != F.col("target_entity_id")
    both = e.select(*turned.columns).union(turned.filter(loops))
    starts = e.sparkSession.range(1).select(F.lit(entity_id).alias("start_id"))
    walked = trails(both, starts, depth, incoming=False).select(F.col("node").alias("neighbor_id"), F.array_join("edges", ">").alias("path"), "hops").distinct()
    return walked.orderBy("hops", "neighbor_id", "path").limit(limit)


def transitive_ownership(edges: DataFrame, threshold: float = 10.0) -> DataFrame:
    """New INDIRECT_OWNS edges over exactly two OWNS edges, one for each way."""
    owns = of_types(edges, ("OWNS",))
    a = owns.select(F.col("source_entity_id").alias("owner"), F.col("target_entity_id").alias("via"), F.col("relationship_id").alias("e1"), _pct("ownership_pct").alias("p1"))
    b = owns.select(F.col("source_entity_id").alias("via"), F.col("target_entity_id").alias("owned"), F.col("relationship_id").alias("e2"), _pct("ownership_pct").alias("p2"))
    known = of_types(edges, ("INDIRECT_OWNS",)).select(F.col("source_entity_id").alias("owner"), F.col("target_entity_id").alias("owned")).distinct()
    pct = F.col("p1") * F.col("p2") / 100.0
    found = a.join(b, "via").filter(F.col("e1") != F.col("e2")).withColumn("ownership_pct", pct).filter(F.col("ownership_pct") >= threshold).join(known, ["owner", "owned"], "left_anti")
    return found.select(F.col("owner").alias("source_entity_id"), "via", F.col("owned").alias("target_entity_id"), F.lit("INDIRECT_OWNS").alias("relationship_type"), "ownership_pct", F.lit(True).alias("derived"))


def pairs_within(members: DataFrame, key: str, a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """a joined with b by ``key``, where both have one row for each of ``members``; a key of over ``most`` (default MEMBERS) is several tasks' work."""
    most = most or MEMBERS
    hot = members.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("deals"))
    # fewer than members / most keys
    hot, deals = F.broadcast(hot), F.coalesce("deals", F.lit(1))
    dealt = a.join(hot, key, "left").withColumn("deal", F.pmod(F.xxhash64(*a.columns), deals).cast("int")).drop("deals")
    copies = b.join(hot, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return dealt.join(copies, [key, "deal"]).drop("deal")


def address_groups(entities: DataFrame) -> DataFrame:
    """Each address that two or more entities have: their number and the first of them, a row where pairs are too many."""
    one = entities.select("entity_id", F.explode(F.array_distinct("addresses")).alias("address"))
    return one.groupBy("address").agg(F.countDistinct("entity_id").alias("members"), F.min("entity_id").alias("first_id")).filter("members > 1")


def shared_addresses(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """New SHARES_ADDRESS edges between entities, a before b, with an equal address; an equi-join, not all pairs.

    Pairs grow with the square of an address's entities; ``address_groups`` has a row an address.
    """
    one = entities.select("entity_id", "addresses", F.explode(F.array_distinct("addresses")).alias("at"))
    a, b = one.select(F.col("entity_id").alias("a"), F.col("addresses").alias("la"), "at"), one.select(F.col("entity_id").alias("b"), F.col("addresses").alias("lb"), "at")
    known = of_types(edges, ("SHARES_ADDRESS",))
    known = known.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b")).distinct()
    both = F.filter("la", lambda x: F.array_contains("lb", x))
    # a pair that meets at several addresses counts at its first
    pairs = pairs_within(one, "at", a, b).filter("a < b").withColumn("shared", both).filter(F.col("at") == F.get("shared", F.lit(0)))
    pairs = pairs.join(known, ["a", "b"], "left_anti")
    return pairs.select(F.col("a").alias("source_entity_id"), F.col("b").alias("target_entity_id"), F.lit("SHARES_ADDRESS").alias("relationship_type"), F.col("shared").alias("shared_addresses"), F.lit(True).alias("derived"))


def common_directors(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """New SHARES_DIRECTOR edges, one for each person who directs both."""
    d = of_types(edges, ("DIRECTOR_OF",)).join(entities.filter("entity_type = 'INDIVIDUAL'").select(F.col("entity_id").alias("source_entity_id"), "name"), "source_entity_id")
    known = of_types(edges, ("SHARES_DIRECTOR",)).select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b")).distinct()
    a = d.select("source_entity_id", "name", F.col("target_entity_id").alias("a"))
    b = d.select("source_entity_id", F.col("target_entity_id").alias("b"))
    pairs = pairs_within(d, "source_entity_id", a, b).filter("a < b").join(known, ["a", "b"], "left_anti")
    return pairs.select(F.col("a").alias("source_entity_id"), F.col("b").alias("target_entity_id"), F.lit("SHARES_DIRECTOR").alias("relationship_type"), F.col("name").alias("common_director"), F.lit(True).alias("derived"))


def inferred_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """How many edges each of the three inferences would add."""
    kinds = (("transitive_ownership", transitive_ownership(edges)), ("shared_addresses", shared_addresses(entities, edges)), ("common_directors", common_directors(entities, edges)))
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds])
