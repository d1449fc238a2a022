"""Fusion, explanation, extraction, stores, risk, features, GNN and streaming."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinledger.config import EngineConfig
from kinledger.functions import context, features, risk
from kinledger.functions import similarity as sim
from kinledger.operators import extract, gnn, resolve
from kinledger.plans import catalogue
from kinledger.sources import store
from kinledger.streaming import link

ENTITY = "entity_id string, name string, entity_type string, addresses array<string>, identifiers map<string,string>"
A = ("a", "ABC Corporation", "COMPANY", ["123 Main St, New York, NY"], {"ein": "12-3456789"})
B = ("b", "ABC Corp", "COMPANY", ["123 Main Street, New York, NY"], {"ein": "123456789"})


def decide(spark, **more):
    pairs = spark.createDataFrame([("b", "a"), ("a", "b")], "id1 string, id2 string")
    return resolve.resolve_entities(pairs, spark.createDataFrame([A, B], ENTITY), **more).collect()


def test_worked_decision(spark):
    raw = decide(spark)
    assert len(raw) == 1 and raw[0].decision == "NOT_MATCH" and raw[0].score == pytest.approx(0.295511, abs=1e-6)
    same = decide(spark, normalize=True)[0]
    assert same.decision == "DEFINITE_MATCH" and same.score == pytest.approx(0.9)
    assert "Matching identifiers detected (confidence: 100.0%)" in same.explanation and "LLM not available" in same.explanation


def test_answers_move_the_score(spark):
    ans = lambda text: spark.createDataFrame([("a", "b", text)], "id1 string, id2 string, response string")
    no = decide(spark, normalize=True, answers=ans('{"is_match": false, "confidence": 0.95, "reasoning": "x"}'))[0]
    assert no.score == pytest.approx(0.40) and no.decision == "NOT_MATCH"
    yes = decide(spark, answers=ans('well {"is_match": true, "confidence": 0.95, "supporting_factors": ["p", "q"]}'))[0]
    assert yes.score == pytest.approx(0.85) and "Supporting factors: p, q" in yes.explanation
    bad = decide(spark, answers=ans("nonsense"))[0]
    assert "Error" in bad.explanation


def plain_pairs(rows, most):
    """Pairs by loops: all of small blocks; of large ones those near each other by name, or by the name read backwards, and an identifier's star."""
    held = {}
    for i, name, kind, places, ids in rows:
        sound = {"N": "N000", "P": "P000"}[name[0]]
        for block in {f"name:{name}", f"sound:{sound}:{kind}", *(f"address:{p}" for p in places), *(f"id:{k}:{v}" for k, v in ids.items())}:
            held.setdefault(block, []).append((f"{name}|{'|'.join(places)}", i))
    out = set()
    for block, members in held.items():
        for order in (lambda m: m, lambda m: (m[0][::-1], m[1])):
            line = [i for _, i in sorted(members, key=order)]
            reach = len(line) if len(line) <= most else most
            out |= {tuple(sorted((a, b))) for k, a in enumerate(line) for b in line[k + 1 : k + 1 + reach]}
        if block.startswith("id:"):
            first = min(i for _, i in members)
            out |= {(first, i) for _, i in members if i != first}
    return out


@pytest.mark.parametrize("most", [3, 5, 200])
def test_blocks(spark, most):
    rows = [(f"e{k:02}", f"N{k * 7 % 11}", "COMPANY", ["same place"] if k < 9 else [], {"ein": "1"} if k % 3 else {}) for k in range(20)]
    rows += [("f1", "P1", "COMPANY", [], {}), ("f2", "P1", "INDIVIDUAL", ["x"], {"ein": ""})]
    pairs = [tuple(r) for r in resolve.blocks(spark.createDataFrame(rows, ENTITY), most).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs(rows, most)


def test_large_blocks_keep_near_names_together(spark):
    """1,000 entities at one address, 50 of them again with a typing error at the name's begin or end."""
    rng = np.random.default_rng(3)
    letters = np.array(list("BCDFGHKLMNPRST"))
    names = ["".join(rng.choice(letters, 9)) for _ in range(950)]
    rows = [(f"a{k:04}", n, "COMPANY", ["hot"], {}) for k, n in enumerate(names)]
    planted = {}
    for k in range(50):
        wrong = "Z" + names[k][1:] if k % 2 else names[k][:-1] + "Z"
        rows.append((f"b{k:04}", wrong, "COMPANY", ["hot"], {}))
        planted[f"a{k:04}", f"b{k:04}"] = wrong
    small, large = (spark.createDataFrame(rows[-n:], ENTITY) for n in (200, 1000))
    found = {(r.id1, r.id2) for r in resolve.blocks(large, most=20).collect()}
    assert set(planted) <= found and len(found) < 1000 * 2 * 20 * 2
    counts = [resolve.blocks(df).count() for df in (small, large)]
    assert counts[0] == 200 * 199 // 2 and counts[1] / 1000 > counts[0] / 200


def test_clusters(spark):
    rows = [("a", "b", "MERGE_ENTITIES"), ("b", "c", "MERGE_ENTITIES"), ("c", "d", "FLAG_FOR_REVIEW"), ("e", "f", "MERGE_ENTITIES")]
    found = resolve.clusters(spark.createDataFrame(rows, "id1 string, id2 string, action string"))
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")}
    ents = spark.createDataFrame([(i, f"name {i}", "COMPANY", [i, "x"] if i != "d" else None, 0.5 if i == "a" else None if i == "d" else 0.9) for i in "abcdg"], "entity_id string, name string, entity_type string, addresses array<string>, confidence double")
    every = resolve.clusters(spark.createDataFrame(rows, "id1 string, id2 string, action string"), ents)
    got = {r.cluster_id: r for r in resolve.merged_entities(ents, every).collect()}
    assert set(got) == {"a", "d", "g"} and (got["a"].members, got["a"].name, got["a"].confidence, got["a"].addresses) == (3, "name b", 0.9, ["a", "b", "c", "x"])
    assert got["d"].addresses == [] and got["d"].confidence is None
    none = spark.createDataFrame([], "id1 string, id2 string, action string")
    assert resolve.clusters(none).count() == 0 and resolve.clusters(none, ents).count() == 5


def test_extraction(spark):
    docs = spark.createDataFrame([(0, "Notice: Acme Corp, EIN 10-0000000, is run by John Smith at 12 Oak Street. Write to desk0@example.com or 555-123-4567."), (1, "Zed Corp and Foo Ltd signed"), (2, None), (3, "Use VISA now")], "doc_id long, text string")
    got = {}
    for r in extract.extract_entities(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(r.name for r in got[0]) == ["Acme", "John Smith", "Oak Street"]
    assert {tuple(r.addresses) for r in got[0]} == {("12 OAK ST",)} and {r.identifiers["ein"] for r in got[0]} == {"100000000"}
    firms = lambda d: [r.original_name for r in got[d] if r.entity_type == "COMPANY"]
    assert firms(1) == ["Zed Corp and Foo Ltd"] and firms(3) == ["Use VISA"]
    assert 2 not in got
    acme = next(r for r in got[0] if r.name == "Acme")
    assert acme.confidence == 0.6 and acme.entity_type == "COMPANY"
    answers = spark.createDataFrame([(1, '{"entities": [{"name": "Foo Ltd"}, {"name": "foo ltd"}]}')], "doc_id long, response string")
    named = [(r.doc_id, r.original_name, r.confidence) for r in extract.extract_entities(docs.filter("doc_id = 1"), answers).collect()]
    assert named == [(1, "Foo Ltd", 0.9)]


def test_phone_pattern_trap(spark):
    docs = spark.createDataFrame([(1, "call (555) 123-4567 or +1-555-123-4567")], "doc_id long, text string")
    assert extract.attributes(docs).first().phone == "555) 123-4567"


def test_upserts(spark):
    old = spark.createDataFrame([("a", "A", 0.9, ["x"]), ("b", "B", 0.5, ["y"])], "entity_id string, name string, confidence double, roles array<string>")
    new = spark.createDataFrame([("a", "A2", 0.4, ["z"], 1), ("a", "A3", 0.95, ["w"], 2), ("c", "C", 0.1, [], 3)], "entity_id string, name string, confidence double, roles array<string>, seq int")
    got = {r.entity_id: (r.name, r.confidence, r.roles) for r in store.upsert_entities(old, new, "seq").collect()}
    assert got == {"a": ("A", 0.95, ["w"]), "b": ("B", 0.5, ["y"]), "c": ("C", 0.1, [])}
    edge = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double"
    e = store.upsert_edges(spark.createDataFrame([("1", "a", "b", "OWNS", 0.2)], edge), spark.createDataFrame([("1", "a", "b", "CONTROLS", 0.7), ("2", "a", "zz", "OWNS", 1.0)], edge), old)
    assert [(r.relationship_id, r.relationship_type, r.confidence) for r in e.collect()] == [("1", "OWNS", 0.7)]


def test_store(spark, tmp_path):
    e = spark.createDataFrame([("a", "Abc", None, {"k": "v"}), ("b", "xbc", 0.5, None)], "entity_id string, name string, confidence double, identifiers map<string,string>")
    assert [r.entity_id for r in store.find_by_name(e, "bc").collect()] == ["a", "b"]
    filled = {r.entity_id: r for r in store.with_defaults(e).collect()}
    assert filled["a"].confidence == 1.0 and filled["b"].identifiers == {}
    assert store.from_json(store.to_json(e), e.schema).collect() == e.collect()
    flat = e.drop("identifiers")
    for fmt in ("parquet", "orc", "json", "csv"):
        store.write_table(flat, str(tmp_path / fmt), fmt)
        assert store.read_table(spark, str(tmp_path / fmt), fmt, "entity_id string, name string, confidence double").count() == 2
    cache = store.PairCache()
    cache.put("b", "a", 1)
    assert cache.get("a", "b") == 1 and cache.size() == 1
    cache.clear()
    assert cache.get("a", "b") is None


def test_risk(spark):
    j = [r.x for r in spark.createDataFrame([("Iran",), ("Malta",), ("malta",), ("",), (None,)], "j string").select(risk.jurisdiction_risk(F.col("j")).alias("x")).collect()]
    assert j == [1.0, 0.7, 0.1, 0.5, 0.5]
    now = dt.datetime(2024, 1, 1, 12)
    days = [89.9, 90.0, 365.0, 1095.0, -5.0]
    rows = spark.createDataFrame([(now - dt.timedelta(days=d),) for d in days] + [(None,)], "t timestamp")
    assert [r.x for r in rows.select(risk.age_risk(F.col("t"), F.lit(now)).alias("x")).collect()] == [0.8, 0.5, 0.3, 0.1, 0.8, 0.5]
    c = spark.createDataFrame([(100.0, 1), (40.0, 1), (20.0, 1), (100.0, 5)], "p double, n int").select(risk.ubo_confidence(F.col("p"), F.col("n")).alias("x"))
    assert [r.x for r in c.collect()] == pytest.approx([1.0, 0.8, 0.32, 0.81])


def test_features(spark):
    row = spark.createDataFrame([("Abc Def", "NGO", {"lei": "x"}, None, None, ["p"], None, None, ["a", "b"], 0.5, [])], "name string, entity_type string, identifiers map<string,string>, incorporation_date timestamp, dissolution_date timestamp, phone_numbers array<string>, email_addresses array<string>, websites array<string>, addresses array<string>, confidence double, roles array<string>")
    f = row.select(features.node_features(F.lit("2024-01-01").cast("timestamp")).alias("f")).first().f
    assert len(f) == 164 and f[:18] == pytest.approx([0, 0, 0, 1, 0, 1, 0, 0, 1, 0, 1, 1, 0, 0.4, 0.5, 0.07, 0.2, 0])
    edge = spark.createDataFrame([("OWNS", None, 1.0, None, None)], "relationship_type string, ownership_pct double, confidence double, temporal_valid_from timestamp, temporal_valid_to timestamp")
    assert edge.select(features.edge_features(F.lit("2024-01-01").cast("timestamp")).alias("f")).first().f == [1.0] + [0.0] * 12 + [1.0, 0.0, 1.0]


def test_prompts(spark):
    c = [F.lit("x")] * 2 + [F.lit(0.5)] * 3
    text = spark.range(1).select(context.disambiguation_prompt(*c).alias("p"), context.analysis_prompt(F.lit("ctx")).alias("q")).first()
    assert "50.00%" in text.p and text.q.endswith("ctx")


def test_gnn_against_numpy(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "node_id string, features array<double>")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")
    w = gnn.Weights.drawn(2, 4, 3, n_layers=1)
    got = {r.node_id: np.array(r.h) for r in gnn.embed(nodes, edges, w).collect()}
    x = {k: gnn._mlp(np.array([v]), w.encoder)[0] for k, v in (("a", [1.0, 0]), ("b", [0, 1.0]), ("c", [1.0, 1]))}
    layer = w.layers[0]
    h = x["b"] @ layer["own"] + (x["a"] + x["c"]) / 2 @ layer["near"] + layer["bias"]
    out = gnn._mlp(h[None], w.head)
    out = (out - out.mean()) / np.sqrt(out.var() + 1e-5)
    assert got["b"] == pytest.approx((out / np.linalg.norm(out))[0])


def plain_gat(x, edges, w, heads, active):
    """One attention layer by loops over receivers and heads."""
    per = len(w["bias"]) // heads
    lin = {k: (v @ w["lin"]).reshape(heads, per) for k, v in x.items()}
    out = {}
    for dst in x:
        senders = sorted({s for s, d in edges if d == dst and s in x} | {dst})
        parts = []
        for k in range(heads):
            raw = np.array([lin[dst][k] @ w["to"][k] + lin[s][k] @ w["from"][k] for s in senders])
            e = np.where(raw > 0, raw, 0.2 * raw)
            share = np.exp(e - e.max())
            parts.append(sum(a * lin[s][k] for a, s in zip(share / share.sum(), senders)))
        h = np.concatenate(parts) + w["bias"]
        out[dst] = np.maximum(h, 0) if active else h
    return out


@pytest.mark.parametrize("scale", [1.0, 1000.0, -1000.0])
def test_attention_against_numpy(spark, scale):
    feats = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0], "d": [-1.0, 0.5]}
    links = [("a", "b"), ("c", "b"), ("b", "a"), ("b", "b"), ("d", "b"), ("d", "b"), ("x", "a")]
    nodes = spark.createDataFrame(list(feats.items()), "node_id string, features array<double>")
    edges = spark.createDataFrame(links, "src string, dst string")
    w = gnn.Weights.drawn(2, 4, 3, kind="gat", heads=2)
    assert w.layers[0]["lin"].shape == (4, 8) and w.layers[1]["lin"].shape == w.layers[2]["lin"].shape == (8, 8) and w.head[0][0].shape == (8, 3)
    for layer in w.layers:
        layer["to"] = layer["to"] * scale
    got = {r.node_id: np.array(r.h) for r in gnn.embed(nodes, edges, w).collect()}
    x = {k: gnn._mlp(np.array([v]), w.encoder)[0] for k, v in feats.items()}
    for k, layer in enumerate(w.layers):
        x = plain_gat(x, links, layer, 2, k < 2)
    for k, h in x.items():
        out = gnn._mlp(h[None], w.head)[0]
        out = (out - out.mean()) / np.sqrt(out.var() + 1e-5)
        assert got[k] == pytest.approx(out / np.linalg.norm(out), abs=1e-9)


def test_a_plan_has_one_layer(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "node_id string, features array<double>")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    for kind in ("sage", "gat"):
        sizes = {len(gnn.embed(nodes, edges, gnn.Weights.drawn(2, 4, 3, n_layers=n, kind=kind, heads=2))._jdf.queryExecution().toString()) // 1000 for n in (1, 3)}
        assert max(sizes) - min(sizes) <= 1


def test_a_batch_meets_only_its_blocks(spark):
    known = [(f"k{k}", f"N{k}", "COMPANY", [f"P{k % 50}"], {}) for k in range(300)]
    batch = [("n1", "N7", "COMPANY", [], {}), ("k8", "Other", "COMPANY", ["p9"], {}), ("n2", "Zz", "INDIVIDUAL", None, None)]
    got = {(r.id1, r.id2) for r in link.link_batch(spark.createDataFrame(batch, ENTITY), spark.createDataFrame(known, ENTITY)).collect()}
    assert ("k7", "n1") in got and {("k109", "k8"), ("k59", "k8"), ("k8", "k9")} <= got
    assert all("n1" in p or "k8" in p or "n2" in p for p in got)


def test_pairs_may_bring_scores_and_answers(spark):
    rows = [(f"e{k}", f"Firm {k % 3}", "COMPANY", [f"{k} Elm", "Oak"][: k % 3], {"ein": str(k // 2)}) for k in range(8)]
    ents, pairs = spark.createDataFrame(rows, ENTITY), resolve.blocks(spark.createDataFrame(rows, ENTITY))
    more = {"gnn_score": F.when(F.col("id1") < "e3", 0.7), "response": F.when(F.col("id2") > "e5", '{"is_match": true, "confidence": 0.95}')}
    joined = resolve.resolve_entities(pairs, ents, scores=pairs.withColumns(more).filter("gnn_score IS NOT NULL").select("id1", "id2", "gnn_score"), answers=pairs.withColumns(more).select("id1", "id2", "response"))
    brought = resolve.resolve_entities(pairs.withColumns(more), ents, once=True)
    keep = ("id1", "id2", "gnn_score", "address_similarity", "score", "decision", "explanation")
    got = [sorted(map(tuple, df.select(*keep).collect())) for df in (joined, brought)]
    assert got[0] == got[1] and len({r[2] for r in got[0]}) == 2 and len({r[5] for r in got[0]}) > 1


def _odd_entities(rng):
    """Equal names and addresses, several addresses, null and empty ones, two identifiers, long and foreign texts."""
    rows = []
    for k in range(160):
        name = [f"Nor{'abc'[k % 3]} Élan {k * 7 % 13}", f"NORA  elan {k % 5} x", "", None, f" nora {'word ' * (k % 30)}", f"Nora {k} ß\U0001f600"][k % 6 if k % 4 else 0]
        places = [None, [], [f"{k % 9} Elm"], [f"{k % 9}  ELM", f"{k} Oak st", f"{k % 9}  ELM"], [None, "Oak"], [f"{k}" * 70]][int(rng.integers(6))]
        ids = [None, {}, {"ein": "7"}, {"ein": str(k % 4), "lei": "x"}, {"ein": None, "tag": "t"}, {"tag": None, "lei": ""}, {"tag": "t"}][int(rng.integers(7))]
        rows.append((f"e{k * 37 % 1000}", name, "INDIVIDUAL" if k % 5 == 0 else "COMPANY", places, ids))
    return rows


@pytest.mark.parametrize("most, metric", [(3, "jw4"), (7, "sm3"), (200, "jw4")])
def test_candidates_that_meet_in_cells_have_the_signals_of_pairs(spark, most, metric):
    rng = np.random.default_rng(5)
    rows, config = _odd_entities(rng), EngineConfig(name_metric=metric)
    people = [r[0] for r in rows if r[2] == "INDIVIDUAL"]
    links = [(f"r{k}", people[int(rng.integers(4))], rows[int(rng.integers(len(rows)))][0], "DIRECTOR_OF") for k in range(200)]
    ents = spark.createDataFrame(rows, ENTITY)
    edges = spark.createDataFrame(links, "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string").withColumn("ownership_pct", F.lit(None).cast("double"))
    pairs = resolve.blocks(ents, most)
    for known in (edges, None):
        plain = resolve.compute_similarity(pairs, ents, config)
        plain = resolve.graph_signals(plain, ents, known) if known is not None else plain.withColumns({"num_shared_directors": F.lit(0), "shared_directors_score": F.lit(0.0), "shared_addresses_score": F.when(F.size("shared_addresses") > 0, 1.0).otherwise(0.0)})
        met = resolve.candidate_signals(ents, known, most, config=config)
        want, got = (sorted(map(tuple, df.select(met.columns).collect())) for df in (plain, met))
        assert len(want) > 500 and [r[:2] for r in got] == [r[:2] for r in want]
        assert got == want


def test_measures_among_texts_are_those_of_pairs():
    rng = np.random.default_rng(2)
    texts = sorted({"".join(rng.choice(list("abcd é\0"), int(rng.choice([0, 1, 2, 9, 40, 63, 64, 90, 210])))) for _ in range(60)})
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for k, c in enumerate(a, 1):
            new = [k]
            for m, d in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[m] + 1, row[m - 1] + (c != d)))
            row = new
        return row[-1]

    assert sim.jaro_winkler_among(texts, i, j).tolist() == [sim.jaro_winkler(texts[a], texts[b]) for a, b in zip(i, j)]
    some = np.arange(0, len(i), 7)
    assert sim.levenshtein_among(texts, i[some], j[some]).tolist() == [edits(texts[a], texts[b]) for a, b in zip(i[some], j[some])]


def test_no_candidate_pair_is_sent_or_looked_up(spark):
    """Shuffles and joins of resolve_candidates grow with the entities: none stands above the place where pairs are made."""
    plan = catalogue.QUERIES["resolve_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Exchange" not in above and "Join" not in above


def test_a_batch_by_identifier_meets_no_one_else(spark):
    known = [(f"k{k}", f"Firm {k}", "COMPANY", [f"P{k % 7}"], {"ein": str(k // 2)}) for k in range(40)]
    batch = [(f"b{k}", f"Firm {k}", "COMPANY", [f"P{k % 7}"], {"ein": str(k // 2), "x": "1"}) for k in range(30)] + [("n", "Firm", "COMPANY", None, None)]
    rows = lambda **more: link.link_batch(spark.createDataFrame(batch, ENTITY), spark.createDataFrame(known, ENTITY), **more).select("id1", "id2", "score", "identifier_match_score").collect()
    full, own = rows(), rows(kinds=("id",))
    assert len(own) == 15 + 60 and set(own) == {r for r in full if r.identifier_match_score == 1} and len(full) > len(own)
    assert len(full) == len(set(full)) and not any(r.id1[0] == r.id2[0] == "k" for r in full)


def test_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    schema = ENTITY + ", last_updated timestamp"
    spark.createDataFrame([(*A, dt.datetime(2024, 1, 1)), (*A, dt.datetime(2024, 1, 1))], schema).write.parquet(source)
    known = spark.createDataFrame([B], ENTITY)
    from kinledger.functions.normalize import normalize_entity

    stream = link.first_arrivals(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))
    q = link.link_stream(stream, lambda: normalize_entity(known), lambda df, n: seen.extend(df.select("id1", "id2", "decision").collect()), str(tmp_path / "cp"))
    assert q.awaitTermination(120) and [tuple(r) for r in seen] == [("a", "b", "DEFINITE_MATCH")]
    counts = link.windowed_counts(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "last_updated", "entity_type")
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and [r.n for r in spark.table("counted").collect()] == [2]
