"""SimHash groups, components and nearest neighbours against brute force."""

import numpy as np
import pytest
import re
import xxhash

from kinledger.llm import op5_ann as o5
from kinledger.llm import op7_simhash as o7
from kinledger.llm.common import written
from kinledger.operators.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "ÀB c\td  e f", "x y z " * 400, "  q\x1cr s"])
def test_fingerprint(text):
    assert o7.fingerprint(text) == plain_fingerprint(text)


def groups(fps, ids, radius=3):
    up = list(range(len(fps)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {d: min(x for x, y in zip(ids, range(len(fps))) if root(y) == root(k)) for k, d in enumerate(ids)}


def noisy(n, seed):
    """Dense clusters, chains and lone fingerprints."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 1 << 63)) if not out or rng.random() < 0.4 else out[int(rng.integers(len(out)))]
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            base ^= 1 << int(b)
        out.append(base)
    return out


@pytest.mark.parametrize("leaf", [4, 192])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shard_links(seed, leaf, monkeypatch):
    monkeypatch.setattr(o7, "LEAF", leaf)
    fps = sorted(set(noisy(300, seed)))
    kept = o7.shard_links(np.array(fps, np.uint64), np.ones(len(fps), bool))
    assert len(kept) < len(fps)
    f = o7.Forest(len(fps))
    f.link(iter(kept))
    want = groups(fps, list(range(len(fps))))
    assert [f.root(k) for k in range(len(fps))] == [want[k] for k in range(len(fps))]


@pytest.mark.parametrize("homes, block", [(100_000, 30), (100_000, 500_000), (17, 30), (9, 500_000)])
def test_shards_lose_no_link(spark, homes, block):
    fps = sorted(set(noisy(600, 9)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = written(spark.createDataFrame([(f,) for f in signed], "fp long"), "prints")
    found = {r.node: r.root for r in components(o7.linked(prints, shard=40, sample=64, homes=homes, block=block)).collect()}
    want = groups(fps, signed)
    assert {f: found.get(f, f) for f in signed} == want


def test_documents(spark):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(7, base, 1), (3, base, 2), (5, base + " tail", 3), (9, None, 4), (11, "", 5), (12, "!", 6), (12, "!", 6), (None, base, 7), (13, "Other text here", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = [(r.doc_id, r.component_id) for r in o7.near_duplicates(docs).collect()]
    ids = [r[0] for r in rows if r[0] is not None]
    fps = {d: plain_fingerprint(t) for d, t, _ in rows if d is not None}
    want = groups([fps[d] for d in ids], ids)
    assert sorted(x for x in got if x[0] is not None) == sorted((d, want[d]) for d in ids) and (None, 3) in got
    assert want[3] == 3 and want[7] == 3 and want[11] == 9
    kept = sorted(r.doc_id for r in o7.stage(spark, docs, "").collect())
    assert kept == sorted(set(want.values()))
    assert o7.near_duplicates(docs.filter("false")).count() == 0


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("group", [4, 256])
def test_stage_finds_edited_copies(spark, group):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, 300)]
        for _ in range(6 if k else 40):
            words = list(base)
            for at in rng.choice(300, int(rng.integers(1, 14)), replace=False):
                words[at] = f"v{int(rng.integers(5000))}"
            rows.append((len(rows), " ".join(words)))
    sets = [five(t) for _, t in rows]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    got = o7.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), group).collect()
    least = {}
    for r in got:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert {r.doc_id: least[r.root] for r in got} == dict(enumerate(want))


def test_stage_keeps_distinct_texts_of_null_and_repeated_ids(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (4, words("d")), (4, words("e")), (2, words("e")), (-(1 << 63), words("f")), (9, words("a") + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in o7.stage(spark, docs, "").collect())
    assert kept == sorted((str(d), t) for d, t in [(9, words("a") + " x"), (None, words("b")), (None, words("c")), (4, words("d")), (2, words("e")), (-(1 << 63), words("f"))])


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 80)], []])
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    up = {}
    for a, b in pairs:
        up.setdefault(a, a), up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    assert {n: got.get(n, n) for n in up} == up


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]  # many equal vectors
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [1.0, None] + [0.0] * 14, 0), (5300, [float("nan")] * 16, 0), (5400, [1.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in o5.nearest(o5.usable(df)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hits, xd = 0, x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((xd - xd[q]) ** 2).sum(1))
        d[q] = np.inf
        top = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[2] for f in found] == pytest.approx([d[f[1]] for f in found])
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len(set(top.tolist()) & {f[1] for f in found})
    assert hits / (10 * len(got)) >= 0.9
    assert [f[1] for f in sorted(got[100])] == list(range(101, 111))


def test_nearest_within_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(o5, "SAMPLE", 300)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x[3000:5000] = x[3000] + 0.01 * rng.normal(size=(2000, 64))
    x = x[rng.permutation(6000)].astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in o5.nearest(o5.usable(df), reach=1.0, deep=12).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, xd = 0, x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((xd - xd[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(6000), d))[:10].tolist()) & found)
    print("recall", hits / (10 * len(got)))
    assert len(got) == 60 and hits / (10 * len(got)) > 0.98


def test_blocks_of_candidates_and_queries(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist())] * 150
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, o5.nearest(o5.usable(df), every=3, reach=1.0, **size).collect())) for size in ({}, {"block": 40, "asks": 17})]
    assert found[0] == found[1] and len(found[0]) == 3000
    got = {}
    for q, _, v, _ in found[0]:
        got.setdefault(q, []).append(v)
    ids = np.array([r[0] for r in rows])
    at = np.array([r[1] for r in rows])
    for q, mine in got.items():
        d = np.where(ids == q, np.inf, np.sqrt(((at - x[q]) ** 2).sum(1)))
        assert mine == ids[np.lexsort((ids, d))[:10]].tolist()


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.1]), (100, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in o5.nearest(o5.usable(df)).collect())
    assert got == [(0, 1, 100), (0, 2, 100), (0, 3, 1), (100, 1, 0), (100, 2, 1)]
    assert o5.nearest(o5.usable(df.filter("false"))).count() == 0
