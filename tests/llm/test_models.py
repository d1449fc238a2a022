"""Quality and language models: formulas against brute force, held-out results, odd rows."""

import math
import os
import zlib

import numpy as np
import pytest

from kinledger.llm import op1_quality as o1
from kinledger.llm import op6_language as o6

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = o1.FactorisationMachine(0.3, rng.normal(size=o1.WIDTH), rng.normal(size=(o1.WIDTH, 3)))
    idx, val = rng.choice(o1.WIDTH, 9, replace=False), rng.normal(size=9)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(9) for j in range(i))
    assert m.raw(idx, val, np.array([0]))[0][0] == pytest.approx(0.3 + m.w[idx] @ val + pairs)


@pytest.mark.parametrize("text", [None, "", " ", "a", "x " * 50_000, "!!!", "\n\n", "ÀÉ"])
def test_features_of_odd_texts(text):
    idx, val = o1.features(text, None)
    assert len(idx) == len(val) and idx.max() < o1.WIDTH and np.isfinite(val).all()
    assert len(set(idx.tolist())) == len(idx)


def corpus(spark, n=400):
    rows = []
    for k in range(n):
        good = k % 3 > 0
        words = [f"w{(k * 7 + j * j) % 97}" for j in range(40)]
        rows.append((k, " ".join(words) + "." if good else " ".join([words[0]] * 40), "en", "s", None if k % 50 == 0 else 200, "clash"))
    return spark.createDataFrame([*rows, (n, None, None, None, None, None), (None, "null id", "en", "s", 1, "")], DOCS), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(n)] + [(n, None)], "doc_id long, quality int")


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_quality(spark):
    docs, labels = corpus(spark)
    model = o1.fit(docs, labels)
    got = o1.scored(docs, model).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 400 and held(r.doc_id))
    again = o1.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.v, again.v)


def test_quality_without_labels(spark):
    docs, labels = corpus(spark, 6)
    model = o1.fit(docs, labels.filter("false"))
    assert {r.score for r in o1.scored(docs, model).collect()} == {0.5}
    assert o1.scored(docs.filter("false"), model).count() == 0
    good = o1.fit(docs, labels.filter("quality = 1"))
    assert all(r.score > 0.5 for r in o1.scored(docs, good).collect())


def test_term_counts_by_hand():
    c = o6.term_counts("Ab")  # blank, a, b, blank: three pairs, two threes, one four
    assert c.sum() == 6 and o6.term_counts("").sum() == 1


def plain_terms(text):
    """n-grams of 2 to 4 bytes, ASCII but letters as blanks, by bucket: a dictionary of counts."""
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode())
    out = {}
    for n in (2, 3, 4):
        for k in range(len(raw) - n + 1):
            code = 0
            for b in raw[k : k + n]:
                code = (code * 257 + b) % 2**32
            mixed = ((code ^ code >> 15) * 2654435761 + n * 40503) % 2**32
            out[mixed >> 20] = out.get(mixed >> 20, 0) + 1
    return out


def test_nearest_centroid_against_a_plain_one(spark):
    """With a centroid for each training text, the nearest text by cosine of TF-IDF names the language."""
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"{'abc'[k % 3]}{'xyzuvw'[int(j)]}o" for j in rng.integers(0, 6, 9)), "abc"[k % 3], None, 1, "") for k in range(24)]
    docs = spark.createDataFrame(rows + [(None, "axo axo bzo", "b", None, 1, "")], DOCS)
    got = {r.doc_id: r for r in o6.identified(docs, o6.fit(docs, clusters=100)).collect()}
    train = [(r.lang, plain_terms(r.text)) for r in docs.collect() if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5]
    df = {}
    for _, terms in train:
        for t in terms:
            df[t] = df.get(t, 0) + 1

    def unit(terms):
        x = {t: math.log(1 + c) * (math.log((1 + len(train)) / (1 + df.get(t, 0))) + 1) for t, c in terms.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / size for t, v in x.items()}

    known = [(lang, unit(terms)) for lang, terms in train]
    for r in docs.collect():
        x = unit(plain_terms(r.text))
        near = [(sum(v * y.get(t, 0.0) for t, v in x.items()), lang) for lang, y in known]
        best = max(s for s, _ in near)
        assert got[r.doc_id].score == pytest.approx(min(1.0, best), abs=1e-5)
        assert got[r.doc_id].lang_pred in {lang for s, lang in near if s > best - 1e-5}


def test_equal_texts_get_equal_scores_and_long_ones_are_read_whole():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(j)}" for j in rng.integers(0, 50, 20)) for _ in range(700)]
    idf = np.ones(o6.BUCKETS)
    model = o6.NearestCentroid.of(idf, [("a", o6.vectors(np.stack([o6.term_counts(t) for t in texts[:5]]), idf), 0.1), ("b", o6.vectors(o6.term_counts("zz yy")[None], idf), 0.1)])
    many = model.predict([texts[9]] * 700 + texts + [texts[9]])[1]
    assert len(set(many[:700].tolist()) | {many[709], many[-1], model.predict([texts[9]])[1][0]}) == 1
    assert model.predict(["zz yy " * 100_000 + texts[0]])[0] == ["b"] and model.predict(["w1 " + "zz yy " * 100_000])[0] == ["b"]


def test_language(spark):
    words = {"en": "the and of with this that house river", "de": "der und nicht schön für haus fluss straße", "fr": "le et pas été pour maison rivière où"}
    rows = []
    for k in range(300):
        lang = sorted(words)[k % 3]
        w = words[lang].split()
        rows.append((k, " ".join(w[(k + j * (k % 5 + 1)) % len(w)] for j in range(12)), lang, "s", 1, "clash"))
    rows += [(900, None, "en", "s", 1, ""), (901, "123 !!", "en", "s", 1, ""), (902, "der fluss und das haus", None, None, None, None), (None, "the river", "en", "", 1, "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in o6.identified(docs, o6.fit(docs)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == sorted(words)[k % 3] and 0 < got[k].score <= 1 for k in range(300))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[900].rejected
    assert got[902].lang_pred == "de" and got[None].lang_pred == "en"
    empty = docs.filter("false")
    assert o6.identified(empty, o6.fit(empty)).count() == 0
    assert {r.lang_pred for r in o6.identified(docs, o6.fit(empty)).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in o1.op1_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in rows]) > 0.97
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in o6.op6_language(spark, d).collect() if r.held_out]) > 0.95
