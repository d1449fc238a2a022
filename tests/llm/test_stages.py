"""Every stage of the pipeline on odd rows: null and repeated ids, equal texts in two sources, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from kinledger.llm import op7_simhash as o7  # noqa: E402
from kinledger.llm import op9_mixing as o9  # noqa: E402
from kinledger.llm.common import join_hot, written  # noqa: E402

CLASHES = ("score", "kl_score", "KL_PREDICTED", "kl_none", "kl_id", "kl_text", "kl_row", "kl_copies", "kl_copy", "fp", "size", "run", "uid", "root", "row", "deal", "length", "cls")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, " + ", ".join(f"{c} int" for c in CLASHES)
STAGES = dict(corpus_pipeline.STAGES)


def words(c, n=60):
    return " ".join(f"{c}{k}" for k in range(n)) + "."


def frame(spark, rows):
    full = [(*r, "en", s, None if r[1] is None else len(r[1]), {"a": 1}, *range(k, k + len(CLASHES))) for k, (*r, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (None, words("a"), "s1"), (None, words("b"), "s1"), (None, words("c"), None), (4, words("d"), "s1"), (4, words("e"), "s2"), (5, words("f"), "s1"), (5, words("f"), "s2"),
    (6, None, "s1"), (7, "", "s2"), (8, words("long", 30_000), "s1"), (9, "one", "s2"),
]


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(k, int(k % 3 > 0)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_and_values_stay(spark, tables, name):
    docs = written(frame(spark, ODD), "docs")
    got = STAGES[name](spark, docs, tables)
    assert got.dtypes == docs.dtypes
    before = {r.score: r for r in docs.collect()}
    for r in got.collect():
        b = before[r.score]
        assert [x for c, x in r.asDict().items() if c not in ("text", "n_chars")] == [x for c, x in b.asDict().items() if c not in ("text", "n_chars")]
        assert name == "secret scans" or r.text == b.text
    assert STAGES[name](spark, written(docs.filter("false"), "none"), tables).count() == 0


def test_near_dedup_keeps_a_row_of_each_component(spark):
    docs = written(frame(spark, ODD + [(5, words("f"), "s1"), (12, words("a") + " x", "s3")]), "docs")
    got = [(r.doc_id, r.text) for r in o7.stage(spark, docs, "").collect()]
    want = {(12, words("a") + " x"), (None, words("b")), (None, words("c")), (4, words("d")), (4, words("e")), (5, words("f")), (6, None), (8, words("long", 30_000)), (9, "one")}
    assert len(got) == len(want) and set(got) == want
    again = [r.score for r in o7.stage(spark, written(docs.repartition(5), "docs"), "").collect()]
    assert sorted(again) == sorted(r.score for r in o7.stage(spark, docs, "").collect())


def test_mixing_copies_stay_in_their_source(spark):
    rows = [(1, words("x", 20), "s1"), (1, words("x", 20), "s2")] + [(None, words("y", 5), "s2")] * 3 + [(k, words(f"d{k}", 3 + k % 40), f"s{k % 3 + 1}") for k in range(10, 400)]
    docs = written(frame(spark, rows), "docs")
    plan = {(r.doc_id, r.t, r.r): 0 for r in o9.mixed(docs).collect()}
    for r in o9.mixed(docs).collect():
        plan[r.doc_id, r.t, r.r] += r.copies
    got = {}
    for r in o9.stage(spark, docs, "").collect():
        got[r.score] = got.get(r.score, 0) + 1
    assert sum(got.values()) == sum(plan.values()) and max(got.values()) <= 2
    size = {s: sum(len(t.split()) for _, t, at in rows if at == s) for s in ("s1", "s2", "s3")}
    goal = dict(zip(sorted(size), o9.targets(sorted(size.items()))))
    taken = dict.fromkeys(size, 0)
    for k, n in got.items():
        taken[rows[k][2]] += n * len(rows[k][1].split())
    assert all(abs(taken[s] - goal[s]) <= 50 for s in size)


def test_mixing_deals_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(o9, "RUN", 40)
    rows = [(1, "w w w", "s1")] * 500 + [(k, "w " * (k % 30 + 1), "s2") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    layouts = [written(docs.repartition(n), "docs") for n in (2, 5)]
    got = [sorted((r.doc_id, r.t, r.taken) for r in o9.mixed(d).collect()) for d in layouts]
    assert got[0] == got[1] and len(got[0]) == 800
    nth = [r.nth for r in o9._nth_equal(layouts[1].select("doc_id", F.lit(0).alias("t"), F.lit(0).alias("r"), F.monotonically_increasing_id().alias("uid")), 40).collect() if r.doc_id == 1]
    assert sorted(nth)[-500:] == list(range(len(nth) - 500, len(nth)))


def test_join_of_a_hot_key(spark):
    rows = written(spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id"), "rows")
    named = spark.createDataFrame([(k, f"n{k}") for k in range(6)], "k long, name string")
    for how, n in (("inner", rows.filter("k < 6").count()), ("left", 1000)):
        got = join_hot(rows, named, "k", how, most=20)
        assert got.count() == n == got.select("id").distinct().count()
        assert got.filter("name is null").count() == (0 if how == "inner" else rows.filter("k = 6").count())
        assert got.filter("name <> concat('n', k)").count() == 0


def test_packing_stage(spark, tables):
    docs = written(frame(spark, ODD * 2), "docs")
    got = STAGES["packing"](spark, docs, tables).collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert len(ids) == 2 * len(ODD)
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert STAGES["packing"](spark, written(docs.filter("false"), "none"), tables).count() == 0
