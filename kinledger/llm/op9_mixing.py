"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document gets a rate between 0 and MOST, as near to one copy as the token
constraints allow: rates minimise the (bounded) relative entropy to 1 under
``sum of rate x size = target`` in each source. The minimum is an exponential tilt,
MOST / (1 + exp(-tilt x size / mean size)), and each source's tilt is found by Newton
iterations on the convex dual. An iteration is one aggregation over the counts of
(source, size), of which a row per source reaches the driver; a bracket keeps each step safe.

Rates become copies by systematic rounding along a fixed order of each source, whose
running sums are taken in two levels, so that no task sees a whole source. What
rounding leaves over is taken from or given to one document of the source in part.

All sums are of whole numbers, so reruns agree to the last digit. Defined results:
null text has size 0 and nothing taken; null is the last source; a source without words
has target 0; repeated rows are rows of their own, and those of one id and text in different sources
count for their own source each; no rows give no rows; further columns only order equal ids and texts. The stage
keeps all columns, whatever their names. One row per source is held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinledger.llm.common import few, free_names, inline, n_words, row_key, table, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Unit of rates and of the iterations' sums, documents whose running sums are taken in one go, steps at most.
UNIT, RUN, STEPS = 1 << 30, 4000, 60


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's words, for sources in their order: a share of all words by weight, at most ``most`` times its own."""
    goal, weight = share * sum(n for _, n in sizes), [weights[k % len(weights)] for k in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = goal - sum(most * sizes[k][1] for k in full)
        open_weight = sum(w for k, w in enumerate(weight) if k not in full)
        out = [float(most * n) if k in full else left * weight[k] / open_weight for k, (_, n) in enumerate(sizes)]
        over = {k for k, (_, n) in enumerate(sizes) if k not in full and out[k] > most * n}
        if not over:
            return out
        full |= over


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.lit(float(MOST)) / (F.lit(1.0) + F.exp(-tilt * size / mean))


def _whole(x: Column) -> Column:
    return F.sum(F.round(x * F.lit(65536.0)).cast("decimal(38,0)"))


def solve(spark: SparkSession, counts: DataFrame, sources: list[dict]) -> dict[int, float | None]:
    """The tilt of each source; None: its target is all there is, MOST copies of each document."""
    tilt: dict[int, float | None] = {}
    low, high, live = {}, {}, []
    for s in sources:
        if s["target"] >= MOST * s["size"] * (1 - 1e-9):
            tilt[s["sid"]] = None
        else:
            tilt[s["sid"]], low[s["sid"]], high[s["sid"]] = 0.0, -1e9, 1e9
            live.append(s)
    for _ in range(STEPS):
        if not live:
            break
        # one row per source that isn't settled
        state = inline(spark, [{"sid": s["sid"], "mean": s["mean"], "tilt": tilt[s["sid"]]} for s in live], "sid:int,mean:double,tilt:double")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        x = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size")
        got = counts.join(few(state, len(live)), "sid").groupBy("sid").agg(_whole(words * rate).alias("taken"), _whole(words * x * rate * (1 - rate / MOST)).alias("slope"))
        sums = {r.sid: (float(r.taken) / 65536, float(r.slope) / 65536) for r in got.collect()}
        still = []
        for s in live:
            k = s["sid"]
            taken, slope = sums[k]
            away = taken - s["target"]
            if abs(away) <= max(0.25, 1e-7 * s["target"]):
                continue
            if away > 0:
                high[k] = min(high[k], tilt[k])
            else:
                low[k] = max(low[k], tilt[k])
            step = tilt[k] - away / slope if slope > 0 else None
            if step is None or not low[k] < step < high[k]:
                bound = (low[k], high[k])
                step = sum(bound) / 2 if abs(bound[0]) < 1e9 and abs(bound[1]) < 1e9 else tilt[k] + (1.0 if away < 0 else -1.0) * max(1.0, abs(tilt[k]))
            if step != tilt[k]:
                tilt[k] = step
                still.append(s)
        live = still
    return tilt


def _nth_equal(rows: DataFrame, most: int = RUN) -> DataFrame:
    """Adds nth: 0, but the place among equal rows where they are more than ``most``.

    Places are counted by input partition, so that no task sees all rows of such a group.
    """
    keyed = rows.withColumns({"same": F.xxhash64("doc_id", "t", "r"), "at": F.shiftright("uid", 33)})
    hot = written(keyed.groupBy("same").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("same"), "hot")
    if hot.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    # fewer than rows / most keys
    hot = F.broadcast(hot)
    many = keyed.join(hot, "same")
    counts = many.groupBy("same", "at").agg(F.count("*").alias("n"))
    before = counts.select("same", "at", (F.sum("n").over(Window.partitionBy("same").orderBy("at")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("same", "at").orderBy("uid")) - 1
    many = many.withColumn("inside", inside).join(before, ["same", "at"]).select(*rows.columns, (F.col("before") + F.col("inside")).cast("long").alias("nth"))
    return keyed.join(hot, "same", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("nth")).union(many)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), r (hash of the row), sid, size, source_size, target, copies and taken of every row."""
    spark = docs.sparkSession
    has = "source" in docs.columns
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.col("source").cast("string") if has else F.lit(None).cast("string")).alias("source"),
            n_words(F.col("text")).alias("size"),
            F.xxhash64("text").alias("t"),
            row_key(docs).alias("r"),
        ).withColumn("uid", F.monotonically_increasing_id()),
        "rows",
    )
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([(r.source, r.size) for r in found])
    sources = [{"sid": k, "source": r.source, "size": r.size, "target": t, "mean": max(1.0, r.size / max(1, r.n))} for k, (r, t) in enumerate(zip(found, goal))]
    total = sum(r.n for r in found)
    names = inline(spark, sources, "sid:int,source:string,size:long,target:double,mean:double").withColumnRenamed("size", "source_size")
    known = rows.join(few(names, len(sources)), rows["source"].eqNullSafe(names["source"])).drop("source")
    counts = written(known.filter("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n")), "counts")
    tilt = solve(spark, counts, sources)
    rates = inline(spark, [{"sid": k, "tilt": v} for k, v in tilt.items()], "sid:int,tilt:double")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(MOST))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean")))
    rated = known.join(few(rates, len(sources)), "sid").withColumn("rate", F.round(rate * UNIT).cast("long"))
    rated = _nth_equal(rated).withColumn("run", F.pmod(F.xxhash64("doc_id", "t", "r", F.expr(f"nth div {RUN}")), F.lit(max(1, -(-total // RUN)))).cast("int"))
    per_run = rated.groupBy("sid", "run").agg(F.sum("rate").alias("n"))
    starts = per_run.select("sid", "run", (F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("sid", "run").orderBy(F.desc("size"), "doc_id", "t", "r", "uid")
    sums = rated.withColumn("upto", F.sum("rate").over(inside)).join(starts, ["sid", "run"])
    copies = F.expr(f"(before + upto + {UNIT // 2}) div {UNIT}") - F.expr(f"(before + upto - rate + {UNIT // 2}) div {UNIT}")
    planned = written(sums.withColumn("copies", copies).select("uid", "doc_id", "t", "r", "sid", "size", "source_size", "target", "copies"), "planned")
    # what is left over: one document a source takes more, or less, in part
    left = planned.groupBy("sid").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    room = F.when(F.col("left") > 0, (MOST - F.col("copies")) * F.col("size")).otherwise(F.col("copies") * F.col("size"))
    offered = planned.join(few(left.filter("left <> 0"), len(sources)), "sid").withColumn("room", room).filter("room > 0")
    fits = F.col("room") >= F.abs("left")
    pick = offered.groupBy("sid", "left").agg(
        F.min(F.when(fits, F.struct("room", "doc_id", "t", "r", "uid"))).alias("best"), F.max(F.when(~fits, F.struct("room", "doc_id", "t", "r", "uid"))).alias("most")
    )
    chosen = pick.select(
        F.coalesce("best.uid", "most.uid").alias("uid"),
        (F.signum("left") * F.least(F.abs("left"), F.coalesce("best.room", "most.room"))).cast("long").alias("part"),
    )
    return planned.join(few(chosen, len(sources)), "uid", "left").select(
        "doc_id", "t", "r", "sid", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + F.coalesce("part", F.lit(0))).alias("taken")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix has whole copies of it, in its own source."""
    names = free_names(docs, "kl_id", "kl_none", "kl_text", "kl_row")
    copies, copy = free_names(docs, "kl_copies", "kl_copy")
    key = lambda doc_id, t, r: dict(zip(names, (F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), t, r)))
    plan = mixed(docs).withColumns(key(F.col("doc_id"), F.col("t"), F.col("r"))).groupBy(*names).agg(F.sum("copies").alias(copies)).filter(F.col(copies) > 0)
    # one shuffle of the texts, by these keys, serves the choice among equal rows and the join
    own = docs.withColumns(key(F.col("doc_id").cast("long"), F.xxhash64("text"), row_key(docs))).dropDuplicates(names)
    both = own.join(plan, names)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[f"`{c}`" for c in docs.columns])


QUERIES = {"op9_mixing": op9_mixing}
ORACLE: dict[str, str] = {}
