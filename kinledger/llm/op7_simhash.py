"""SimHash near-duplicates by vantage-point trees.

Every whole text gets a 64-bit fingerprint, and fingerprints link at RADIUS or
fewer differing bits. Each distinct fingerprint is looked at once, so copies cost
nothing further.

A vantage-point tree over a bounded sample of fingerprints is the map of shards: a
fingerprint lives in the leaf that its Hamming distances to the vantage points
lead to, and is also a query to each leaf that its ball of RADIUS can reach by the
triangle inequality. Within a shard a second tree is built over all of the shard's
fingerprints, and points and queries go down it together, pruned by the same
bounds, to leaves small enough to compare outright. So no pair within RADIUS is
missed, whatever the sample was: it decides only how even the shards are.

A shard's own fingerprints are dealt to blocks of HOMES at most, and what asks each block (queries from
other shards and the shard's later blocks) to blocks of BLOCK, so what a task holds is bounded even
where the map has reached its largest size. Each returns a spanning forest of its links, never all pairs of a group, and the
components of all forests give each fingerprint's smallest reachable document.

The pipeline's stage links texts whose sets of 5-word shingles have a Jaccard similarity of SIMILAR or
more. Near fingerprints are too few for that (such pairs differ in about 10 of 64 bits), so candidates
come from the trees over 5-word fingerprints and from BANDS bands of ROWS least hashes each, which miss a pair of
just 0.8 with a chance of 3 in a million; every link is then checked on the sets themselves. Members of a
large candidate group are dealt to bounded blocks; those that the group's largest component has
not taken are then compared with every block.

Defined results: null text is like empty text, fingerprint zero; a text of one or
two words has the one shingle of all its words; repeated rows and ids stay; a null
doc_id gets a component but is never its name unless no id is known; no rows give no rows; further
columns are not read by the query. The stage keeps one row of each component whatever its id is, all its columns
included: the least by id (null last), text hash and hash of the whole row, so that reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinledger.llm.common import free_names, join_hot, row_key, table, written
from kinledger.operators.components import components
from kinledger.llm.tokens import blocks

#: Words in a shingle, differing bits of a link, fingerprints that the map of shards is drawn from (a quarter as many shards at most).
SHINGLE, RADIUS, SAMPLE = 3, 3, 16_384
#: Fingerprints that should live in a shard, and at-home and asking ones that a task takes at about the most.
SHARD, HOMES, BLOCK = 25_000, 100_000, 500_000
#: Points and queries that are compared outright.
LEAF = 192
#: The stage's rule: words in a shingle and Jaccard similarity of a link; its bands of ROWS least hashes, and texts that a task compares outright.
COPY_SHINGLE, SIMILAR, BANDS, ROWS, GROUP = 5, 0.8, 24, 4, 256

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in their order, in parts, so that memory is bounded."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for done in range(0, n, 65536):
        yield np.array([digest(flat[starts[k] : stops[k]], 42) for k in range(done, min(n, done + 65536))], "<u8")


def _majority(parts: Iterable[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return _majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                fp = np.array([fingerprint(t.as_py(), shingle) for t in piece.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class ShardMap:
    """A vantage-point tree whose leaves are shards; ``nodes``: (vantage, bound, near child, far child),
    where a child under zero is the leaf ~child."""

    def __init__(self, nodes: list[tuple[int, int, int, int]], leaves: int):
        self.nodes, self.leaves = nodes, leaves

    @classmethod
    def over(cls, sample: np.ndarray, leaves: int) -> ShardMap:
        nodes: list[tuple[int, int, int, int]] = []
        made = 0

        def grow(points: np.ndarray, want: int) -> int:
            nonlocal made
            points = np.unique(points)
            if want > 1 and len(points) > 1:
                # of a few candidates the one whose distances differ most
                tries = [(float(np.var(_far(points, v))), int(v)) for v in points[:: max(1, len(points) // 8)]]
                v = max(tries)[1]
                d = _far(points, np.uint64(v))
                bound = int(np.median(d))
                bound = bound if (d > bound).any() else bound - 1
                here = len(nodes)
                nodes.append((v, bound, 0, 0))
                near = grow(points[d <= bound], want // 2)
                far = grow(points[d > bound], want - want // 2)
                nodes[here] = (v, bound, near, far)
                return here
            made += 1
            return ~(made - 1)

        grow(sample, leaves)
        return cls(nodes, made)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in fps, leaf, whether it lives there) for the home and for each later leaf that the ball reaches.

        A pair in two leaves is met in the later one, so earlier leaves aren't asked.
        """
        out: list[tuple[np.ndarray, int, np.ndarray]] = []

        def down(node: int, rows: np.ndarray, home: np.ndarray) -> None:
            if not len(rows):
                return
            if node < 0:
                out.append((rows, ~node, home))
                return
            v, bound, near, far = self.nodes[node]
            d = _far(fps[rows], np.uint64(v)).astype(np.int64)
            go = d - radius <= bound
            down(near, rows[go], (home & (d <= bound))[go])
            go = d + radius > bound
            down(far, rows[go], (home & (d > bound))[go])

        down(0 if self.nodes else -1, np.arange(len(fps)), np.ones(len(fps), bool))
        rows = np.concatenate([r for r, _, _ in out]) if out else np.zeros(0, np.int64)
        leaf = np.concatenate([np.full(len(r), k) for r, k, _ in out]) if out else rows
        home = np.concatenate([h for _, _, h in out]) if out else np.zeros(0, bool)
        mine = np.zeros(len(fps), np.int64)
        mine[rows[home]] = leaf[home]
        keep = leaf >= mine[rows]
        return rows[keep], leaf[keep], home[keep]


class Forest:
    """Union-find that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def link(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.kept.append((a, b))


def shard_links(fps: np.ndarray, home: np.ndarray, radius: int = RADIUS, among_home: bool = True) -> list[tuple[int, int]]:
    """A spanning forest, as places in fps, of the pairs within radius of which one at least is at home.

    fps are distinct. A point that is at home is a query as well, unless ``among_home`` is false.
    """
    forest = Forest(len(fps))

    def outright(points: np.ndarray, asks: np.ndarray) -> None:
        for at in range(0, len(asks), 512):
            part = asks[at : at + 512]
            q, p = np.nonzero(_far(fps[part][:, None], fps[points][None, :]) <= radius)
            q, p = part[q], points[p]
            new = (q != p) & ((q > p) | ~home[q])
            forest.link(zip(q[new].tolist(), p[new].tolist()))

    def down(points: np.ndarray, asks: np.ndarray, stuck: int) -> None:
        while len(points) and len(asks):
            if len(points) <= LEAF or len(asks) <= 8 or stuck > 3:
                outright(points, asks)
                return
            tries = points[:: max(1, len(points) // 5)]
            v = fps[tries[int(np.argmax([np.var(_far(fps[points[:: max(1, len(points) // 500)]], fps[t])) for t in tries]))]]
            d, e = _far(fps[points], v).astype(np.int64), _far(fps[asks], v).astype(np.int64)
            # what lies within half the radius of one point is linked all to all, by way of that point
            core = points[d <= radius // 2]
            if among_home and len(core) > 1:
                centre = core[int(np.argmin(_far(fps[core], v)))]
                forest.link((int(c), int(centre)) for c in core if c != centre)
            bound = int(np.median(d))
            bound = bound if (d > bound).any() else bound - 1
            low, high = points[d <= bound], points[d > bound]
            near, far = asks[e - radius <= bound], asks[e + radius > bound]
            idle = stuck + 1 if len(near) + len(far) > 1.9 * len(asks) else 0
            down(low, near, idle)
            points, asks, stuck = high, far, idle

    down(np.flatnonzero(home), np.arange(len(fps)) if among_home else np.flatnonzero(~home), 0)
    return forest.kept


def linked(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE, homes: int = HOMES, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) of distinct fingerprints ``prints`` (a written table of fp): a spanning forest of each block."""
    spark = prints.sparkSession
    n = prints.count()
    drawn = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    leaves = min(max(1, -(-n // shard) * 2), sample // 4)
    shared = spark.sparkContext.broadcast(ShardMap.over(np.array([r.fp for r in drawn], np.int64).view(np.uint64), leaves))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp"))
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, leaf, home = shared.value.route(part.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(part[rows]), pa.array(home)], ["leaf", "fp", "home"])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.ascontiguousarray(pdf["fp"].to_numpy(np.int64))
        order = np.argsort(fps, kind="stable")
        fps, home = fps[order], pdf["home"].to_numpy(bool)[order]
        pairs = np.array(shard_links(fps.view(np.uint64), home, radius, key[2] == 0), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": fps[pairs[:, 0]], "v": fps[pairs[:, 1]]})

    routed = written(prints.mapInArrow(route, "leaf int, fp long, home boolean"), "routed")
    # a row per shard, of which there are a bounded number; a shard of several home blocks has its later ones ask the earlier
    n_home, n_ask = F.count(F.when(F.col("home"), 1)), F.count(F.when(~F.col("home"), 1))
    parts = F.ceil(F.greatest(F.col("n_home"), F.lit(1)) / homes).cast("int")
    sizes = routed.groupBy("leaf").agg(n_home.alias("n_home"), n_ask.alias("n_ask")).withColumn("parts", parts)
    asking = F.col("n_ask") + F.when(F.col("parts") > 1, F.col("n_home")).otherwise(F.lit(0))
    sizes = sizes.select("leaf", "parts", F.ceil(F.greatest(asking, F.lit(1)) / block).cast("int").alias("blocks"))
    held = routed.join(F.broadcast(sizes), "leaf").withColumns({"part": F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), "block": F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")})
    up_to = lambda c: F.sequence(F.lit(0), c - 1)
    own = held.filter("home").withColumn("block", F.explode(up_to(F.col("blocks"))))
    later = held.filter("home").withColumn("part", F.explode(F.when(F.col("part") > 0, up_to(F.col("part"))))).withColumn("home", F.lit(False))
    others = held.filter(~F.col("home")).withColumn("part", F.explode(up_to(F.col("parts"))))
    dealt = reduce(DataFrame.union, [df.select("leaf", "part", "block", "fp", "home") for df in (own, later, others)])
    return dealt.groupBy("leaf", "part", "block").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    made = written(fingerprints(docs), "fingerprints")
    classes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(linked(classes.select("fp"), radius))
    owned = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = owned.select("fp", "least", "root").join(owned.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return join_hot(made, named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


_FLIP, _TIMES = _tables()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of the stage's rule, ascending."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingles(text, COPY_SHINGLE)]))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes of a set; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048, None] ^ _FLIP) * _TIMES).min(0))
    keys = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, row_key, node (a hash of the set of shingles), fp and keys (of its bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                nodes, fps, keys = [], [], []
                for text in piece.column("text"):
                    parts = list(shingles(text.as_py(), COPY_SHINGLE))
                    found = np.unique(np.concatenate([np.zeros(0, "<u8"), *parts]))
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                    fps.append(_majority(parts))
                    keys.append(bands(found))
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("doc_id", "text_key", "row_key")), longs(nodes), longs(fps), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    ["doc_id", "text_key", "row_key", "node", "fp", "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), row_key(docs).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, row_key long, node long, fp long, keys array<long>")


def similar_links(sets: list[np.ndarray], member: np.ndarray, asks: np.ndarray, root: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as places in sets, of the links between ``asks`` and ``member`` (places too).

    Places with an equal ``root`` are linked beforehand and not compared.
    """
    forest, first = Forest(len(sets)), {}
    if root is not None:
        forest.link((first.setdefault(r, k), k) for k, r in enumerate(root))
        forest.kept.clear()
    size = np.array([len(s) for s in sets])
    owner = np.repeat(member, size[member])
    values = np.concatenate([np.zeros(0, "<u8"), *(sets[k] for k in member)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for k in asks.tolist():
        low, high = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((shared > 0) & (shared >= SIMILAR * (size + size[k] - shared) - 1e-9))
        forest.link((k, j) for j in near.tolist() if j != k)
    return forest.kept


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) found in each (group, block) of ``rows`` (group, block, node, member, ask, root)."""

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        nodes, found = pdf["node"].to_numpy(np.int64), [np.frombuffer(b, "<u8") for b in pdf["found"]]
        kept = similar_links(found, np.flatnonzero(pdf["member"]), np.flatnonzero(pdf["ask"]), pdf["root"].tolist())
        pairs = np.array(kept, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": nodes[pairs[:, 0]], "v": nodes[pairs[:, 1]]})

    return rows.join(sets, "node").groupBy("group", "block").applyInPandas(search, "u long, v long")


def near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text_key, row_key and root (of its component) of every row of docs, by the stage's rule."""
    made = written(described(docs), "described")
    nodes = written(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("text_key").alias("text_key"), F.first("keys").alias("keys")), "nodes")
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    near = written(linked(prints.select("fp")), "near")
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    edges = near.join(of("u"), "u").join(of("v"), "v").select(F.xxhash64(F.lit("fp"), "u", "v").alias("group"), F.explode(F.array("u_node", "v_node")).alias("node"))
    # equal fingerprints are candidates as well
    same = nodes.select(F.xxhash64(F.lit("fp"), "fp").alias("group"), "node")
    belongs = written(nodes.select(F.explode("keys").alias("group"), "node").union(edges).union(same), "belongs")
    groups = belongs.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("lead"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).filter("n > 1")
    # groups of the same members are one
    groups = written(groups.groupBy("n", "lead", "all").agg(F.min("group").alias("group")).select("group", "lead", F.ceil(F.col("n") / group).cast("int").alias("blocks")), "groups")
    members = written(belongs.join(groups, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    texts = docs.select(_text_key().alias("text_key"), "text").join(wanted, "text_key").dropDuplicates(["node"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                found = [shingle_set(t.as_py()).tobytes() for t in piece.column("text")]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(found, pa.binary())], ["node", "found"])

    sets = written(texts.select("node", "text").mapInArrow(read, "node long, found binary"), "sets")
    # the first of a group stands in each of its blocks
    leads = groups.filter("blocks > 1").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("node"))
    rows = members.select("group", "block", "node").union(leads.select("group", "block", "node")).distinct()
    links = written(_compared(rows.select("*", F.lit(True).alias("member"), F.lit(True).alias("ask"), F.col("node").alias("root")), sets), "links")
    roots = components(links)
    large = members.filter("blocks > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    large = written(large.select("group", "block", "blocks", "node", "root"), "large")
    if large.limit(1).count():
        sizes = large.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
        open_ = large.join(sizes, "group")
        stray = open_.filter("root <> main").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = stray.select("group", F.col("at").alias("block"), "node", (F.col("at") == F.col("block")).alias("member"), F.lit(True).alias("ask"), "root")
        held = open_.filter("root = main").select("group", "block", "node", F.lit(True).alias("member"), F.lit(False).alias("ask"), "root")
        roots = components(links.union(_compared(asks.union(held), sets)))
    rows = made.select("doc_id", "text_key", "row_key", "node")
    return join_hot(rows, roots, "node", "left").select("doc_id", "text_key", "row_key", F.coalesce("root", "node").alias("root"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, the row with its smallest doc_id stays, of equal or no ids that with the least text hash, then row hash."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row_key")).alias("k")
    names = free_names(docs, "kl_none", "kl_id", "kl_text", "kl_row")
    of = lambda doc_id: (doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast("long")))
    k = (*of(F.col("k.doc_id")), F.col("k.text_key"), F.col("k.row_key"))
    keep = near_copies(docs).groupBy("root").agg(least).select(*[c.alias(n) for c, n in zip(k, names)])
    # one shuffle of the texts, by these keys, serves the join and the choice among equal rows
    own = (*of(F.col("doc_id").cast("long")), _text_key(), row_key(docs))
    return docs.withColumns(dict(zip(names, own))).join(keep, names, "left_semi").dropDuplicates(names).select(*[f"`{c}`" for c in docs.columns])


QUERIES = {"op7_simhash": op7_simhash}
ORACLE: dict[str, str] = {}
