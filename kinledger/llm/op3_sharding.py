"""K-d tree sharding by bytes, with DataFrame operations only.

A node of the tree holds some shards' worth of documents. It is cut along that
metadata dimension (source, lang, size, doc_id) which is widest in it, against the
dimension's width in the whole table, at the weighted median: the point below which
lies the share of bytes that the shards on the near side should get. All nodes of a
level are cut together. A median is found by histograms: each round sums bytes by
(node, bucket), at most nodes x BUCKETS rows reach the driver, and the bucket that
holds the median is the next round's range; a range of at most FEW rows is finished from
its rows. Ties of a dimension are ordered by a hash of the text, so a median exists within a single source too.

Equal texts have equal coordinates (their least source, lang and doc_id), so they share
a shard, unless a group of them alone is over 1 / WHOLE of a shard's bytes: its rows are then
placed one by one. There are at most shards x WHOLE such groups. Where a unit (a group, or a
document) of over 1 / COARSE of a shard lies on a median, it is put to its nearer side by name and the
median is sought anew among the rest, up to APART times a node, so that shards stay near equal.

Defined results: null text has size 1 and crc32 0; null source, lang or doc_id sort
first; repeated rows are placed like equal texts; fewer rows than shards leave
shards empty; no rows give no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinledger.llm.common import join_hot, table, written

SHARDS, WHOLE = 16, 1
#: Buckets of a round's histogram; a median is settled when its bucket is under 1 / FINE of a shard; rows that finish a node on the driver.
BUCKETS, FINE, FEW = 1024, 1000, 16_384
#: Units over 1 / COARSE of a shard don't lie on a cut, of which a node names APART at most.
COARSE, APART = 100, 12
#: Rows that are numbered in one go.
RUN = 2000

DIMENSIONS = ("d_source", "d_lang", "d_size", "d_id")
_TOP = (1 << 63) - 1


@dataclass
class _Node:
    """Shards first .. first + want - 1; dim to hash are the cut: below it (inclusive) is the near side.

    apart: units (by hash) that are on the near side (True) or the far one whatever the cut is.
    """

    name: int
    first: int
    want: int
    dim: str = ""
    value: int = 0
    hash: int = _TOP
    apart: dict[int, bool] = field(default_factory=dict)
    # the search: bytes before the range, and the range of values, or of hashes within one value, and its rows
    goal: float = 0.0
    before: int = 0
    low: int = 0
    high: int = 0
    rows: int = 0
    in_hash: bool = False
    done: bool = False
    kids: list = field(default_factory=list)

    def seek(self, low: int, high: int, rows: int) -> None:
        """Begins a search over values from low to high."""
        self.before, self.low, self.high, self.rows, self.in_hash = 0, low, high, rows, False
        if low == high:
            self.value, self.in_hash, self.low, self.high = low, True, 0, _TOP

    def near(self) -> Column:
        """Whether a row of the node is on the near side."""
        by_cut = (F.col(self.dim) < self.value) | ((F.col(self.dim) == self.value) & (F.col("h") <= self.hash))
        for side in (True, False):
            if named := [h for h, near in self.apart.items() if near == side]:
                by_cut = F.when(F.col("h").isin(named), F.lit(side)).otherwise(by_cut)
        return by_cut


def _beyond(low: str | None, high: str | None) -> int:
    """Bytes that all strings between two have in common at their begin."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _prefix(text: Column, skip: int) -> Column:
    """Order-preserving number of seven bytes of a string after ``skip`` ones; null is below all."""
    raw = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), skip + 1, 7)), 14, "0")
    return F.when(text.isNotNull(), F.conv(raw, 16, 10).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def _rows(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    ends = docs.agg(*[f(c).alias(f"{name}{k}") for name, c in have.items() for k, f in enumerate((F.min, F.max))]).first()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw, F.octet_length(raw)).alias("key"),
        *[_prefix(c, _beyond(ends[f"{name}0"], ends[f"{name}1"])).alias(f"d_{name}") for name, c in have.items()],
    ).withColumns({"d_id": F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)).cast("long")), "uid": F.monotonically_increasing_id()})


def _coordinates(rows: DataFrame, most: float) -> DataFrame:
    """Rows with the coordinates of their group of equal texts; groups over ``most`` bytes go row by row."""
    least = ("d_source", "d_lang", "d_id")
    groups = rows.groupBy("key").agg(F.sum("size").alias("n"), *[F.min(c).alias(f"g_{c}") for c in least])
    both, one_by_one = join_hot(rows, groups, "key"), F.col("n") > most
    unit = F.when(one_by_one, F.xxhash64("key", "doc_id", "uid")).otherwise(F.col("key"))
    return both.select(
        "doc_id", "size", "text_crc32", "uid",
        F.shiftrightunsigned(unit, 1).alias("h"),
        F.col("size").alias("d_size"),
        *[F.when(one_by_one, F.col(c)).otherwise(F.col(f"g_{c}")).alias(c) for c in least],
    )


def _leaf(node: _Node, of) -> Column:
    """``of`` the tree's present leaf that a row is in."""
    return F.when(node.near(), _leaf(node.kids[0], of)).otherwise(_leaf(node.kids[1], of)) if node.kids else F.lit(of(node))


def _narrow(node: _Node, hist: list, fine: float) -> None:
    """One step of a node's search by its histogram: (bucket, bytes, rows, least, largest)."""
    at = node.before
    for _, n, rows, least, largest in sorted(hist):
        if at + n < node.goal:
            at += n
            continue
        node.before, node.rows = at, rows
        if n <= fine:
            edge = largest if node.goal - at > n / 2 else least - 1  # the side that comes nearer to the goal
            node.value, node.hash, node.done = (node.value, edge, True) if node.in_hash else (edge, _TOP, True)
        elif least == largest and node.in_hash:
            node.low, node.high, node.rows = least, least, 0  # one unit: its sum alone is left to be looked at
        elif least == largest:
            node.value, node.in_hash, node.low, node.high = least, True, 0, _TOP
        else:
            node.low, node.high = least, largest
        return
    node.value, node.hash, node.done = (node.value, node.high, True) if node.in_hash else (node.high, _TOP, True)


def _finish(node: _Node, units: list[tuple[int, int, int]], coarse: float) -> bool:
    """The cut from the range's units (value, hash, bytes); False if a coarse one was put apart and the search is to begin anew."""
    at = node.before
    node.done = True
    for value, h, n in sorted(units):
        if at + n < node.goal:
            at += n
            continue
        near = node.goal - at > n / 2
        if n > coarse and len(node.apart) < APART:
            node.apart[h] = near
            node.goal -= n if near else 0
            node.done = False
            return False
        node.value, node.hash = value, h if near else h - 1
        return True
    # what was seen, and the range, are all on the near side
    node.value, node.hash = (node.value, node.high) if node.in_hash else (node.high, _TOP)
    return True


def _cut(coords: DataFrame, root: _Node, nodes: list[_Node], widths: dict[str, int], share: float) -> None:
    """Finds the cuts of all ``nodes``, which are leaves of the tree so far."""
    here = coords.withColumn("node", _leaf(root, lambda x: x.name))
    spans = [F.min(d).alias(f"lo_{d}") for d in DIMENSIONS] + [F.max(d).alias(f"hi_{d}") for d in DIMENSIONS]
    facts = {r.node: r for r in here.groupBy("node").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), *spans).collect()}

    def begin(x: _Node) -> None:
        r = facts[x.name]
        x.seek(r[f"lo_{x.dim}"], r[f"hi_{x.dim}"], r.rows)

    for x in nodes:
        r = facts.get(x.name)
        if r is None:
            x.dim, x.done = DIMENSIONS[0], True
            continue
        x.dim = max(DIMENSIONS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, widths[d]), -DIMENSIONS.index(d)))
        x.goal = r.n * (x.want // 2) / x.want
        begin(x)

    def ranges(live: list[_Node]) -> DataFrame:
        """Rows in the ranges of live nodes: node, value, h, size, and what the range is of (v), its begin and a bucket's width."""
        value, dim, low, step = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
        for x in live:
            mine = F.col("node") == x.name
            v = F.when(F.col(x.dim) == x.value, F.col("h")) if x.in_hash else F.col(x.dim)
            held = mine & v.between(x.low, x.high)
            value = F.when(held & ~F.col("h").isin(list(x.apart)) if x.apart else held, v).otherwise(value)
            dim = F.when(mine, F.col(x.dim)).otherwise(dim)
            low = F.when(mine, F.lit(x.low).cast("long")).otherwise(low)
            step = F.when(mine, F.lit((x.high - x.low) // BUCKETS + 1).cast("long")).otherwise(step)
        return here.select("node", "size", "h", dim.alias("value"), value.alias("v"), low.alias("low"), step.alias("step")).filter("v IS NOT NULL")

    while left := [x for x in nodes if not x.done]:
        wide = [x for x in left if x.rows > FEW]
        if wide:
            sums = ranges(wide).groupBy("node", F.expr("(v - low) div step").alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("v").alias("a"), F.max("v").alias("b"))
            hists: dict[int, list] = {}
            for r in sums.collect():
                hists.setdefault(r.node, []).append((r.bucket, r.n, r.rows, r.a, r.b))
            for x in wide:
                _narrow(x, hists.get(x.name, []), share / FINE)
        else:
            # at most FEW rows a node
            units: dict[int, list] = {}
            for r in ranges(left).groupBy("node", "value", "h").agg(F.sum("size").alias("n")).collect():
                units.setdefault(r.node, []).append((r.value, r.h, r.n))
            for x in left:
                found, whole = units.get(x.name, []), facts[x.name].rows <= FEW
                while not _finish(x, found, share / COARSE):
                    begin(x)
                    if not whole:  # the range's rows don't tell where the median is now
                        break
                    found = [u for u in found if u[1] not in x.apart]


def tree_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, by near equal bytes."""
    rows = written(_rows(docs), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / shards
    coords = written(_coordinates(rows, share / WHOLE), "coordinates")
    widths = coords.agg(*[F.coalesce(F.max(d) - F.min(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first().asDict()
    root = _Node(0, 0, shards)
    level, made = [root], 1
    while level := [x for x in level if x.want > 1]:
        _cut(coords, root, level, widths, share)
        after = []
        for x in level:
            near = x.want // 2
            x.kids = [_Node(made, x.first, near), _Node(made + 1, x.first + near, x.want - near)]
            made += 2
            after += x.kids
        level = after
    runs = max(1, -(-n // (shards * RUN)))
    placed = coords.select("doc_id", "size", "text_crc32", "h", "uid", _leaf(root, lambda x: x.first).cast("int").alias("shard")).withColumn(
        "run", F.pmod(F.xxhash64("doc_id", "h", "uid"), F.lit(runs)).cast("int")
    )
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "run", (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "h", "uid")
    numbered = placed.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tree_shards(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_kd_shards": op3_kd_shards}
ORACLE: dict[str, str] = {}
