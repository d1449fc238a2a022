"""Approximate nearest neighbours: inverted lists of product-quantised residuals.

Fitted on at most SAMPLE vectors, in the order of a hash of their ids: coarse
centroids, and a codebook for each of PARTS slices of what is left of a vector without
its centroid. Every vector is indexed: its list, its codes, and the vector itself.

A query probes the lists of its nearest centroids, as many as hold REACH of the true
nearest within the fit's sample, measured there by brute force. A list's candidates and the queries that probe
it are each dealt to blocks of bounded size, and each block of queries searches each block of candidates, so a list
that holds a third of all rows, or that all queries probe, is many tasks' work of bounded memory. What is shuffled
is the searched pairs over a block's size; a query's row is stored once for each list it probes. In each
block a table of squared distances from the query's residual to every codeword gives all approximate
distances by look-ups; the DEEP nearest of the block (ties to smaller vec_id) are
ranked anew by exact distances on the original vectors, in double precision, and so is every
other vector that its approximate distance less its own quantisation error does not
put beyond the k-th of them. So a probed list's k nearest are exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of other than the most frequent length (of two,
the longer one); rows with the query's own vec_id are never its candidates; of a
repeated query id the vector first in byte order asks; repeated candidate rows are
candidates each; further columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinledger.llm.common import table, written

#: Vectors of the fit, slices of a vector, codewords of a slice.
SAMPLE, PARTS, WORDS = 12_000, 16, 256
#: Lists at most, and vectors that a list should have.
LISTS, PER_LIST = 1024, 600
#: Share of near vectors whose lists are to be probed, candidates that a block ranks exactly, candidates and queries of a block.
REACH, DEEP, BLOCK, ASKS = 0.97, 96, 4096, 8192
EVERY, NEAREST = 100, 10


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centroids; the same for the same rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            total = np.bincount(own, x[:, j], len(c))
            c[:, j] = np.where(n > 0, total / np.maximum(n, 1), c[:, j])
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[at : at + 4096], c).argmin(1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and the codebooks of residuals."""

    def __init__(self, x: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS):
        self.dim = x.shape[1]
        self.parts = min(parts, self.dim)
        self.cuts = np.linspace(0, self.dim, self.parts + 1).astype(int)
        x = x.astype(np.float32)
        self.coarse = _k_means(x, lists, 10, 11)
        rest = x - self.coarse[_nearest(x, self.coarse)]
        self.books = [_k_means(rest[:, a:b], words, 8, 12 + k) for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def probes(self, x: np.ndarray, k: int, reach: float, asked: int = 300) -> int:
        """Nearest lists that hold ``reach`` of the k nearest of the first ``asked`` rows of x among x."""
        own, y = _nearest(x, self.coarse), x[:asked]
        away = _squared(y, x)
        away[np.arange(len(y)), np.arange(len(y))] = np.inf
        near = np.argsort(away, 1)[:, : min(k, len(x) - 1)]
        place = np.argsort(np.argsort(_squared(y, self.coarse), 1, kind="stable"), 1)
        ranks = np.take_along_axis(place, own[near], 1)
        return int(np.quantile(ranks, reach, method="higher")) + 1 if ranks.size else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and distance from what the codes stand for, of each row."""
        x = x.astype(np.float32)
        own = _nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([_nearest(rest[:, a:b], c) for c, a, b in zip(self.books, self.cuts, self.cuts[1:])], 1).astype(np.uint8)
        stands = np.concatenate([c[codes[:, k]] for k, c in enumerate(self.books)], 1)
        return own, codes, np.sqrt(((rest - stands).astype(np.float64) ** 2).sum(1))

    def tables(self, queries: np.ndarray, own: int) -> np.ndarray:
        """Squared distances of each query's residual to each codeword: queries x parts x words."""
        rest = queries.astype(np.float32) - self.coarse[own]
        out = np.zeros((len(queries), self.parts, max(map(len, self.books))), np.float32)
        for k, (c, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out[:, k, : len(c)] = _squared(rest[:, a:b], c)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles as they are, floats otherwise) of the rows that take part."""
    ok = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(ok)
    usual = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.filter(F.size("embedding") == (usual.dim if usual else 0))


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind).reshape(len(column), -1)


def index(rows: DataFrame, q: Quantiser) -> DataFrame:
    """list, vec_id, codes, error (of the codes) and vector (its components' bytes) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(q)
    kind = _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), kind)
            own, codes, error = shared.value.encode(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([v.tobytes() for v in x], pa.binary())],
                ["list", "vec_id", "codes", "error", "vector"],
            )

    return rows.mapInArrow(run, "list int, vec_id long, codes binary, error double, vector binary")


def _kind(rows: DataFrame) -> np.dtype:
    return np.dtype("<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8")


def nearest(rows: DataFrame, every: int = EVERY, k: int = NEAREST, reach: float = REACH, deep: int = DEEP, block: int = BLOCK, asks: int = ASKS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query, from ``usable`` rows."""
    spark, kind = rows.sparkSession, _kind(rows)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(SAMPLE).collect()
    if not drawn:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    n = rows.count()
    lists = int(min(LISTS, max(1, n // PER_LIST)))
    sample = np.array([r.embedding for r in drawn], np.float32)
    q = Quantiser(sample, lists)
    n_probes = q.probes(sample, k, reach)
    shared = spark.sparkContext.broadcast(q)
    stored = written(index(rows, q), "index")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector").to_pylist()
            x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)
            for at in range(0, len(ids), 1024):
                near = np.argsort(_squared(x[at : at + 1024].astype(np.float32), shared.value.coarse), 1, kind="stable")[:, :n_probes]
                row, own = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.array(ids[at : at + 1024][row]), pa.array([raw[at + r] for r in row.tolist()], pa.binary())],
                    ["list", "query_id", "asked"],
                )

    def search(key: tuple, candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asking):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids = candidates["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(candidates["codes"]), np.uint8).reshape(len(ids), -1)
            x = np.frombuffer(b"".join(candidates["vector"]), kind).reshape(len(ids), -1).astype(np.float64)
            error, size = candidates["error"].to_numpy(), (x**2).sum(1)
            who = asking["query_id"].to_numpy()
            y = np.frombuffer(b"".join(asking["asked"]), kind).reshape(len(who), -1).astype(np.float64)
            for at in range(0, len(who), 128):
                tables = shared.value.tables(y[at : at + 128], key[0])
                rough = np.zeros((len(tables), len(ids)), np.float32)
                for part in range(codes.shape[1]):
                    rough += tables[:, part][:, codes[:, part]]
                for j, mine in enumerate(rough):
                    own = who[at + j]
                    top = np.argsort(mine, kind="stable")[: deep + 1]
                    if (ids[top] == own).any():  # the query's own rows leave their places to others
                        top = np.argsort(np.where(ids == own, np.inf, mine), kind="stable")[:deep]
                        top = top[ids[top] != own]
                    exact = np.sqrt(((x[top] - y[at + j]) ** 2).sum(1))
                    # the rest that may be as near as the k-th; the slack is for sums in single precision
                    bound = np.partition(exact, k - 1)[k - 1] if len(exact) >= k else np.inf
                    slack = 1e-4 * (size + (y[at + j] ** 2).sum())
                    may = (np.sqrt(np.maximum(mine - slack, 0)) - error <= bound) & (ids != own)
                    may[top] = False
                    more = np.flatnonzero(may)
                    top, exact = np.concatenate([top, more]), np.concatenate([exact, np.sqrt(((x[more] - y[at + j]) ** 2).sum(1))])
                    best = np.lexsort((ids[top], exact))[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[top][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    asked = stored.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    probing = written(asked.mapInArrow(route, "list int, query_id long, asked binary"), "probing")
    # a row per list
    count = lambda df, name, size: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = F.broadcast(written(count(stored, "blocks", block).join(count(probing, "parts", asks), "list"), "parts"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda key, c: F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.col(c)).cast("int")
    candidates = stored.join(parts, "list").withColumn("block", deal("vec_id", "blocks")).withColumn("part", each("parts"))
    asking = probing.join(parts, "list").withColumn("part", deal("query_id", "parts")).withColumn("block", each("blocks"))
    place = ("list", "block", "part")
    sides = candidates.select(*place, "vec_id", "codes", "error", "vector").groupBy(*place), asking.select(*place, "query_id", "asked").groupBy(*place)
    found = sides[0].cogroup(sides[1]).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")))


QUERIES = {"op5_ivfpq": op5_ivfpq}
ORACLE: dict[str, str] = {}
