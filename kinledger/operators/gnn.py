"""Graph neural layers at inference, a pair scorer, and embedding losses.

Weights are given; none are trained here. A layer is one join of edges and states, one
aggregation by receiver (a column per place of the state, so that it is partial before the
shuffle), and one dense step in Arrow batches. Each layer's states are written to the shared
folder, so a plan has the length of one layer and a lost executor costs a layer at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinledger.functions.similarity import distance
from kinledger.sources.scratch import written


@dataclass
class Weights:
    """Encoder, convolution layers and output head; each dense step is (matrix in x out, bias)."""

    encoder: list[tuple[np.ndarray, np.ndarray]]
    layers: list[dict[str, np.ndarray]]
    head: list[tuple[np.ndarray, np.ndarray]]
    norm: tuple[np.ndarray, np.ndarray] | None = None
    kind: str = "sage"
    heads: int = 4

    @classmethod
    def drawn(cls, n_in: int, hidden: int, n_out: int, n_layers: int = 3, kind: str = "sage", heads: int = 4, seed: int = 0) -> Weights:
        """Weights that the seed fixes, for demonstrations and tests."""
        rng = np.random.default_rng(seed)
        dense = lambda a, b: (rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b))
        if kind == "sage":
            layers = [{"own": dense(hidden, hidden)[0], "near": dense(hidden, hidden)[0], "bias": np.zeros(hidden)} for _ in range(n_layers)]
        else:
            wide = heads * hidden  # each head is as wide as a state, and heads are joined
            sizes = [hidden] + [wide] * (n_layers - 1)
            layers = [{"lin": dense(n, wide)[0], "to": rng.normal(0, 1, (heads, hidden)), "from": rng.normal(0, 1, (heads, hidden)), "bias": np.zeros(wide)} for n in sizes]
        last = hidden if kind == "sage" else heads * hidden
        return cls([dense(n_in, hidden), dense(hidden, hidden)], layers, [dense(last, n_out), dense(n_out, n_out)], (np.ones(n_out), np.zeros(n_out)), kind, heads)


def _rows(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 0))


def _mlp(x: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for k, (w, b) in enumerate(steps):
        x = x @ w + b
        if k + 1 < len(steps):
            x = np.maximum(x, 0)
    return x


def _mapped(df: DataFrame, f, columns: tuple[str, ...], out: tuple[str, ...] = ("h",)) -> DataFrame:
    """node_id and the arrays that f makes of the columns' arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                made = f(*[_rows(b[c]) for c in columns])
                yield pd.DataFrame({"node_id": b["node_id"], **{name: list(x) for name, x in zip(out, made if len(out) > 1 else (made,))}})

    return df.select("node_id", *columns).mapInPandas(run, "node_id string, " + ", ".join(f"{c} array<double>" for c in out))


def _by_place(df: DataFrame, by: str, name: str, width: int, how) -> DataFrame:
    """Arrays of ``width`` aggregated place by place."""
    got = df.groupBy(by).agg(*[how(F.get(name, F.lit(k))).alias(f"p{k}") for k in range(width)])
    return got.select(by, F.array(*[f"p{k}" for k in range(width)]).alias(name))


def sage_layer(h: DataFrame, edges: DataFrame, w: dict, active: bool = False) -> DataFrame:
    """h own + mean of the senders' h near + bias (a node without senders: mean 0), cut at 0 if ``active``; ``h`` is a written table."""
    width = w["near"].shape[0]
    sent = edges.join(h.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id"), F.col("h").alias("m"))
    both = h.join(_by_place(sent, "node_id", "m", width, F.avg), "node_id", "left").withColumn("m", F.coalesce("m", F.array_repeat(F.lit(0.0), width)))
    done = lambda x: np.maximum(x, 0) if active else x
    return _mapped(both, lambda x, m: done(x @ w["own"] + m @ w["near"] + w["bias"]), ("h", "m"))


def gat_layer(h: DataFrame, edges: DataFrame, w: dict, heads: int, active: bool = False) -> DataFrame:
    """Attention by head over each receiver's senders and itself; heads are joined.

    A receiver's largest score is taken from its scores before they are raised, so that scores of any size
    have a soft-max.
    """
    wide = len(w["bias"])
    per = wide // heads

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lin = x @ w["lin"]
        by_head = lin.reshape(-1, heads, per)
        return lin, (by_head * w["to"]).sum(2), (by_head * w["from"]).sum(2)

    lin = written(_mapped(h, project, ("h",), ("lin", "to", "from")), "lin")
    own = lin.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    near = edges.select("src", "dst").union(own).distinct()
    pairs = near.join(lin.select(F.col("node_id").alias("src"), "from"), "src").join(lin.select(F.col("node_id").alias("dst"), "to"), "dst")
    leaky = F.transform(F.zip_with("to", "from", lambda a, b: a + b), lambda x: F.when(x > 0, x).otherwise(0.2 * x))
    scores = written(pairs.select("src", "dst", leaky.alias("e")), "scores")
    top = _by_place(scores.select("dst", F.col("e").alias("top")), "dst", "top", heads, F.max)
    shares = scores.join(top, "dst").select("src", F.col("dst").alias("node_id"), F.zip_with("e", "top", lambda x, t: F.exp(x - t)).alias("e"))
    sent = shares.join(lin.select(F.col("node_id").alias("src"), F.col("lin").alias("m")), "src")
    weighed = sent.select("node_id", F.concat("e", F.transform("m", lambda x, i: x * F.get("e", F.floor(i / per).cast("int")))).alias("m"))
    done = lambda x: np.maximum(x, 0) if active else x
    return _mapped(_by_place(weighed, "node_id", "m", heads + wide, F.sum), lambda m: done(m[:, heads:] / np.repeat(m[:, :heads], per, 1) + w["bias"]), ("m",))


def embed(nodes: DataFrame, edges: DataFrame, weights: Weights) -> DataFrame:
    """node_id and h, unit vectors, from nodes (node_id, features) and edges (src, dst)."""
    h = written(_mapped(nodes, lambda x: _mlp(x, weights.encoder), ("features",)), "states")
    edges = written(edges.select("src", "dst"), "edges")
    for k, w in enumerate(weights.layers):
        active = k + 1 < len(weights.layers)
        h = written(sage_layer(h, edges, w, active) if weights.kind == "sage" else gat_layer(h, edges, w, weights.heads, active), "states")

    def finish(x: np.ndarray) -> np.ndarray:
        x = _mlp(x, weights.head)
        if weights.norm:
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * weights.norm[0] + weights.norm[1]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    return _mapped(h, finish, ("h",))


@dataclass
class PairScorer:
    """Probability that two embeddings are one entity."""

    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def drawn(cls, width: int, seed: int = 0) -> PairScorer:
        rng = np.random.default_rng(seed)
        sizes = [2 * width, 256, 128, 64, 1]
        return cls([(rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])

    def score(self, a: Column, b: Column) -> Column:
        steps = self.steps

        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            x = np.concatenate([_rows(a), _rows(b)], 1)
            return pd.Series(1 / (1 + np.exp(-_mlp(x, steps)[:, 0])))

        return run(a, b)

    def predict(self, a: Column, b: Column, threshold: float = 0.5) -> Column:
        return self.score(a, b) > threshold


def contrastive_loss(pairs: DataFrame, a: str, b: str, same: str, margin: float = 1.0) -> DataFrame:
    d = distance(F.col(a), F.col(b))
    gap = F.greatest(margin - d, F.lit(0.0))
    return pairs.agg(F.avg(F.col(same) * d * d + (1 - F.col(same)) * gap * gap).alias("loss"))


def triplet_loss(rows: DataFrame, anchor: str, positive: str, negative: str, margin: float = 1.0) -> DataFrame:
    away = distance(F.col(anchor), F.col(positive)) - distance(F.col(anchor), F.col(negative)) + margin
    return rows.agg(F.avg(F.greatest(away, F.lit(0.0))).alias("loss"))
