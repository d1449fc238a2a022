"""Quality classifier: a factorisation machine over hashed words, structure and length.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise
sum of n active features is had in O(n k) as half of (sum v x)^2 - sum (v x)^2.

Features of a text: its distinct lower-cased words by hash, weighted by square roots
of their shares; fifteen structure statistics, each as a value and as one of eight
ranges; and the metadata column n_chars as a range of its own. Labels, lang,
source and doc_id are never features.

Fitting takes a bounded sample, SAMPLE labelled rows in the order of a hash of their
ids; every text is scored whole.

Defined results: null text counts as empty and is scored from structure alone; a null
n_chars is a range of its own; repeated rows get equal scores; with no labelled rows,
or labels of one kind only, the score is the share of good labels, smoothed by one of
each; no rows give no rows; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinledger.llm.common import free_names, held_out, table
from kinledger.llm.tokens import blocks
from kinledger.session import ship

#: Labelled rows that the fit takes at most.
SAMPLE = 6000
#: Buckets of the word hash, rank of the interactions.
BUCKETS, RANK = 1 << 13, 8
THRESHOLD = 0.3

_RANGES = 8
_MARKS = [b"!", b"|", b"#$%&*@^~", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"<>{}[]()/\\=_+"]
_N_STATS = 8 + len(_MARKS)
#: Columns: words, statistics as values, statistics in ranges, ranges of n_chars.
_AT_VALUE = BUCKETS
_AT_RANGE = _AT_VALUE + _N_STATS
_AT_CHARS = _AT_RANGE + _N_STATS * _RANGES
WIDTH = _AT_CHARS + 18

_KEEP = {m: bytes(sorted(set(range(256)) - set(m))) for m in _MARKS}


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Numbers in 0..1 that describe a text's form."""
    raw = text.encode("utf-8", "replace")
    n, m = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n")
    upper = sum(map(str.isupper, words)) / m
    out = [
        upper,
        len(counts) / m,
        sum(map(str.__eq__, words[1:], words)) / m,
        max(counts.values(), default=0) / m,
        min(1.0, sum(map(len, words)) / m / 20),
        min(1.0, len(lines) / m),
        len(set(lines)) / len(lines),
        min(1.0, math.log1p(len(words)) / 12),
    ]
    return out + [min(1.0, len(raw.translate(None, _KEEP[k])) / n) for k in _MARKS]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Active columns and their values."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    lower: dict[int, int] = {}
    for w, c in counts.items():
        k = zlib.crc32(w.lower().encode("utf-8", "replace")) % BUCKETS
        lower[k] = lower.get(k, 0) + c
    stats = np.array(statistics(text, words, counts))
    ranges = np.minimum((np.sqrt(stats) * _RANGES).astype(np.int64), _RANGES - 1)
    chars = 17 if n_chars is None else min(16, max(0, int(n_chars)).bit_length())
    idx = np.concatenate([
        np.fromiter(lower, np.int64, len(lower)),
        _AT_VALUE + np.arange(_N_STATS),
        _AT_RANGE + np.arange(_N_STATS) * _RANGES + ranges,
        [_AT_CHARS + chars],
    ])
    share = np.sqrt(np.fromiter(lower.values(), np.float64, len(lower)) / max(len(words), 1))
    return idx.astype(np.int32), np.concatenate([share, stats, np.ones(_N_STATS + 1)]).astype(np.float32)


class FactorisationMachine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def raw(self, idx: np.ndarray, val: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums before the sigmoid, in time linear in the active features; every row has some."""
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, begin)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx * vx, begin)).sum(1)
        return self.bias + np.add.reduceat(self.w[idx] * val, begin) + pairs, total, vx

    def score(self, idx: np.ndarray, val: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, begin)[0].astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = RANK, epochs: int | None = None, step: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the logistic loss in small batches, in an order that the seed fixes.

        Small samples are gone through more often: about 1200 steps, in 12 to 80 rounds.
        """
        epochs = epochs or min(80, max(12, -(-1200 * 64 // max(1, len(rows)))))
        good = sum(y for _, _, y in rows)
        bias = math.log((good + 1) / (len(rows) - good + 1))
        rng = np.random.default_rng(seed)
        w, v = np.zeros(WIDTH), rng.normal(0, 0.01, (WIDTH, rank))
        if good in (0, len(rows)):
            return cls(bias, w.astype(np.float32), np.zeros((WIDTH, rank), np.float32))
        model = cls(bias, w, v)
        gw, gv, gb = np.full(WIDTH, 1e-3), np.full((WIDTH, rank), 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                part = [rows[k] for k in order[at : at + 64]]
                idx = np.concatenate([p[0] for p in part])
                val = np.concatenate([p[1] for p in part]).astype(np.float64)
                size = np.array([len(p[0]) for p in part])
                begin = np.concatenate([[0], np.cumsum(size)[:-1]])
                out, total, vx = model.raw(idx, val, begin)
                err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - np.array([p[2] for p in part])) / len(part)
                e = np.repeat(err, size)
                cols, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, e * val, len(cols)) + decay * model.w[cols]
                each = (e * val)[:, None] * (np.repeat(total, size, 0) - vx)
                dv = np.stack([np.bincount(inv, each[:, k], len(cols)) for k in range(rank)], 1) + decay * model.v[cols]
                gw[cols] += dw**2
                gv[cols] += dv**2
                gb += err.sum() ** 2
                model.w[cols] -= step * dw / np.sqrt(gw[cols])
                model.v[cols] -= step * dv / np.sqrt(gv[cols])
                model.bias -= step * err.sum() / math.sqrt(gb)
        return cls(model.bias, model.w.astype(np.float32), model.v.astype(np.float32))


def _text_input(docs: DataFrame, *more: str) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n.alias("n_chars"), *more)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on labelled rows that aren't held out; of two labels of an id, the lower counts."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                ["doc_id", "quality", "idx", "val"],
            )

    # at most `sample` rows of two numbers are broadcast
    texts = _text_input(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", "quality")
    rows = texts.mapInArrow(run, "doc_id long, quality int, idx binary, val binary").orderBy(F.xxhash64("doc_id"), F.xxhash64("idx", "val")).limit(sample).collect()
    return FactorisationMachine.fit([(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32), int(r.quality > 0)) for r in rows])


def scored(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score and predicted under ``names``; every column of docs stays, unless it has one of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    with_n = "n_chars" in kept
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", `{names[0]}` double, `{names[1]}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                texts = piece.column("text").to_pylist()
                chars = piece.column("n_chars").to_pylist() if with_n else [None if t is None else len(t) for t in texts]
                rows = [features(t, n) for t, n in zip(texts, chars)]
                begin = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
                s = shared.value.score(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), begin)
                cols = [piece.column(c) for c in kept] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [*kept, *names])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(_text_input(docs), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; every other row stays, with all its columns."""
    ship(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    names = free_names(docs, "kl_score", "kl_predicted")
    return scored(docs, model, names=tuple(names)).filter(F.col(names[1]) == 1).select(*[f"`{c}`" for c in docs.columns])


QUERIES = {"op1_quality": op1_quality}
ORACLE: dict[str, str] = {}
