"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed byte n-grams (2 to 4 bytes, of
lower-cased text with all ASCII but letters as blanks). Each language has several
centroids, found by clustering its sample by cosine, and the nearest centroid of all
names the language. A text farther from it than nearly all of that language's
sample were is marked as rejected.

Document frequencies count every training row; centroids are clustered, each language's in a task of its own,
from a sample bounded by SAMPLE rows a language, in the order of a hash of their ids and texts. The driver
holds centroids only, CLUSTERS a language.

Cosines are sums of products of whole numbers (components on a grid of 2 ** -GRID), which are
exact in any order, so that equal texts get equal scores wherever they stand.

Defined results: null text, or text without any letter, is ``und`` with score 0 and
rejected; with no training rows every text is ``und``; ties go to the language first
in code-point order; repeated rows get equal results; training rows without an id count like
others; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinledger.llm.common import held_out, table
from kinledger.llm.tokens import blocks

#: Sampled rows per language, centroids per language, hash buckets.
SAMPLE, CLUSTERS, BUCKETS = 600, 4, 1 << 12
#: Bits of a component; twice as many, the sum of a vector's products, fit a double.
GRID = 24
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_TO_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(text: str) -> np.ndarray:
    """Counts of a text's n-grams by bucket."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_TO_BLANK), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    code = raw
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        code = code[:-1] * np.uint32(257) + raw[n - 1 :]
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 40503)
        out += np.bincount((mixed >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors on the grid."""
    x = np.log1p(counts) * idf
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return np.round(x * (1 << GRID))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / float(1 << 2 * GRID)


def clustered(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means, all on the grid; fewer rows than k: each row is one."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = [x[int(rng.integers(len(x)))]]
    while len(centres) < k:  # the row farthest from all centres so far
        centres.append(x[int(np.argmin((x @ np.stack(centres).T).max(1)))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = np.round(m / max(np.sqrt((m * m).sum()), 1e-9) * (1 << GRID))
    return c


class NearestCentroid:
    def __init__(self, idf: np.ndarray, names: list[str], owner: np.ndarray, centres: np.ndarray, floor: np.ndarray):
        """owner: each centroid's place in names; floor: each language's least cosine."""
        self.idf, self.names, self.owner, self.centres, self.floor = idf, names, owner, centres, floor

    @classmethod
    def of(cls, idf: np.ndarray, parts: list[tuple[str, np.ndarray, float]]) -> NearestCentroid:
        """From each language's name, centroids and floor."""
        parts = sorted(parts, key=lambda p: p[0])
        owner = [k for k, (_, c, _) in enumerate(parts) for _ in c]
        centres = np.concatenate([c for _, c, _ in parts]) if parts else np.zeros((0, BUCKETS))
        return cls(idf, [p[0] for p in parts], np.array(owner, np.int64), centres, np.array([p[2] for p in parts]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0..1, and whether the text is rejected, for each text."""
        known = [k for k, t in enumerate(texts) if t and self.names and _LETTER.search(t)]
        lang, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(known), 512):
            part = known[at : at + 512]
            near = _cosines(vectors(np.stack([term_counts(texts[k]) for k in part]), self.idf), self.centres)
            best = near.argmax(1)
            for k, b, s in zip(part, self.owner[best].tolist(), near[np.arange(len(part)), best].tolist()):
                lang[k], score[k], far[k] = self.names[b], min(1.0, max(0.0, s)), s < self.floor[b]
        return lang, score, far


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> NearestCentroid:
    u = F.xxhash64("doc_id", "text")
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", u.alias("u"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                total += term_counts(text.as_py()) > 0
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], total]))], ["bucket", "n"])

    got = {r.bucket: r.n for r in train.select("text").mapInArrow(frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n, df = int(got.get(-1, 0)), np.array([got.get(k, 0) for k in range(BUCKETS)], np.float64)
    idf = np.log((1 + n) / (1 + df)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            sparse = [[k.astype("<u2").tobytes() for k in at], [c[k].astype("<u4").tobytes() for c, k in zip(counts, at)]]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *(pa.array(s, pa.binary()) for s in sparse)], ["lang", "at", "n"])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "n"], kind="stable")
        counts = np.zeros((len(rows), BUCKETS))
        for row, at, c in zip(counts, rows["at"], rows["n"]):
            row[np.frombuffer(at, "<u2")] = np.frombuffer(c, "<u4")
        x = vectors(counts, idf)
        centres = clustered(x, clusters)
        floor = float(np.quantile(_cosines(x, centres).max(1), 0.01)) * 0.8
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "centres": [centres.astype("<i4").tobytes()], "floor": [floor]})

    # of a language with many rows, only those with a low hash are ranked: about four times the sample, whatever their number is
    chance = F.pmod("u", F.lit(1 << 40)) / float(1 << 40)
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"))
    low = train.select("lang", "u").join(F.broadcast(sizes), "lang").filter(chance * F.col("n") < 4.0 * sample + 100).select("lang", "u").distinct()
    ids = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).filter(F.col("rank") <= sample).select("lang", "u")
    chosen = train.join(F.broadcast(ids), ["lang", "u"], "left_semi").dropDuplicates(["lang", "u"])
    made = chosen.select("lang", "text").mapInArrow(count, "lang string, at binary, n binary").groupBy("lang").applyInPandas(cluster, "lang string, centres binary, floor double")
    return NearestCentroid.of(idf, [(r.lang, np.frombuffer(r.centres, "<i4").reshape(-1, BUCKETS).astype(np.float64), r.floor) for r in made.collect()])


def identified(docs: DataFrame, model: NearestCentroid) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text"):
                lang, score, far = shared.value.predict(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op6_language": op6_language}
ORACLE: dict[str, str] = {}
