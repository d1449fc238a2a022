"""Harmonic packing of token pieces into sequences of a fixed capacity.

A piece of n tokens is of class k = capacity // n: exactly k pieces of that class
fit a sequence, whatever their lengths are. So packing is counting: every worker
numbers its own pieces by class, the counts of workers are summed up to where each
begins, and a piece's sequence is its number // k. No worker looks at another's
pieces, and only the last sequence of each class can have room for more pieces.

Documents longer than the capacity give full pieces first. A rest that would leave
much of its class's share empty is cut: its head fills the next smaller class's
share exactly, and what is left is treated alike, so little is padded. The last
sequences of all classes (about 2 x sqrt(capacity) at most) are joined first-fit.

Defined results: a null or empty text is its end id alone; repeated rows are packed
as rows of their own; no rows give no sequences; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinledger.llm.common import table, written
from kinledger.llm.tokens import blocks, tokenizer

CAPACITY = 2048


def cuts(n: int, capacity: int = CAPACITY, slack: int = 64, least: int = 32) -> list[int]:
    """Lengths of the pieces of n tokens: whole capacities, then shares of classes.

    A rest is cut while more than 1 / ``slack`` of its class's share would stay
    empty, but not into pieces under ``least`` unless the document itself is.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        share = capacity // (capacity // rest)
        head = capacity // (-(-capacity // rest))
        if (share - rest) * slack <= share or rest < 2 * least or head < least:
            out.append(rest)
            break
        out.append(head)
        rest -= head
    return out


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, remember: int = 900_000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, cls, part, nth (number within part and class).

    A Python worker keeps the ids of up to ``remember`` distinct words, which changes time and memory and no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, met = tokenizer(tokenizer_path, remember), TaskContext.get().partitionId(), Counter()
        plans: dict[int, list[int]] = {}
        for batch in batches:
            for piece in blocks(batch, "text"):
                ids, bounds = tok.ids(piece.column("text"))
                raw, end = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
                rows: list[tuple] = []
                for d, a, b in zip(piece.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    n, at = b - a + 1, 0
                    for length in plans.get(n) or plans.setdefault(n, cuts(n, capacity)):
                        stop = at + length
                        body = raw[4 * (a + at) : 4 * (a + min(stop, n - 1))]
                        k = capacity // length
                        rows.append((d, at, length, zlib.crc32(body + end if stop == n else body), n, k, met[k]))
                        met[k] += 1
                        at = stop
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(np.full(len(rows), part, np.int32))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "nth", "part"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, nth long, part int"
    )


def first_fit(last: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """The classes' last sequences (class, tokens) joined: class -> (number, offset there)."""
    room: list[int] = []
    out = {}
    for cls, n in sorted(last, key=lambda x: (-x[1], x[0])):
        k = next((i for i, used in enumerate(room) if used + n <= capacity), len(room))
        if k == len(room):
            room.append(0)
        out[cls] = (k, room[k])
        room[k] += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id, offset and padded (the sequence's length with padding) to a table of pieces.

    ``pieces`` must be a written table, so that part and nth are the same each time.
    """
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("cls", "part").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")), "counts")
    # at most about 2 x sqrt(capacity) classes
    classes = sorted((r.cls, r.n) for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect())
    base, at = {}, 0
    for k, n in classes:
        base[k] = (at, n // k)
        at += n // k
    starts = counts.select("cls", "part", (F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("nth")
    ranked = pieces.join(starts, ["cls", "part"]).withColumn("bin", F.floor(rank / F.col("cls")).cast("long")).withColumn("pos", (rank % F.col("cls")).cast("long"))
    bases = spark.createDataFrame([(k, b, full) for k, (b, full) in base.items()], "cls int, base long, full long")
    ranked = written(ranked.join(F.broadcast(bases), "cls").drop("before", "nth", "part"), "ranked")
    last = [(r.cls, r.tokens) for r in ranked.filter("bin = full").groupBy("cls").agg(F.sum("length").alias("tokens")).collect()]
    moved = spark.createDataFrame([(k, at + s, o) for k, (s, o) in first_fit(last, capacity).items()], "cls int, moved long, ahead long")
    joined = ranked.join(F.broadcast(moved), "cls", "left")
    is_last = F.col("bin") == F.col("full")
    placed = joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "pos",
        F.when(is_last, F.col("moved")).otherwise(F.col("base") + F.col("bin")).alias("sequence_id"),
        F.when(is_last, F.col("ahead")).otherwise(F.lit(0)).alias("ahead"),
    )
    by = Window.partitionBy("sequence_id")
    inside = by.orderBy("ahead", "cls", "pos")
    used = F.sum("length").over(by)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(inside) - F.col("length")).alias("offset"),
        F.when(used <= 1, F.lit(1)).otherwise(F.least(F.lit(capacity), F.pow(F.lit(2.0), F.ceil(F.log2(used.cast("double")))))).cast("long").alias("padded"),
    )


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, remember: int = 900_000) -> DataFrame:
    return pack(written(cut_documents(docs, tokenizer_path, end_id, capacity, remember), "pieces"), capacity)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_harmonic_packing": op4_harmonic_packing}
ORACLE: dict[str, str] = {}
