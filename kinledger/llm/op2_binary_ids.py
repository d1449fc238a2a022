"""Token-id output: concatenated ids in segments with Elias-Fano document boundaries.

A segment is one binary value of a Parquet container, so any store that Spark
writes to can hold it. Its layout (little endian):

    magic "KLEF1", id width in bytes (u8), then u64: nulls, n_docs, n_ids, first_id
    Elias-Fano block of the n_docs + 1 boundaries
    Elias-Fano block of the ascending document ids, less first_id
    the ids, n_ids x width bytes

    Elias-Fano block: u64 n, low-bit width, upper-bit bytes, samples; low bits
    packed; upper bits in unary; the position of every 64th one (u32 each)

``select(i)`` starts at the sample before the i-th one and counts ones, so an
offset is found from about 2 + log2(universe / n) bits a document, without a table
of 64-bit offsets.

Defined results: null or empty text is the end id alone; null doc_ids come first
and read back as null; repeated doc_ids and equal rows all stay, ordered by text
hash within an id (equal rows too are dealt to several parts where they are many); no rows give no segments; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinledger.llm.common import table, written
from kinledger.llm.tokens import blocks, tokenizer

#: Pieces that a worker remembers.
REMEMBER = 900_000

_MAGIC, _STEP = b"KLEF1", 64


class EliasFano:
    """A non-decreasing sequence of unsigned numbers in near-minimal space."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, last = len(v), int(v[-1]) if len(v) else 0
        width = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), at[::_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQ", self.n, self.width, len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, n_high, n_samples = struct.unpack_from("<QQQQ", raw, at)
        at += 32
        parts = []
        for kind, count in (("u1", (n * width + 7) // 8), ("u1", n_high), ("<u4", n_samples)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at

    def select(self, i: int) -> int:
        """The i-th value."""
        at, need = int(self.samples[i // _STEP]), i % _STEP
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while need >= word.bit_count():
            need -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(need):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.width
        span = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3].tobytes(), "little")
        return (place - i) << self.width | (span >> (first & 7)) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        return high | (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)


def pack_segment(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, width: int) -> bytes:
    """doc_ids ascending, nulls first; bounds: n_docs + 1 places in ids."""
    nulls = sum(d is None for d in doc_ids)
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    head = _MAGIC + struct.pack("<BQQQq", width, nulls, len(doc_ids), len(ids), first)
    away = np.array([d - first for d in known], np.uint64)
    return head + EliasFano.of(bounds).to_bytes() + EliasFano.of(away).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """Random access to one segment's bytes."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        if bytes(view[:5]) != _MAGIC:
            raise ValueError("not a segment")
        width, self.nulls, self.n_docs, n_ids, self.first = struct.unpack_from("<BQQQq", view, 5)
        self.bounds, at = EliasFano.read(view, 5 + 33)
        self.away, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.first + d for d in self.away.all().tolist()]

    def doc(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select alone."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, most: int = 1_000_000) -> DataFrame:
    """Table of segments: part, seq, before (ids of the part before it), n_docs, n_ids, body.

    Parts are ranges of doc_id in ascending order, and seq counts within a part;
    a segment closes when it has ``most`` ids or more.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq, before = tokenizer(tokenizer_path, REMEMBER), TaskContext.get().partitionId(), 0, 0
        width = 2 if max(tok.tok.get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            names = [d for h in held for d in h[0]]
            body = pack_segment(names, ids, np.concatenate([[0], np.cumsum(sizes)]), width)
            row = pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (len(names), pa.int64()), (len(ids), pa.int64()), (body, pa.binary()))],
                ["part", "seq", "before", "n_docs", "n_ids", "body"],
            )
            seq, before = seq + 1, before + len(ids)
            held.clear()
            return row

        for batch in batches:
            for piece in blocks(batch, "text"):
                ids, bounds = tok.ids(piece.column("text"))
                sizes = np.diff(bounds) + 1
                ends = np.cumsum(sizes) - 1
                full = np.full(int(sizes.sum()), end_id, np.uint32)
                own = np.ones(len(full), bool)
                own[ends] = False
                full[own] = ids
                held.append((piece.column("doc_id").to_pylist(), full, sizes))
                if sum(len(h[1]) for h in held) >= most:
                    yield close()
        if held:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(encode, "part int, seq int, before long, n_docs long, n_ids long, body binary")


def part_starts(segments: DataFrame) -> DataFrame:
    """Ids before each part: one row per part, of which there are as many as shuffle partitions."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_index(segments: DataFrame) -> DataFrame:
    """One row per document from the stored bytes: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, raw in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("body")):
                seg = Segment(raw.as_buffer())
                bounds = seg.bounds.all().astype(np.int64)
                wide = memoryview(seg.ids.astype("<u4").tobytes())
                at = (bounds * 4).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:])]
                n = seg.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(seg.doc_ids(), pa.int64()), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "before", "body").mapInArrow(decode, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(part_starts(segments)), "part").select("doc_id", (F.col("within") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = write_segments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_index(written(made, "segments"))


QUERIES = {"op2_token_ids": op2_token_ids}
ORACLE: dict[str, str] = {}
