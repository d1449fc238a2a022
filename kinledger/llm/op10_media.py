"""Media columns: payloads as WAV values, and spectral-peak pairs as their fingerprint.

A payload's bytes are the 8-bit samples of a one-channel WAV value. Values are
stored in a table's binary column; reading goes through the wave module. The samples'
differences (which lift high tones against slow changes) go through a short-time Fourier transform, frame by frame; the first frame's middle is the first sample. Frames whose strongest bin stands
out from both neighbours hold peaks, up to PEAKS bins that stand out from the bins beside them and
have PART of the strongest one's strength; and each peak is paired with the next ones, of its own frame and of later ones. A pair
is one number: frame << 32 | bin << 16 | later bin << 8 | frames between. A lone peak is its own partner, so
that every payload but a constant one has pairs.

Defined results: null text is like empty text, 64 zero bytes; equal texts have equal
values; a constant signal has no peaks; repeated rows stay; no rows give no rows; further
columns are not read. Frames are taken CHUNK at a time, so a long text's transform
needs bounded memory.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinledger.llm.common import scratch_path, table
from kinledger.llm.tokens import blocks

#: Samples a second, samples of a frame, samples between frames, frames at a time.
RATE, FRAME, HOP, CHUNK = 8000, 256, 128, 4096
#: Peaks of a frame at most, and their strength as a part of the strongest one's.
PEAKS, PART = 3, 0.25
#: Later peaks that a peak is paired with, and frames between them at most.
FAN, REACH = 3, 255
UNIT = 64

_SHAPE = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def landmarks(samples: bytes) -> np.ndarray:
    """Time-coded pairs of spectral peaks, ascending by frame."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(HOP + len(x) - FRAME) // HOP) + 1)
    x = np.diff(x.astype(np.float32), prepend=np.float32(x[0] if len(x) else 128))
    x = np.concatenate([np.zeros(HOP, np.float32), x, np.zeros((frames - 1) * HOP + FRAME - HOP - len(x), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, strength = np.empty((frames, PEAKS), np.int64), np.empty((frames, PEAKS), np.float32)
    for at in range(0, frames, CHUNK):
        part = view[at : at + CHUNK] * _SHAPE
        power = np.round(np.abs(np.fft.rfft(part, axis=1)[:, 2:-1]), 2)
        beside = np.pad(power, ((0, 0), (1, 1)))
        power[(power < beside[:, :-2]) | (power < beside[:, 2:])] = 0
        rows = np.arange(len(power))
        for k in range(PEAKS):
            top = power.argmax(1)
            bins[at : at + CHUNK, k], strength[at : at + CHUNK, k] = top + 2, power[rows, top]
            power[rows, top] = 0
    first = strength[:, 0]
    around = np.pad(first, 1)
    stands = (first > 0) & (first >= around[:-2]) & (first >= around[2:])
    frame, which = np.nonzero(stands[:, None] & (strength > 0) & (strength >= PART * first[:, None]))
    tone = bins[frame, which]
    order = np.lexsort((tone, frame))
    frame, tone = frame[order], tone[order]
    out = []
    for k in range(0 if len(frame) == 1 else 1, FAN + 1):
        a, b = slice(0, max(0, len(frame) - k)), slice(k, None)
        away = frame[b] - frame[a]
        out.append((frame[a] << 32 | tone[a] << 16 | tone[b] << 8 | away)[away <= REACH])
    return np.unique(np.concatenate(out)).astype(np.int64)


def stored(docs: DataFrame, path: str) -> DataFrame:
    """Writes doc_id, n_bytes and media (a WAV value) to ``path`` and returns that table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "text", 2 << 20):
                raw = [(t.as_py() or "").encode() for t in piece.column("text")]
                media = [to_wav(r.ljust(max(UNIT, -(-len(r) // UNIT) * UNIT), b"\0")) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def described(media: DataFrame) -> DataFrame:
    """What the stored values hold: digests, and landmarks as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks(batch, "media", 2 << 20):
                rows, marks = [], []
                for value in piece.column("media"):
                    value = value.as_py()
                    payload = from_wav(value)
                    m = landmarks(payload)
                    marks.append(m)
                    feature = f"{len(m)}:{hashlib.sha256(m.astype('<i8').tobytes()).hexdigest()}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(value), hashlib.sha256(value).hexdigest(), feature))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                ends = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(marks)))],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "landmarks"],
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<long>"
    return media.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(stored(table(spark, sf_dir, "documents"), scratch_path(spark, "media")))


QUERIES = {"op10_media": op10_media}
ORACLE: dict[str, str] = {}
